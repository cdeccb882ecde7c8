"""Queries of the corpus operators: name to function of (spark, sf_dir)."""

from __future__ import annotations

from timberline.llm.decontaminate import op6
from timberline.llm.langid import op10
from timberline.llm.metricjoin import op3
from timberline.llm.mixing import op7
from timberline.llm.neardup import op9
from timberline.llm.oracles import DECONTAMINATION, METRIC_JOIN, NEAR_DUPLICATES, REPEATS, SHARD_LAW, URL_RULES
from timberline.llm.sharding import op1, shard_law
from timberline.llm.suffixdedup import op8
from timberline.llm.tokens import op4
from timberline.llm.toxicity import op2
from timberline.llm.urls import op5, url_rules

QUERIES = {
    "op1_histogram_sort_shards": op1,
    "op2_toxic_spans": op2,
    "op3_metric_range_join": op3,
    "op4_token_counts": op4,
    "op5_url_filter": op5,
    "op6_winnowing_decontamination": op6,
    "op7_soft_membership_mixing": op7,
    "op8_suffix_array_dedup": op8,
    "op9_minhash_near_duplicates": op9,
    "op10_language_id": op10,
    "url_rules": url_rules,
    "shard_law": shard_law,
}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op3_metric_range_join": METRIC_JOIN,
    "op6_winnowing_decontamination": DECONTAMINATION,
    "op8_suffix_array_dedup": REPEATS,
    "op9_minhash_near_duplicates": NEAR_DUPLICATES,
    "url_rules": URL_RULES,
    "shard_law": SHARD_LAW,
}
