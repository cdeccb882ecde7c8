"""A training corpus from ``documents``: toxic documents go, one of each group of near-duplicates stays, documents that
hold benchmark passages go, scarce domains are repeated to meet their weights, and the rest is dealt into shards.

Every stage takes any columns beside doc_id and text, whatever their names, and hands all of them on; it takes null texts
(as empty ones), null ids, empty tables, and repeated rows and ids. What it does with them stands in each docstring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import decontaminate, mixing, neardup, sharding, toxicity
from timberline.llm.common import materialise, read

#: Toxic documents are gone by then; what still looks toxic isn't repeated.
WEIGHTS = {"good": 0.85, "poor": 0.15, "toxic": 0.0}

#: No SQL: the stages train models, fit rates and join by hashes.
ORACLE_SQL = None


def _boxed(docs: DataFrame) -> DataFrame:
    """The row in one column, so that its columns can't clash with those a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Each row is judged by its text alone, so repeated rows share their fate; null, empty and wordless texts stay.
    Without a label, or with labels of one kind, that kind is everyone's (all stay, or all go)."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold=None)
    return toxicity.score_toxicity(_boxed(docs), model, keep=["_doc"]).where("predicted = 0").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of the least id, a null id last; of repeated rows one stays. Null, empty and wordless texts are no one's duplicates, but repeats of such a row under its own id go."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark passage; null and empty texts stay, repeated rows share their fate. An empty benchmark hits nothing."""
    return decontaminate.decontaminate(_boxed(docs), read(spark, sf_dir, "benchmark"), keep=["_doc"]).where("not contaminated").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of scarce domains more than once, none over ``mixing.MOST_REPEATS`` times. Rows of one id and text are repeated alike; a null text is one token."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"), WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows included, with size, text_crc32, shard and slot; columns of these names give way. Ties in size don't matter: rows are ordered by hashes of text and id."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
