"""Each corpus operator against a brute-force version, and on odd rows: nulls, empty and long texts, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import decontaminate, langid, metricjoin, mixing, neardup, sharding, suffixdedup, suffixsort, tokens, toxicity, urls
from timberline.llm.common import byte_class, components, slices, word_hashes

LOWER = {k: k + 32 for k in range(65, 91)}


def low(text):
    return (text or "").translate(LOWER)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# shared helpers


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n.é\x00", max_size=12)), max_size=8), st.integers(1, 40))
def test_word_hashes_follow_the_regex(rows, limit):
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    names: dict[int, str] = {}
    for at, to, data, cut in slices(pa.array(rows, pa.string()), limit):
        hashes, starts, ends, first = word_hashes(data, cut, byte_class([0x20, *range(0x09, 0x0E)]))
        for r in range(to - at):
            want = pattern.findall(low(rows[at + r]))
            own = range(first[r], first[r + 1])
            assert [bytes(data[starts[k] : ends[k]]).decode().translate(LOWER) for k in own] == want
            for k, w in zip(own, want, strict=True):
                assert names.setdefault(int(hashes[k]), w) == w


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 9), (7, 8), (20, 21), (21, 22), (22, 23), (23, 24), (24, 19)] + [(100, 100 + k) for k in range(1, 60)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 7, 8: 7} | dict.fromkeys(range(19, 25), 19) | dict.fromkeys(range(100, 160), 100)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 sharding


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_slots_gapless(docs, shards):
    rows = sharding.shard(docs, shards, per_shard=4).collect()
    assert len(rows) == docs.count() and "spans" in sharding.shard(docs, 2).columns
    sizes = Counter()
    for r in rows:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        sizes[r.shard] += r.size
    for s in range(shards):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 2 * largest


def test_shards_split_one_huge_group(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard(rows, 8, per_shard=2).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 8 and max(r.s for r in got) / min(r.s for r in got) < 1.03 and all(r.m == r.n - 1 for r in got)


def test_repeated_rows_are_dealt_too(spark):
    rows = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard(rows, 4, per_shard=2).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 4 and max(r.n for r in got) - min(r.n for r in got) < 20 and all(r.m == r.n - 1 for r in got)


# 2 toxicity


def labelled(spark, n=260):
    rng = np.random.default_rng(3)
    clean = ["bara", "ketu", "lozen", "mira", "tuly", "zendor", "kera", "lotu"]
    rows, labels = [], []
    for k in range(n):
        words = list(rng.choice(clean, rng.integers(5, 60)))
        toxic = k % 5 == 0
        if toxic:
            for at in rng.integers(0, len(words), 3):
                words[at] = rng.choice(["vileness", "gruk", "gruks", "viler"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_marginals_match_the_sum_over_all_taggings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        emission, moves, start = rng.normal(size=n), rng.normal(size=(2, 2)), 0.3
        total = np.zeros((n, 2))
        for tags in np.ndindex(*[2] * n):
            w = sum(emission[k] for k in range(n) if tags[k]) + (start if tags[0] else 0) + sum(moves[tags[k], tags[k + 1]] for k in range(n - 1))
            for k in range(n):
                total[k, tags[k]] += math.exp(w)
        odds = toxicity.marginal_odds(emission, np.arange(n) == 0, start, moves)
        np.testing.assert_allclose(odds, np.log(total[:, 1] / total[:, 0]), rtol=1e-9)


def test_expected_moves_match_the_sum_over_all_taggings():
    rng = np.random.default_rng(4)
    emission, moves, start, length = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), 0.3, np.array([5, 3, 1])
    want = np.zeros((2, 2))
    for row, n in enumerate(length):
        weight, seen = [], []
        for tags in itertools.product((0, 1), repeat=int(n)):
            total = start * tags[0] + sum(emission[row, k] * t for k, t in enumerate(tags)) + sum(moves[a, b] for a, b in itertools.pairwise(tags))
            own = np.zeros((2, 2))
            for a, b in itertools.pairwise(tags):
                own[a, b] += 1
            weight.append(np.exp(total))
            seen.append(own)
        want += sum(w * o for w, o in zip(weight, seen, strict=True)) / sum(weight)
    np.testing.assert_allclose(toxicity._pairs(emission, length, start, moves), want, atol=1e-9)


def test_many_chains_are_as_good_as_each_alone():
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=k) * 3 for k in (1, 200, 63, 64, 65, 1)]
    moves = rng.normal(size=(2, 2))
    alone = [toxicity.marginal_odds(p, np.arange(len(p)) == 0, -0.5, moves) for p in parts]
    begins = np.concatenate([np.arange(len(p)) == 0 for p in parts])
    np.testing.assert_allclose(toxicity.marginal_odds(np.concatenate(parts), begins, -0.5, moves), np.concatenate(alone), rtol=1e-7, atol=1e-7)


def test_toxicity_held_out_accuracy_and_spans(spark, docs):
    rows, labels = labelled(spark)
    model = toxicity.fit(rows, labels)
    got = toxicity.score_toxicity(rows, model).join(labels, "doc_id").where(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0).collect()
    assert len(got) > 30 and all(r.predicted == r.toxic for r in got)
    for r in got:
        bad = [r.text.encode()[a:b].decode() for a, b in r.spans]
        assert all(re.fullmatch(r"((vile|gruk)\w* ?)+", b) for b in bad) and bool(bad) == bool(r.toxic)
    odd = toxicity.score_toxicity(docs, model)
    assert odd.count() == docs.count() and odd.schema["spans"].dataType.simpleString() == "array<array<bigint>>"
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd.collect())


def test_toxicity_without_labels(spark, no_docs):
    rows, labels = labelled(spark, 10)
    for model in (toxicity.fit(rows, labels.limit(0)), toxicity.fit(no_docs, labels), toxicity.fit(rows, labels.where("toxic = 0"))):
        assert all(r.predicted == 0 for r in toxicity.score_toxicity(rows, model).collect())
    assert toxicity.score_toxicity(no_docs, toxicity.Field()).count() == 0


# 3 metric join


@pytest.mark.parametrize("sizes", [(4096, 4096), (20, 7)])
def test_vector_links_match_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    rows = [v for v in base] + [base[k % 5] + rng.normal(size=8) * s for k in range(90) for s in (0.05, 0.3)] + [base[0] * 2, base[0], base[0]]
    table = [(k, v.tolist()) for k, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [math.nan]), (903, [1.0] * 7 + [math.inf]), (904, [1.0] * 7 + [None]), (905, []), (906, [0.0] * 8)]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>").withColumn("m", F.lit(1)).repartition(3)
    X = np.array(rows)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    near = X @ X.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(X))
    for _ in range(len(X)):
        label = np.array([min(label[i], label[near[i]].min(initial=10**6)) for i in range(len(X))])
    got = {r.vec_id: r for r in metricjoin.near_vectors(df, cell_rows=sizes[0], block_rows=sizes[1]).collect()}
    assert [got[k].n_links for k in range(len(X))] == near.sum(1).tolist()
    assert [got[k].component_id for k in range(len(X))] == label.tolist()
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k, _ in odd)
    assert metricjoin.near_vectors(df.limit(0)).count() == 0


# 4 token counts


def test_token_counts_are_the_librarys(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs).collect()}
    for k, t in enumerate(texts):
        n = len(made.encode(t or "", add_special_tokens=False).ids)
        assert (k, len((t or "").encode()), n, n > 512) in got
    assert tokens.count_tokens(docs).count() == docs.count()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 1.\n\té'’　<|endoftext>", max_size=80), st.integers(1, 10))
def test_safe_cuts_keep_the_count(text, limit):
    made = tokens._tokenizer(tokens.TOKENIZER)
    parts = list(tokens.pieces(text, limit))
    assert "".join(parts) == text
    assert sum(len(made.encode(p, add_special_tokens=False).ids) for p in parts) == len(made.encode(text, add_special_tokens=False).ids)


# 5 urls


def test_url_rules(spark):
    rows = ["http://Example.org/es/x", "https://a.example.org/en/12?q#f", "ftp://b.org/", "http://x.com/fr/1", "http://com/de/", "http://notexample.org/es/", "http://x.net/en", "no scheme", None, "http://x.org", "://org/?a", "http://org:80/", "http://a.com/fr?x=/fr/"]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("score", F.lit(9))).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(rows))] == [
        ("example.org", "/es/x", "example.org/es/"), ("a.example.org", "/en/12", "example.org/en/1"), ("b.org", "/", "org/"), ("x.com", "/fr/1", "com/fr/"), ("com", "/de/", "com/de/"), ("notexample.org", "/es/", "org/"),
        ("x.net", "/en", None), ("", "", None), ("", "", None), ("x.org", "", None), ("org", "/", "org/"), ("org:80", "/", None), ("a.com", "/fr", None),
    ]
    assert [got[k].verdict for k in range(6)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert all(got[k].verdict in ("allow", "block") for k in got)
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_trees_learn_a_lexical_rule(spark):
    rows = [(k, f"http://{'buy-now-' if k % 3 == 0 else ''}s{k % 17}.{'net' if k % 2 else 'org'}/{'x' * (k % 5)}{k * 7919 % 9999 if k % 3 == 0 else ''}") for k in range(600)]
    rules = [("org", "/", "allow")] + [(f"buy-now-s{j}.org", "/", "block") for j in range(17)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert len(got) == 300
    assert np.mean([(r.verdict == "block") == (r.page_id % 3 == 0) for r in got]) > 0.95


def test_native_plans_run_no_python(spark, sf):
    for q in (urls.filter_urls(spark.read.parquet(f"{sf}/pages.parquet")), mixing.mix_rates(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))):
        plan = q._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# 6 decontamination


def contaminated(docs, items, n=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = pattern.findall(low(text))
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[a : a + k]), set()).add(name)
    out = []
    for i, text in docs:
        w, hit, found = pattern.findall(low(text)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_decontamination_matches_brute_force(spark, docs, texts, limit):
    items = [(1, texts[0]), (2, texts[-20]), (3, "one"), (4, "One, two three"), (5, None), (6, ""), (7, " ".join((texts[60] or "").split()[3:15])), (7, "é ü"), (None, texts[2]), (3, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("extra", F.lit(1))
    got = decontaminate.decontaminate(docs, bench, broadcast_bytes=limit)
    assert got.columns[-5:] == ["n_words", "n_hit", "items", "spans", "contaminated"] and "source" in got.columns
    rows = got.collect()
    want = contaminated(pairs_of(docs), [("" if i is None else str(i), t) for i, t in items])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in rows), key=repr) == want
    assert all(r.contaminated == (r.n_hit > 0) and sum(b - a for a, b in r.spans) == r.n_hit for r in rows)
    assert sum(r.contaminated for r in rows) > 3
    none = decontaminate.decontaminate(docs, bench.limit(0), broadcast_bytes=limit)
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()
    assert decontaminate.decontaminate(docs.limit(0), bench, broadcast_bytes=limit).count() == 0


# 7 mixing


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(1, 50)), rng.dirichlet(np.array([6.0, 1.0, 0.5]) if k % 2 else np.array([1.0, 5.0, 2.0])).tolist()) for k in range(500)]
    members = spark.createDataFrame(rows, "id long, tokens long, p array<double>")
    rate, report = mixing.fit_rates(members, {"good": 0.5, "poor": 0.3, "toxic": 0.2})
    total = sum(r[1] for r in rows)
    for d, share in zip(mixing.DOMAINS, (0.5, 0.3, 0.2), strict=True):
        assert abs(report["totals"][d] / total - share) < 0.01
    got = members.select(rate.alias("r"), "tokens", "p").collect()
    assert min(r.r for r in got) >= 0
    assert abs(sum(r.r * r.tokens * r.p[0] for r in got) / total - 0.5) < 0.01
    rate, report = mixing.fit_rates(members, {"good": 0.5, "poor": 0.3, "toxic": 0.2}, keep_all=True)
    assert members.select(F.min(rate)).first()[0] >= 1
    rate, report = mixing.fit_rates(members, {"good": 0.05, "poor": 0.05, "toxic": 0.9}, keep_all=True, most=3.0)
    low, high = members.select(F.min(rate), F.max(rate)).first()
    assert low >= 1 and high == 3 and not report["met"]


def test_rates_reach_the_optimum_of_soft_posteriors(spark):
    """20 rounds of projected gradient end with poor documents at 0.244 of the total for a target of 0.2."""
    rng = np.random.default_rng(3)
    kind = rng.choice(3, 4000, p=[0.30, 0.68, 0.02])
    p = np.array([rng.dirichlet(np.array([[6.0, 3.0, 0.3], [3.0, 7.0, 0.3], [1.5, 2.0, 3.0]])[k]) for k in kind])
    t = rng.integers(1, 400, len(kind))
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "tokens long, p array<double>").cache()
    rate, report = mixing.fit_rates(members, mixing.WEIGHTS)
    assert report["met"]
    for d in mixing.DOMAINS:
        assert abs(report["totals"][d] / t.sum() - mixing.WEIGHTS[d]) < mixing.CLOSE
    # the conditions of the optimum, for targets that no rates can meet: r = max(1, r - gradient)
    weights = {"good": 0.85, "poor": 0.15, "toxic": 0.0}
    rate, report = mixing.fit_rates(members, weights, keep_all=True)
    assert not report["met"]
    got = members.select("tokens", "p", rate.alias("r")).collect()
    t, p, r = np.array([x.tokens for x in got]), np.array([x.p for x in got]), np.array([x.r for x in got])
    W = np.linalg.inv((p * t[:, None]).T @ p / t.sum() + 1e-6 * np.eye(3))
    off = (r * t) @ p / t.sum() - np.array([report["targets"][d] for d in mixing.DOMAINS]) / t.sum()
    gradient = p @ W @ off + mixing.RIDGE * (r - 1)
    assert r.min() >= 1 and np.abs(r - np.maximum(1, r - gradient)).max() < 1e-3
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "MOST_PASSES", 2)
        with pytest.raises(RuntimeError):
            mixing.fit_rates(members, weights, keep_all=True)


def test_mixing_keeps_every_document(spark, docs, no_docs):
    rows, labels = labelled(spark)
    got = mixing.mix_rates(rows, labels).collect()
    assert len(got) == 260 and all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in got)
    by = {r.doc_id: r.p_toxic for r in got}
    assert np.mean([by[k] for k in range(0, 260, 5)]) > np.mean([by[k] for k in range(260) if k % 5]) + 0.5
    mixed = mixing.mix(docs, labels, {"good": 0.6, "poor": 0.4, "toxic": 0.0})
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r.text) for r in mixed.collect()} == set(pairs_of(docs))
    assert mixing.mix_rates(no_docs, labels).count() == 0 and mixing.mix(no_docs, labels).count() == 0
    assert mixing.mix_rates(docs, labels.limit(0)).count() == docs.count()


def test_posteriors_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    unseen = labels.where("doc_id % 4 = 0")
    p = mixing.posteriors(docs, labels.where("doc_id % 4 <> 0"), "doc_id", "text", 20_000)
    truth = unseen.where("toxic = 0").join(p, F.col("doc_id") == F.col("id")).select("quality", (F.col("p")[1] >= 0.5).cast("int").alias("poor"))
    got = truth.groupBy("quality").agg(F.avg("poor").alias("share")).collect()
    by = {r.quality: r.share for r in got}
    print(by)
    assert by[0] > 0.75 and by[1] < 0.1, by


# names that operators use themselves, and odd tables


def odd_names(spark, rows):
    names = ["_w", "_k0", "_crc", "_row", "__row", "id", "domain", "row", "words", "part", "y", "name", "_doc"]
    return spark.createDataFrame([(k, t, *range(len(names))) for k, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))


@pytest.fixture(scope="module")
def odd(spark):
    text = "lo ra mi zen ke tu ba dor lo mi ra tu"
    return odd_names(spark, [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, "alone here"), (5, "one"), (6, "x " * 3000)])


def test_columns_may_have_any_name(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "ra mi zen ke tu ba dor lo mi ra")], "item_id long, text string")
    want = sorted(map(repr, odd.collect()))
    for got in (sharding.shard(odd, 3), mixing.mix(odd, labels, keep_all=True), *(decontaminate.decontaminate(odd, bench, broadcast_bytes=limit) for limit in (1 << 20, 0))):
        assert got.columns[: len(odd.columns)] == odd.columns
        assert {repr(r) for r in got.select(*[f"`{c}`" for c in odd.columns]).collect()} == set(want)
    assert mixing.mix_rates(odd, labels).count() == odd.count()
    assert langid.fit(odd.withColumn("lang", F.lit("xx")), "doc_id", "text", "lang", 9, 10).langs == ["xx"]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert sharding.shard(none).columns == [*odd.columns, "size", "text_crc32", "shard", "slot"] and sharding.shard(none).count() == 0
    assert tokens.count_tokens(none).count() == 0
    assert suffixdedup.remove_repeats(none).count() == 0


def test_very_long_and_odd_urls(spark):
    rows = [(1, "http://a.org/" + "x" * 200_000), (2, "://"), (3, "http://"), (4, "http://EXAMPLE.org?://b.com/de/"), (5, None), (5, None), (None, "https://é.com/fr/ü#?")]
    got = {(r.page_id, r.host, r.path[:4], r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {(1, "a.org", "/xxx", "org/", "allow"), (None, "é.com", "/fr/", "com/fr/", "allow")} <= got and len(got) == 6
    assert {x[1] for x in got if x[0] in (2, 3, 5)} == {""}


# 8 suffix-array dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(values):
    text = np.array(values, np.int64)
    assert suffixdedup.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda k: values[k:])


def removed(docs, length):
    starts = Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, t in raw:
        starts.update(t[k : k + length] for k in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if starts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "length"), [(600_000, 400), (600_000, 60), (900, 60), (1, 400)])
def test_repeats_match_brute_force(docs, monkeypatch, hot, length):
    monkeypatch.setattr(suffixdedup, "HOT_BYTES", hot)
    got = suffixdedup.remove_repeats(docs, length=length).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == removed(pairs_of(docs), length)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize(("letters", "length"), [(1, 7), (3, 30)])
def test_spread_suffix_sort_matches_brute_force(spark, letters, length):
    rng = np.random.default_rng(letters)
    strings = [rng.integers(1, letters + 1, n).tolist() for n in rng.integers(0, 60, 25)]
    strings += [strings[3], strings[4] + [9], [7] * 40]
    rows = spark.createDataFrame(list(enumerate(strings)), "t long, s array<long>").repartition(3)
    seen = Counter(tuple(s[k : k + length]) for s in strings for k in range(len(s) - length + 1))
    want = {(t, k) for t, s in enumerate(strings) for k in range(len(s) - length + 1) if seen[tuple(s[k : k + length])] > 1}
    got = [(r.t, r.o) for r in suffixsort.repeated_places(rows, length).collect()]
    assert len(got) == len(want) and set(got) == want
    ranked = sorted((r.r[k], strings[r.t][k : k + length]) for r in suffixsort.suffix_ranks(rows, length).collect() for k in range(len(strings[r.t])))
    assert [x for _, x in ranked] == sorted(x for _, x in ranked)


def test_crowded_buckets_are_sorted_together(docs, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT_BYTES", 1)
    monkeypatch.setattr(suffixdedup, "STEPS", ())
    got = suffixdedup.remove_repeats(docs, length=60).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == removed(pairs_of(docs), 60)


def test_repeats_of_nothing(no_docs):
    assert suffixdedup.remove_repeats(no_docs).count() == 0


# 9 near-duplicates


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(docs):
    ids = sorted(i for i, _ in docs if i is not None)
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_match_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = near(pairs_of(docs))
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert not r.kept and r.component_id == want[4][1]


def test_one_of_each_component_stays(docs, no_docs):
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = near(pairs_of(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert neardup.drop_near_duplicates(no_docs).count() == 0 and neardup.near_duplicates(no_docs).count() == 0


def test_signature_distance_under_the_bound_is_always_found(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
    rows = []
    for k in range(60):
        b = a.copy()
        b[rng.choice(neardup.SYMBOLS, 15, replace=False)] ^= np.uint16(k + 1)
        rows.append((k, b.tobytes()))
    got = neardup._keys(spark.createDataFrame([(-1, a.tobytes()), *rows], "c long, sig binary"))
    own = {(r.place, r.key) for r in got.where("c = -1").collect()}
    assert {r.c for r in got.where("c >= 0").collect() if (r.place, r.key) in own} == set(range(60))


# 10 language identification


def test_language_held_out_accuracy(spark, sf):
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = langid.fit(rows, "doc_id", "text", "lang", 2, 4, sample_rows=120)
    got = langid.identify(rows, model).where(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_of_odd_texts(spark, docs, no_docs):
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")), "doc_id", "text", "lang", 2, 4)
    assert model.langs == ["en"]
    got = {(r.doc_id, r.text): r for r in langid.identify(docs, model).collect()}
    for (_, text), r in got.items():
        letter = any(c.isalpha() for c in text or "")
        assert r.lang_pred == ("en" if letter else "und") and 0 <= r.score <= 1 and (letter or r.score == 0)
    assert langid.identify(no_docs, model).count() == 0
    empty = langid.fit(no_docs, "doc_id", "text", "lang", 2, 4)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


# the pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in docs.collect()}
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {(r.doc_id, r.text) for r in at.collect()}
        at = corpus_pipeline.materialise(stage(spark, at, sf))
        assert at.columns == docs.columns
        after = {(r.doc_id, r.text) for r in at.collect()}
        assert after <= before and (k < 3 or after == before)
        if k == 1:
            want = near(sorted(before))
            assert {i for i, _ in after} == {i for i, (_, c) in want.items() if i == c}
        if k == 2:
            hit = contaminated(sorted(before), [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
            assert {i for i, _ in after} == {i for i, _, n, _ in hit if not n}
        if k == 0:
            gone = ids - {i for i, _ in after}
            assert sum(labels.get(i) == 0 for i in gone) == 0
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert last.count() == at.count()


def test_pipeline_of_odd_rows(spark, odd, sf):
    import corpus_pipeline

    at, seen = odd, {r.doc_id for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialise(stage(spark, at, sf))
        assert at.columns == odd.columns, name
    left = [(r.doc_id, r.text) for r in at.collect()]
    assert {i for i, _ in left} == seen - {2}  # 2 is a copy of 1
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert last.count() == len(left) and last.columns == [*odd.columns, "size", "text_crc32", "shard", "slot"]


def test_pipeline_of_nothing(spark, odd, sf):
    import corpus_pipeline

    at = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialise(stage(spark, at, sf))
        assert at.count() == 0


def test_sql_checks_run(spark, sf):
    import oracle

    from timberline.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        assert oracle.differences(QUERIES[name](spark, sf), sql, sf) == [], name
