"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

All of it is DataFrame expressions. Trees are grown from histograms: one aggregate a level gives the gradients of every
(node, feature, bin), at most 2**depth * features * bins rows, from which the driver takes the best splits, halfway
between the bins that a node has. The finished
model is a sum of CASE expressions, so scoring is one projection over the scan (and one join for the suffix statistics).
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import materialise, read

#: Host with subdomains, start of the path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Labelled rows that the trees are fitted on (those of the least hashes); suffix statistics come from all of them.
SAMPLE_ROWS = 20_000
BINS, TREES, DEPTH, RATE, RIDGE = 12, 12, 2, 0.4, 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a later one is longer and goes first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Lexical features of ``url``, ``host`` and ``path``: x0, x1, ... as doubles, and the host's suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.array_distinct(F.split(F.lower(url), ""))
    share = lambda c: (F.length(url) - F.length(F.replace(F.lower(url), c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    features = [
        F.length(url), F.length("host"), F.length("path"), F.regexp_count("path", F.lit("/")), F.regexp_count(url, F.lit("[0-9]")) / n, entropy, F.when(query != "", F.regexp_count(query, F.lit("&")) + 1).otherwise(0),
        F.regexp_count("host", F.lit(r"\.")), F.regexp_count("host", F.lit("-")), F.length(F.regexp_extract("path", r"^/([^/]*)", 1)), F.length(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.contains(url, F.lit("#")).cast("int"), url.startswith("https").cast("int"),
    ]
    return df.select("*", *[f.cast("double").alias(f"x{k}") for k, f in enumerate(features)], F.element_at(F.split("host", r"\."), -1).alias("suffix"), F.regexp_extract("path", r"^/([^/]*)", 1).alias("opening"))


def _with_statistics(rows: DataFrame, key: str, at: int, base: float) -> DataFrame:
    """Add the share of blocked rows, drawn towards the share ``base`` of all, and how common the value is, among the labelled rows of the same ``key``.

    A labelled row takes them from the other half of the labelled rows (``part``), so its own label is never in them."""
    halves = [F.col("part") == 0, F.col("part") == 1]
    known = rows.where("y is not null").groupBy(key).agg(*[f for k, h in enumerate(halves) for f in (F.sum(F.when(h, F.col("y")).otherwise(0)).alias(f"_s{k}"), F.sum(h.cast("int")).alias(f"_n{k}"))])
    pick = lambda c: F.coalesce(F.when(F.col("y").isNull(), F.col(f"{c}0") + F.col(f"{c}1")).when(halves[0], F.col(f"{c}1")).otherwise(F.col(f"{c}0")), F.lit(0))
    wide = rows.join(known, key, "left")
    return wide.withColumns({f"x{at}": (pick("_s") + 2 * base) / (pick("_n") + 2), f"x{at + 1}": F.log2(pick("_n") + F.lit(0.5))}).drop("_s0", "_n0", "_s1", "_n1")


def _bins(cuts: list[list[float]]) -> list[Column]:
    return [reduce(lambda a, c: a + (F.col(f"x{k}") > c).cast("int"), own, F.lit(0)).alias(f"b{k}") for k, own in enumerate(cuts)]  # noqa: B023


def fit(sample: DataFrame, features: int) -> tuple[list[list[float]], Column]:
    """Bin edges, and the log-odds of y = 1 as an expression of the bins, from the columns x0, x1, ... and y."""
    edges = sample.select(*[F.percentile_approx(f"x{k}", [j / BINS for j in range(1, BINS)], 10_000).alias(f"x{k}") for k in range(features)]).first()
    values = [sorted(set(edges[k] or [])) for k in range(features)]
    cuts = [[(a + b) / 2 for a, b in zip(own[:-1], own[1:], strict=True)] + own[-1:] for own in values]  # between the values that occur
    rows = materialise(sample.select(*_bins(cuts), "y").groupBy(*[f"b{k}" for k in range(features)], "y").agg(F.count("*").alias("w")))
    total, ones = rows.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("w") * F.col("y")), F.lit(0))).first()
    base = math.log((ones + 1) / (total - ones + 1))
    score = F.lit(base)
    if not 0 < ones < total:
        return cuts, score
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-score))
        held = rows.select("*", ((F.col("y") - p) * F.col("w")).alias("g"), (p * (1 - p) * F.col("w")).alias("h"))
        tree: dict[int, tuple[int, int]] = {}
        leaf: dict[int, float] = {1: 0.0}
        for _level in range(DEPTH):
            node = _walk(tree, {k: F.lit(k) for k in leaf})
            wide = held.select(node.alias("node"), "g", "h", F.posexplode(F.array(*[f"b{k}" for k in range(features)])).alias("feature", "bin"))
            sums: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
            for r in wide.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault((r["node"], r["feature"]), {})[r["bin"]] = (r["g"], r["h"])
            best: dict[int, tuple[float, int, int, float, float]] = {}
            for (k, feature), own in sorted(sums.items()):
                G, H = sum(x[0] for x in own.values()), sum(x[1] for x in own.values())
                g = h = 0.0
                there = sorted(own)
                for b, after in zip(there[:-1], there[1:], strict=True):
                    g, h = g + own[b][0], h + own[b][1]
                    gain = g * g / (h + RIDGE) + (G - g) ** 2 / (H - h + RIDGE) - G * G / (H + RIDGE)
                    if gain > max(1e-6, best.get(k, (0.0,))[0] + 1e-9):
                        best[k] = (gain, feature, (b + after) // 2, RATE * g / (h + RIDGE), RATE * (G - g) / (H - h + RIDGE))
            for k, (_, feature, b, left, right) in best.items():
                tree[k] = (feature, b)
                leaf.pop(k)
                leaf |= {2 * k: left, 2 * k + 1: right}
            if not best:
                break
        score = score + _walk(tree, {k: F.lit(v) for k, v in leaf.items()})
    return cuts, score


def _walk(tree: dict[int, tuple[int, int]], leaves: dict[int, Column], k: int = 1) -> Column:
    if k not in tree:
        return leaves[k]
    feature, b = tree[k]
    return F.when(F.col(f"b{feature}") <= b, _walk(tree, leaves, 2 * k)).otherwise(_walk(tree, leaves, 2 * k + 1))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id: str = "page_id", url: str = "url", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, score (of ``block``, by the trees).

    Rows that a rule fits are the labelled ones; the others get ``block`` where their score is 0.5 or more. A null url, or
    one without ``://``, has an empty host and path. If all labels agree, or there are none, the score is their smoothed
    share. Repeated rows and ids stay; other columns are not read."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    y = (F.col("by_rule") == "block").cast("int")
    rows = materialise(lexical(judged.select("*", rule.alias("rule"), verdict.alias("by_rule"))).withColumns({"y": y, "part": F.pmod(F.xxhash64("id", "url", F.lit(3)), F.lit(2))}))
    first = sum(c.startswith("x") for c in rows.columns)
    base = rows.agg(F.coalesce(F.avg("y"), F.lit(0.5))).first()[0]
    for key in ("suffix", "opening"):
        rows = _with_statistics(rows, key, first, base)
        first += 2
    rows = materialise(rows)
    sample = rows.where("y is not null").orderBy(F.xxhash64("id", "url"), "id", "url").limit(sample_rows)
    cuts, score = fit(sample, first)
    scored = rows.select("id", "host", "path", "rule", "by_rule", *_bins(cuts)).withColumn("score", 1 / (1 + F.exp(-score)))
    return scored.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def url_rules(spark, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, the part of ``op5`` that SQL can check."""
    host, path = host_and_path(F.col("url"))
    parts = read(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))
