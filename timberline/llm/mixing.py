"""Mixing to target weights with soft membership, in DataFrame expressions only.

Domains are what the labels table tells apart: ``good``, ``poor`` (quality 0) and ``toxic``. A classifier gives every
document a posterior over them: words, hashed to 65,536 buckets, get the smoothed shares of each domain among labelled
documents that hold them; a document is described by the mean and the greatest share of its words, and normal densities
of these, fitted on other labelled documents, give the posterior. Rates r >= 0 then minimise

    (A - T)' W (A - T) / total**2  +  ridge * sum_i t_i (r_i - 1)**2 / total,   A_d = sum_i r_i t_i p_id,

exactly. W is the inverse of the Gram matrix of the posteriors. The best rates are r_i = 1 + u'p_i between bounds, with one
number u_d a domain, so Newton's method on u (the convex dual, with step halving) finds them: a pass is one aggregate over
a narrow table, with ten sums as its result, and the passes end at the optimum only.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import bit_map, mark, materialise, read

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.70, "poor": 0.20, "toxic": 0.10}
#: Labelled documents (of the least hashes) that the classifier is fitted on; half of them for each of its two steps.
SAMPLE_ROWS = 20_000
BUCKETS, SMOOTHING = 1 << 16, 4.0
CLOSE, RIDGE = 1e-3, 1e-4
#: How often a document may be repeated at most when all are kept.
MOST_REPEATS = 4.0
#: Share of distinct words, of characters that are neither letters, digits nor spaces, and of capital letters.
SHAPE = ("distinct", "signs", "capitals")
#: Optimality that ends the fit (share of the total), and the passes after which it raises.
EXACT, MOST_PASSES = 1e-5, 200
WORDS = r"[\s.,;:!?|#$%&*()\[\]\"]+"


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """A bounded sample of labelled ids: id, domain number, part (0 or 1). An id labelled twice takes the larger labels."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).where("toxic is not null or quality is not null")
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("id"), domain.alias("domain"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("part"))


def posteriors(docs: DataFrame, labels: DataFrame, id: str, text: str, sample_rows: int) -> DataFrame:
    """row, id, name (hash of the text), tokens (words, at least 1), p (posterior over DOMAINS) of every row of ``docs``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(F.lower(body), WORDS), lambda w: w != "")
    share = lambda pattern: F.regexp_count(body, F.lit(pattern)) / F.greatest(F.length(body), F.lit(1))
    shape = [share(r"[^\p{L}\p{N}\s]").alias("signs"), share(r"\p{Lu}").alias("capitals")]
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").alias("id"), F.xxhash64(f"`{text}`").alias("name"), words.alias("words"), *shape)
    sample = materialise(_sample(labels, sample_rows))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    D = range(len(DOMAINS))
    labelled = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias(text)).join(F.broadcast(sample.where("part = 0")), "id")  # at most sample_rows rows
    seen = labelled.select("domain", F.explode(F.array_distinct(words)).alias("word"))
    counts = seen.groupBy(bucket.alias("bucket")).agg(*[F.sum((F.col("domain") == d).cast("double")).alias(f"n{d}") for d in D])
    counts = materialise(counts)
    total = counts.agg(*[F.coalesce(F.sum(f"n{d}"), F.lit(0.0)) for d in D]).first()
    prior = [(x + 1) / (sum(total) + len(DOMAINS)) for x in total]
    shares = counts.select("bucket", *[((F.col(f"n{d}") + SMOOTHING * prior[d]) / (sum(F.col(f"n{e}") for e in D) + SMOOTHING)).alias(f"s{d}") for d in D])
    # one row of words a document: partial sums in each task leave one row a document to shuffle
    each = split.select("row", "id", "name", "signs", "capitals", F.size("words").alias("tokens"), F.explode_outer(F.array_distinct("words")).alias("word")).withColumn("bucket", bucket)
    held = each.join(F.broadcast(shares), "bucket", "left")  # at most 65,536 rows
    aggregates = [f(F.coalesce(f"s{d}", F.lit(prior[d]))).alias(f"{n}{d}") for d in D for n, f in (("mean", F.avg), ("top", F.max))]
    kept = [F.first(c).alias(c) for c in ("id", "name", "tokens", "signs", "capitals")]
    distinct = (F.count("word") / F.greatest(F.first("tokens"), F.lit(1))).alias("distinct")
    described = materialise(held.groupBy("row").agg(*kept, distinct, *aggregates))
    features = [*[f"{n}{d}" for d in D for n in ("mean", "top")], *SHAPE]
    fitted = described.join(F.broadcast(sample.where("part = 1")), "id").groupBy("domain").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("v", F.var_pop))]).collect()
    by = {r["domain"]: r for r in fitted}
    n = sum(r["n"] for r in fitted)
    logs: list[Column] = []
    for d in D:
        if d not in by:
            logs.append(F.lit(-50.0))
            continue
        density = F.lit(0.0)
        for c in features:
            m, v = by[d][f"m_{c}"], by[d][f"v_{c}"] + 1e-4
            density = density - (F.col(c) - m) * (F.col(c) - m) / (2 * v) - F.log(F.lit(v)) / 2
        logs.append(density / 2 + F.log(F.lit((by[d]["n"] + 1) / (n + len(DOMAINS)))))  # halved: the features repeat each other
    most = F.greatest(*logs)
    weights = [F.exp(x - most) for x in logs]
    return described.select("row", "id", "name", F.greatest("tokens", F.lit(1)).cast("long").alias("tokens"), F.array(*[w / reduce(lambda a, b: a + b, weights) for w in weights]).alias("p"))


def fit_rates(members: DataFrame, weights: dict[str, float], keep_all: bool = False, most: float | None = None) -> tuple[Column, dict]:
    """The rate of a row as an expression of its ``p``, and what it reached.

    Targets share out the corpus's own total, or with ``keep_all`` the least total at which no domain has to shrink.
    With ``keep_all`` no rate is below 1; none is above ``most``. The passes end at the optimum; ``met`` tells whether all totals are then within
    CLOSE of the targets (some targets no rates can meet)."""
    D = range(len(DOMAINS))
    pairs = [(d, e) for d in D for e in D if e >= d]
    p = [F.col("p")[d] for d in D]
    tokens = F.col("tokens").cast("double")
    least, top = 1.0 if keep_all else 0.0, 1e9 if most is None else float(most)

    def bounded(rate: Column) -> Column:
        return F.least(F.lit(top), F.greatest(F.lit(least), rate))

    def look(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """One pass: totals by domain, the Gram matrix of the rows above the least rate, and the sum of the rates' integrals."""
        s = reduce(lambda a, b: a + b, [p[d] * F.lit(float(at[d])) for d in D])
        free = (s >= least - 1) & (s <= top - 1)
        part = F.when(free, s + s * s / 2).when(s < least - 1, F.lit(least) * s - (least - 1) ** 2 / 2).otherwise(F.lit(top) * s - (top - 1) ** 2 / 2)
        weighed = bounded(1 + s) * tokens
        sums = [*[weighed * p[d] for d in D], *[F.when(free, tokens * p[d] * p[e]).otherwise(0.0) for d, e in pairs], tokens * part]
        got = list(members.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{k}") for k, x in enumerate(sums)]).first())
        square = np.zeros((len(D), len(D)))
        for (d, e), x in zip(pairs, got[len(D) : -1], strict=True):
            square[d, e] = square[e, d] = x
        return np.array(got[: len(D)]), square, got[-1]

    at = np.zeros(len(D))
    now, gram, inner = look(at)
    total = float(now.sum()) or 1.0
    spread = RIDGE * (gram / total + 1e-6 * np.eye(len(D)))
    aim = np.array([weights[d] / sum(weights.values()) for d in DOMAINS])
    scale = max([now[d] / total / aim[d] for d in D if aim[d] > 0], default=1.0) if keep_all else 1.0
    goal = aim * scale
    value = lambda at, inner: float(at @ spread @ at / 2 + inner / total - goal @ at)
    slope, height, passes = spread @ at + now / total - goal, value(at, inner), 1
    while np.abs(slope).max() > EXACT * scale:
        step, share = -np.linalg.solve(spread + gram / total, slope), 1.0
        while True:
            if passes == MOST_PASSES:
                raise RuntimeError(f"fit_rates did not reach its optimum in {MOST_PASSES} passes: {np.abs(slope).max():.2e} of the total is left")
            to = at + share * step
            now, square, inner = look(to)
            passes += 1
            found, lower = spread @ to + now / total - goal, value(to, inner)
            if np.abs(found).max() <= EXACT * scale or lower <= height + 1e-4 * share * float(slope @ step) + 1e-12 * abs(height):
                break
            share /= 2
        at, gram, slope, height = to, square, found, lower
    rate = bounded(1 + reduce(lambda a, b: a + b, [p[d] * F.lit(float(at[d])) for d in D]))
    met = bool(np.abs(now / total - goal).max() < CLOSE * scale)
    return rate, {"rounds": passes, "met": met, "totals": dict(zip(DOMAINS, now.tolist(), strict=True)), "targets": dict(zip(DOMAINS, (goal * total).tolist(), strict=True))}


def _fit(members: DataFrame, weights: dict[str, float], keep_all: bool, most: float | None = None) -> Column:
    """The rate; targets that no rates can meet are warned of."""
    rate, report = fit_rates(members, weights, keep_all, most)
    if not report["met"] and any(report["totals"].values()):
        warnings.warn(f"mixing: the targets are out of reach: {report['targets']}; the nearest totals are {report['totals']}", stacklevel=3)
    return rate


def mix_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, tokens (words), p_good, p_poor, p_toxic, rate.

    A null or empty text counts as one token without words and gets the posterior of such. Rows repeated under one id
    are rows of their own. Without labels every posterior is equal and the rates share out the total evenly."""
    members = materialise(posteriors(docs, labels, id, text, sample_rows))
    rate = _fit(members, weights, False)
    return members.select(F.col("id").alias(id), "tokens", *[F.col("p")[d].alias(f"p_{name}") for d, name in enumerate(DOMAINS)], rate.alias("rate"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, id: str = "doc_id", text: str = "text", keep_all: bool = True, most: float | None = MOST_REPEATS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says: its whole part, and one more if a hash of id and text falls below the rest.

    With ``keep_all`` every row stays at least once, and only rows of scarce domains repeat, none over ``most`` times;
    targets that this rules out are met as nearly as can be, and a warning says so. Rows that stay as they are
    aren't shuffled."""
    members = materialise(posteriors(docs, labels, id, text, sample_rows))
    rate = _fit(members, weights, keep_all, most)
    chance = F.shiftrightunsigned(F.xxhash64("id", "name", F.lit(9)), 11) / float(1 << 53)
    times = members.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.floor(rate + chance).cast("int").alias("_times")).where("_times <> 1").distinct()
    other = materialise(times)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id}`").alias("_own"), F.xxhash64(f"`{text}`").alias("_text"))
    marked = mark(named, bit_map(other, "_id", "_name"), "_own", "_text")
    counted = marked.where("_marked").join(other, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_name")), "left")
    repeated = counted.select("_doc", F.explode(F.array_repeat(F.lit(0), F.coalesce("_times", F.lit(1)))))
    return marked.where("not _marked").select("_doc").unionByName(repeated.select("_doc")).select("_doc.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return mix_rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
