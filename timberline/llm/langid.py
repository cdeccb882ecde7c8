"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams (2 to 4, hashed into buckets; whatever isn't a letter counts as a
space). Embeddings and softmax are trained together by stochastic gradient descent in numpy, on the driver, over a bounded
sample of labelled texts and random stretches of them. For prediction both are multiplied once, so a text costs one lookup
for each n-gram. Probabilities are tempered on a part of the sample kept apart; the same part sets the score below which
a prediction isn't accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import LOWER, annotate, crc_of_id, mix, read, slices

BUCKETS, DIM, GRAMS = 1 << 15, 12, (2, 3, 4)
#: Labelled texts of each language that may be used in training, and the characters used of each; of a longer one, those
#: from a place that its hash tells.
SAMPLE_ROWS, SAMPLE_CHARS = 800, 1 << 16
EPOCHS, BATCH, STEP = 6, 64, 4.0
UNKNOWN = "und"

FOLD = LOWER.copy()
FOLD[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram of bytes at each place."""
    m = max(len(data) - n + 1, 0)
    code = np.zeros(m, np.uint64)
    for k in range(n):
        code = (code << np.uint64(8)) | data[k : k + m].astype(np.uint64)
    return (mix(code + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def totals(data: np.ndarray, rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each text's n-grams, and their number."""
    data = FOLD[data]
    out, count = np.zeros((len(rows) - 1, table.shape[1])), np.zeros(len(rows) - 1)
    for n in GRAMS:
        sums = np.zeros((max(len(data) - n + 1, 0) + 1, table.shape[1]))
        np.cumsum(table[gram_buckets(data, n)], axis=0, out=sums[1:])
        first, last = np.minimum(rows[:-1], len(sums) - 1), np.clip(rows[1:] - n + 1, 0, len(sums) - 1)
        last = np.maximum(first, last)
        out += sums[last] - sums[first]
        count += last - first
    return out, count


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def scores(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        sums, count = totals(data, rows, self.table)
        return softmax((sums / np.maximum(count, 1)[:, None] + self.bias) / self.heat)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sparse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their shares."""
    out = []
    for text in texts:
        data = FOLD[np.frombuffer(text, np.uint8)] if text else np.zeros(0, np.uint8)
        seen, n = np.unique(np.concatenate([gram_buckets(data, g) for g in GRAMS]), return_counts=True)
        out.append((seen, (n / max(n.sum(), 1)).astype(np.float32)))
    return out


def train(texts: list[str], langs: list[str], seed: int = 1) -> Model:
    """Fit on whole texts and on two random stretches of each; a fifth of the texts is kept apart for calibration."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, max(len(names), 1))), np.zeros(max(len(names), 1)))
    rng = np.random.default_rng(seed)
    apart = rng.random(len(texts)) < 0.2 if len(texts) >= 20 else np.zeros(len(texts), bool)
    raw, target = [], []
    for k in np.flatnonzero(~apart):
        words = texts[k].split()
        raw.append(texts[k].encode())
        target.append(y[k])
        for size in rng.integers(1, 12, 2):
            at = rng.integers(0, max(len(words) - size, 0) + 1)
            raw.append(" ".join(words[at : at + size]).encode())
            target.append(y[k])
    rows, goal = _sparse(raw), np.array(target)
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W, b = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    steps, done = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            ids, share = np.concatenate([rows[k][0] for k in own]), np.concatenate([rows[k][1] for k in own])
            whose = np.repeat(np.arange(len(own)), [len(rows[k][0]) for k in own])
            H = np.zeros((len(own), DIM), np.float32)
            np.add.at(H, whose, E[ids] * share[:, None])
            d = softmax(H @ W + b)
            d[np.arange(len(own)), goal[own]] -= 1
            d = d.astype(np.float32)
            rate = STEP * (1 - done / steps)
            np.add.at(E, ids, (-rate) * (d @ W.T)[whose] * share[:, None])
            W -= rate * (H.T @ d) / len(own)
            b -= rate * d.mean(0)
            done += 1
    model = Model(names, (E @ W).astype(np.float64), b.astype(np.float64))
    if apart.any():
        held = [t for k in np.flatnonzero(apart) for t in (texts[k].encode(), " ".join(texts[k].split()[:4]).encode())]
        truth = np.repeat(y[apart], 2)
        data, cut = np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
        loss = {}
        for heat in np.geomspace(0.1, 4, 25):
            model.heat = float(heat)
            loss[model.heat] = -np.log(model.scores(data, cut)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.heat = min(loss, key=loss.get)
        p = model.scores(data, cut)
        best, right = p.max(1), p.argmax(1) == truth
        order = np.argsort(-best)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99
        model.least = float(best[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def fit(docs: DataFrame, id: str, text: str, lang: str, fold: int, of: int, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``sample_rows`` texts of each language outside the fold (those of the least hashes of their ids).

    A count for each language tells how small a hash may be: so few rows pass that ranking them takes no large group."""
    known = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.pmod(crc_of_id(F.col(id)), F.lit(of)) != fold))
    hashed = known.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(id, lang).alias("h"))
    room = F.lit(1.5 * sample_rows + 50) / F.count("*")  # of uniform hashes far more than sample_rows pass
    bounds = hashed.groupBy("lang").agg(F.when(room >= 1, F.lit(2.0**63)).otherwise((room * 2 - 1) * 2.0**63).alias("most"))
    near = hashed.join(bounds, "lang").where(F.col("h").cast("double") <= F.col("most")).drop("most")
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")))
    chosen = ranked.where(F.col("k") <= sample_rows).select("id", "lang").distinct()
    place = 1 + F.pmod(F.xxhash64(id), F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1)).cast("long")).cast("int")
    rows = known.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.substring(text, place, F.lit(SAMPLE_CHARS)).alias("text")).join(F.broadcast(chosen), ["id", "lang"])  # at most sample_rows a language
    got = rows.groupBy("id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "id").toArrow()
    return train(got.column("text").to_pylist(), got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row with lang_pred, score (probability of it, 0 to 1) and accepted (score at or above the calibrated bound).

    A text that is null or has no letter is ``und`` with score 0 and isn't accepted; so is every text if no language was
    learned. Columns of ``docs`` stay (or those in ``keep``), but give way to an added one of the same name."""

    def step(column: pa.Array) -> list[pa.Array]:
        best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
        if model.langs:
            for at, to, data, rows in slices(column):
                p = model.scores(data, rows)
                best[at:to], score[at:to] = p.argmax(1), p.max(1)
        names = pa.array([*model.langs, UNKNOWN])
        return [names.take(pa.array(best)), pa.array(score)]

    held = docs.select("*", (F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.langs))).alias("__letter"))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score", "accepted")]
    named = annotate(held, text, step, "lang_pred string, score double", [*kept, "__letter"])
    score = F.when(F.col("__letter"), F.col("score")).otherwise(0.0)
    return named.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col("__letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"), (F.col("__letter") & (score >= model.least)).alias("accepted"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, "doc_id", "text", "lang", 2, 4)
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
