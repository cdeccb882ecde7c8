"""Toxic spans by a linear-chain conditional random field.

The field tags each word as toxic or not. Its features are the word, its first 3 to 7 and last 3 and 4 bytes, and its
neighbours, hashed into one table of weights. Labels exist for documents only, so the words to learn from are labelled
first: a word of a toxic document counts as toxic if the word or one of its beginnings is used in toxic documents far more
often than chance would have it, and words of clean documents count as clean. Training is stochastic gradient descent on
the exact likelihood. A document's score is a logistic function of its marginals from the forward-backward pass, fitted on
training documents that the field hasn't seen; the words with a marginal of 0.5 or more are the offending spans.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import LOWER, annotate, crc_of_id, materialise, mix, odd_numbers, read, slices, small_batches, word_hashes
from timberline.llm.decontaminate import WORD

#: Labelled documents used in training (of either class those of the least hashes of their ids, toxic ones up to half), and
#: the characters used of each; of a longer one, those from a place that its hash tells.
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 1 << 16
#: Uses of a word in one document that count, and the share of toxic documents among all uses from which it may be toxic.
USES, TOXIC_SHARE = 8, 0.75
BUCKETS, COUNTERS = 1 << 18, 1 << 22
HEADS, TAILS = (3, 4, 5, 6, 7), (3, 4)
WINDOW, MOST_WINDOWS, EPOCHS, BATCH = 24, 24_000, 3, 256
CHUNK = 64
SALTS = odd_numbers(8, 51)


def word_features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit features of each word (own ones first, then those of its neighbours), its first and last byte, and each row's first word."""
    words, starts, ends, first = word_hashes(data, rows, WORD)
    low, size = LOWER[data], ends - starts
    columns = [words]
    for step, kinds, base in ((1, HEADS, 1), (-1, TAILS, 2)):
        code = np.full(len(words), base, np.uint64)
        for k in range(max(kinds)):
            at = np.clip(starts + k if step == 1 else ends - 1 - k, 0, max(len(low) - 1, 0))
            with np.errstate(over="ignore"):
                code = np.where(size > k, code * np.uint64(0x100000001B3) + low[at].astype(np.uint64) + np.uint64(1), code)
            if k + 1 in kinds:
                columns.append(mix(code ^ SALTS[k]))
    head = np.zeros(len(words), bool)
    head[first[:-1][first[:-1] < len(words)]] = True
    before, after = np.zeros_like(words), np.zeros_like(words)
    before[1:] = np.where(head[1:], np.uint64(0), words[:-1])
    after[:-1] = np.where(head[1:], np.uint64(0), words[1:])
    columns += [mix(before + np.uint64(101)), mix(after + np.uint64(102))]
    return np.stack(columns, 1) if len(words) else np.zeros((0, 1 + len(HEADS) + len(TAILS) + 2), np.uint64), starts, ends, first


OWN = 1 + len(HEADS)  # features that may label a word


@dataclass
class Field:
    """Weights of the toxic state against the other one; moves[i, j] is the weight of going from state i to j."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = -4.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: tuple[float, ...] = (1.0, 0.5, 0.0, 0.0)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[(features & np.uint64(BUCKETS - 1)).astype(np.int64)].sum(1, dtype=np.float64) + self.bias, -25, 25)


def marginal_odds(emission: np.ndarray, begins: np.ndarray, start: float, moves: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic state for each word of many chains, laid end to end.

    With two states the forward odds follow r' = e (m01 + m11 r) / (m00 + m10 r), a fractional-linear map. The maps are
    composed within chunks for all chunks at once, the chunks are passed one after the other, and the chunks are then
    filled in: exact, in a number of numpy steps that doesn't depend on the lengths of the texts. Backward likewise."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    e, m = np.exp(emission), np.exp(moves)

    def run(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        pad = -n % CHUNK
        A, B, C, D = (np.concatenate((x, np.full(pad, y))).reshape(-1, CHUNK) for x, y in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
        p, q, r, s = (np.full(len(A), x) for x in (1.0, 0.0, 0.0, 1.0))
        for k in range(CHUNK):
            p, q, r, s = A[:, k] * p + B[:, k] * r, A[:, k] * q + B[:, k] * s, C[:, k] * p + D[:, k] * r, C[:, k] * q + D[:, k] * s
            scale = np.maximum(np.maximum(np.maximum(p, q), np.maximum(r, s)), 1e-300)
            p, q, r, s = p / scale, q / scale, r / scale, s / scale
        odds, x = np.empty(len(A)), 1.0
        for k, (u, v, w, z) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
            odds[k] = x
            x = min(max((u * x + v) / max(w * x + z, 1e-300), 1e-30), 1e30)
        out, x = np.empty_like(A), odds
        for k in range(CHUNK):
            x = np.clip((A[:, k] * x + B[:, k]) / np.maximum(C[:, k] * x + D[:, k], 1e-300), 1e-30, 1e30)
            out[:, k] = x
        return out.reshape(-1)[:n]

    ones = np.ones(n)
    forward = run(np.where(begins, 0.0, e * m[1, 1]), np.where(begins, e * np.exp(start), e * m[0, 1]), np.where(begins, 0.0, m[1, 0]), np.where(begins, 1.0, m[0, 0]))
    last = np.append(begins[1:], True)  # behind a chain's last word the backward odds are even
    follow = np.append(e[1:], 1.0)
    a, b, c, d = (np.where(last, x, y) for x, y in ((0.0, m[1, 1] * follow), (1.0, m[1, 0] * ones), (0.0, m[0, 1] * follow), (1.0, m[0, 0] * ones)))
    backward = run(a[::-1], b[::-1], c[::-1], d[::-1])[::-1]
    return np.log(forward) + np.log(backward)


def document_features(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Greatest log-odds, and the logs of the expected number of toxic words and of their share, for each document."""
    out = np.tile(np.array([-12.0, np.log(1e-3), np.log(1e-4)]), (len(first) - 1, 1))
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    if len(full):
        cut = first[:-1][full]
        out[full, 0] = np.clip(np.maximum.reduceat(odds, cut), -12, 12)
        out[full, 1] = np.log(np.add.reduceat(1 / (1 + np.exp(-odds)), cut) + 1e-3)
        out[full, 2] = out[full, 1] - np.log(sizes[full] + 10)
    return out


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _parts(texts: list[str], size: int = 64):
    for at in range(0, len(texts), size):
        yield at, word_features(*_bytes(texts[at : at + size]))


def _word_labels(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Which counters stand for toxic words: seen in so many toxic documents that chance can't explain it, and used there nearly always."""
    uses, toxic_uses, in_toxic = (np.zeros(COUNTERS, np.int32) for _ in range(3))
    for at, (features, _, _, first) in _parts(texts):
        ids = (features[:, :OWN] & np.uint64(COUNTERS - 1)).astype(np.int64)
        for k in range(len(first) - 1):
            own, n = np.unique(ids[first[k] : first[k + 1]], return_counts=True)
            n = np.minimum(n, USES)
            uses[own] += n
            if toxic[at + k]:
                toxic_uses[own] += n
                in_toxic[own] += 1
    share = max(toxic.mean(), 1e-4)
    seen = max(int((uses > 0).sum()), 2)
    return (in_toxic >= max(3, np.log(seen) / -np.log(min(share, 0.9)))) & (toxic_uses >= TOXIC_SHARE * uses)


def train(texts: list[str], labels: list[int], seed: int = 1) -> Field:
    """Label words, fit the field on windows of words, then the documents' score on the fifth of the documents kept apart."""
    made, toxic = Field(), np.array(labels, bool)
    if not toxic.any() or toxic.all():
        made.doc = (0.0, 0.0, 0.0, 8.0 if len(toxic) and toxic.all() else -8.0)
        return made
    rng = np.random.default_rng(seed)
    apart = rng.random(len(texts)) < 0.2 if toxic.sum() >= 10 else np.zeros(len(texts), bool)
    seen = np.flatnonzero(~apart)
    lexicon = _word_labels([texts[k] for k in seen], toxic[seen])
    windows, marks = [], []
    quota = {True: MOST_WINDOWS, False: MOST_WINDOWS}
    for at, (features, _, _, first) in _parts([texts[k] for k in seen]):
        named = lexicon[(features[:, :OWN] & np.uint64(COUNTERS - 1)).astype(np.int64)].any(1)
        for k in range(len(first) - 1):
            a, b = first[k], first[k + 1]
            kind = bool(toxic[seen[at + k]])
            if b == a:
                continue
            if kind:
                middle = a + np.flatnonzero(named[a:b])
                if len(middle) > 8:
                    middle = rng.choice(middle, 8, replace=False)
            else:
                middle = a + rng.integers(0, b - a, 3)
            for c in middle[: max(quota[kind], 0)]:
                quota[kind] -= 1
                lo = max(a, min(c - int(rng.integers(0, WINDOW)), b - WINDOW))
                own = (features[lo : min(lo + WINDOW, b)] & np.uint64(BUCKETS - 1)).astype(np.int32)
                tags = named[lo : min(lo + WINDOW, b)] if kind else np.zeros(len(own), bool)
                windows.append(np.pad(own, ((0, WINDOW - len(own)), (0, 0)), constant_values=-1))
                marks.append(np.pad(tags, (0, WINDOW - len(tags))))
    if windows:
        _descend(made, np.stack(windows), np.stack(marks), rng)
    judge = apart if apart.any() and toxic[apart].any() and not toxic[apart].all() else np.ones(len(texts), bool)
    own = [texts[k] for k in np.flatnonzero(judge)]
    x = np.concatenate([document_features(_odds(made, f, first), first) for _, (f, _, _, first) in _parts(own)])
    made.doc = _logistic(x, toxic[judge].astype(float))
    return made


def _odds(model: Field, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    begins = np.zeros(len(features), bool)
    begins[first[:-1][first[:-1] < len(features)]] = True
    return marginal_odds(model.emissions(features), begins, model.start, model.moves)


def _descend(model: Field, windows: np.ndarray, marks: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad on the negative log-likelihood of the tags, with a penalty on large weights."""
    w, past = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-2)
    small, small_past = np.array([model.bias, 0.0, 0.0, 0.0, 0.0, 0.0]), np.full(6, 1e-2)  # bias, start, four moves
    for _ in range(EPOCHS):
        for at in range(0, len(order := rng.permutation(len(windows))), BATCH):
            ids, tags = windows[order[at : at + BATCH]], marks[order[at : at + BATCH]].astype(int)
            real = ids[:, :, 0] >= 0
            length = real.sum(1)
            begins = np.zeros(real.shape, bool)
            begins[:, 0] = True
            emission = np.clip(w[ids].sum(2) + small[0], -25, 25)
            chain, moves = emission[real], small[2:].reshape(2, 2)
            odds = np.full(real.shape, -50.0)
            odds[real] = marginal_odds(chain, begins[real], small[1], moves)
            p = 1 / (1 + np.exp(-odds))
            error = np.where(real, p - tags, 0.0)
            both = real[:, 1:]
            joint = _pairs(emission, length, small[1], moves)
            seen = np.zeros((2, 2))
            np.add.at(seen, (tags[:, :-1][both], tags[:, 1:][both]), 1)
            grad = np.concatenate(([error.sum(), error[:, 0].sum()], (joint - seen).ravel())) / len(ids) + 1e-3 * small
            small_past += grad * grad
            small = small - 0.1 * grad / np.sqrt(small_past)
            flat = np.bincount(ids.ravel(), np.repeat(error.ravel(), ids.shape[2]), BUCKETS) if (ids >= 0).all() else np.bincount(ids[ids >= 0], np.repeat(error.ravel(), ids.shape[2])[(ids >= 0).ravel()], BUCKETS)
            touched = np.flatnonzero(flat)
            g = flat[touched] / len(ids) + 1e-6 * w[touched]
            past[touched] += g * g
            w[touched] -= 0.3 * g / np.sqrt(past[touched])
    model.weights, model.bias, model.start, model.moves = w[:BUCKETS].astype(np.float32), float(small[0]), float(small[1]), small[2:].reshape(2, 2)


def _pairs(emission: np.ndarray, length: np.ndarray, start: float, moves: np.ndarray) -> np.ndarray:
    """Expected number of each move in a batch of padded chains."""
    B, T = emission.shape
    e, m = np.stack((np.ones((B, T)), np.exp(emission)), 2), np.exp(moves)
    alpha, beta = np.zeros((B, T, 2)), np.ones((B, T, 2))
    alpha[:, 0] = e[:, 0] * np.array([1.0, np.exp(start)])
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, T):
        alpha[:, t] = (alpha[:, t - 1] @ m) * e[:, t]
        alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
    for t in range(T - 2, -1, -1):
        nxt = (e[:, t + 1] * beta[:, t + 1]) @ m.T
        beta[:, t] = np.where((t + 1 < length)[:, None], nxt / nxt.sum(1, keepdims=True), 1.0)
    joint = alpha[:, :-1, :, None] * m * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return joint[np.arange(1, T)[None, :] < length[:, None]].sum(0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a small ridge."""
    X, w = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        H = (X * (p * (1 - p))[:, None]).T @ X + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(H, X.T @ (y - p) - 0.05 * w)
    return tuple(w.tolist())


def _train_in_a_task(sample: DataFrame) -> Field:
    """``train`` on the rows (text, label) of a bounded sample, in one task of an executor; only the model comes to the driver."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            labels += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels))], pa.binary())], ["model"])

    made = sample.coalesce(1).mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(made[0]["model"]) if made else train([], [])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fold: int | None = 0, of: int = 5, sample_rows: int = SAMPLE_ROWS) -> Field:
    """Train on at most ``sample_rows`` labelled documents outside the fold; an id labelled twice is toxic if one label says so.

    Toxic ones may be up to half of them; the score is then corrected for their true share."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    if fold is not None:
        known = known.where(F.pmod(crc_of_id(F.col(id)), F.lit(of)) != fold)
    each = materialise(known.groupBy(F.col(id).alias("id")).agg(F.max(label).alias("y")))
    there = {bool(r["y"]): r["n"] for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    clean, bad = there.get(False, 0), there.get(True, 0)
    quota = min(bad, max(sample_rows // 2, sample_rows - clean))
    parts = [each.where(F.col("y").cast("boolean") == kind).orderBy(F.xxhash64("id"), "id").limit(n) for kind, n in ((True, quota), (False, sample_rows - quota))]
    chosen = parts[0].unionByName(parts[1])
    place = 1 + F.pmod(F.xxhash64(id), F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1)).cast("long")).cast("int")
    rows = docs.select(F.col(id).alias("id"), F.substring(text, place, F.lit(SAMPLE_CHARS)).alias("text")).join(F.broadcast(chosen), "id")  # at most sample_rows rows
    model = _train_in_a_task(rows.groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text")).orderBy("id").select("text", "y"))
    used = sample_rows - quota
    if 0 < used < clean or 0 < quota < bad:
        model.doc = (*model.doc[:-1], model.doc[-1] + float(np.log(bad / quota * min(used, clean) / clean)))
    return model


def score_toxicity(docs: DataFrame, model: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row with score (0 to 1), predicted (1 from 0.5 on), and spans: byte ranges of the offending words, joined where only one gap lies between.

    A null, empty or wordless text gets the score of a text without toxic words and no spans. Rows may repeat. Columns of
    ``docs`` stay (or those in ``keep``), but give way to an added one of the same name."""

    def step(column: pa.Array) -> list[pa.Array]:
        score = np.zeros(len(column))
        spans: list[list[list[int]]] = [[] for _ in range(len(column))]
        for at, to, data, rows in slices(column):
            features, starts, ends, first = word_features(data, rows)
            odds = _odds(model, features, first)
            x = document_features(odds, first)
            score[at:to] = 1 / (1 + np.exp(-np.clip(x @ np.array(model.doc[:-1]) + model.doc[-1], -30, 30)))
            bad = np.flatnonzero(odds >= 0)
            for w, row in zip(bad, np.searchsorted(first, bad, "right") - 1, strict=True):
                own, base = spans[at + row], rows[row]
                if own and w and own[-1][1] == ends[w - 1] - base:
                    own[-1][1] = int(ends[w] - base)
                else:
                    own.append([int(starts[w] - base), int(ends[w] - base)])
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.list_(pa.int64())))]

    return annotate(docs, text, step, "score double, predicted int, spans array<array<long>>", keep)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    found = score_toxicity(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "spans")
