"""Benchmark decontamination by winnowing.

A window is ``n`` consecutive words of a benchmark item. Of the k-gram hashes in a window the least one is its
fingerprint (k = 5 and n = 10: the least of six), so equal windows have equal fingerprints and no shared span of n words
or more can be missed. Document windows whose fingerprint the benchmark holds are extended to the whole window and
compared by 128 bits of hash. An item of fewer than n words is one window, and its own fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import annotate, byte_class, gram_hashes, map_batches, materialise, read, slices, word_hashes

WORD = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WINDOW, GRAM = 10, 5
#: A benchmark of more bytes of text than this isn't broadcast; its fingerprints are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

WINDOW_FIELDS = "fp long, h1 long, h2 long, length int"


def fingerprints(words: np.ndarray, n: int, k: int) -> np.ndarray:
    """The least k-gram hash of each n consecutive words."""
    grams = gram_hashes(words, k, 11)
    span = n - k + 1
    if len(grams) < span:
        return np.zeros(0, np.uint64)
    least = grams[: len(grams) - span + 1].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : len(grams) - span + 1 + j], out=least)
    return least


def item_windows(words: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Fingerprints, both hashes, and the length of an item's windows."""
    size = min(n, len(words))
    h1, h2 = gram_hashes(words, size, 21), gram_hashes(words, size, 22)
    return (fingerprints(words, n, k) if size == n else h1), h1, h2, size


def benchmark_windows(bench: DataFrame, item: str, text: str, n: int, k: int) -> DataFrame:
    """Distinct windows of the benchmark: item, fp, h1, h2, length."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for at, to, data, rows in slices(batch.column(1)):
            words, _, _, first = word_hashes(data, rows, WORD)
            for r in range(to - at):
                own = words[first[r] : first[r + 1]]
                if len(own):
                    fp, h1, h2, size = item_windows(own, n, k)
                    for c, x in zip(columns, (np.full(len(h1), at + r), fp.view(np.int64), h1.view(np.int64), h2.view(np.int64), np.full(len(h1), size, np.int32)), strict=True):
                        c.append(x)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat[0].astype(np.int64))), *map(pa.array, (*flat[1:4], flat[4].astype(np.int32)))], ["item", "fp", "h1", "h2", "length"])

    return map_batches(bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")), step, "item string, " + WINDOW_FIELDS).distinct()


class Index:
    """The benchmark's windows in sorted arrays, for lookups by fingerprint and then by hash."""

    def __init__(self, rows) -> None:
        self.items = sorted({r["item"] for r in rows})
        number = {x: k for k, x in enumerate(self.items)}
        self.long: tuple | None = None
        self.by: dict[int, tuple] = {}
        for size in sorted({r["length"] for r in rows}):
            own = [r for r in rows if r["length"] == size]
            array = lambda f: np.array([r[f] for r in own], np.int64).view(np.uint64)  # noqa: B023, E731
            order = np.lexsort((array("h2"), array("h1")))
            fps = np.unique(array("fp"))
            sieve = np.zeros(1 << 20, bool)
            sieve[(fps & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by[size] = (sieve, fps, array("h1")[order], array("h2")[order], np.array([number[r["item"]] for r in own])[order])

    def find(self, words: np.ndarray, n: int, k: int):
        """Yields length, starts and item numbers of the windows that occur in a run of words (rows not yet told apart)."""
        for size, (sieve, fps, h1, h2, items) in self.by.items():
            marks = fingerprints(words, n, k) if size == n else gram_hashes(words, size, 21)
            at = np.flatnonzero(sieve[(marks & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(at):
                continue
            at = at[fps[np.minimum(np.searchsorted(fps, marks[at]), len(fps) - 1)] == marks[at]]
            if not len(at):
                continue
            take = at[:, None] + np.arange(size)
            own1, own2 = hashes_of(words[take], size, 21), hashes_of(words[take], size, 22)
            left, right = np.searchsorted(h1, own1, "left"), np.searchsorted(h1, own1, "right")
            count = right - left
            rep = np.repeat(np.arange(len(at)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
            same = h2[place] == own2[rep]
            yield size, at[rep[same]], items[place[same]]


def hashes_of(grams: np.ndarray, size: int, seed: int) -> np.ndarray:
    """gram_hashes of rows of words."""
    return gram_hashes(np.ascontiguousarray(grams).reshape(-1), size, seed)[::size] if len(grams) else np.zeros(0, np.uint64)


FIELDS = "n_words long, n_hit long, items array<string>, spans array<array<long>>, contaminated boolean"


def _marked(index: Index, n: int, k: int):
    def step(column: pa.Array) -> list[pa.Array]:
        n_words, n_hit = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        items: list[list[str]] = [[] for _ in range(len(column))]
        spans: list[list[list[int]]] = [[] for _ in range(len(column))]
        for at, to, data, rows in slices(column):
            words, _, _, first = word_hashes(data, rows, WORD)
            n_words[at:to] = np.diff(first)
            cover = np.zeros(len(words) + 1, np.int64)
            found: dict[int, set[int]] = {}
            for size, starts, which in index.find(words, n, k):
                row = np.searchsorted(first, starts, "right") - 1
                inside = starts + size <= first[row + 1]  # a window doesn't cross rows
                starts, which, row = starts[inside], which[inside], row[inside]
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + size, -1)
                for r, x in {*zip(row.tolist(), which.tolist(), strict=True)}:
                    found.setdefault(r, set()).add(x)
            if not found:
                continue
            hit = np.cumsum(cover)[:-1] > 0
            for r, own in found.items():
                mine = hit[first[r] : first[r + 1]]
                n_hit[at + r] = mine.sum()
                items[at + r] = [index.items[x] for x in sorted(own)]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
                spans[at + r] = edge.reshape(-1, 2).tolist()
        return [pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(n_hit > 0)]

    return step


#: Bits (as a power of two) of the map of fingerprints that goes to every task, whatever the size of the benchmark.
SIEVE_BITS = 24


def _sieve(windows: DataFrame) -> np.ndarray:
    """A map of 2**SIEVE_BITS bits, those of the fingerprints set: 2 MB, gathered as at most 2**18 rows."""
    at = F.col("fp").bitwiseAND((1 << SIEVE_BITS) - 1)
    words = windows.select(at.alias("x")).groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("bits"))
    return out.view(np.uint64)


def _joined(docs: DataFrame, windows: DataFrame, text: str, keep: list[str] | None, n: int, k: int) -> DataFrame:
    """The same result by shuffles, for a benchmark of any size: only document windows whose fingerprint the map of bits lets through are joined."""
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most n of them
    sieve = _sieve(windows)
    added = {c.split()[0] for c in FIELDS.split(", ")}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    held = materialise(docs.select(whole.alias("_doc"), F.col(f"`{text}`").alias("_text"), F.monotonically_increasing_id().alias("_row")))

    def counted(column: pa.Array) -> list[pa.Array]:
        return [pa.array(np.concatenate([np.diff(word_hashes(d, r, WORD)[3]) for _, _, d, r in slices(column)] or [np.zeros(0, np.int64)]).astype(np.int64))]

    def step(batch: pa.RecordBatch):
        for at, _, data, rows in slices(batch.column(1)):
            words, _, _, first = word_hashes(data, rows, WORD)
            ids = np.asarray(batch.column(0))
            for size in lengths:
                marks = fingerprints(words, n, k) if size == n else gram_hashes(words, size, 21)
                low = marks & np.uint64((1 << SIEVE_BITS) - 1)
                starts = np.flatnonzero(sieve[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                row = np.searchsorted(first, starts, "right") - 1
                inside = starts + size <= first[np.minimum(row + 1, len(first) - 1)]
                starts, row = starts[inside], row[inside]
                if len(starts):
                    take = starts[:, None] + np.arange(size)
                    own = [x.view(np.int64) for x in (marks[starts], hashes_of(words[take], size, 21), hashes_of(words[take], size, 22))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + row]), pa.array(starts - first[row]), *map(pa.array, own), pa.array(np.full(len(starts), size, np.int32))], ["_row", "start", "fp", "h1", "h2", "length"])

    mine = map_batches(held.select("_row", "_text"), step, "_row long, start long, " + WINDOW_FIELDS)
    hits = materialise(mine.drop("fp").join(windows.drop("fp"), ["h1", "h2", "length"]).select("_row", "start", "length", "item"))
    places = hits.select("_row", F.struct("start", "length").alias("w")).distinct().groupBy("_row").agg(F.collect_list("w").alias("w"))  # of one row of docs
    items = hits.select("_row", "item").distinct().groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for found in batch.column(1).to_pylist():
            own: list[list[int]] = []
            for start, length in sorted((w["start"], w["length"]) for w in found):
                if own and start <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], start + length)
                else:
                    own.append([start, start + length])
            spans.append(own)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["_row", "spans"])

    covered = map_batches(places, merged, "_row long, spans array<array<long>>").join(items, "_row")
    base = annotate(held, "_text", counted, "n_words long", ["_doc", "_row"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return base.join(covered, "_row", "left").select(
        *[F.col("_doc").getField(c).alias(c) for c in kept], "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<array<bigint>>)")).alias("spans"), F.col("spans").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, n: int = WINDOW, k: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each row of ``docs`` with n_words, n_hit, items (ids as sorted strings), spans (word ranges) and contaminated.

    A null or empty text has no words. A null item id counts as ''; items repeated under one id count once; an empty
    benchmark hits nothing. Columns of ``docs`` stay (or those in ``keep``), but give way to an added one of the same name."""
    windows = materialise(benchmark_windows(bench, item, item_text, n, k))
    size = windows.agg(F.count("*") * 40 + F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _joined(docs, windows, text, keep, n, k)
    return annotate(docs, text, _marked(Index(windows.collect()), n, k), FIELDS, keep)  # checked above to be small


def op6(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
