"""Repeated passages by difference-cover suffix sorting.

A start is repeated if the ``length`` bytes from there also start elsewhere. Two equal strings of that length have the same
least 32-gram hash, so that hash deals starts into buckets that can be sorted apart: a run of neighbouring starts with one
least hash is one string of the bucket. Buckets with one occurrence of their hash hold nothing repeated. Equal runs are
counted before they are shuffled; one of each is sorted, and a run that occurs twice is repeated as a whole. What is left,
runs that share their hash with a different run (or with themselves), goes through the suffix sort: sort sampled triples
(positions 1 and 2 modulo 3), recurse on their names, merge the remaining suffixes, then compare the prefixes of neighbours.

Crowded buckets are parted by what their windows have in common, coarsely and then ever finer, and equal parts counted again; what is
crowded even then is sorted as DataFrames (``suffixsort``), which needs no group in one place. All texts are named by 128
bits of hash, so copies share their spans and no row number is relied on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import bit_map, map_batches, mark, materialise, mix, odd_numbers, read, slices
from timberline.llm.suffixsort import repeated_places

LENGTH, GRAM = 400, 32
#: Symbols of small buckets that are sorted together, and the size from which a bucket is crowded (names must stay under 2**21).
SORT_SYMBOLS, HOT_BYTES = 600_000, 1_000_000
#: Starts in a part of a crowded bucket's string: coarse parts first, finer ones of what is still crowded and not counted yet.
STEPS = (128, 32, 8)
_FACTORS = odd_numbers(20, 61)


def block_hash(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place, by doubling."""
    held, have, out, done = mix(data.astype(np.uint64) + np.uint64(1 + seed)), 1, None, 0
    with np.errstate(over="ignore"):
        for k in range(size.bit_length()):
            if size >> k & 1:
                part = held[done:]
                out = part if out is None else out[: len(part)] * _FACTORS[k] + part[: len(out)]
                done += have
            if size >> (k + 1):
                held = held[: max(len(held) - have, 0)] * _FACTORS[k + 10] + held[have:]
                have *= 2
    return mix(out)[: max(len(data) - size + 1, 0)]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    grid = np.concatenate((values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of positive symbols, fewer than 2**21 of them, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    s = np.concatenate((text.astype(np.uint64), np.zeros(3, np.uint64)))
    at = np.arange(n + (n % 3 == 1))
    one, two = at[at % 3 == 1], at[at % 3 == 2]
    sampled = np.concatenate((one, two))
    triples = s[sampled] << np.uint64(42) | s[sampled + 1] << np.uint64(21) | s[sampled + 2]
    order = np.argsort(triples, kind="stable")
    in_order = triples[order]
    names = np.empty(len(sampled), np.int64)
    names[order] = np.cumsum(np.append(True, in_order[1:] != in_order[:-1]))
    if names.max() < len(sampled):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.uint64)
    sampled_order = sampled[order]
    rank[sampled_order] = np.arange(1, len(order) + 1, dtype=np.uint64)
    sampled_order = sampled_order[sampled_order < n]
    rest = np.arange(0, n, 3)
    first = s[rest] << np.uint64(21) | rank[rest + 1]
    rest = rest[np.argsort(first, kind="stable")]
    # places of the remaining suffixes among those of either class, by keys that both kinds have
    own1, own2 = (sampled_order[sampled_order % 3 == c] for c in (1, 2))
    less = np.searchsorted(s[own1] << np.uint64(21) | rank[own1 + 1], s[rest] << np.uint64(21) | rank[rest + 1])
    less += np.searchsorted(s[own2] << np.uint64(42) | s[own2 + 1] << np.uint64(21) | rank[own2 + 2], s[rest] << np.uint64(42) | s[rest + 1] << np.uint64(21) | rank[rest + 2])
    out = np.empty(n, np.int64)
    places = less + np.arange(len(rest))
    out[places] = rest
    mask = np.ones(n, bool)
    mask[places] = False
    out[mask] = sampled_order
    return out


def repeated_starts(strings: list[np.ndarray], length: int, bits: int = 8) -> list[np.ndarray]:
    """For each string of symbols below 2**bits, which of its places start ``length`` symbols that also start at another place of any of the strings."""
    gap = np.zeros(1, np.int64)
    data = np.concatenate([x for s in strings for x in (s, gap)]).astype(np.int64)
    ends = np.cumsum([len(s) + 1 for s in strings])
    text = data + 2
    text[ends - 1] = 1
    order = suffix_array(text)
    stop = np.repeat(ends - 1, np.diff(np.append(0, ends)))
    whole = order[order + length <= stop[order]]  # neighbours among these are neighbours of those with equal prefixes
    each = 64 // bits
    wide = np.concatenate((data, np.zeros(each, np.int64))).astype(np.uint64)
    words = np.zeros(len(data), np.uint64)
    for k in range(each):
        words = words << np.uint64(bits) | wide[k : k + len(data)]
    a, b = whole[:-1], whole[1:]
    for k in [*range(0, length - each + 1, each), *([length - each] if length % each else [])]:
        if length < each:
            break
        same = words[a + k] == words[b + k]
        a, b = a[same], b[same]
    for k in range(length if length < each else 0):
        same = data[a + k] == data[b + k]
        a, b = a[same], b[same]
    found = np.zeros(len(data), bool)
    found[a] = found[b] = True
    return [found[e - len(s) - 1 : e - 1] for s, e in zip(strings, ends.tolist(), strict=True)]


def _runs(of: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], of.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


RUN = "k1 long, k2 long, first long, last long, m long, f1 long, f2 long, times int"


def _find_runs(texts: DataFrame, length: int) -> DataFrame:
    """Runs of starts with one least hash, for every row: the text's name, first and last start, the hash, the run's name, and how often the hash occurs in it."""
    width = length - GRAM + 1

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, _, data, rows in slices(batch.column(2)):
            if len(data) < length:
                continue
            grams = block_hash(data, GRAM)
            least = sliding_least(grams, width)
            raw = data.tobytes()
            out: list[list] = [[] for _ in range(7)]
            for r in range(len(rows) - 1):
                a, b = int(rows[r]), int(rows[r + 1]) - length + 1
                if b <= a:
                    continue
                own = least[a:b]
                cut = np.flatnonzero(own[1:] != own[:-1]) + 1
                firsts, lasts = np.append(0, cut), np.append(cut, len(own)) - 1
                for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
                    name = xxhash.xxh3_128_intdigest(raw[a + first : a + last + length])
                    for c, x in zip(out, (at + r, first, last, own[first], name >> 64, name & 0xFFFFFFFFFFFFFFFF, np.count_nonzero(grams[a + first : a + last + width] == own[first])), strict=True):
                        c.append(x)
            if out[0]:
                take = pa.array(np.array(out[0], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(np.array(out[k], np.int64)) for k in (1, 2)), *(pa.array(np.array(out[k], np.uint64).view(np.int64)) for k in (3, 4, 5)), pa.array(np.array(out[6], np.int32))],
                    ["k1", "k2", "first", "last", "m", "f1", "f2", "times"],
                )

    return map_batches(texts.where(F.octet_length("text") >= length).select("k1", "k2", "text"), step, RUN)


def _cut_out(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The strings of runs (k1, k2, first, last, m, c): m, k1, k2, first, c, string."""
    packed = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "m", "c")).alias("runs"))  # of one text each
    near = mark(texts, bit_map(wanted, "k1"), "k1").where("_marked").select("k1", "k2", "text")
    one = near.join(packed, ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in range(len(batch)):
            raw = batch.column(2)[r].as_py().encode()
            runs = batch.column(3)[r].as_py()
            for at in range(0, len(runs), 2000):
                part = runs[at : at + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["m"] for x in part], pa.int64()), *(pa.array([batch.column(k)[r].as_py()] * len(part), pa.int64()) for k in (0, 1)), pa.array([x["first"] for x in part], pa.int64()), pa.array([x["c"] for x in part], pa.int64()), pa.array([raw[x["first"] : x["last"] + length] for x in part], pa.binary())],
                    ["m", "k1", "k2", "first", "c", "string"],
                )

    return map_batches(one.select("k1", "k2", "text", "runs"), step, "m long, k1 long, k2 long, first long, c long, string binary")


SPAN = "k1 long, k2 long, a long, b long"


def _sorted_spans(strings: DataFrame, length: int, step: int | None = None) -> DataFrame:
    """Repeated spans of the strings that occur once, bucket by bucket (m, k1, k2, first, c, string, lead, size of the bucket).

    With ``step``, the strings are parts whose windows all hold the bytes that their bucket has in common, from ``lead``
    on. These bytes become one symbol of the bucket, and a window is then ``step`` symbols long."""
    dealt = strings.repartition("m").sortWithinPartitions("m")
    common = 0 if step is None else length - step + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = bucket = 0

        def flush() -> pa.RecordBatch:
            spans = []
            found = repeated_starts([x[4] for x in held], length) if step is None else repeated_starts([x[4] for x in held], step, 16)
            for (k1, k2, first, c, _), own in zip(held, found, strict=True):
                if c == 1:
                    spans += [(k1, k2, first + a, first + b + length) for a, b in _runs(own)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in spans], pa.int64()) for k in range(4)], ["k1", "k2", "a", "b"])

        last = None
        for batch in batches:
            for m, k1, k2, first, c, raw, lead, full in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if m != last:
                    if held and size + full > SORT_SYMBOLS:
                        yield flush()
                        held, size, bucket = [], 0, 0
                    last, bucket = m, bucket + 1
                symbols = np.frombuffer(raw, np.uint8)
                if step is not None:
                    symbols = np.concatenate((symbols[:lead].astype(np.int64), [255 + bucket], symbols[lead + common :]))
                held.append((k1, k2, first, c, symbols))
                size += len(symbols) + 1
        if held:
            yield flush()

    return dealt.mapInArrow(run, SPAN)


def _spread_spans(strings: DataFrame, length: int, step: int | None = None) -> DataFrame:
    """The same for buckets of any size: one suffix sort of all their strings, spread over all tasks."""
    size, common = (length, 0) if step is None else (step, length - step + 1)

    def symbols(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for m, raw, lead in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            own = np.frombuffer(raw, np.uint8).astype(np.int64) + 1
            if step is not None:  # the bytes that all windows of the bucket share become one symbol of its own
                own = np.concatenate((own[:lead], [(m & ((1 << 62) - 1)) + 512], own[lead + common :]))
            out.append(own)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["t", "s"])

    numbered = materialise(strings.withColumn("t", F.monotonically_increasing_id()))
    spelt = materialise(map_batches(numbered.select("t", "m", "string", "lead"), symbols, "t long, s array<long>"))
    found = repeated_places(spelt, size)
    of = numbered.where("c = 1").select("t", "k1", "k2", "first")
    return found.join(of, "t").select("k1", "k2", (F.col("first") + F.col("o")).alias("a"), (F.col("first") + F.col("o") + length).alias("b"))


def _parted(strings: DataFrame, step_: int, length: int) -> DataFrame:
    """Cut the strings of crowded buckets into runs of at most ``step_`` starts, and deal these into finer buckets.

    A start's offset is its distance to the first place at or after it where the least hash (``gram``) occurs. Starts of one string
    whose offsets to one such place have the same multiple of ``step_`` below them form a run; all their windows hold the
    bytes that the windows of the least and the greatest such offset share. Equal windows have equal offsets and equal
    shared bytes, so a hash of both names the finer bucket."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in range(len(batch)):
            k1, k2, first, c, raw, gram = (batch.column(k)[r].as_py() for k in range(1, 7))
            places = np.flatnonzero(block_hash(np.frombuffer(raw, np.uint8), GRAM).view(np.int64) == gram)
            starts = np.arange(len(raw) - length + 1)
            anchor = places[np.searchsorted(places, starts)]
            step_of = (anchor - starts) // step_
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (step_of[1:] != step_of[:-1])) + 1
            heads, tails = np.append(0, cut), np.append(cut, len(starts)) - 1
            names, parts, leads = [], [], []
            for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
                low = int(step_of[h]) * step_
                core = int(anchor[h]) - low
                names.append(xxhash.xxh3_64_intdigest(raw[core : core - step_ + 1 + length], seed=low * 131 + step_))
                parts.append(raw[h : t + length])
                leads.append(core - h)
            one = np.ones(len(parts), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(one * k1), pa.array(one * k2), pa.array(heads + first), pa.array(one * c), pa.array(parts, pa.binary()), pa.array(one * gram), pa.array(leads, pa.int64())], ["m", "k1", "k2", "first", "c", "string", "gram", "lead"])

    return map_batches(strings.select("m", "k1", "k2", "first", "c", "string", "gram"), step, "m long, k1 long, k2 long, first long, c long, string binary, gram long, lead long")


def _settled(strings: DataFrame, length: int, steps: tuple[int, ...], step: int | None = None) -> DataFrame:
    """Repeated spans of strings of any buckets: sort the small ones, part the others and look again; in the end sort all that is left as one, spread over all tasks."""
    common = 0 if step is None else length - step
    buckets = strings.groupBy("m").agg(F.sum(F.octet_length("string") + 1 - common).alias("size"))
    judged = materialise(strings.join(buckets, "m").withColumn("hot", F.col("size") > HOT_BYTES))
    found = _sorted_spans(judged.where("not hot").select("m", "k1", "k2", "first", "c", "string", "lead", "size"), length, step)
    hot = judged.where("hot").drop("hot", "size").repartition("k1", "k2", "first")  # a crowded bucket is worked on by all tasks
    if hot.isEmpty():
        return found
    if not steps:
        return found.unionByName(_spread_spans(hot, length, step))
    parts = materialise(_parted(hot, steps[0], length).withColumns({"f1": F.xxhash64("string"), "f2": F.xxhash64(F.lit(7), "string")}))
    each = materialise(parts.groupBy("m", "f1", "f2").agg(F.sum("c").alias("all"), F.min(F.struct("k1", "k2", "first")).alias("of")))
    whole = parts.where("c = 1").join(each.where("all > 1").select("m", "f1", "f2"), ["m", "f1", "f2"]).select("k1", "k2", F.col("first").alias("a"), (F.col("first") + F.octet_length("string")).alias("b"))
    mixed = each.groupBy("m").agg(F.count("*").alias("n"), F.sum((F.col("all") == 1).cast("int")).alias("once")).where("once > 0 and n > 1").select("m")
    wanted = each.join(mixed, "m").select("m", "of.*", "all")
    left = parts.drop("c", "f1", "f2").join(wanted, ["m", "k1", "k2", "first"]).select("m", "k1", "k2", "first", F.col("all").alias("c"), "string", "gram", "lead")
    return found.unionByName(whole).unionByName(_settled(left, length, steps[1:], steps[0]))


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans to remove (k1, k2, a, b; they may overlap) of texts (k1, k2, text)."""
    runs = materialise(_find_runs(texts, length))
    shared = runs.groupBy("m").agg(F.sum("times").alias("all"), F.count("*").alias("n")).where("all > 1 or n > 1").select("m")
    near = materialise(runs.join(shared, "m"))
    each = materialise(near.groupBy("m", "f1", "f2").agg(F.count("*").alias("c"), F.max("times").alias("times"), F.min(F.struct("k1", "k2", "first", "last")).alias("of")))
    whole = near.join(each.where("c > 1").select("m", "f1", "f2"), ["m", "f1", "f2"]).select("k1", "k2", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    buckets = each.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once"), F.max("times").alias("most"))
    wanted = each.join(buckets.where("once > 0 and (n > 1 or most > 1)").select("m"), "m").select("of.*", "m", "c")
    strings = materialise(_cut_out(wanted, texts, length))
    return whole.unionByName(_settled(strings.withColumns({"gram": F.col("m"), "lead": F.lit(0).cast("long")}), length, tuple(x for x in STEPS if x < length)))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (remaining bytes).

    A null text is empty. Rows repeated under one id, and equal texts under different ids, are repeats of each other.
    Texts shorter than ``length`` keep all. The remaining bytes need not be whole characters. Other columns are not read."""
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id}`").alias("id"), clean.alias("text"), F.xxhash64(clean).alias("k1"), F.xxhash64(F.lit(7), clean).alias("k2"))
    spans = materialise(repeated_spans(texts, length))
    marked = mark(texts, bit_map(spans, "k1"), "k1")
    packed = spans.groupBy("k1", "k2").agg(F.collect_set(F.array("a", "b")).alias("spans"))  # of one text each
    kind = docs.schema[id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, to, data, rows in slices(batch.column(1)):
            raw, out = data.tobytes(), []
            spans = batch.column(2).slice(at, to - at).to_pylist()
            for r in range(len(rows) - 1):
                a, b = int(rows[r]), int(rows[r + 1])
                parts, end, gone, count = [], a, 0, 0
                for x, y in sorted(spans[r] or []):
                    x, y = a + x, a + y
                    if x > end or not count:
                        parts.append(raw[end:x])
                        count += 1
                        gone += y - x
                    else:
                        gone += max(y - end, 0)
                    end = max(end, y)
                parts.append(raw[end:b])
                left = b"".join(parts)
                out.append((b - a, gone, count, hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *(pa.array([x[k] for x in out]) for k in range(5))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = map_batches(marked.where("_marked").join(packed, ["k1", "k2"], "left").select("id", "text", "spans"), step, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    data = F.encode("text", "UTF-8")
    same = marked.where("not _marked").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), data.alias("kept"))
    return changed.unionByName(same).withColumnRenamed("id", id)


def op8(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
