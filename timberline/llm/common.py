"""Helpers shared by the corpus operators: shared storage, byte batches, word hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.storage import discard, materialise

#: Most bytes of text that a numpy step looks at together; temporaries are about twenty times as large.
SLICE_BYTES = 256 << 10
#: Most bytes in an Arrow batch that the JVM hands to Python.
ARROW_BYTES = "8m"

ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_of_id(column: Column) -> Column:
    """crc32 of an id written as text, the remainder of which deals documents into folds."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits that leaves no linear structure."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * ODD + np.uint64(seed)) | np.uint64(1)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes (one longer text is a run of its own).

    Yields first row, row after the last, the bytes, and the offset of each row's text in them; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: str | list[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, p, p*p, ... modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), np.uint64(0xD6E8FEB86659FD93))
        grown[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(grown)
    return _powers


def word_hashes(data: np.ndarray, rows: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash each maximal run of word bytes within a row, A-Z taken as a-z.

    Returns the 64-bit hashes, first byte and byte after the last of each word, and the index of each row's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    low = LOWER[data]
    inside = in_word[low]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = rows[(rows > 0) & (rows < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, rows)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, first
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)]))))
    place[: starts[0]] = 0
    place[~inside] = 0
    with np.errstate(over="ignore"):
        value = (low.astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
        value[~inside] = 0
        return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * ODD), starts, ends, first


def gram_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        total = np.full(m, np.uint64(n) * ODD)
        for k, a in enumerate(odd_numbers(n, seed)):
            total += words[k : k + m] * a
    return mix(total)


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Apply a function of one Arrow batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return df.mapInArrow(run, schema)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id of ``links`` (u, v): columns id, component_id.

    Large-star and small-star rounds (Kiveris et al. 2014) on Parquet tables; the number of edges never grows,
    nothing but one count a round reaches the driver, and a hub's edges are spread by the partial aggregates."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges)
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        before, edges = edges, materialise(small)
        discard(before)
        now = edges.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == now[1] and now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())


def annotate(df: DataFrame, text: str, step: Callable[[pa.Array], list[pa.Array]], added: str, keep: list[str] | None = None) -> DataFrame:
    """Add columns that a numpy step makes from the text column, row by row; nothing is joined, so ids may repeat or be null.

    ``keep`` lists the columns to hand on (default: all); one with the name of an added column gives way to it."""
    new = T.StructType.fromDDL(added)
    taken = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    out = T.StructType([*base.schema.fields[:-1], *new.fields])
    names = out.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.columns
        return pa.RecordBatch.from_arrays([*columns[:-1], *step(columns[-1])], names)

    return map_batches(base, run, out)


MAP_BITS = 23


def bit_map(rows: DataFrame, *key: str) -> DataFrame:
    """2**MAP_BITS bits, those of the keys' hashes set: at most 131,072 rows (_w, _bits) of 16 bytes, whatever the input."""
    at = F.shiftrightunsigned(F.xxhash64(*key), 64 - MAP_BITS)
    return rows.select(at.alias("_x")).groupBy(F.shiftright("_x", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_x & 63 as int))")).alias("_bits"))


def mark(rows: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """Add ``_marked``: true for every row whose key is in the map, and for few others. Saves their shuffle to the rest."""
    at = rows.withColumn("_x", F.shiftrightunsigned(F.xxhash64(*key), 64 - MAP_BITS))
    held = at.join(F.broadcast(bits), F.shiftright("_x", 6) == F.col("_w"), "left")
    bit = F.expr("(shiftright(_bits, cast(_x & 63 as int)) & 1) = 1")
    return held.withColumn("_marked", F.coalesce(bit, F.lit(False))).drop("_w", "_bits", "_x")
