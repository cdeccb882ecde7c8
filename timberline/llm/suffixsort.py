"""Difference-cover suffix sorting of many strings as DataFrames, of any total size.

Strings are rows of symbol arrays, their suffixes rows (t, o). A level names the triples at the places 1 and 2 modulo 3 by
their order, recurses on the strings of names, and merges the suffixes at the places 0 modulo 3 by counting how many of
either kind lie below each other's. Every order is a range-partitioned sort with prefix sums over its partitions, so no
string of names and no group of equal keys has to fit in one place; a few numbers for each partition reach the driver.
Prefixes are told apart up to a depth only, so the recursion ends as soon as a name covers it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import discard, map_batches, materialise, small_batches


def _symbols(batch: pa.RecordBatch, column: int, row: int) -> np.ndarray:
    value = batch.column(column)[row]
    return np.asarray(value.values).astype(np.int64) if value.is_valid else np.zeros(0, np.int64)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values at the places, 0 beyond the end."""
    inside = places < len(values)
    out = np.zeros(len(places), np.int64)
    out[inside] = values[places[inside]]
    return out


def _rows(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def counted_below(rows: DataFrame, keys: list[str], kinds: int) -> tuple[DataFrame, DataFrame]:
    """t, o, kind, and how many rows of each kind (n0, n1, ...) have a smaller key; and the table to discard afterwards."""
    small_batches(rows.sparkSession)
    ordered = rows.select("t", "o", "kind", *keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = [f"n{k}" for k in range(kinds)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, below, last = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [np.asarray(batch.column(3 + k)) for k in range(len(keys))]
            new = np.zeros(n, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last != tuple(int(c[0]) for c in columns)
            last = tuple(int(c[-1]) for c in columns)
            kind = np.asarray(batch.column(2))
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = []
            for k in range(kinds):
                own = kind == k
                before = seen[k] + np.cumsum(own) - own
                out.append(np.where(begin >= 0, before[begin], below[k]))
                below[k] = out[-1][-1]
                seen[k] += own.sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(n, part, np.int32)), *map(pa.array, out)], ["t", "o", "kind", "part", *names])

    found = materialise(ordered.mapInArrow(step, "t long, o long, kind int, part int, " + ", ".join(f"{n} long" for n in names)))
    sizes = {(r["part"], r["kind"]): r["count"] for r in found.groupBy("part", "kind").count().collect()}  # a row for each partition and kind
    parts = sorted({p for p, _ in sizes}) or [0]
    offsets, sums = [], [0] * kinds
    for p in parts:
        offsets.append((p, *sums))
        sums = [x + sizes.get((p, k), 0) for k, x in enumerate(sums)]
    table = rows.sparkSession.createDataFrame(offsets, "part int, " + ", ".join(f"off{k} long" for k in range(kinds)))
    return found.join(F.broadcast(table), "part").select("t", "o", "kind", *[(F.col(n) + F.col(f"off{k}")).alias(n) for k, n in enumerate(names)]), found  # a row for each partition


def _triples(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for r in range(batch.num_rows):
        s = _symbols(batch, 1, r)
        o = np.arange(len(s))
        o = o[o % 3 != 0]
        if len(o):
            yield _rows([np.full(len(o), batch.column(0)[r].as_py()), o, np.zeros(len(o), np.int32), s[o], _at(s, o + 1), _at(s, o + 2)], ["t", "o", "kind", "x", "y", "z"])


def _pairs(second: int):
    """Keys by which the places 0 modulo 3 (kind 0) and those of class 1 or 2 (kind 1) compare: symbols up to a sampled place, and its rank."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in range(batch.num_rows):
            s, r1, r2 = (_symbols(batch, k, r) for k in (1, 2, 3))
            for kind, c in ((0, 0), (1, second)):
                o = np.arange(c, len(s), 3)
                if not len(o):
                    continue
                to = o + second  # a place of class 1 or 2 whatever the class of o
                rank = _at(r1 if to[0] % 3 == 1 else r2, to // 3)
                yield _rows([np.full(len(o), batch.column(0)[r].as_py()), o, np.full(len(o), kind, np.int32), s[o], _at(s, o + 1) if second == 2 else np.zeros(len(o), np.int64), rank], ["t", "o", "kind", "x", "y", "z"])

    return step


KEYED = "t long, o long, kind int, x long, y long, z long"


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """t and r for strings (t, s): for each place 1 and the number of suffixes below its own. Symbols are positive.

    Suffixes with the same first ``depth`` symbols have neighbouring ranks; a string's end is smaller than any symbol."""
    if depth <= 1:
        return strings.select("t", F.col("s").alias("r"))
    named, held = counted_below(map_batches(strings.select("t", "s"), _triples, KEYED), ["x", "y", "z"], 1)
    of = F.transform(F.array_sort(F.collect_list(F.struct("o", (F.col("n0") + 1).alias("name")))), lambda p: p["name"])  # of one string
    names = materialise(named.groupBy((F.col("t") * 2 + F.col("o") % 3 - 1).alias("t")).agg(of.alias("s")))
    discard(held)
    ranks = suffix_ranks(names, -(-depth // 3))
    own = F.shiftright("t", 1).alias("t")
    split = ranks.groupBy(own).agg(F.max(F.when(F.col("t") % 2 == 0, F.col("r"))).alias("r1"), F.max(F.when(F.col("t") % 2 == 1, F.col("r"))).alias("r2"))
    both = materialise(strings.select("t", "s").join(split, "t", "left").select("t", "s", "r1", "r2"))
    discard(names)
    first, held1 = counted_below(map_batches(both, _pairs(1), KEYED), ["x", "z"], 2)
    second, held2 = counted_below(map_batches(both, _pairs(2), KEYED), ["x", "y", "z"], 2)
    rest = F.col("kind") == 0
    more = first.select("t", "o", F.when(rest, F.col("n0") + F.col("n1")).otherwise(F.col("n0")).alias("n")).unionByName(second.select("t", "o", F.when(rest, F.col("n1")).otherwise(F.col("n0")).alias("n")))
    added = more.groupBy("t").agg(F.collect_list("o").alias("o"), F.collect_list("n").alias("n"))  # of one string

    def merged(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for r in range(batch.num_rows):
            s, r1, r2, o, n = (_symbols(batch, k, r) for k in range(1, 6))
            rank = np.zeros(len(s), np.int64)
            np.add.at(rank, o, n)
            rank[0::3] += 1
            rank[1::3] += r1
            rank[2::3] += r2
            out.append(rank)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["t", "r"])

    done = materialise(map_batches(both.join(added, "t").select("t", "s", "r1", "r2", "o", "n"), merged, "t long, r array<long>"))
    discard(both, held1, held2)
    return done


def repeated_places(strings: DataFrame, length: int) -> DataFrame:
    """t and o of each place of strings (t, s) from which ``length`` symbols start that also start at another place: neighbours in suffix order with equal prefixes."""
    ranks = suffix_ranks(strings, length)

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in range(batch.num_rows):
            s, rank = _symbols(batch, 1, r), _symbols(batch, 2, r)
            n = len(s) - length + 1
            for at in range(0, n, 4096):
                part = np.lib.stride_tricks.sliding_window_view(s[at : min(at + 4096, n) + length - 1], length)
                raw = np.ascontiguousarray(part).view(f"V{8 * length}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(0)[r].as_py())), pa.array(np.arange(at, at + len(part))), pa.array(rank[at : at + len(part)]), pa.array([x.tobytes() for x in raw], pa.binary())], ["t", "o", "r", "w"])

    rows = map_batches(strings.select("t", "s").join(ranks, "t").select("t", "s", "r"), windows, "t long, o long, r long, w binary")
    ordered = rows.repartitionByRange("r").sortWithinPartitions("r")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is known when the next one is seen; the first and last of a partition keep their window."""
        part = TaskContext.get().partitionId()
        held: list | None = None  # t, o, window, equal to the one before, edge
        names = ["t", "o", "hit", "part", "edge", "w"]

        def out(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[3] for x in rows], pa.bool_()), pa.array([part] * len(rows), pa.int32()), pa.array([x[4] for x in rows], pa.int32()), pa.array([x[2] if x[4] else None for x in rows], pa.binary())], names)

        for batch in batches:
            done = []
            for t, o, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                same = held is not None and held[2] == w
                if held is not None:
                    held[3] |= same
                    done.append(held)
                held = [t, o, w, same, int(held is None)]
            if done:
                yield out(done)
        if held is not None:
            held[4] += 2
            yield out([held])

    found = materialise(ordered.mapInArrow(neighbours, "t long, o long, hit boolean, part int, edge int, w binary"))
    edges = sorted(found.where("edge > 0").collect(), key=lambda r: (r["part"], r["edge"]))  # at most two for each partition
    extra = set()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a["part"] != b["part"] and a["w"] == b["w"]:
            extra |= {(x["t"], x["o"]) for x in (a, b) if not x["hit"]}
    hits = found.where("hit").select("t", "o")
    return hits.unionByName(strings.sparkSession.createDataFrame(sorted(extra), "t long, o long")) if extra else hits
