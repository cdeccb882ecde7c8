"""Embedding near-duplicates by an exact metric range join.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so a cosine bound is a radius. Pivots, a sample of the vectors, divide
them into cells of the nearest pivot. By the triangle inequality a vector y can only be within r of a vector at home in
the cell of pivot p if d(y, p) <= d(y, own pivot) + 2r and d(y, p) <= (radius of the cell) + r; it is copied to those
of them that come before its own. Each cell then compares its home vectors with each other and with what came to it, in
blocks and by itself. So a pair meets once, in the first of its two cells, and counts for both; of the links themselves
only a spanning set of each block is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import components, map_batches, materialise, read
from timberline.llm.neardup import _grouped

#: Vectors at home in a cell, on average, and in a block of one cell. Pivots go to every task, so from 4 million vectors on
#: there are as many as the square root of the vectors (32,000, or 16 MB, for a billion of 64 dimensions), and cells grow too.
CELL_ROWS, BLOCK_ROWS, FEW_PIVOTS = 4096, 4096, 1024
#: Distances to pivots that are held at once.
HELD = 1 << 22
#: Single precision decides a pair unless its cosine is so near the bound.
UNSURE = 1e-4


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length; shorter vectors are filled with zeros. Rows without a direction are all nan."""
    out = np.zeros((len(column), dim))
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), place] = flat
    with np.errstate(all="ignore"):
        out /= np.abs(out).max(1, keepdims=True, initial=0)
        return out / np.sqrt((out * out).sum(1, keepdims=True))


def _matches(home: np.ndarray, others: np.ndarray, near: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray | None:
    """Which pairs have a cosine of at least ``least`` in double precision (None: none); ``near`` holds both in single precision."""
    rough = near[0] @ near[1].T
    out = rough >= np.float32(least - UNSURE)
    if not out.any():
        return None
    i, j = np.nonzero(out & (rough < np.float32(least + UNSURE)))
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[a, b] = np.einsum("ij,ij->i", home[a], others[b]) >= least
    return out


def _spanning(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bipartite graph that keep its components: each node with the least id in its component."""
    i, j = np.nonzero(hits & (left[:, None] != right[None, :]))
    if not len(i):
        return i, i
    names, both = np.unique(np.concatenate((left[i], right[j])), return_inverse=True)
    a, b = both[: len(i)], both[len(i) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(names))
    return names[apart], names[label[apart]]


def near_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    n_links counts the other rows of a cosine of at least ``cosine``, copies included; component_id is the smallest id in
    reach. A vector that is null, zero, or holds a null or a non-finite component links with nothing. A shorter vector
    counts as filled up with zeros. Rows repeated under one id count as rows. Other columns are not read."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))
    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{embedding}`").alias("v"), valid.alias("valid"))
    table = materialise(source.select("row", "id", "valid", F.when(F.col("valid"), F.col("v")).alias("v"), F.xxhash64("v").alias("f1"), F.xxhash64(F.lit(7), "v").alias("f2")))
    classes = materialise(table.where("valid").groupBy("f1", "f2").agg(F.min("row").alias("c"), F.min("id").alias("least"), F.count("*").alias("m"), F.min_by("v", "row").alias("v")))
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    pivots = classes.orderBy(F.xxhash64("f1", "f2"), "c").limit(min(max(FEW_PIVOTS, math.isqrt(n)), max(1, round(n / cell_rows)))).select("v").toArrow()
    centre = units(pivots.column(0).combine_chunks(), dim) if n else np.zeros((1, dim))
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-9

    def distances(column: pa.Array) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (units(column, dim) @ centre.T), 0))

    def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = max(1, HELD // len(centre))
        for at in range(0, len(batch), size):
            yield batch.slice(at, size)

    def homes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batch):
            d = distances(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1)), pa.array(d.min(1))], ["cell", "d"])

    cells = map_batches(classes.select("v"), homes, "cell long, d double").groupBy("cell").agg(F.max("d"), F.count("*")).collect()  # a row for each pivot
    reach, blocks = np.full(len(centre), -1.0), np.ones(len(centre), int)
    for cell, far, size in cells:
        reach[cell], blocks[cell] = far + radius, -(-size // block_rows)

    def deal(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(whole):
            yield from deal_part(batch)

    def deal_part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d = distances(batch.column(2))
        home = d.argmin(1)
        before = np.arange(d.shape[1])[None, :] <= home[:, None]  # a pair of two cells meets in the first of them
        row, cell = np.nonzero((d <= d.min(1, keepdims=True) + 2 * radius + 1e-9) & (d <= reach[None, :] + 1e-9) & before)
        c = np.asarray(batch.column(0))
        take, cells_, block, role = [], [], [], []
        for b in range(blocks.max()):  # a crowded cell is compared block by block
            own = blocks[cell] > b
            take.append(row[own]), cells_.append(cell[own]), block.append(np.full(own.sum(), b)), role.append(np.where(cell[own] == home[row[own]], 1, 2))
        take.append(np.arange(len(c))), cells_.append(home), block.append(c % blocks[home]), role.append(np.zeros(len(c), int))
        take, cells_, block, role = map(np.concatenate, (take, cells_, block, role))
        for at in range(0, len(take), 8192):
            part = slice(at, at + 8192)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in (cells_, block, role)), *(batch.column(k).take(pa.array(take[part])) for k in range(3))], ["cell", "block", "role", "c", "m", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt = map_batches(classes.select("c", "m", "v"), deal, f"cell long, block long, role long, c long, m long, v {kind}")
    dealt = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "role")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, names, counts, times = None, np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        single: np.ndarray | None = None
        done: list[pa.RecordBatch] = []

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.int64()), pa.array(counts)], ["a", "b", "n"])

        def parts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            for batch in stream:
                yield from _grouped(iter([batch]), 3)

        for part in parts(batches):
            cell, block, role = (part.column(k)[0].as_py() for k in range(3))
            c, m = (np.asarray(part.column(k).combine_chunks()) for k in (3, 4))
            v = units(part.column(5).combine_chunks(), dim)
            if now != (cell, block):
                if now is not None:
                    yield counted()
                now, single = (cell, block), None
                home, names, counts, times = np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if role == 0:
                home, names, counts, times = np.concatenate((home, v)), np.append(names, c), np.append(counts, np.zeros(len(c), np.int64)), np.append(times, m)
                continue
            visits = np.zeros(len(c), np.int64)
            if single is None:
                single = home.astype(np.float32)
            others = v.astype(np.float32)
            for i in range(0, len(home), 1024):
                for j in range(0, len(c), 1024):
                    hits = _matches(home[i : i + 1024], v[j : j + 1024], (single[i : i + 1024], others[j : j + 1024]), cosine)
                    if hits is None:
                        continue
                    hits &= names[i : i + 1024, None] != c[None, j : j + 1024]
                    counts[i : i + 1024] += hits @ m[j : j + 1024]
                    if role == 2:
                        visits[j : j + 1024] += times[i : i + 1024] @ hits
                    a, b = _spanning(hits, names[i : i + 1024], c[j : j + 1024])
                    if len(a):
                        done.append(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "n"]))
            yield from done
            done.clear()
            met = np.flatnonzero(visits)
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(c[met]), pa.nulls(len(met), pa.int64()), pa.array(visits[met])], ["a", "b", "n"])
        if now is not None:
            yield counted()

    found = materialise(dealt.mapInArrow(join, "a long, b long, n long"))
    near = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = found.where("n is not null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    placed = classes.join(links, "c", "left").join(near, F.col("c") == F.col("id"), "left").select("f1", "f2", "m", F.coalesce("n", F.lit(0)).alias("n"), "least", F.coalesce("component_id", "c").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(roots, "root").select("f1", "f2", (F.col("n") + F.col("m") - 1).alias("n_links"), "component_id", F.lit(True).alias("valid"))
    rows = table.select("id", "valid", "f1", "f2").join(of, ["f1", "f2", "valid"], "left")
    return rows.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False)))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
