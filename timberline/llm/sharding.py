"""Sharding by histogram sort.

Rows are ordered by a hash of their text (so that equal texts are neighbours), then of their id. Splitters of that
order are found by exact counts: each round sums the bytes and rows below up to 512 finer boundaries around every
splitter that is still too far from its target, for all of them in one aggregate. Rows move once, when all are known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import materialise, read

BITS, WIDTH = 9, 63
TOP = 1 << WIDTH


@dataclass
class _Target:
    aim: float
    slack: float
    group_slack: float
    done: tuple[int, ...] = ()  # values of the columns before the one now refined
    prefix: int = 0
    below: int = 0  # bytes and rows before the interval
    rows: int = 0
    bound: tuple[int, int, int] | None = None


def _settle(t: _Target, level: int, left: int, counts: list[tuple[int, int, int]]) -> None:
    """Move one target into a digit of its interval, or fix it at an edge. counts: digit, bytes, rows in order."""
    below, rows = t.below, t.rows
    for digit, size, n in counts:
        if below + size >= t.aim or (digit, size, n) == counts[-1]:
            break
        below, rows = below + size, rows + n
    first, after = (t.prefix << BITS) | digit, (t.prefix << BITS) | (digit + 1)
    lower = t.aim - below <= below + size - t.aim
    off = min(abs(t.aim - below), abs(below + size - t.aim))
    last = left == 0
    if off <= (t.group_slack if last and level == 0 else t.slack) or n <= 1 or (last and level == 2):
        edge = (first if lower else after) << left
        t.bound = (*t.done, edge, *[0] * (2 - level)) if edge < TOP else (*t.done, *[TOP - 1] * (3 - level))
        t.below, t.rows = (below, rows) if lower else (below + size, rows + n)
        return
    t.below, t.rows = below, rows
    t.prefix, t.done = (0, (*t.done, first)) if last else (first, t.done)


def splitters(keyed: DataFrame, shards: int, per_shard: int, tolerance: float, group_tolerance: float) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Bounds of shards * per_shard ranges of (_k0, _k1, _k2); rows before each range; bytes before each range.

    At most shards * per_shard * 512 counts reach the driver in a round."""
    total, n = keyed.agg(F.coalesce(F.sum("_w"), F.lit(0)), F.count("*")).first()
    parts = shards * per_shard
    ideal = total / shards
    targets = []
    for k in range(1, parts):
        edge = k % per_shard == 0
        targets.append(_Target(total * k / parts, ideal * tolerance if edge else ideal / per_shard / 4, ideal * group_tolerance if edge else ideal / per_shard / 2))
    if not n:
        return [(0, 0, 0)] * (parts - 1), [0] * parts, [0] * parts
    for level in range(3):
        for left in range(WIDTH - BITS, -1, -BITS):
            live = [t for t in targets if t.bound is None and len(t.done) == level]
            if not live:
                break
            places = {p: k for k, p in enumerate(sorted({(*t.done, t.prefix) for t in live}))}
            names = [f"_k{j}" for j in range(level)]
            near = keyed.sparkSession.createDataFrame([(*p, k) for p, k in places.items()], ", ".join(f"{c} long" for c in [*names, "_p", "_i"]))
            rows = keyed if left + BITS >= WIDTH else keyed.withColumn("_p", F.shiftrightunsigned(f"_k{level}", left + BITS))
            rows = rows if "_p" in rows.columns else rows.withColumn("_p", F.lit(0).cast("long"))
            found = (  # the broadcast side has a row for each open splitter
                rows.join(F.broadcast(near), [*names, "_p"])
                .groupBy("_i", (F.shiftrightunsigned(f"_k{level}", left).bitwiseAND((1 << BITS) - 1)).alias("_d"))
                .agg(F.sum("_w").alias("w"), F.count("*").alias("n"))
                .collect()
            )
            by: dict[int, list[tuple[int, int, int]]] = {}
            for r in sorted(found):
                by.setdefault(r["_i"], []).append((r["_d"], r["w"], r["n"]))
            for t in live:
                _settle(t, level, left, by[places[(*t.done, t.prefix)]])
    order = sorted(targets, key=lambda t: t.bound)
    return [t.bound for t in order], [0, *(t.rows for t in order)], [0, *(t.below for t in order)]


def shard(
    docs: DataFrame, shards: int = 8, text: str = "text", id: str = "doc_id", keep: list[str] | None = None, per_shard: int = 16, tolerance: float = 0.002, group_tolerance: float = 0.02
) -> DataFrame:
    """Deal ``docs`` into ``shards`` of nearly equal bytes, and number the rows of each.

    Adds size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32 (unsigned, of the UTF-8 bytes; a null
    text counts as empty), shard, and slot (0, 1, ... without gaps in each shard). Columns of ``docs`` (or those in
    ``keep``) stay; of the same names as an added one, the added one wins. A group of equal texts stays in one shard
    where that moves a boundary by at most ``group_tolerance`` of a shard, and is split by id otherwise; repeated rows
    are rows of their own. An empty table gives an empty one."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))  # no name of theirs can clash
    text, id = f"`{text}`", f"`{id}`"
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    half = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    keyed = materialise(
        docs.select(
            whole.alias("_row"), (F.octet_length(data) + 1).cast("long").alias("_w"), F.crc32(data).alias("_crc"), half(F.col(text), F.col(text).isNull()).alias("_k0"), half(F.col(id)).alias("_k1"), F.monotonically_increasing_id().alias("_k2")
        )
    )
    bounds, rows_before, _ = splitters(keyed.select("_w", "_k0", "_k1", "_k2"), shards, per_shard, tolerance, group_tolerance)
    key = F.struct("_k0", "_k1", "_k2")
    cuts = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"_k{j}") for j, x in enumerate(b)]) for b in bounds])
    ranged = keyed.withColumn("_r", F.size(F.filter(cuts, lambda c: c <= key)) if bounds else F.lit(0))
    base = F.array(*[F.lit(rows_before[k] - rows_before[k - k % per_shard]).cast("long") for k in range(shards * per_shard)])
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_k0", "_k1", "_k2"))
    return ranged.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        F.col("_w").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.floor(F.col("_r") / per_shard).cast("int").alias("shard"),
        (F.element_at(base, F.col("_r") + 1) + place - 1).alias("slot"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, keep=["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_law(spark, sf_dir: str) -> DataFrame:
    """One row on what ``op1`` promises: rows and bytes of all shards, whether slots are gapless, whether sizes are within 2 % of each other or one text."""
    each = op1(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("most"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    slack = F.greatest(0.02 * F.max("b"), F.max("most"))
    return each.agg(F.sum("n").alias("n_rows"), F.sum("b").alias("n_bytes"), F.bool_and((F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"), (F.max("b") - F.min("b") <= slack).alias("even"))
