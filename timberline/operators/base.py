"""Statistics of groups attached to their rows by partial aggregates and a join, and the groups within an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, keys: list[str] | str, **stats: Column) -> DataFrame:
    """Add aggregates of each group to its rows.

    Unlike a window, this needs no group in one task: the aggregate is partial, its result has a row for each group, and
    the join is broadcast or split by the optimiser as sizes demand."""
    keys = [keys] if isinstance(keys, str) else keys
    found = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    renamed = found.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = df.join(renamed, on)
    return joined.drop(*[f"_of_{k}" for k in keys])


def begins(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """True at the first row of each run of equal values in the first ``keys`` columns; nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        column = batch.column(k)
        new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]).fill_null(False))
        new[1:] |= np.asarray(pc.xor(column[1:].is_null(), column[:-1].is_null()))
    return new


def pieces(batch: pa.RecordBatch, keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of a batch that is sorted by its first ``keys`` columns."""
    first = np.append(np.flatnonzero(begins(batch, keys)), batch.num_rows)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)
