"""Every point-cloud query against its SQL, or at least to its end with a stable schema."""

from __future__ import annotations

import oracle
import pytest

from timberline.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    sf = "/root/testdata/sf0.01" if name in ORACLES else sf  # rounding ties need as many rows as the driver's own check has
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert oracle.differences(df, ORACLES[name], sf) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    for r in rows:  # the design radius of tree k is 0.10 + 0.02 k
        assert abs(r["diameter_ls"] - (20 + 4 * int(r["cloud_id"][1:]))) < 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
