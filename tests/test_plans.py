"""Shapes of physical plans that the operators rely on."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline import fixtures
from timberline.operators import normalize, spatial, voxel
from timberline.plans import trees


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_joins_are_equi_joins(spark, sf):
    v = fixtures.vectors(spark, sf)
    shape = plan(spatial.radius_join(v, v, 0.1))
    assert "NestedLoop" not in shape and "Cartesian" not in shape and ("HashJoin" in shape or "SortMergeJoin" in shape)


def test_statistics_are_joined_not_windowed(spark, sf):
    for df in (normalize.normalize_fields(fixtures.cloud(spark, sf)), normalize.tree_normalize(fixtures.cloud(spark, sf))):
        shape = plan(df)
        assert "Window" not in shape and "NestedLoop" not in shape and shape.count("partial_") >= 1


def test_scans_read_what_is_asked(spark, sf):
    shape = plan(voxel.voxelize(fixtures.cloud(spark, sf), 5.0).groupBy("vx").agg(F.count("*")))
    assert "l_quantity" in shape and "l_tax" not in shape and "l_shipdate" not in shape


def test_voxel_tables_sum_before_the_exchange(spark, sf):
    shape = plan(voxel.voxel_table(fixtures.cloud(spark, sf), 5.0))
    assert "partial_avg" in shape and shape.count("Exchange hashpartitioning") == 1 and "Python" not in shape


def test_closed_circle_fits_run_no_python(spark, sf):
    f = fixtures.forest(spark, sf)
    for method in ("kasa", "hyper"):
        assert "Pandas" not in plan(trees.breast_fits(f, method))
