"""Point clouds derived from the ``lineitem`` table. The SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINT_ID = "((l_orderkey*8+l_linenumber)*100000+l_partkey)*10000+l_suppkey"

CLOUD_SQL = f"""
select concat('c', cast(l_suppkey % 4 as string)) as cloud_id, {POINT_ID} as point_id,
 l_quantity as x, l_extendedprice/2000.0e0 as y, l_discount*100.0e0 as z, cast((l_partkey*37) % 10000 as double) as intensity,
 cast(l_partkey % 256 as int) as r, cast(l_suppkey % 256 as int) as g, cast(l_orderkey % 256 as int) as b,
 cast(l_linenumber % 3 as double) as original_cloud_index, cast(l_orderkey % 86400 as double) as gps_time, l_tax*100.0e0 as illuminance,
 l_discount*10.0e0 as nx, l_tax*10.0e0 as ny, 1.0e0 as nz from lineitem"""

FOREST_SQL = """
select concat('t', cast(tree_id as string)) as cloud_id, point_id, 10.0e0*tree_key + 0.02e0*z + rad*cos(th) as x, 5.0e0*tree_key + rad*sin(th) as y, z, intensity,
 cast(case when trunk=1 then 0 else 1 end as double) as original_cloud_index from (
 select tree_id, tree_key, point_id, th, z, trunk, case when trunk=1 then 0.10e0+0.02e0*tree_key else 0.8e0+((h*17) % 100)/200.0e0 end as rad,
 case when trunk=1 then 6000.0e0+(h % 500) else 2000.0e0+(h % 500) end as intensity from (
 select {tree} as tree_id, cast(l_suppkey % 5 as int) as tree_key, {pid} as point_id, (l_orderkey*131+l_linenumber*29+l_partkey*7) as h,
 2.0e0*pi()*((l_partkey*37+l_orderkey*11+l_linenumber*101) % 360)/360.0e0 as th, ((l_orderkey*13+l_linenumber*71+l_partkey*3) % 1500)/100.0e0 as z,
 case when ((l_orderkey*13+l_linenumber*71+l_partkey*3) % 1500) < 500 then 1 else 0 end as trunk from lineitem) a) b"""



def vectors_sql(first: int = 1, element: str = "element_at") -> str:
    """Three dimensions of all vectors as one cloud."""
    places = ", ".join(f"cast({element}(embedding, {first + k}) as double) as {c}" for k, c in enumerate("xyz"))
    return f"select 'v' as cloud_id, vec_id as point_id, {places} from embeddings"


def forest_sql(trees: int | None = 5) -> str:
    """Leaning cylinders with canopies; one tree for each supplier if ``trees`` is None."""
    return FOREST_SQL.format(tree="l_suppkey" if trees is None else f"cast(l_suppkey % {trees} as int)", pid=POINT_ID)


def grove_sql() -> str:
    """The forest with a bright shrub of a trunk's foot beside each tree, so that there is more than one cluster to choose from."""
    f = f"({forest_sql()}) f"
    return f"select * from {f} union all select cloud_id, -1 - point_id as point_id, x + 1.5e0 as x, y, z, 6000.0e0 as intensity, 2.0e0 as original_cloud_index from {f} where intensity >= 5000.0e0 and z < 1.0e0"


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", CLOUD_SQL)


def forest(spark: SparkSession, sf_dir: str, trees: int | None = 5) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", forest_sql(trees))


def grove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", grove_sql())


def vectors(spark: SparkSession, sf_dir: str, first: int = 1) -> DataFrame:
    return _view(spark, sf_dir, "embeddings", vectors_sql(first))
