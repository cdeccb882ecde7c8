from __future__ import annotations

from timberline import fixtures
from timberline.operators.points import intensity_cut
from timberline.operators.voxel import voxel_table, voxelize
from timberline.schema import conform
from timberline.streaming.clouds import stream_points, stream_voxels


def test_running_voxel_table(spark, sf, tmp_path):
    points = conform(fixtures.cloud(spark, sf))
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_points(spark, str(tmp_path / "in"), 1)
    assert voxelize(intensity_cut(stream), 1.0).isStreaming
    query = stream_voxels(stream, 5.0, str(tmp_path / "state"), "running_voxels")
    query.processAllAvailable()
    query.stop()
    keys = ["cloud_id", "vx", "vy", "vz", "num_points", "label"]
    got = sorted(map(tuple, spark.table("running_voxels").select(*keys).collect()))
    assert got == sorted(map(tuple, voxel_table(points, 5.0).select(*keys).collect()))
