"""Numerical kernels against brute force, file formats by round trips, and edge cases."""

from __future__ import annotations

import io
import math
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline import scoring
from timberline.operators import circle, clustering, normalize, points, sampling, spatial, voxel
from timberline.plans import trees
from timberline.schema import POINT_SCHEMA, conform, fill_missing, with_name
from timberline.sources import files, las, lzf, pcd

RNG = np.random.default_rng(5)


def frame(spark, xyz, cloud="a", **more):
    rows = [{"cloud_id": cloud, "point_id": k, "x": float(p[0]), "y": float(p[1]), "z": float(p[2]), **{n: v[k] for n, v in more.items()}} for k, p in enumerate(xyz)]
    return conform(spark.createDataFrame(rows)) if rows else spark.createDataFrame([], POINT_SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=600))
def test_lzf_round_trip(raw):
    assert lzf.decompress(lzf.compress(raw), len(raw)) == raw


def test_lzf_forgets_what_is_out_of_reach():
    import tracemalloc

    raw = np.random.default_rng(5).integers(0, 256, 200_000, np.uint8).tobytes() + bytes(30_000) + b"abcd" * 9000
    tracemalloc.start()
    packed = lzf.compress(raw)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lzf.decompress(packed, len(raw)) == raw and most < 5e6


def test_lzf_shrinks_repeats():
    raw = b"leaning cylinder " * 500
    assert len(lzf.compress(raw)) < len(raw) / 10
    with pytest.raises(ValueError):
        lzf.decompress(b"\x20\xff", 3)


@pytest.mark.parametrize("data", pcd.ENCODINGS)
def test_pcd_round_trip(data):
    records = np.zeros(7, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("label", "u1"), ("t", "<f8"), ("n", "<i4")])
    for name in records.dtype.names:
        records[name] = RNG.normal(size=7) * 40 if records.dtype[name].kind == "f" else RNG.integers(0, 200, 7)
    back, meta = pcd.decode(pcd.encode(records, data, viewpoint=[0, 0, 0, 1, -1, 0, 0]))
    assert meta["viewpoint"][4] == -1 and meta["points"] == 7
    for name in records.dtype.names:
        np.testing.assert_allclose(back[name], records[name], rtol=1e-9 if data != "ascii" else 1e-6)


def test_pcd_incompressible_block_and_counts():
    records = np.frombuffer(RNG.bytes(400), [("x", "<f4")]).copy()
    back, _ = pcd.decode(pcd.encode(records, "binary_compressed"))
    assert back.tobytes() == records.tobytes()
    head = "VERSION .7\nFIELDS x n\nSIZE 4 4\nTYPE F F\nCOUNT 1 3\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n1 2 3 4\n"
    got, _ = pcd.decode(head.encode())
    assert got.dtype.names == ("x", "n_0000", "n_0001", "n_0002") and got[0].tolist() == (1, 2, 3, 4)


@pytest.mark.parametrize("raw", [b"VERSION .7\nFIELDS x\n", b"FIELDS x\nSIZE 4\nTYPE F\nWIDTH 2\nHEIGHT 1\nPOINTS 3\nDATA ascii\n1\n2\n3\n", b"FIELDS x\nSIZE 3\nTYPE F\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA binary\nabcd"])
def test_pcd_errors(raw):
    with pytest.raises(ValueError):
        pcd.decode(raw)


def test_pcd_label_kinds_and_colors():
    assert pcd.xyz_label_records(np.ones((2, 4)), "u").dtype["label"] == np.uint8
    with pytest.raises(ValueError):
        pcd.xyz_rgb_records(np.ones((2, 3), np.float32))
    r, g, b = (RNG.integers(0, 256, 50) for _ in range(3))
    assert all((x == y).all() for x, y in zip(pcd.unpack_colors(pcd.pack_colors(r, g, b)), (r, g, b), strict=True))


def test_las_round_trip_and_empty():
    n = 40
    columns = {c: RNG.normal(size=n) * 100 for c in "xyz"} | {"intensity": RNG.integers(0, 9000, n), "r": RNG.integers(0, 256, n), "g": RNG.integers(0, 256, n), "b": RNG.integers(0, 256, n), "gps_time": RNG.normal(size=n) * 1e6, "illuminance": RNG.random(n).astype(np.float32)}
    back = las.decode(las.encode(columns))
    assert np.abs(back["x"] - columns["x"]).max() <= 0.00051 and (back["red"] == columns["r"]).all() and (back["gps_time"] == columns["gps_time"]).all() and (back["illuminance"] == columns["illuminance"]).all()
    assert len(las.decode(las.encode({c: np.zeros(0) for c in "xyz"}))["x"]) == 0
    with pytest.raises(ValueError):
        las.decode(b"nothing")


def test_readers_and_dispatch(spark, tmp_path):
    (tmp_path / "t.one.txt").write_text("//X Y Z Intensity Gps_Time\n1 2 3 4 5\n6 7 8 9 10\n")
    got = files.read_cloud(spark, str(tmp_path / "t.one.txt")).orderBy("point_id").collect()
    assert [(r.cloud_id, r.x, r.intensity, r.gps_time, r.illuminance, r.r) for r in got] == [("t", 1, 4, 5, 0, 0), ("t", 6, 9, 10, 0, 0)]
    (tmp_path / "plain.txt").write_text("1 2 3 4 5 6 7 8 9 10\n2 2 3\n")
    got = files.read_cloud(spark, str(tmp_path / "plain.txt"), pad=False).orderBy("point_id").collect()
    assert [(r.x, r.gps_time, r.illuminance) for r in got] == [(1, 9, 10), (2, None, None)]
    with pytest.raises(ValueError):
        files.read_cloud(spark, "cloud.xyz")
    with pytest.raises(ValueError):
        files.write_cloud(frame(spark, [(0, 0, 0)]), str(tmp_path / "c.ply"))
    files.write_cloud(frame(spark, []), str(tmp_path / "none.pcd"))
    assert files.read_cloud(spark, str(tmp_path / "none.pcd")).count() == 0
    files.write_cloud(frame(spark, [(1, 2, 3), (4, 5, 6)]), str(tmp_path / "two.csv"))
    assert [r.x for r in files.read_cloud(spark, str(tmp_path / "two.csv")).orderBy("point_id").collect()] == [1, 4]
    (tmp_path / "a.csv").write_text("x,y,z,Intensity\n1,2,3,4\n5,6,7,8\n")
    (tmp_path / "b.csv").write_text("Intensity,x,other,y,z\n9,1,0,2,3\n")
    got = sorted((r.cloud_id, r.point_id, r.x, r.y, r.z, r.intensity) for r in files.read_cloud(spark, str(tmp_path / "[ab].csv")).collect())
    assert got == [("a", 0, 1, 2, 3, 4), ("a", 1, 5, 6, 7, 8), ("b", 0, 1, 2, 3, 9)]
    for kind in ("laz", "h5"):
        try:
            __import__({"laz": "laspy", "h5": "h5py"}[kind])
        except ImportError:
            with pytest.raises(Exception, match="laspy|h5py"):
                files.write_cloud(frame(spark, [(1, 2, 3)]), str(tmp_path / f"c.{kind}"))


@pytest.mark.parametrize("kind", ["csv", "txt"])
def test_lines_are_numbered_across_blocks(spark, tmp_path, kind):
    head = {"csv": "x,y,z\n", "txt": "//X Y Z\n"}[kind]
    sep = {"csv": ",", "txt": " "}[kind]
    for name, n in (("long", 3000), ("short", 7)):
        (tmp_path / f"{name}.{kind}").write_text(head + "".join(f"{k}{sep}0{sep}0\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = files.read_cloud(spark, f"{tmp_path}/*.{kind}").select("cloud_id", "point_id", "x").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3007 and all(r.point_id == r.x for r in got)


def test_ascii_pcd_files_are_read_by_lines(spark, tmp_path, monkeypatch):
    head = "# .PCD\n\nVERSION .7\nFIELDS x y z label\nSIZE 4 4 4 {s}\nTYPE F F F {t}\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA ascii\n"
    rows = "".join(f"{k} {k / 7:.10e} 0 1\n" + "\n# a note\n" * (k % 500 == 0) for k in range(3000))
    (tmp_path / "long.a.pcd").write_text(head.format(n=3000, s=4, t="F") + rows + "surplus\n")
    (tmp_path / "odd name.pcd").write_text(head.format(n=3, s=1, t="U") + " 0\t1  nan 5\r\n1 1 inf 6 # end\r\n2 -1 2 255\r\n7 7 7 7")
    (tmp_path / "none.pcd").write_text(head.format(n=0, s=4, t="F"))
    (tmp_path / "binary.pcd").write_bytes(pcd.encode(pcd.xyz_records(np.arange(6.0).reshape(2, 3)), "binary"))
    plain = {p.name: files._from_pcd(p.read_bytes()) for p in tmp_path.glob("*.pcd")}
    decoded, split = [], pcd.split_file
    monkeypatch.setattr(pcd, "split_file", lambda raw: decoded.append(len(raw)) or split(raw))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = files.read_cloud(spark, f"{tmp_path}/*.pcd")
        assert files.read_cloud(spark, f"{tmp_path}/long.a.pcd").rdd.getNumPartitions() > 10
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert max(decoded) < 300  # only headers were looked at here
    for name, columns in plain.items():
        own = sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.point_id)
        assert [r.point_id for r in own] == list(range(len(columns["x"]))) and {r.cloud_id for r in own} <= {name.split(".")[0]}
        for c in "xyz":
            assert [getattr(r, c) for r in own] == columns[c].tolist()
    (tmp_path / "short.pcd").write_text(head.format(n=3, s=4, t="F") + "1 2 3 4\n")
    with pytest.raises(Exception, match="holds 1 points, its header says 3"):
        files.read_cloud(spark, f"{tmp_path}/short.pcd").collect()
    (tmp_path / "headless.pcd").write_text("VERSION .7\nFIELDS x\n")
    with pytest.raises(ValueError, match="DATA"):
        files.read_cloud(spark, f"{tmp_path}/headless.pcd")


def test_ascii_body_as_numpy_reads_and_writes_it():
    records = np.zeros(9000, [("x", "<f4"), ("y", "<f8"), ("n", "u1")])
    records["x"], records["y"], records["n"] = RNG.normal(size=9000), RNG.normal(size=9000) * 1e300, RNG.integers(0, 256, 9000)
    records["x"][:4] = [np.nan, np.inf, -np.inf, 1e-42]
    out = io.StringIO()
    np.savetxt(out, np.array(records.tolist(), object), fmt=["%.10e", "%.10e", "%d"])
    assert pcd.text_body(records) == out.getvalue().encode()
    floats = records[["x", "y"]].astype([("x", "<f4"), ("y", "<f8")])
    body = pcd.text_body(floats)
    for text in (body, body.replace(b" ", b"\t")):
        back = pcd.text_records(text, floats.dtype, 8999)
        wanted = np.loadtxt(io.BytesIO(body), max_rows=8999)
        assert len(back) == 8999 and np.array_equal(back["y"], wanted[:, 1]) and np.array_equal(back["x"], wanted[:, 0].astype("f4"), equal_nan=True)


@pytest.mark.parametrize(("kind", "options"), [("txt", {}), ("csv", {}), ("pcd", {"data": "ascii"}), ("pcd", {"data": "binary"})])
def test_files_are_written_as_rows_come(kind, options):
    given, taken = [{c: np.arange(3.0) + 3 * k for c in "xyz"} for k in range(4)], []
    pieces = files.STREAMED[kind]((taken.append(p) or p for p in given), 12, **options)
    first = next(pieces)
    assert len(taken) <= 1
    whole = {c: np.arange(12.0) for c in "xyz"}
    assert first + b"".join(pieces) == files.ENCODERS[kind](whole, **options)


def test_clouds_are_dealt_evenly_to_tasks(spark, tmp_path):
    several = frame(spark, [(k, 0, 0) for k in range(60)]).withColumns({"point_id": -F.col("x").cast("long"), "cloud_id": F.concat(F.lit("c"), (F.col("x") % 6).cast("int").cast("string"))})
    for n, most in ((4, 1), (6, 2)):
        own = several.where(F.col("x") % 6 < n).withColumn("cloud_id", F.when(F.col("cloud_id") != "c0", F.col("cloud_id")))
        done = files._write_streamed(own, lambda cloud: f"{tmp_path}/{n}/{cloud}.txt", "txt", {}).withColumn("task", F.spark_partition_id()).collect()  # noqa: B023
        tasks = [r.task for r in done]
        assert len(done) == n and len(set(tasks)) == 4 and max(tasks.count(t) for t in tasks) == most
        got = files.read_cloud(spark, f"{tmp_path}/{n}/*.txt").orderBy("cloud_id", "point_id").collect()
        assert [(r.cloud_id, r.x) for r in got] == [(c, x) for c, k in sorted([("None", 0), *((f"c{k}", k) for k in range(1, n))]) for x in range(54 + k, -1, -6)]


@pytest.mark.parametrize("kind", ["txt", "csv", "pcd"])
def test_written_clouds_by_id_and_place(spark, tmp_path, kind):
    both = frame(spark, [(k % 7, 50 - k, k) for k in range(50)], cloud="a").withColumn("intensity", F.lit(2.0)).unionByName(frame(spark, [(1, 2, 3)], cloud="b").withColumn("intensity", F.lit(None).cast("double")))
    done = files.write_clouds(both.withColumn("point_id", F.lit(1)), str(tmp_path), kind).collect()
    assert sorted((r.cloud_id, r.points) for r in done) == [("a", 50), ("b", 1)]
    got = [(r.x, r.y, r.z, r.intensity) for r in files.read_cloud(spark, f"{tmp_path}/a.{kind}").orderBy("point_id").collect()]
    assert got == sorted((k % 7, 50 - k, k, 2) for k in range(50))
    assert [(r.x, r.intensity) for r in files.read_cloud(spark, f"{tmp_path}/b.{kind}").collect()] == [(1, 0)]


def test_records_by_declared_types(spark, tmp_path):
    records = np.zeros(3, [("x", "<f4"), ("label", "u1"), ("big", "<u8")])
    records["label"], records["big"] = [1, 2, 255], [1, 2, 2**63]
    (tmp_path / "r.pcd").write_bytes(pcd.encode(records, "binary"))
    got = files.read_records(spark, str(tmp_path / "r.pcd")).orderBy("point_id").collect()
    assert [(r.label, int(r.big)) for r in got] == [(1, 1), (2, 2), (255, 2**63)]


def test_h5_and_laz_with_stand_ins(monkeypatch):
    import pickle
    import types

    class Held(dict):
        def __init__(self, at, mode):
            super().__init__(pickle.loads(at.getvalue()) if mode == "r" else {})
            self.at, self.mode = at, mode

        def __enter__(self):
            return self

        def __exit__(self, *_):
            if self.mode == "w":
                self.at.write(pickle.dumps(dict(self)))

    class Las:
        def __init__(self, raw):
            self.raw, self.fields = raw, las.decode(raw)
            self.fields |= {c: self.fields[c] * 256 for c in ("red", "green", "blue") if c in self.fields} | {c: self.fields[k] * 256 for c, k in (("red", "r"), ("green", "g"), ("blue", "b")) if k in self.fields}
            self.x, self.y, self.z = (self.fields[c] for c in "xyz")
            self.point_format = types.SimpleNamespace(dimension_names=list(self.fields))

        def __getitem__(self, name):
            return self.fields[name]

        def write(self, out, do_compress):
            assert do_compress
            out.write(self.raw)

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=Held))
    monkeypatch.setitem(sys.modules, "laspy", types.SimpleNamespace(read=lambda at: Las(at.getvalue())))
    columns = {c: np.array([1.0, 2.5, -3.0]) for c in "xyz"} | {c: np.array([0, 7, 255]) for c in "rgb"} | {"intensity": np.array([5.0, 6.0, 7.0]), "gps_time": np.array([1.0, 2.0, 3.0])}
    for write, read in ((files._to_h5, files._from_h5), (files._to_laz, files._from_laz)):
        got = read(write(columns))
        for c, want in columns.items():
            np.testing.assert_allclose(np.asarray(got[c], float), want, atol=1e-3, err_msg=c)


def test_headers_of_records(spark, tmp_path):
    (tmp_path / "h.pcd").write_bytes(pcd.encode(np.zeros(4, [("x", "<f4"), ("label", "u1")]), "binary"))
    r = files.read_headers(spark, str(tmp_path / "*.pcd")).first()
    assert (r.fields, r.types, r.points, r.data) == (["x", "label"], ["F4", "U1"], 4, "binary") and list(r.viewpoint) == [0, 0, 0, 1, 0, 0, 0]


def test_write_labels(spark, tmp_path):
    files.write_labels(spark.createDataFrame([(1.0, 2.0, 3.0, None), (1.0, 2.0, 3.0, 7)], "x double, y double, z double, label int"), str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["1.0000 2.0000 3.0000 1000", "1.0000 2.0000 3.0000 7"]


def test_edge_cases_of_frames(spark):
    one = frame(spark, [(1, 2, 3)])
    for f in (normalize.shift_to_zero, normalize.normalize_fields, normalize.shift_to_origin):
        assert f(one).select("x", "y").first() is not None
    assert normalize.tree_normalize(one).first().x is None  # no height: no scale
    assert normalize.minmax_normalize(frame(spark, [])).count() == 0
    twice = frame(spark, [(0.0, 1, 1), (-0.0, 1, 1), (math.nan, 1, 1), (math.nan, 1, 1)])
    assert [r.point_id for r in points.unique_points(twice).orderBy("point_id").collect()] == [0, 2]
    cells = voxel.voxelize(frame(spark, [(-0.1, 0, 0.99)]), 0.5).first()
    assert (cells.vx, cells.vy, cells.vz) == (-1, 0, 1)
    ties = frame(spark, [(0, 0, 0)] * 4, original_cloud_index=[2.0, 1.0, 2.0, 1.0])
    assert voxel.voxel_table(ties, 1.0).first().label == 1
    assert fill_missing(one).first().r == 0
    assert with_name(spark.createDataFrame([("/a/b/tree.7.las",)], "path string")).first().name == "tree"
    assert points.append(one, one).count() == 2 and points.append(one, one).agg(F.max("point_id")).first()[0] == 1
    with pytest.raises(ValueError):
        points.add_fields(one, one)
    with pytest.raises(ValueError):
        points.concatenate(one, one.drop("r"))


def test_rotations_keep_lengths(spark):
    xyz = RNG.normal(size=(50, 3))
    df = frame(spark, xyz)
    for turned in (sampling.rotate_y(df, seed=1), sampling.rotate_z(df, seed=2), sampling.rotate_perturbation(df, seed=3)):
        got = np.array([(r.x, r.y, r.z) for r in turned.orderBy("point_id").collect()])
        np.testing.assert_allclose(np.linalg.norm(got, axis=1), np.linalg.norm(xyz, axis=1))
        assert np.abs(got - xyz).max() > 0
    moved = sampling.jitter(df, seed=1).orderBy("point_id").collect()
    assert max(abs(r.x - p[0]) for r, p in zip(moved, xyz, strict=True)) <= 0.05
    assert sampling.scale(df, seed=4).count() == sampling.shift(df, seed=4).count() == sampling.dropout(df, seed=4).count() == 50
    assert [r.x for r in sampling.jitter(df.repartition(3), seed=1).orderBy("point_id").collect()] == [r.x for r in moved]


def test_farthest_points(spark):
    xyz = RNG.normal(size=(60, 3))
    got = sampling.farthest_indices(xyz, 20)
    left = np.full(60, 1e10)
    at = 0
    for k in range(20):
        assert got[k] == at
        left = np.minimum(left, ((xyz - xyz[at]) ** 2).sum(1))
        at = int(left.argmax())
    assert sampling.farthest_indices(xyz, 10).tolist() == got[:10].tolist()
    rows = sampling.farthest_points(frame(spark, xyz), 20).orderBy("rank").collect()
    assert [r.point_id for r in rows] == got.tolist()
    assert sampling.farthest_points(frame(spark, xyz[:3]), 5).count() == 5


def test_shuffles_of_many_points(spark):
    n = 300_000  # int positions times 7919 overflow from 271,179 on
    rows = spark.range(n).select(F.lit("a").alias("cloud_id"), F.lit(5).alias("point_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("id").cast("double").alias("z"))
    got = sampling.shuffle_points(rows, 7, lambda k: (k * 7919) % 104729).orderBy("point_id").select("z").toPandas()["z"].to_numpy()
    assert got.tolist() == sorted(range(n), key=lambda k: (k * 7919 % 104729, k))


def test_distance_joins_match_brute_force(spark):
    xyz = RNG.normal(size=(150, 3)) * [1, 1, 4]
    df = frame(spark, xyz)
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    got = {(r.query_id, r.point_id) for r in spatial.radius_join(df, df, 0.7).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(d2 <= 0.49), strict=True)}
    near = spatial.knn_join(df, df, 7).collect()
    for i in range(150):
        own = [r.point_id for r in sorted((r for r in near if r.query_id == i), key=lambda r: r.rank)]
        assert own == np.argsort(d2[i], kind="stable")[:7].tolist()
    few = frame(spark, xyz[:3])
    assert spatial.knn_join(few, few, 7).count() == 9
    lone = frame(spark, [(0, 0, 0), (100, 0, 0)])
    normals = spatial.estimate_normals(lone).collect()
    assert [(r.nx, r.ny, r.nz) for r in normals] == [(0, 0, 1)] * 2


@pytest.mark.parametrize("include_self", [True, False])
def test_neighbours_of_small_and_large_clouds_agree(spark, monkeypatch, include_self):
    both = frame(spark, np.round(RNG.random((120, 3)), 1), cloud="a").unionByName(frame(spark, RNG.random((30, 3)), cloud="b"))
    found = []
    for small in (0, 40, 1000):
        monkeypatch.setattr(spatial, "SMALL", small)
        found.append(sorted(map(tuple, spatial.knn_join(both, both, 6, include_self).select("cloud_id", "query_id", "point_id", "d2", "rank").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 900


def test_pairs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 7)
    xyz = RNG.random((40, 3))
    both = frame(spark, xyz).unionByName(frame(spark, xyz[:3], cloud="b"))
    pairs = spatial.pairwise_distance(both, both)
    got = sorted((r.cloud_id, r.query_id, r.point_id, round(r.d2, 9)) for r in pairs.collect())
    assert got == sorted((c, i, j, round(float(((xyz[i] - xyz[j]) ** 2).sum()), 9)) for c, n in (("a", 40), ("b", 3)) for i in range(n) for j in range(n))
    assert "_i" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_in_reach(spark):
    xyz = np.vstack((np.round(RNG.random((200, 3)), 1), np.zeros((40, 3))))  # ties and copies
    d2 = ((xyz[:, None, 0] - xyz[None, :, 0]) ** 2 + (xyz[:, None, 1] - xyz[None, :, 1]) ** 2) + (xyz[:, None, 2] - xyz[None, :, 2]) ** 2
    df = frame(spark, xyz).unionByName(frame(spark, [(float("nan"), 0, 0)], cloud="b"))
    near = spatial.nearest_in_reach(df, df, 0.3, 9)
    got = sorted((r.query_id, r.point_id) for r in near.collect())
    assert got == sorted((i, int(j)) for i in range(240) for j in np.argsort(d2[i], kind="stable")[:9] if d2[i, j] <= 0.3 * 0.3)
    assert "Window" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_normals_of_a_plane(spark):
    flat = np.column_stack((RNG.random((80, 2)) * 0.3, np.zeros(80)))
    for r in spatial.estimate_normals(frame(spark, flat), 0.2).collect():
        assert abs(r.nz - 1) < 1e-9


def test_outlier_factors(spark):
    xyz = np.vstack((RNG.normal(size=(60, 3)), [[30, 30, 30]]))
    rows = {r.point_id: r.lof for r in spatial.local_outlier_factors(frame(spark, xyz), 10).collect()}
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    near = np.argsort(d, 1, kind="stable")[:, 1:11]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(1) + 1e-10)
    np.testing.assert_allclose([rows[k] for k in range(61)], lrd[near].mean(1) / lrd, rtol=1e-9)
    kept = {r.point_id for r in spatial.lof_inliers(frame(spark, xyz), 10).collect()}
    assert 60 not in kept and len(kept) in (54, 55)


def test_circles(spark):
    angle = RNG.random(200) * 2 * np.pi
    noisy = 0.2 + RNG.normal(size=200) * 0.003
    xyz = np.column_stack((3 + noisy * np.cos(angle), -1 + noisy * np.sin(angle), np.zeros(200)))
    for method in circle.FITS:
        r = circle.circles(frame(spark, xyz), ["cloud_id"], method).first()
        assert abs(r.r - 0.2) < 0.002 and abs(r.xc - 3) < 0.002 and r.n == 200
    for bad in (xyz[:2], [(k, 2 * k, 0) for k in range(5)], [(1, 1, 0)] * 5):
        for method in circle.FITS:
            assert circle.circles(frame(spark, bad), ["cloud_id"], method).first().r is None


def test_geometric_fits_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(circle, "TOGETHER", 40)
    rows, want = [], {}
    for k in range(60):
        n = int(RNG.integers(1, 30))
        a, r = RNG.random(n) * 2 * np.pi, 0.1 + 0.01 * k
        own = np.column_stack((k + r * np.cos(a) + RNG.normal(size=n) * 0.01, r * np.sin(a) + RNG.normal(size=n) * 0.01))
        rows += [(None if k == 7 else f"c{k % 10}", k, float(x), float(y)) for x, y in own]
        want[k] = circle.geometric_circle(own[:, 0], own[:, 1])
    got = circle.least_squares(spark.createDataFrame(rows, "cloud_id string, layer int, x double, y double").repartition(3), ["cloud_id", "layer"]).collect()
    assert len(got) == 60
    for r in got:
        assert (r.r is None) == (want[r.layer] is None)
        if r.r is not None:
            assert np.allclose((r.xc, r.yc, r.r), want[r.layer], rtol=1e-6, atol=1e-6)


def test_clusters():
    blobs = np.vstack([RNG.normal(size=(80, 3)) * 0.1 + c for c in ([0, 0, 0], [3, 0, 0], [0, 4, 0])] + [RNG.random((10, 3)) * 20 - 10])
    labels = clustering.hdbscan(blobs, 10)
    for k in range(3):
        own = labels[80 * k : 80 * k + 80]
        assert (own == np.bincount(own[own >= 0]).argmax()).mean() > 0.85
    assert len(set(labels[:240]) - {-1}) == 3 and (labels[240:] == -1).mean() > 0.5
    assert (clustering.hdbscan(blobs[:15], 10) == -1).all()
    moved = blobs + np.array([512345.0, 5412345.0, 300.0])
    d = np.sort(np.sqrt(((blobs[:, None] - blobs[None]) ** 2).sum(2)), 1)[:, 10]
    assert np.abs(clustering.core_distances(moved, 10) - d).max() < 1e-6
    assert (clustering.hdbscan(moved, 10) == labels).all()
    assert (clustering.hdbscan(np.zeros((40, 3)), 10) >= -1).all()


def _tree(radius=0.15, lean=0.02, n=1500, height=4.9, at=(0, 0)):
    z = RNG.random(n) * height
    a = RNG.random(n) * 2 * np.pi
    return np.column_stack((at[0] + lean * z + radius * np.cos(a), at[1] + radius * np.sin(a), z))


def test_inventory_finds_the_trunk(spark):
    trunk, shrub = _tree(), np.column_stack((RNG.normal(size=(150, 2)) * 0.1 + [1.5, 0], RNG.random(150)))
    crown = RNG.normal(size=(300, 3)) + [0, 0, 9]
    xyz = np.vstack((trunk, shrub, crown))
    light = [6000.0] * (len(trunk) + len(shrub)) + [100.0] * len(crown)
    row = trees.inventory(frame(spark, xyz, cloud="t", intensity=light)).first()
    assert row.status == "ok" and abs(row.diameter_hls - 30) < 1.5 and abs(row.diameter_ls - 30) < 1.5
    assert abs(row.coord_x) < 0.03 and 0.5 < row.lean_deg < 3.5 and row.height > 9
    broken = frame(spark, [(float("nan"), 0, 1.0)] * 30, cloud="b", intensity=[6000.0] * 30)
    both = {r.cloud_id: r.status for r in trees.trunk_slice(frame(spark, xyz, cloud="t", intensity=light).unionByName(broken))[1].collect()}
    assert both == {"t": "ok", "b": "error"}
    none = trees.inventory(frame(spark, crown, cloud="t", intensity=[100.0] * 300)).first()
    assert none.status == "no_points" and none.diameter_ls is None


def test_lean_windows(spark):
    df = frame(spark, _tree(n=6000))
    exact = trees.lean(df, "kasa", exact=True).first().lean_deg
    wide = trees.lean(df, "kasa").first().lean_deg
    assert abs(exact - math.degrees(math.atan(0.02))) < 0.15
    assert abs(wide - math.degrees(math.atan(0.03))) < 0.25


def test_network_shapes_and_fold():
    arrays, width = {}, 3
    for k, (_, _, _, widths) in enumerate(scoring.ABSTRACTIONS, 1):
        for j, w in enumerate(widths):
            arrays[f"sa{k}.{j}.weight"], arrays[f"sa{k}.{j}.bias"] = RNG.normal(size=(w, width)) * 0.2, np.zeros(w)
            width = w
        width += 3
    width -= 3
    for j, w in enumerate([*scoring.DENSE, 2], 1):
        arrays[f"fc{j}.weight"], arrays[f"fc{j}.bias"] = RNG.normal(size=(w, width)) * 0.05, np.zeros(w)
        width = w
    net = scoring.PointNet(arrays)
    xyz = scoring.tree_normalized(RNG.normal(size=(600, 3)))
    assert net.features(xyz).shape == (1024,) and abs(np.exp(net.log_probabilities(xyz)).sum() - 1) < 1e-9 and 0 < net(xyz) < 1
    w, b = scoring.fold(np.ones((2, 3)), np.zeros(2), np.ones(2), np.full(2, 4.0), np.full(2, 2.0), np.full(2, 5.0))
    np.testing.assert_allclose(w, 1, rtol=1e-4)
    np.testing.assert_allclose(b, 4, rtol=1e-4)
    assert scoring.geometric_score(_tree()) > scoring.geometric_score(RNG.normal(size=(400, 3)))
    assert abs(scoring.nll_loss(np.log(np.array([[0.5, 0.5]])), np.array([1])) - math.log(2)) < 1e-12


def test_ball_query_fill(spark):
    df = frame(spark, [(0, 0, 0), (0.05, 0, 0), (5, 5, 5)])
    got = {}
    for r in spatial.ball_query(df, df, 0.1, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.point_id)
    assert got == {0: [0, 1, 0], 1: [0, 1, 0], 2: [2, 2, 2]}


def test_multi_scale_and_propagation():
    places, points = RNG.normal(size=(50, 3)), RNG.normal(size=(50, 4))
    layer = lambda w, n: [(RNG.normal(size=(w, n)), np.zeros(w))]
    centres, out = scoring.multi_scale_abstraction(places, points, 8, [(0.5, 4, layer(5, 7)), (1.0, 8, layer(6, 7))])
    assert centres.shape == (8, 3) and out.shape == (8, 11) and (out >= 0).all()
    carried = scoring.propagate_features(places, None, centres, out, [(np.eye(11), np.zeros(11))])
    at = [int(np.flatnonzero((places == c).all(1))[0]) for c in centres]
    np.testing.assert_allclose(carried[at], out, rtol=1e-3, atol=1e-3)
    assert scoring.propagate_features(places, points, centres[:1], out[:1], layer(3, 15)).shape == (50, 3)
    assert scoring.group_features(places, points, 8, 0.5, 4)[1].shape == (8, 4, 7)


def test_clouds_as_bytes_and_text(spark, tmp_path):
    df = frame(spark, [(1, 2, 3), (4, 5, 6)], cloud="c")
    packed = files.encode_clouds(df, "pcd", data="ascii").withColumn("path", F.concat("cloud_id", F.lit(".pcd")))
    assert [(r.cloud_id, r.x) for r in files.decode_column(packed, "pcd").orderBy("point_id").collect()] == [("c", 1), ("c", 4)]
    files.write_records_text(df.select("point_id", "x"), str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["0 1.0000000000e+00", "1 4.0000000000e+00", "point_id x"]
