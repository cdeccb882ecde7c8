"""Readers and writers of point clouds by file suffix.

Binary formats are read with one task for a file (``binaryFile`` and Arrow batches); text formats, PCD files with ascii data
among them, by Spark's own readers, block by block.
A cloud is one file, so a writer brings the rows of a cloud into one task; clouds are written side by side. Text and PCD
files are written as the sorted rows come in, so that no cloud has to fit the memory of its task."""

from __future__ import annotations

import contextlib
import io
import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from timberline.operators.base import pieces
from timberline.schema import FLAT_COLUMNS, POINT_SCHEMA, conform, fill_missing
from timberline.sources import las, pcd

#: The names that each format gives to the fields.
PCD_NAMES = {"intensity": "Intensity", "original_cloud_index": "Original_cloud_index", "gps_time": "GpsTime", "illuminance": "Illuminance"}
CSV_NAMES = {"x": "x", "y": "y", "z": "z", "intensity": "Intensity", "illuminance": "Illuminance", "gps_time": "GpsTime", "original_cloud_index": "Original_cloud_index", "r": "red", "g": "green", "b": "blue"}
TXT_NAMES = {"x": "X", "y": "Y", "z": "Z", "intensity": "Intensity", "r": "R", "g": "G", "b": "B", "original_cloud_index": "Original_cloud_index", "gps_time": "GpsTime", "illuminance": "Illuminance_(PCV)"}
CSV_NAMES_BACK = [(stored, name) for name, stored in CSV_NAMES.items()]
LAS_NAMES = {"r": "red", "g": "green", "b": "blue", "original_cloud_index": "point_source_id"}
SUFFIXES = ("pcd", "las", "laz", "csv", "txt", "h5")
BATCH = 65536
#: Bytes of a PCD file that are read first for its header, and the most that are looked through for one.
HEAD_BYTES, HEAD_MOST = 1 << 16, 1 << 24
#: A line of an ascii file that is neither empty nor a comment.
DATA_LINE = r"^\s*[^\s#]"


def _suffix(path: str) -> str:
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind not in SUFFIXES:
        raise ValueError(f"no reader or writer for {path}: one of {', '.join(SUFFIXES)} is expected")
    return kind


def _from_pcd(raw: bytes) -> dict[str, np.ndarray]:
    return _of_records(pcd.decode(raw)[0])


def _of_records(records: np.ndarray) -> dict[str, np.ndarray]:
    out = {c: records[c] for c in "xyz"}
    for name, stored in PCD_NAMES.items():
        if stored in records.dtype.names:
            out[name] = records[stored]
    if "rgb" in records.dtype.names:
        out |= dict(zip("rgb", pcd.unpack_colors(records["rgb"]), strict=True))
    for c, stored in (("nx", "normal_x"), ("ny", "normal_y"), ("nz", "normal_z")):
        if stored in records.dtype.names:
            out[c] = records[stored]
    return {k: np.nan_to_num(np.asarray(v, float)) for k, v in out.items()}


def _from_las(raw: bytes) -> dict[str, np.ndarray]:
    found = las.decode(raw)
    names = {v: k for k, v in LAS_NAMES.items()}
    return {names.get(k, k): v for k, v in found.items() if names.get(k, k) in POINT_SCHEMA.names}


def _from_laz(raw: bytes) -> dict[str, np.ndarray]:
    try:
        import laspy
    except ImportError as missing:
        raise ImportError("LAZ files need the library laspy with a LAZ backend") from missing
    held = laspy.read(io.BytesIO(raw))
    have = set(held.point_format.dimension_names)
    out = {c: np.asarray(getattr(held, c)) for c in "xyz"}
    for name in ("intensity", "gps_time", "illuminance"):
        if name in have:
            out[name] = np.asarray(held[name])
    for name, stored in LAS_NAMES.items():
        if stored in have:
            out[name] = np.asarray(held[stored]) // (256 if name in "rgb" else 1)
    return out


def _from_h5(raw: bytes) -> dict[str, np.ndarray]:
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("HDF5 files need the library h5py") from missing
    with h5py.File(io.BytesIO(raw), "r") as held:
        out = dict(zip("xyz", np.asarray(held["points"]).T, strict=True))
        if "rgb" in held:
            out |= dict(zip("rgb", np.asarray(held["rgb"]).T, strict=True))
        return out | {k: np.asarray(held[v]) for k, v in PCD_NAMES.items() if v in held}


DECODERS: dict[str, Callable[[bytes], dict[str, np.ndarray]]] = {"pcd": _from_pcd, "las": _from_las, "laz": _from_laz, "h5": _from_h5}


def _batches(columns: dict[str, np.ndarray], cloud: str, path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n = len(columns["x"])
    for at in range(0, n, BATCH):
        size = min(BATCH, n - at)
        arrays = []
        for f in schema:
            if f.name == "cloud_id":
                arrays.append(pa.array([cloud] * size, f.type))
            elif f.name == "path":
                arrays.append(pa.array([path] * size, f.type))
            elif f.name in columns:
                arrays.append(pa.array(np.asarray(columns[f.name][at : at + size])).cast(f.type, safe=False))
            elif f.name == "point_id":
                arrays.append(pa.array(np.arange(at, at + size), f.type))
            else:
                arrays.append(pa.nulls(size, f.type))
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


READ_SCHEMA = POINT_SCHEMA.simpleString()[len("struct<") : -1].replace(":", " ") + ", path string"


def decode_column(files: DataFrame, kind: str, path: str = "path", content: str = "content") -> DataFrame:
    """Points of files held in a binary column, in the point schema with their path; cloud_id is the base name up to the first dot."""
    decode = DECODERS[kind]
    schema = to_arrow_schema(POINT_SCHEMA).append(pa.field("path", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                name = batch.column(0)[k].as_py()
                yield from _batches(decode(batch.column(1)[k].as_py()), os.path.basename(name).split(".")[0], name, schema)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, READ_SCHEMA)



def _numbered(lines: DataFrame, total: str | None = None) -> DataFrame:
    """Add path and the position of each line in its file, and by the name ``total`` how many lines the file has.

    Lines of a block follow each other in one task, so their place in the block is a difference of row numbers; a row for
    each block (path, first byte) then tells how many lines come before it. No file is sorted, and none has to fit a task."""
    held = lines.withColumns({"path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
    blocks = held.groupBy("path", "_block").agg(F.min("_row").alias("_least"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    of_file = [F.sum("_n").over(Window.partitionBy("path")).alias(total)] if total else []
    before = blocks.select(F.col("path").alias("_path"), F.col("_block").alias("_at"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_least")).alias("_shift"), *of_file)
    joined = held.join(F.broadcast(before), (F.col("path") == F.col("_path")) & (F.col("_block") == F.col("_at")))
    # ``before`` is broadcast: a join by path would move every line, those of a file into one task
    return joined.withColumn("point_id", (F.col("_row") + F.col("_shift")).cast("long")).drop("_block", "_row", "_path", "_at", "_shift")


def _cloud_of(path: str = "path"):
    return F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0]


def _heads(lines: DataFrame) -> DataFrame:
    """First line of each file: path, head. Only blocks that begin a file are looked at."""
    first = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).where("block = 0")
    return first.groupBy("path").agg(F.min_by("value", "row").alias("head"))


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files are read by their own headers: those of one header together."""
    heads: dict[str, list[str]] = {}
    for r in _heads(spark.read.text(path)).collect():  # a row for each file
        heads.setdefault(r["head"].removeprefix("\ufeff"), []).append(r["path"])
    names = {v: k for k, v in CSV_NAMES.items()}
    parts = []
    for head, paths in sorted(heads.items()):
        columns = [c.strip().strip('"') for c in head.split(",")]
        if "x" not in columns:
            raise ValueError(f"{paths[0]} has no column x")
        schema = ", ".join(f"`_{k}` string" for k in range(len(columns)))
        numbered = _numbered(spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(paths))
        fields = [F.col(f"_{k}").cast("double").cast(POINT_SCHEMA[names[c]].dataType).alias(names[c]) for k, c in enumerate(columns) if c in names]
        absent = [F.lit(None).cast(POINT_SCHEMA[n].dataType).alias(n) for c, n in CSV_NAMES_BACK if c not in columns]
        parts.append(numbered.select(_cloud_of().alias("cloud_id"), "point_id", "path", *fields, *absent))
    if not parts:
        raise ValueError(f"{path} holds no line")
    return reduce(DataFrame.unionByName, parts)


def _read_txt(spark: SparkSession, path: str) -> DataFrame:
    """A first line that starts with // names the columns; without one they are the default ones and no line is lost."""
    lines = spark.read.text(path)
    numbered = _numbered(lines).where(F.trim("value") != "")
    heads = _heads(lines.where(F.trim("value") != "")).select("path", F.when(F.col("head").startswith("//"), F.split(F.trim(F.regexp_replace("head", "^//", "")), r"\s+")).otherwise(F.array(*[F.lit(v) for v in TXT_NAMES.values()])).alias("names"))
    rows = numbered.where(~F.col("value").startswith("//")).join(F.broadcast(heads), "path")
    parts = rows.select("path", "point_id", "names", F.split(F.trim("value"), r"\s+").alias("v"))

    def field(name: str):
        spellings = [name, "Gps_Time"] if name == "GpsTime" else [name]
        return F.coalesce(*[F.expr(f"try_element_at(v, nullif(cast(array_position(names, '{s}') as int), 0))") for s in spellings]).cast("double")

    based = parts.groupBy("path").agg(F.min("point_id").alias("_base"))
    return parts.join(F.broadcast(based), "path").select(_cloud_of().alias("cloud_id"), (F.col("point_id") - F.col("_base")).alias("point_id"), "path", *[field(v).cast(POINT_SCHEMA[k].dataType).alias(k) for k, v in TXT_NAMES.items()])


def _pcd_heads(spark: SparkSession, path: str) -> dict[str, tuple[str, bytes]]:
    """For the file path of each PCD file as the metadata column has it: its plain path and its header. Only the first bytes of a file are read."""
    found = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("at")).collect()  # a row for each file
    conf = spark._jsparkSession.sessionState().newHadoopConf()

    def head(plain: str) -> bytes:
        place = spark._jvm.org.apache.hadoop.fs.Path(plain)
        stream, raw = place.getFileSystem(conf).open(place), b""
        try:
            while len(raw) < HEAD_MOST:
                more = bytes(stream.readNBytes(max(HEAD_BYTES, len(raw))))
                raw += more
                end = pcd.head_size(raw, whole=not more)
                if end is not None:
                    return raw[:end]
                if not more:
                    break
        finally:
            stream.close()
        raise ValueError(f"PCD file without a DATA line: {plain}")

    with ThreadPoolExecutor(16) as pool:
        return {r["at"]: (r["path"], h) for r, h in zip(found, pool.map(head, [r["path"] for r in found]), strict=True)}


def _read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """Files with ascii data are read by lines in any number of tasks, the others whole."""
    files: dict[str, tuple] = {}
    heads = _pcd_heads(spark, path)
    kinds: dict[str, np.dtype] = {}
    for at, (plain, head) in heads.items():
        meta, _ = pcd.split_file(head)
        if meta["data"] == "ascii":
            kind = pcd.record_type(meta)
            lines = sum(bool(re.match(DATA_LINE.encode(), x)) for x in head.split(b"\n"))
            files[at] = plain, kinds.setdefault(str(kind.descr), kind), lines, meta["points"]
    at = F.col("_metadata.file_path")
    whole = spark.read.format("binaryFile").load(path)
    if not files:
        return decode_column(whole, "pcd")
    lines = _numbered(spark.read.text(path, lineSep="\n").where(at.isin(list(files)) & F.col("value").rlike(DATA_LINE)), "lines")
    schema = to_arrow_schema(POINT_SCHEMA).append(pa.field("path", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in pieces(batch, 1)):
            plain, kind, before, points = files[part.column(0)[0].as_py()]
            held = part.column(1)[0].as_py() - before
            if held < points:
                raise ValueError(f"PCD file holds {held} points, its header says {points}: {plain}")
            place = part.column(2).to_numpy() - before
            inside = (place >= 0) & (place < points)
            if inside.any():
                body = b"\n".join(part.column(3).filter(pa.array(inside)).to_pylist())
                columns = _of_records(pcd.text_records(body, kind, points)) | {"point_id": place[inside]}
                yield from _batches(columns, os.path.basename(plain).split(".")[0], plain, schema)

    found = lines.select("path", "lines", "point_id", F.col("value").cast("binary").alias("value")).mapInArrow(run, READ_SCHEMA)
    return found if len(files) == len(heads) else found.unionByName(decode_column(whole.where(~at.isin(list(files))), "pcd"))


def read_cloud(spark: SparkSession, path: str, kind: str | None = None, pad: bool = True) -> DataFrame:
    """Points of a file, or of all files that a pattern fits, in the point schema plus ``path``; absent attributes are 0 (null if not ``pad``)."""
    kind = kind or _suffix(path)
    if kind == "csv":
        found = _read_csv(spark, path)
    elif kind == "txt":
        found = _read_txt(spark, path)
    elif kind == "pcd":
        found = _read_pcd(spark, path)
    else:
        found = decode_column(spark.read.format("binaryFile").load(path), kind)
    found = conform(found).withColumn("path", F.lit(None).cast("string")) if "path" not in found.columns else found.select(*[F.col(c) if c in found.columns else F.lit(None).cast(POINT_SCHEMA[c].dataType).alias(c) for c in POINT_SCHEMA.names], "path")
    return fill_missing(found) if pad else found


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy() for c in pdf.columns if c in POINT_SCHEMA.names and not pdf[c].isna().all()} | {c: pdf[c].to_numpy(float) for c in "xyz"}


def _pcd_records(columns: dict[str, np.ndarray]) -> np.ndarray:
    n = len(columns["x"])
    get = lambda c, empty: np.asarray(columns[c], float).astype(np.float32) if c in columns else np.full(n, empty, np.float32)
    colors = pcd.pack_colors(*(np.nan_to_num(get(c, 0)).astype(np.uint8) for c in "rgb"))
    fields = {c: get(c, np.nan) for c in "xyz"} | {"rgb": colors} | {PCD_NAMES[c]: get(c, np.nan) for c in ("gps_time", "original_cloud_index", "intensity", "illuminance")}
    return pcd.records_of(fields)


def _to_pcd(columns: dict[str, np.ndarray], data: str = "binary") -> bytes:
    return pcd.encode(_pcd_records(columns), data)


def _to_csv(columns: dict[str, np.ndarray], header: bool = True) -> bytes:
    frame = pd.DataFrame({stored: columns[c].astype(int) if c in "rgb" else columns[c] for c, stored in CSV_NAMES.items() if c in columns})
    return frame.to_csv(index=False, header=header).encode()


def _to_txt(columns: dict[str, np.ndarray], header: bool = True) -> bytes:
    have = [c for c in TXT_NAMES if c in columns]
    rows = zip(*(columns[c].tolist() for c in have), strict=True)
    head = "//" + " ".join(TXT_NAMES[c] for c in have) + "\n" if header else ""
    return (head + "".join(" ".join(str(v) for v in row) + "\n" for row in rows)).encode()


def _to_laz(columns: dict[str, np.ndarray]) -> bytes:
    try:
        import laspy
    except ImportError as missing:
        raise ImportError("LAZ files need the library laspy with a LAZ backend") from missing
    out = io.BytesIO()
    laspy.read(io.BytesIO(las.encode(columns))).write(out, do_compress=True)
    return out.getvalue()


def _to_h5(columns: dict[str, np.ndarray]) -> bytes:
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("HDF5 files need the library h5py") from missing
    out = io.BytesIO()
    with h5py.File(out, "w") as held:
        held["points"] = np.column_stack([columns[c] for c in "xyz"])
        if all(c in columns for c in "rgb"):
            held["rgb"] = np.column_stack([columns[c] for c in "rgb"])
        for c, stored in PCD_NAMES.items():
            if c in columns:
                held[stored] = columns[c]
    return out.getvalue()


ENCODERS: dict[str, Callable[..., bytes]] = {"pcd": _to_pcd, "las": las.encode, "laz": _to_laz, "csv": _to_csv, "txt": _to_txt, "h5": _to_h5}


@contextlib.contextmanager
def _written(path: str) -> Iterator[pa.NativeFile]:
    """A file to write to in any store that Arrow knows; it appears under its name only when complete."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.create_dir(os.path.dirname(place), recursive=True)
    with store.open_output_stream(place + ".part") as out:
        yield out
    store.move(place + ".part", place)


def write_bytes(path: str, content: bytes) -> None:
    """Write a whole file."""
    with _written(path) as out:
        out.write(content)


def _pieces_of_text(encode: Callable[..., bytes]) -> Callable[..., Iterator[bytes]]:
    def run(parts: Iterator[dict[str, np.ndarray]], points: int) -> Iterator[bytes]:
        for k, columns in enumerate(parts):
            yield encode(columns, header=k == 0)

    return run


def _pieces_of_pcd(parts: Iterator[dict[str, np.ndarray]], points: int, data: str = "binary") -> Iterator[bytes]:
    yield from pcd.encode_parts(map(_pcd_records, parts), points, data)


#: Formats that are written as the rows come in: the bytes of a file from the columns of some rows at a time and their number in all.
STREAMED: dict[str, Callable[..., Iterator[bytes]]] = {"csv": _pieces_of_text(_to_csv), "txt": _pieces_of_text(_to_txt), "pcd": _pieces_of_pcd}


def _write_streamed(df: DataFrame, path_of: Callable[[str], str], kind: str, options: dict) -> DataFrame:
    """Each cloud's rows by point_id and place. How many there are, and how many have each field, is counted before.

    Clouds are dealt to tasks by size and not by hash, so that no task has two of them while another has none."""
    plain = conform(df).select("cloud_id", "point_id", *FLAT_COLUMNS)
    held = [F.count(F.when(~F.isnan(c), F.col(c)) if POINT_SCHEMA[c].dataType.simpleString() == "double" else c) for c in FLAT_COLUMNS]
    counted = plain.groupBy("cloud_id").agg(F.array(F.count("*"), *held).alias("counts")).collect()  # a row for each file
    counted.sort(key=lambda r: (-r["counts"][0], str(r["cloud_id"])))
    counts_of = {r["cloud_id"]: r["counts"] for r in counted}
    tasks = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(counted)))
    slots = df.sparkSession.createDataFrame([(r["cloud_id"], k % tasks) for k, r in enumerate(counted)], "_of string, _slot int")
    rows = plain.join(F.broadcast(slots), F.col("cloud_id").eqNullSafe(F.col("_of"))).drop("_of").repartitionById(tasks, "_slot")
    several = ["cloud_id"] if len(counted) > tasks else []  # a cloud alone in its task is sorted faster by its numbers
    dealt = rows.sortWithinPartitions(*several, "point_id", "x", "y", "z").select("cloud_id", *FLAT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (part for batch in batches for part in pieces(batch, 1))
        part = next(stream, None)
        while part is not None:
            cloud, after = part.column(0)[0].as_py(), []
            counts = counts_of[cloud]
            have = {c: n for c, n in zip(FLAT_COLUMNS, counts[1:], strict=True) if n or c in "xyz"}

            def columns() -> Iterator[dict[str, np.ndarray]]:
                own = part  # noqa: B023
                while own is not None and own.column(0)[0].as_py() == cloud:  # noqa: B023
                    frame = own.select(list(have)).to_pandas()  # noqa: B023
                    yield {c: frame[c].to_numpy(float if c in "xyz" or n < counts[0] else None) for c, n in have.items()}  # noqa: B023
                    own = next(stream, None)
                after.append(own)  # noqa: B023

            path = path_of(str(cloud))
            with _written(path) as out:
                for piece in STREAMED[kind](columns(), counts[0], **options):
                    out.write(piece)
            yield pa.RecordBatch.from_arrays([pa.array([str(cloud)]), pa.array([path]), pa.array([counts[0]], pa.int64())], ["cloud_id", "path", "points"])
            part = after[0]

    return dealt.mapInArrow(run, "cloud_id string, path string, points long")


def write_clouds(df: DataFrame, directory: str, kind: str, **options) -> DataFrame:
    """Write a file for each cloud by point_id and place, each in one task: (cloud_id, path, points) of what was written."""
    if kind not in SUFFIXES:
        raise ValueError(f"no writer for {kind}")

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["point_id", *"xyz"], ignore_index=True)
        cloud = str(pdf["cloud_id"].iloc[0])
        path = f"{directory.rstrip('/')}/{cloud}.{kind}"
        write_bytes(path, ENCODERS[kind](_columns(pdf), **options))
        return pd.DataFrame({"cloud_id": [cloud], "path": [path], "points": [len(pdf)]})

    if kind in STREAMED:
        done = _write_streamed(df, lambda cloud: f"{directory.rstrip('/')}/{cloud}.{kind}", kind, options)
    else:
        done = conform(df).groupBy("cloud_id").applyInPandas(save, "cloud_id string, path string, points long")
    return df.sparkSession.createDataFrame(done.toPandas(), "cloud_id string, path string, points long")  # a row for each file


def encode_clouds(df: DataFrame, kind: str, **options) -> DataFrame:
    """Each cloud as the bytes of a file: cloud_id, content. ``decode_column`` is the way back."""
    if kind not in SUFFIXES:
        raise ValueError(f"no writer for {kind}")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", ignore_index=True)
        return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], "content": [ENCODERS[kind](_columns(pdf), **options)]})

    return conform(df).groupBy("cloud_id").applyInPandas(pack, "cloud_id string, content binary")


def write_records_text(df: DataFrame, path: str, header: bool = True) -> None:
    """Text lines of all columns, floats as %.10e and integers as they are, with the names first if ``header``."""
    formats = {"double": "%.10e", "float": "%.10e"}
    cells = [F.format_string(formats[k], F.col(f"`{c}`").cast("double")) if k in formats else F.col(f"`{c}`").cast("string") for c, k in df.dtypes]
    lines = df.select(F.concat_ws(" ", *cells).alias("value"))
    if header:
        lines = df.sparkSession.createDataFrame([(" ".join(df.columns),)], "value string").unionByName(lines)
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_cloud(df: DataFrame, path: str, **options) -> None:
    """Write all points to one file of the kind its suffix says."""
    kind = _suffix(path)
    one = conform(df).withColumn("cloud_id", F.lit("all"))

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        write_bytes(path, ENCODERS[kind](_columns(pdf.sort_values("point_id", ignore_index=True)), **options))
        return pd.DataFrame({"points": [len(pdf)]})

    if not one.groupBy("cloud_id").applyInPandas(save, "points long").collect():
        write_bytes(path, ENCODERS[kind]({c: np.zeros(0) for c in "xyz"}, **options))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A PCD file with the columns that its own header declares; types come from the first file, unsigned ones widened."""
    files = spark.read.format("binaryFile").load(path)
    head = bytes(files.select(F.substring("content", 1, 1 << 16).alias("c")).first()["c"])
    end = head.upper().find(b"\nDATA")
    meta = pcd.parse_header(head[: head.find(b"\n", end + 1) + 1].decode("ascii", "replace").splitlines())
    kind = pcd.record_type(meta)
    spark_types = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "decimal(20,0)"}
    fields = [(n, spark_types[kind[n].str[1:]]) for n in kind.names]
    schema = "point_id bigint, " + ", ".join(f"`{n}` {t}" for n, t in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"float": pa.float32(), "double": pa.float64(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}
        for batch in batches:
            for raw in batch.column(0):
                records, _ = pcd.decode(raw.as_py())
                arrays = [pa.array([int(v) for v in records[n]], types[t]) if t.startswith("decimal") else pa.array(np.ascontiguousarray(records[n])).cast(types[t]) for n, t in fields]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(records))), *arrays], ["point_id", *[n for n, _ in fields]])

    return files.select("content").mapInArrow(run, schema)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """What the headers of PCD files say, a row for each: path, version, fields, types (kind and bytes), counts, width, height, viewpoint, points, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                end = raw.upper().find(b"\nDATA")
                meta = pcd.parse_header(raw[: raw.find(b"\n", end + 1) + 1].decode("ascii", "replace").splitlines())
                row = {"path": path, "version": str(meta["version"]), "fields": meta["fields"], "types": [f"{t}{n}" for t, n in zip(meta["type"], meta["size"], strict=True)], "counts": meta["count"]}
                row |= {"width": meta["width"], "height": meta["height"], "viewpoint": [float(v) for v in meta["viewpoint"]], "points": meta["points"], "data": meta["data"]}
                yield pa.RecordBatch.from_pylist([row])

    head = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 1 << 16).alias("content"))
    return head.mapInArrow(run, "path string, version string, fields array<string>, types array<string>, counts array<long>, width long, height long, viewpoint array<double>, points long, data string")


def write_labels(df: DataFrame, path: str, intensity: bool = False, default: str = "1000") -> None:
    """Text lines of x, y, z (and intensity) to four decimals and the label, or ``default`` where there is none."""
    numbers = ["x", "y", "z", *(["intensity"] if intensity else [])]
    label = F.coalesce(F.col("label").cast("string"), F.lit(default)) if "label" in df.columns else F.lit(default)
    df.select(F.concat_ws(" ", *[F.format_string("%.4f", F.col(c).cast("double")) for c in numbers], label).alias("value")).write.mode("overwrite").text(path)
