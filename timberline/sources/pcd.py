"""PCD files: header grammar, ascii, binary and binary_compressed bodies, as bytes in memory."""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import csv

from timberline.sources.lzf import compress, decompress

#: Fixed values of the format: type letter and size of each field type.
TYPES = {("F", 4): "f4", ("F", 8): "f8", ("U", 1): "u1", ("U", 2): "u2", ("U", 4): "u4", ("U", 8): "u8", ("I", 1): "i1", ("I", 2): "i2", ("I", 4): "i4", ("I", 8): "i8"}
LETTERS = {np.dtype(v): k for k, v in TYPES.items()}
ENCODINGS = ("ascii", "binary", "binary_compressed")
REQUIRED = ("fields", "size", "type", "width", "height", "points", "data")


def parse_header(lines: list[str]) -> dict:
    """Header lines as a dict of lower-case keys, with defaults for count, viewpoint and version."""
    found: dict = {}
    for line in lines:
        parts = line.split("#")[0].split()
        if len(parts) < 2:
            continue
        key, values = parts[0].lower(), parts[1:]
        if key in ("fields", "type"):
            found[key] = values
        elif key in ("size", "count"):
            found[key] = [int(v) for v in values]
        elif key in ("width", "height", "points"):
            found[key] = int(values[0])
        elif key == "viewpoint":
            found[key] = [float(v) for v in values]
        elif key == "data":
            found[key] = values[0].lower()
        elif key == "version":
            found[key] = values[0]
    found.setdefault("count", [1] * len(found.get("fields", [])))
    found.setdefault("viewpoint", [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0])
    found.setdefault("version", ".7")
    return found


def check_header(meta: dict) -> None:
    """Raise ValueError for a header that describes no readable cloud."""
    missing = [k for k in REQUIRED if k not in meta]
    if missing:
        raise ValueError(f"PCD header lacks {', '.join(missing)}")
    if not len(meta["fields"]) == len(meta["type"]) == len(meta["size"]) == len(meta["count"]):
        raise ValueError("PCD header: fields, type, size and count differ in length")
    if meta["data"] not in ENCODINGS:
        raise ValueError(f"PCD data of unknown kind {meta['data']}")
    if min(meta["width"], meta["height"], meta["points"]) < 0 or meta["width"] * meta["height"] != meta["points"]:
        raise ValueError("PCD header: width * height must equal points")


def record_type(meta: dict) -> np.dtype:
    """Fields of count n become n scalars, name_0000 and so on."""
    fields = []
    for name, kind, size, count in zip(meta["fields"], meta["type"], meta["size"], meta["count"], strict=True):
        if (kind, size) not in TYPES:
            raise ValueError(f"PCD field type {kind}{size}")
        fields += [(name if count == 1 else f"{name}_{k:04d}", "<" + TYPES[kind, size]) for k in range(count)]
    seen: dict[str, int] = {}
    unique = []
    for name, kind in fields:
        seen[name] = seen.get(name, 0) + 1
        unique.append((name if seen[name] == 1 else f"{name}.{seen[name]}", kind))
    return np.dtype(unique)


def head_size(raw: bytes, whole: bool = True) -> int | None:
    """Bytes of the header, which ends with its DATA line; None if there is none. If ``raw`` isn't the ``whole`` file, that line must have its end."""
    found = re.search(rb"^DATA[ \t]+[^\n]*(\n|$)", raw, re.MULTILINE | re.IGNORECASE)
    return found.end() if found and (whole or found[1]) else None


def split_file(raw: bytes) -> tuple[dict, bytes]:
    """Header and body; a file without a DATA line is an error."""
    end = head_size(raw)
    if end is None:
        raise ValueError("PCD file without a DATA line")
    meta = parse_header(raw[:end].decode("ascii", "replace").splitlines())
    check_header(meta)
    return meta, raw[end:]


def text_records(body: bytes, kind: np.dtype, points: int) -> np.ndarray:
    """Records of the first ``points`` lines of an ascii body; empty lines and comments don't count."""
    out = np.zeros(0, kind)
    if not points:
        return out
    floats = all(kind[f].kind == "f" for f in kind.names)
    if floats:  # plain lines of numbers with one space between them are read at once, all others below
        with contextlib.suppress(pa.ArrowInvalid):
            columns = csv.read_csv(
                io.BytesIO(body), csv.ReadOptions(use_threads=False, column_names=list(kind.names)), csv.ParseOptions(delimiter=" ", quote_char=False),
                csv.ConvertOptions(column_types={f: pa.float64() for f in kind.names}, null_values=[]),
            )
            out = np.zeros(min(points, len(columns)), kind)
            for name in kind.names:
                out[name] = columns[name].to_numpy()[:points]
            return out
    rows = np.loadtxt(io.BytesIO(body), dtype=np.float64 if floats else object, ndmin=2, max_rows=points)
    out = np.zeros(len(rows), kind)
    for k, name in enumerate(kind.names):
        column = rows[:, k]
        out[name] = column.astype(kind[name]) if column.dtype != object else np.array([int(v) if kind[name].kind in "iu" and re.fullmatch(r"[+-]?\d+", v) else float(v) for v in map(str, column)]).astype(kind[name])
    return out


def decode(raw: bytes) -> tuple[np.ndarray, dict]:
    """Records and header of a PCD file."""
    meta, body = split_file(raw)
    kind, n = record_type(meta), meta["points"]
    if meta["data"] == "ascii":
        out = text_records(body, kind, n)
    elif meta["data"] == "binary":
        out = np.frombuffer(body, kind, n)
    else:
        packed, size = np.frombuffer(body, "<u4", 2) if n else (0, 0)
        data = body[8 : 8 + int(packed)]
        plain = data if packed == size else decompress(data, int(size))
        out, at = np.zeros(n, kind), 0
        for name in kind.names:
            out[name] = np.frombuffer(plain, kind[name], n, at)
            at += n * kind[name].itemsize
    if len(out) != n:
        raise ValueError(f"PCD file holds {len(out)} points, its header says {n}")
    return out, meta


def header(records: np.ndarray, data: str, viewpoint: list[float] | None = None, rename_padding: bool = False, points: int | None = None) -> str:
    n = len(records) if points is None else points
    letters = [LETTERS[records.dtype[f].newbyteorder("=")] for f in records.dtype.names]
    names = ["padding" if rename_padding and f == "_" else f for f in records.dtype.names]
    rows = {
        "VERSION": [".7"], "FIELDS": names, "SIZE": [s for _, s in letters], "TYPE": [t for t, _ in letters], "COUNT": [1] * len(names), "WIDTH": [n], "HEIGHT": [1],
        "VIEWPOINT": viewpoint or [0, 0, 0, 1, 0, 0, 0], "POINTS": [n], "DATA": [data],
    }
    return "".join(f"{k} {' '.join(map(str, v))}\n" for k, v in rows.items())


def encode(records: np.ndarray, data: str = "binary", viewpoint: list[float] | None = None, rename_padding: bool = False) -> bytes:
    """A PCD file of a record array. A block that doesn't shrink is stored as it is, with equal sizes."""
    if data not in ENCODINGS:
        raise ValueError(f"PCD data of unknown kind {data}")
    head = header(records, data, viewpoint, rename_padding).encode()
    if data == "ascii":
        return head + text_body(records)
    if data == "binary":
        return head + records.tobytes()
    plain = b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names)
    packed = compress(plain)
    packed = packed if len(packed) < len(plain) else plain
    return head + np.array([len(packed), len(plain)], "<u4").tobytes() + packed


def encode_parts(parts: Iterator[np.ndarray], points: int, data: str = "binary") -> Iterator[bytes]:
    """The bytes of ``encode`` from some records at a time, ``points`` in all."""
    if data not in ENCODINGS:
        raise ValueError(f"PCD data of unknown kind {data}")
    if data == "binary_compressed":
        yield encode(np.concatenate(list(parts)), data)
        return
    for k, records in enumerate(parts):
        if not k:
            yield header(records, data, points=points).encode()
        yield text_body(records) if data == "ascii" else records.tobytes()


def text_body(records: np.ndarray, separator: str = " ") -> bytes:
    """One line for each record: floats as %.10e, integers as they are."""
    line = separator.join({"f": "%.10e", "i": "%d", "u": "%d"}[records.dtype[f].kind] for f in records.dtype.names) + "\n"
    parts = (records[at : at + 4096].tolist() for at in range(0, len(records), 4096))
    return "".join(line * len(part) % tuple(chain.from_iterable(part)) for part in parts).encode()


def records_of(columns: dict[str, np.ndarray]) -> np.ndarray:
    """A record array of named columns."""
    n = len(next(iter(columns.values())))
    out = np.zeros(n, [(k, v.dtype.newbyteorder("<")) for k, v in columns.items()])
    for k, v in columns.items():
        out[k] = v
    return out


def xyz_records(xyz: np.ndarray) -> np.ndarray:
    return records_of({c: xyz[:, k].astype(np.float32) for k, c in enumerate("xyz")})


def xyz_rgb_records(xyz_rgb: np.ndarray) -> np.ndarray:
    """x, y, z and colours packed in a float."""
    if xyz_rgb.dtype != np.float32 or xyz_rgb.ndim != 2 or xyz_rgb.shape[1] != 4:
        raise ValueError("four float32 columns are expected")
    return records_of({c: xyz_rgb[:, k] for k, c in enumerate(["x", "y", "z", "rgb"])})


def xyz_label_records(xyz_label: np.ndarray, label_type: str = "f") -> np.ndarray:
    """x, y, z and a label that is a float (f) or a byte (u)."""
    if label_type not in ("f", "u"):
        raise ValueError("label_type is f or u")
    columns = {c: xyz_label[:, k].astype(np.float32) for k, c in enumerate("xyz")}
    return records_of(columns | {"label": xyz_label[:, 3].astype(np.float32 if label_type == "f" else np.uint8)})


def pack_colors(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits of r << 16 | g << 8 | b as float32."""
    return (r.astype(np.uint32) << 16 | g.astype(np.uint32) << 8 | b.astype(np.uint32)).view(np.float32)


def unpack_colors(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = np.ascontiguousarray(packed, np.float32).view(np.uint32) if packed.dtype.kind == "f" else packed.astype(np.uint32)
    return tuple((bits >> s & 255).astype(np.int32) for s in (16, 8, 0))
