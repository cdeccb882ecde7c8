"""LAS 1.4 files of point format 3 with an extra float dimension ``illuminance``, as bytes (ASPRS LAS specification)."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: fields of point formats 2 and 3 that clouds use.
BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
FORMATS = {0: BASE, 1: [*BASE, ("gps_time", "<f8")], 2: [*BASE, ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], 3: [*BASE, ("gps_time", "<f8"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]}
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
HEADER_SIZE, VLR_SIZE, EXTRA_SIZE = 375, 54, 192


def _extra_fields(raw: bytes, header_size: int, count: int) -> list[tuple[str, str]]:
    at, found = header_size, []
    for _ in range(count):
        user, record, size = raw[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", raw, at + 18)
        if user == b"LASF_Spec" and record == 4:
            for k in range(at + VLR_SIZE, at + VLR_SIZE + size, EXTRA_SIZE):
                found.append((raw[k + 4 : k + 36].rstrip(b"\0").decode(), EXTRA_TYPES[raw[k + 2]]))
        at += VLR_SIZE + size
    return found


def decode(raw: bytes) -> dict[str, np.ndarray]:
    """Columns of a LAS file: scaled x, y, z, raw intensity, colours over 256, and the rest as stored."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    header_size, start, vlrs = struct.unpack_from("<HII", raw, 94)
    kind, width, legacy = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed points: a LAZ reader is needed")
    if kind not in FORMATS:
        raise ValueError(f"LAS point format {kind}")
    scale, offset = np.frombuffer(raw, "<f8", 3, 131), np.frombuffer(raw, "<f8", 3, 155)
    n = struct.unpack_from("<Q", raw, 247)[0] if raw[25] >= 4 and header_size >= HEADER_SIZE else legacy
    fields = [*FORMATS[kind], *_extra_fields(raw, header_size, vlrs)]
    spare = width - np.dtype(fields).itemsize
    points = np.frombuffer(raw, np.dtype([*fields, *([("_spare", f"V{spare}")] if spare > 0 else [])]), n, start)
    out = {c: points[c.upper()] * scale[k] + offset[k] for k, c in enumerate("xyz")}
    out |= {name: points[name] for name, _ in fields if name not in "XYZ"}
    return out | {c: (out[c] // 256).astype(np.int32) for c in ("red", "green", "blue") if c in out}


def encode(columns: dict[str, np.ndarray], scale: float = 0.001) -> bytes:
    """A LAS file; absent columns are zero. Coordinates are rounded to ``scale``, colours stored times 256."""
    n = len(columns["x"])
    get = lambda c: np.nan_to_num(np.asarray(columns[c], float)) if c in columns else np.zeros(n)
    xyz = np.column_stack([get(c) for c in "xyz"]) if n else np.zeros((0, 3))
    offset = np.floor(xyz.min(0)) if n else np.zeros(3)
    points = np.zeros(n, np.dtype([*FORMATS[3], ("illuminance", "<f4")]))
    for k, c in enumerate("XYZ"):
        points[c] = np.round((xyz[:, k] - offset[k]) / scale)
    for name, source in (("intensity", "intensity"), ("point_source_id", "original_cloud_index")):
        points[name] = np.clip(get(source), 0, 65535)
    points["gps_time"], points["illuminance"] = get("gps_time"), get("illuminance")
    for name, source in (("red", "r"), ("green", "g"), ("blue", "b")):
        points[name] = np.clip(get(source), 0, 255) * 256
    extra = bytearray(EXTRA_SIZE)
    extra[2] = 9
    extra[4:15] = b"illuminance"
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, EXTRA_SIZE, b"extra bytes") + bytes(extra)
    head = bytearray(HEADER_SIZE)
    head[:4] = b"LASF"
    head[24], head[25] = 1, 4
    head[26:36], head[58:68] = b"timberline", b"timberline"
    struct.pack_into("<HIIBHI", head, 94, HEADER_SIZE, HEADER_SIZE + len(vlr), 1, 3, points.dtype.itemsize, n if n < 1 << 32 else 0)
    struct.pack_into("<6d", head, 131, *[scale] * 3, *offset)
    low, high = (xyz.min(0), xyz.max(0)) if n else (np.zeros(3), np.zeros(3))
    struct.pack_into("<6d", head, 179, *[v for k in range(3) for v in (high[k], low[k])])
    struct.pack_into("<Q", head, 247, n)
    return bytes(head) + vlr + points.tobytes()
