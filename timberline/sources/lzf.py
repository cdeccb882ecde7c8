"""The LZF block format: literal runs and back references of at most 8 KiB."""

from __future__ import annotations

#: Bytes that a reference goes back at most.
REACH = 8191

def decompress(block: bytes, size: int) -> bytes:
    out = bytearray()
    at = 0
    while at < len(block):
        head = block[at]
        at += 1
        if head < 32:
            out += block[at : at + head + 1]
            at += head + 1
            continue
        count = head >> 5
        if count == 7:
            count += block[at]
            at += 1
        start = len(out) - ((head & 31) << 8) - block[at] - 1
        at += 1
        if start < 0:
            raise ValueError("LZF reference before the start of the block")
        piece = bytes(out[start : start + count + 2])
        while len(piece) < count + 2:  # a reference may run into what it writes
            piece += piece[: count + 2 - len(piece)]
        out += piece
    if len(out) != size:
        raise ValueError(f"LZF block of {len(out)} bytes, {size} expected")
    return bytes(out)


def compress(raw: bytes) -> bytes:
    """Greedy matches by a table of the last place of each three bytes; places too far back to refer to are forgotten."""
    out, last, older = bytearray(), {}, {}
    literal, at, n, turn = 0, 0, len(raw), REACH

    def flush(to: int) -> None:
        nonlocal literal
        while literal < to:
            part = raw[literal : min(literal + 32, to)]
            out.append(len(part) - 1)
            out.extend(part)
            literal += len(part)

    while at + 2 < n:
        if at >= turn:  # what is older than a turn lies beyond the reach of every later place
            older, last = (last if at - turn < REACH else {}), {}
            turn = at + REACH
        key = raw[at : at + 3]
        seen = last.get(key)
        if seen is None:
            seen = older.get(key)
        last[key] = at
        if seen is None or at - seen > REACH:
            at += 1
            continue
        size = 3
        while at + size < n and size < 264 and raw[seen + size] == raw[at + size]:
            size += 1
        flush(at)
        back, count = at - seen - 1, size - 2
        if count < 7:
            out.append((count << 5) | (back >> 8))
        else:
            out += bytes([(7 << 5) | (back >> 8), count - 7])
        out.append(back & 255)
        at += size
        literal = at
    flush(n)
    return bytes(out)
