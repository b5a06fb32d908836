"""Checksums, hashes and lenient JSON, vectorised."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType

_POLY = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(_POLY), t >> 1)
    return t


_CRC = _table().tolist()
#: Added to a rotated checksum that is stored beside its data.
MASK_DELTA = 0xA282EAD8


#: Pieces that a long text is cut into, which are checked side by side, and their least length.
LANES, SHORTEST = 256, 64
_CRC_ARRAY = _table()


def _shifted(columns: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What a linear map makes of checksums; its columns are what it makes of single bits."""
    out = np.zeros_like(c)
    for k in range(32):
        out ^= np.where(c >> np.uint32(k) & np.uint32(1), columns[k], np.uint32(0))
    return out


@functools.lru_cache(maxsize=256)
def _zeros(n: int) -> np.ndarray:
    """Columns of the map that n zero bytes are to a checksum: squared for each bit of n."""
    power = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out, step = power.copy(), _CRC_ARRAY[power & np.uint32(255)] ^ power >> np.uint32(8)
    while n:
        if n & 1:
            out = _shifted(step, out)
        step, n = _shifted(step, step), n >> 1
    return out


def crc32c_of(data: bytes, start: int = 0) -> int:
    c, at = start ^ 0xFFFFFFFF, 0
    while len(data) - at >= LANES * SHORTEST:  # pieces of a power of two, so that few maps are needed
        size = 1 << ((len(data) - at) // LANES).bit_length() - 1
        lanes = np.frombuffer(data, np.uint8, LANES * size, at).reshape(LANES, size).T.astype(np.uint32)
        at += LANES * size
        sums = np.zeros(LANES, np.uint32)
        sums[0] = c
        for row in lanes:
            sums = _CRC_ARRAY[(sums ^ row) & np.uint32(255)] ^ sums >> np.uint32(8)
        while len(sums) > 1:  # neighbours are joined: the left one moves over the right one's bytes
            sums, size = _shifted(_zeros(size), sums[::2]) ^ sums[1::2], 2 * size
        c = int(sums[0])
    for b in data[at:]:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a column, the first of each value and its length."""
    kind = pa.large_binary()
    own = (column if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string() if pa.types.is_large_string(column.type) else pa.string())).cast(kind)
    ends = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8) if len(own) else np.zeros(1, np.int64)
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)
    return data, ends[:-1], np.diff(ends)


def _columnwise(column: pa.Array, start: np.ndarray, step, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs `step(state, words)` over the k-th whole unit of every value that has one, for all k; values are sorted by length, so they are a head."""
    data, first, size = _bytes(column)
    order = np.argsort(-size, kind="stable")
    state, first, units = start[order], first[order], size[order] // unit
    for k in range(int(units.max()) if len(units) else 0):
        n = int(np.searchsorted(-units, -k, side="left"))
        at = first[:n] + unit * k
        word = sum((data[at + b].astype(np.uint32) << np.uint32(8 * b) for b in range(1, unit)), data[at].astype(np.uint32))
        state[:n] = step(state[:n], word)
    out = np.empty_like(state)
    out[order] = state
    return out, data, *_bytes(column)[1:]


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def unmask(stored: int) -> int:
    r = (stored - MASK_DELTA) & 0xFFFFFFFF
    return (r >> 17 | r << 15) & 0xFFFFFFFF


def murmur3_of(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit."""
    h, m = seed, 0xFFFFFFFF
    whole = len(data) // 4
    scramble = lambda k: ((k * 0xCC9E2D51 & m) << 15 | (k * 0xCC9E2D51 & m) >> 17) * 0x1B873593 & m
    for k in np.frombuffer(data[: 4 * whole], "<u4").tolist():
        h ^= scramble(k)
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    if tail := data[4 * whole :]:
        h ^= scramble(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


@arrow_udf(LongType())
def crc32c(column: pa.Array) -> pa.Array:
    """CRC-32C of each value's bytes; all values of a batch go forward together, byte by byte."""
    own, *_ = _columnwise(column, np.full(len(column), 0xFFFFFFFF, np.uint32), lambda c, b: _CRC_ARRAY[(c ^ b) & np.uint32(255)] ^ c >> np.uint32(8), 1)
    return pa.array((own ^ np.uint32(0xFFFFFFFF)).astype(np.int64), mask=np.array(column.is_null().to_pylist(), bool))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint32(n) | x >> np.uint32(32 - n)


def _scrambled(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


@arrow_udf(LongType())
def murmur3(column: pa.Array) -> pa.Array:
    """MurmurHash3 x86 32-bit of each value's bytes, four bytes of all values at a time."""
    h, data, first, size = _columnwise(column, np.zeros(len(column), np.uint32), lambda h, k: _rotated(h ^ _scrambled(k), 13) * np.uint32(5) + np.uint32(0xE6546B64), 4)
    tail, rest = np.zeros(len(h), np.uint32), first + size // 4 * 4
    for b in range(3):
        has = size % 4 > b
        tail[has] |= data[rest[has] + b].astype(np.uint32) << np.uint32(8 * b)
    h = np.where(size % 4 > 0, h ^ _scrambled(tail), h) ^ size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return pa.array((h ^ h >> np.uint32(16)).astype(np.int64), mask=np.array(column.is_null().to_pylist(), bool))


_PART = re.compile(r'"(?:[^"\\]|\\.)*"|/\*.*?\*/|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)


def strict_json(text: str) -> str | None:
    """Strict JSON of a lenient text: names without quotes, comments, commas too many or too few; null if it can't be read."""
    out, stack, before = [], [], ""
    parts = [p for p in _PART.findall(text) if not p.startswith("/*")]
    for k, p in enumerate(parts):
        if p in "{[":
            stack.append(p)
        if p == ",":
            continue
        opens = before in ("", "{", "[", ":")
        if p not in "}]:" and not opens:
            out.append(",")
        if p in "}]" and stack:
            stack.pop()
        name = stack and stack[-1] == "{" and k + 1 < len(parts) and parts[k + 1] == ":"
        out.append(json.dumps(p) if name and p[0] != '"' else p)
        before = p
    try:
        return json.dumps(json.loads("".join(out), object_pairs_hook=lambda pairs: {k: v for k, v in reversed(pairs)} if len({k for k, _ in pairs}) < len(pairs) else dict(pairs)), separators=(",", ":"))
    except ValueError:
        return None


@arrow_udf(StringType())
def lenient_json(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else strict_json(x) for x in column.to_pylist()], pa.string())
