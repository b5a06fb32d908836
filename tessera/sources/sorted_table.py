"""Sorted tables of key-value pairs: a codec for their bytes, and a Spark data source `sst` that writes them and reads a range of keys.

Layout: data blocks, a meta index, an index, a footer of 48 bytes. A block holds entries (shared and own bytes of the key, size of the value), the
places where keys are whole, and their number; behind it are a byte for its compression and a masked CRC32C. The index has a key from the last
of a block up to the first of the next, and where the block lies.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from ..functions.codec import crc32c_of, mask, unmask
from .list_file import Corrupt, _File, _open, _Written, read_varint, varint


#: Fixed values of the format.
MAGIC, FOOTER, TRAILER, META = 0xF968D1DDE8E3D8D6, 48, 5, b"!meta_block"
BLOCK, RESTART = 16 * 1024, 16
_snappy = pa.Codec("snappy")


def pair(a: int, b: int) -> bytes:
    """Two numbers as one: their four-bit digits in turn, the first number's below."""
    return varint(sum(((a >> 4 * k & 15) | (b >> 4 * k & 15) << 4) << 8 * k for k in range(8)))


def read_pair(data: bytes, at: int) -> tuple[int, int, int]:
    v, at = read_varint(data, at)
    return sum((v >> 8 * k & 15) << 4 * k for k in range(8)), sum((v >> 8 * k + 4 & 15) << 4 * k for k in range(8)), at


class _Block:
    def __init__(self, restart: int = RESTART):
        self.restart, self.body, self.whole, self.since, self.last = restart, bytearray(), [0], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = len(os.path.commonprefix((self.last, key)))
        if self.since == self.restart:
            self.whole.append(len(self.body))
            self.since = shared = 0
        self.body += pair(shared, len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.since = key, self.since + 1

    def size(self) -> int:
        return len(self.body) + 4 * len(self.whole) + 4

    def done(self) -> bytes:
        return bytes(self.body) + struct.pack(f"<{len(self.whole) + 1}I", *self.whole, len(self.whole))


def between(low: bytes, high: bytes | None) -> bytes:
    """A short key from `low` up to, without, `high` (any later one if that is None)."""
    if high is None:
        at = next((k for k, b in enumerate(low) if b < 255), None)
        return low if at is None else low[:at] + bytes([low[at] + 1])
    at = len(os.path.commonprefix((low, high)))
    return low[:at] + bytes([low[at] + 1]) if at < min(len(low), len(high)) and low[at] + 1 < high[at] else low


def encode(rows: Iterable[tuple[bytes, bytes]], meta: dict[str, str] | None = None, compress: bool = True, block_size: int = BLOCK) -> Iterator[bytes]:
    """Pieces of a file with the rows, whose keys must grow."""
    offset, index, last, waiting = 0, [], None, None
    own = _Block()

    def stored(raw: bytes) -> tuple[bytes, bytes]:
        nonlocal offset
        small = _snappy.compress(raw, asbytes=True) if compress else raw
        kind, body = (b"\1", small) if len(small) < len(raw) - len(raw) // 8 else (b"\0", raw)
        place = varint(offset) + varint(len(body))
        body += kind + struct.pack("<I", mask(crc32c_of(body + kind)))
        offset += len(body)
        return place, body

    for key, value in rows:
        if last is not None and key <= last:
            raise ValueError(f"keys must grow: {key!r} after {last!r}")
        if waiting:
            index.append((between(last, key), waiting))
            waiting = None
        own.add(key, value)
        last = key
        if own.size() >= block_size:
            waiting, body = stored(own.done())
            yield body
            own = _Block()
    if own.body:
        waiting, body = stored(own.done())
        yield body
    if waiting:
        index.append((between(last, None), waiting))
    texts = [(k.encode(), v.encode()) for k, v in sorted((meta or {}).items())]
    about = _Block()
    about.add(META, varint(len(texts)) + b"".join(pair(len(k), len(v)) + k + v for k, v in texts))
    meta_at, body = stored(about.done())
    yield body
    table = _Block(1)
    for key, place in index:
        table.add(key, place)
    index_at, body = stored(table.done())
    yield body
    yield (meta_at + index_at).ljust(FOOTER - 8, b"\0") + struct.pack("<Q", MAGIC)


def entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    n = struct.unpack_from("<I", block, len(block) - 4)[0]
    end, at, key = len(block) - 4 - 4 * n, 0, b""
    while at < end:
        shared, rest, at = read_pair(block, at)
        size, at = read_varint(block, at)
        key = key[:shared] + block[at : at + rest]
        at += rest
        yield key, block[at : at + size]
        at += size


class Table:
    """A file that is read block by block; `read(offset, size)` gives its bytes."""

    def __init__(self, read, size: int, check: bool = True):
        self.read, self.check = read, check
        foot = read(size - FOOTER, FOOTER) if size >= FOOTER else b""
        if len(foot) != FOOTER or struct.unpack("<Q", foot[-8:])[0] != MAGIC:
            raise Corrupt("not a sorted table")
        places, at = [], 0
        for _ in range(4):
            v, at = read_varint(foot, at)
            places.append(v)
        self.about = dict(entries(self.block(*places[:2])))
        self.index = []
        for key, v in entries(self.block(*places[2:])):
            offset, at = read_varint(v, 0)
            self.index.append((key, (offset, read_varint(v, at)[0])))
        self.keys = [k for k, _ in self.index]
        self.end = places[0]

    def block(self, offset: int, size: int) -> bytes:
        data = self.read(offset, size + TRAILER)
        if len(data) != size + TRAILER:
            raise Corrupt("truncated block")
        if self.check and unmask(struct.unpack("<I", data[-4:])[0]) != crc32c_of(data[:-4]):
            raise Corrupt("block checksum")
        body, kind = data[:size], data[size]
        if kind == 1:
            return _snappy.decompress(body, decompressed_size=read_varint(body, 0)[0], asbytes=True)
        if kind:
            raise Corrupt("block type")
        return body

    def meta(self) -> dict[str, str]:
        data = self.about.get(META, b"\0")
        n, at = read_varint(data, 0)
        out = {}
        for _ in range(n):
            a, b, at = read_pair(data, at)
            out[data[at : at + a].decode()] = data[at + a : at + a + b].decode()
            at += a + b
        return out

    def scan(self, low: bytes = b"", high: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Rows from `low` up to and with `high`; blocks outside aren't read."""
        for k in range(bisect.bisect_left(self.keys, low), len(self.index)):
            for key, value in entries(self.block(*self.index[k][1])):
                if high is not None and key > high:
                    return
                if key >= low:
                    yield key, value

    def approximate_offset(self, key: bytes) -> int:
        k = bisect.bisect_left(self.keys, key)
        return self.index[k][1][0] if k < len(self.index) else self.end


class _Part(_Written):
    """A task's file with its first key."""

    def __init__(self, first: bytes | None, path: str):
        super().__init__(path)
        self.first = first


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.check, self.low, self.high = options["path"], options.get("checksum", "true") == "true", b"", None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("key",):
                value = bytes(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = value if self.high is None else min(self.high, value)
            yield f  # Spark tests each row again; the bounds only spare blocks

    def partitions(self):
        store, path = _open(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [_File(path)]
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition):
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as f:
            def at(offset, size):
                f.seek(offset)
                return f.read(size)

            held, size = [], 0
            for row in Table(at, f.size(), self.check).scan(self.low, self.high):
                held.append(row)
                size += len(row[0]) + len(row[1])
                if size > 4_000_000 or len(held) >= 10_000:
                    yield self.batch(held)
                    held, size = [], 0
            if held:
                yield self.batch(held)

    @staticmethod
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["key", "value"])


class _Writer(DataSourceWriter):
    """One file a task; the rows must come in order of their keys, as `tables.rekey` puts them."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.compress, self.meta = options.get("compression", "snappy") == "snappy", {k[5:]: v for k, v in options.items() if k.startswith("meta.")}

    def write(self, iterator):
        store, top = _open(self.path)
        store.create_dir(top, recursive=True)
        path, first = f"{top}/.{self.job}-{uuid.uuid4().hex}.sst", []

        def rows():
            for r in iterator:
                if not first:
                    first.append(bytes(r[0]))
                yield bytes(r[0]), bytes(r[1])

        with store.open_output_stream(path) as out:
            for piece in encode(rows(), self.meta, self.compress):
                out.write(piece)
        return _Part((first or [None])[0], path)

    def commit(self, messages):
        store, top = _open(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if f.base_name.startswith("part-") and f.base_name.endswith(".sst"):
                    store.delete_file(f.path)
        for m in messages:
            if m and m.first is None:
                store.delete_file(m.path)
        kept = sorted((m for m in messages if m and m.first is not None), key=lambda m: m.first)
        for k, m in enumerate(kept):
            store.move(m.path, f"{top}/part-{k:05d}-{self.job}.sst")

    def abort(self, messages):
        store, _ = _open(self.path)
        for m in messages:
            if m:
                store.delete_file(m.path)


class SortedTables(DataSource):
    """spark.read.format("sst").load(path).where(key >= k); df.write.format("sst").save(path). Columns key and value (binary)."""

    @classmethod
    def name(cls):
        return "sst"

    def schema(self):
        return "key binary, value binary"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    """Filters reach the reader only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SortedTables)
