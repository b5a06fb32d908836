"""Record files of blocks: a codec for their bytes, and a Spark data source `lst` that reads and writes them.

Layout: magic, block multiplier, extension; with metadata its masked checksum, length and map; then blocks of 64 KB times the multiplier, each
a row of physical records: masked CRC32C of type and payload, length, type, payload. Small records share one array record; large ones are
split into first, middle and last. A payload may be compressed with snappy.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.codec import crc32c_of, mask, unmask

#: Fixed values of the format.
MAGIC, FACTOR, HEADER, ARRAY_HEADER = b"LST1\0", 65536, 9, 14
FULL, FIRST, MIDDLE, ARRAY, LAST, PACKED, SNAPPY = 1, 2, 3, 4, 5, 0x10, 1
_snappy = pa.Codec("snappy")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def encode_map(meta: dict[str, str]) -> bytes:
    body = varint(len(meta))
    for k, v in sorted(meta.items()):
        for x in (k.encode(), v.encode()):
            body += varint(len(x)) + x
    return body


def decode_map(body: bytes) -> dict[str, str]:
    n, at = read_varint(body, 0)
    texts = []
    for _ in range(2 * n):
        size, at = read_varint(body, at)
        texts.append(body[at : at + size].decode())
        at += size
    return dict(zip(texts[::2], texts[1::2]))


def encode(records, meta: dict[str, str] | None = None, multiplier: int = 1, compress: bool = True) -> Iterator[bytes]:
    """Pieces of a file that holds the records."""
    if not 1 <= multiplier <= 100:
        raise ValueError("the block multiplier is from 1 to 100")
    yield MAGIC + bytes([multiplier, bool(meta)])
    if meta:
        body = encode_map(meta)
        yield struct.pack("<II", mask(crc32c_of(body)), len(body)) + body
    size = left = FACTOR * multiplier

    def emit(kind: int, payload: bytes) -> bytes:
        nonlocal left
        if compress and len(payload) > 128:
            small = _snappy.compress(payload, asbytes=True)
            if len(small) < len(payload) - len(payload) // 8:
                kind, payload = kind | PACKED, bytes([SNAPPY]) + small
        left -= HEADER + len(payload)
        tail = bytes([kind]) + payload
        return struct.pack("<II", mask(crc32c_of(tail)), len(payload)) + tail

    held: list[bytes] = []
    room = 0
    for record in records:
        item = varint(len(record)) + record
        if held:
            if len(item) <= room:
                held.append(item)
                room -= len(item)
                continue
            yield emit(ARRAY, varint(len(held)) + b"".join(held))
            held = []
        if left < HEADER:
            yield bytes(left)
            left = size
        if len(item) + ARRAY_HEADER < left:
            held, room = [item], left - ARRAY_HEADER - len(item)
        elif HEADER + len(record) <= left:
            yield emit(FULL, record)
        else:
            kind, at = FIRST, 0
            while True:
                part = record[at : at + left - HEADER]
                at += len(part)
                if kind != FIRST and at == len(record):
                    yield emit(LAST, part)
                    break
                yield emit(kind, part)
                kind = MIDDLE
                if left < HEADER:
                    yield bytes(left)
                    left = size
                elif left == HEADER:
                    continue
    if held:
        yield emit(ARRAY, varint(len(held)) + b"".join(held))


class Corrupt(ValueError):
    """A file or record that can't be read."""


def header(data: bytes) -> tuple[int, dict[str, str], int]:
    """Block size, metadata, and where the first block begins."""
    if data[:5] != MAGIC or len(data) < 7 or not 1 <= data[5] <= 100:
        raise Corrupt("invalid header")
    if not data[6]:
        return data[5] * FACTOR, {}, 7
    crc, n = struct.unpack_from("<II", data, 7)
    body = data[15 : 15 + n]
    if unmask(crc) != crc32c_of(body):
        raise Corrupt("corrupted metadata")
    return data[5] * FACTOR, decode_map(body), 15 + n


def _physical(blocks: Iterator[bytes], size: int, check: bool, dropped) -> Iterator[tuple[int, int, bytes]]:
    """(number of the block, type, payload) of each physical record; type 0 where bytes were dropped."""
    for number, block in enumerate(blocks):
        p = 0
        while len(block) - p >= HEADER:
            crc, n = struct.unpack_from("<II", block, p)
            kind, end = block[p + 8], p + HEADER + n
            if not kind and not n:
                break
            bad = "bad length" if end > len(block) else "checksum" if check and unmask(crc) != crc32c_of(block[p + 8 : end]) else ""
            if bad:
                dropped(len(block) - p, bad)
                yield number, 0, b""
                break
            payload, p = block[p + HEADER : end], end
            if kind & PACKED:
                try:
                    size_out, _ = read_varint(payload, 1)
                    payload = _snappy.decompress(payload[1:], decompressed_size=size_out, asbytes=True)
                except (pa.ArrowException, IndexError, OSError):
                    dropped(n + HEADER, "compression")
                    yield number, 0, b""
                    continue
            yield number, kind & 15, payload
        else:
            if p < len(block) < size:  # only the last block is shorter
                dropped(len(block) - p, "truncated")


def decode_blocks(blocks: Iterator[bytes], size: int, check: bool = True, dropped=lambda n, why: None, whole: bool = True, own: int | None = None) -> Iterator[bytes]:
    """Records that begin in the first `own` blocks (in all, if none are named). Unless the blocks are the beginning of a file, the rest of a record
    from before is left out. What is corrupt is reported to `dropped` and left out, and reading goes on."""
    parts: list[bytes] | None = None
    for number, kind, payload in _physical(blocks, size, check, dropped):
        if own is not None and number >= own and parts is None:
            return
        if kind in (MIDDLE, LAST):
            if parts is None:
                if whole:
                    dropped(len(payload), "no start")
                continue
            parts.append(payload)
            if kind == LAST:
                yield b"".join(parts)
                parts = None
            continue
        whole = True
        if parts:
            dropped(sum(map(len, parts)), "no end")
        parts = None
        if own is not None and number >= own:
            return
        if kind == FULL:
            yield payload
        elif kind == FIRST:
            parts = [payload]
        elif kind == ARRAY:
            try:
                n, p = read_varint(payload, 0)
                for _ in range(n):
                    length, p = read_varint(payload, p)
                    if p + length > len(payload):
                        raise IndexError
                    yield payload[p : p + length]
                    p += length
            except IndexError:
                dropped(len(payload), "invalid array")
    if parts:
        dropped(sum(map(len, parts)), "no end")


def decode(data: bytes, check: bool = True, dropped=lambda n, why: None) -> Iterator[bytes]:
    """Records of a file's bytes."""
    size, _, at = header(data)
    return decode_blocks((data[k : k + size] for k in range(at, len(data), size)), size, check, dropped)


def read_header(f) -> tuple[int, dict[str, str], int]:
    """As header, of an open file: no more of it is read than the metadata."""
    head = f.read(15)
    if len(head) == 15 and head[6]:
        head += f.read(struct.unpack_from("<I", head, 11)[0])
    return header(head)


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


#: Bytes of a split, in whole blocks.
SPLIT = 128 << 20


class _File(InputPartition):
    """A file, or `count` blocks of it from `first` on."""

    def __init__(self, path: str, first: int = 0, count: int = 0):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.check, self.fail = options["path"], options.get("checksum", "true") == "true", options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    def partitions(self):
        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and (f is info or not os.path.basename(f.path).startswith(("_", "."))):
                with store.open_input_file(f.path) as own:
                    size, _, at = read_header(own)
                blocks, step = -(-(f.size - at) // size), max(self.split // size, 1)
                out += [_File(f.path, k, min(step, blocks - k)) for k in range(0, blocks, step)] or [_File(f.path, 0, 0)]
        return out

    def read(self, partition):
        store, _ = _open(self.path)

        def dropped(n, why):
            if self.fail:
                raise Corrupt(f"{partition.path}: {why}, {n} bytes")

        with store.open_input_file(partition.path) as f:
            size, _, at = read_header(f)
            f.seek(at + partition.first * size)
            yield from self.batches(decode_blocks(iter(lambda: f.read(size), b""), size, self.check, dropped, not partition.first, partition.count))

    def batches(self, records):
        held, size = [], 0
        for record in records:
            held.append(record)
            size += len(record)
            if size > 4_000_000 or len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceArrowWriter):
    """Tasks write under hidden names; the commit gives the files of the tasks that count their own."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.multiplier, self.compress = int(options.get("blockmultiplier", options.get("blockMultiplier", "1"))), options.get("compression", "snappy") == "snappy"
        self.meta = {k[5:]: v for k, v in options.items() if k.startswith("meta.")}

    def write(self, iterator):
        store, top = _open(self.path)
        store.create_dir(top, recursive=True)
        path = f"{top}/.{self.job}-{uuid.uuid4().hex}.lst"
        with store.open_output_stream(path) as out:
            for piece in encode((bytes(x) for b in iterator for x in b.column(0).to_pylist() if x is not None), self.meta, self.multiplier, self.compress):
                out.write(piece)
        return _Written(path)

    def commit(self, messages):
        store, top = _open(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if f.base_name.startswith("part-") and f.base_name.endswith(".lst"):
                    store.delete_file(f.path)
        for k, m in enumerate(m for m in messages if m):
            store.move(m.path, f"{top}/part-{k:05d}-{self.job}.lst")

    def abort(self, messages):
        store, _ = _open(self.path)
        for m in messages:
            if m:
                store.delete_file(m.path)


class ListFiles(DataSource):
    """spark.read.format("lst").load(path); df.write.format("lst").save(path). One column, `value` (binary)."""

    @classmethod
    def name(cls):
        return "lst"

    def schema(self):
        return "value binary"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(ListFiles)


def metadata(path: str) -> dict[str, str]:
    store, own = _open(path)
    with store.open_input_file(own) as f:
        return read_header(f)[1]
