"""Typed records: messages of tagged fields as bytes, self-describing list files of them, and the catalogue of their fields.

A field's tag is its place in the schema, from 1, or the `tag` of its metadata. Whole numbers and booleans are varints, doubles eight bytes,
texts, bytes and messages have their length before them, repeated fields come once for each value. A field without a value isn't written.
"""

from __future__ import annotations

import base64
import itertools
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_type

from . import list_file
from .list_file import Corrupt, read_varint, varint

#: Fixed values of the descriptor's format: number of a field's type, and of its label.
KINDS = {"double": 1, "float": 2, "bigint": 3, "int": 5, "boolean": 8, "string": 9, "struct": 11, "binary": 12}
TYPES = {1: DoubleType(), 2: FloatType(), 3: LongType(), 4: LongType(), 5: IntegerType(), 8: BooleanType(), 9: StringType(), 12: BinaryType(), 13: LongType(), 14: IntegerType()}
OPTIONAL, REQUIRED, REPEATED = 1, 2, 3
MASK = (1 << 64) - 1


def tag_of(schema: StructType, k: int) -> int:
    return int(schema[k].metadata.get("tag", k + 1)) if schema[k].metadata else k + 1


def _item(tag: int, value, kind: DataType) -> bytes:
    if isinstance(kind, (LongType, IntegerType, BooleanType)):
        return varint(tag << 3) + varint(int(value) & MASK)
    if isinstance(kind, DoubleType):
        return varint(tag << 3 | 1) + struct.pack("<d", value)
    if isinstance(kind, FloatType):
        return varint(tag << 3 | 5) + struct.pack("<f", value)
    body = encode(value, kind) if isinstance(kind, StructType) else value.encode() if isinstance(value, str) else bytes(value)
    return varint(tag << 3 | 2) + varint(len(body)) + body


def encoded_rows(rows: pa.StructArray, schema: StructType) -> list[bytes]:
    """Bytes of a message for each row, made column by column."""
    made = []
    for k, (f, column) in enumerate(zip(schema, rows.flatten())):
        repeated = isinstance(f.dataType, ArrayType)
        kind = f.dataType.elementType if repeated else f.dataType
        own = column.flatten() if repeated else column
        if isinstance(kind, StructType):
            values, write_one = [x if ok else None for x, ok in zip(encoded_rows(own, kind), own.is_valid().to_pylist())], _writer(tag_of(schema, k), BinaryType())
        else:
            values, write_one = own.to_pylist(), _writer(tag_of(schema, k), kind)
        parts = [b"" if x is None else write_one(x) for x in values]
        if repeated:
            ends = list(itertools.accumulate(column.value_lengths().fill_null(0).to_pylist(), initial=0))
            parts = [b"".join(parts[a:b]) for a, b in zip(ends, ends[1:])]
        made.append(parts)
    return list(map(b"".join, zip(*made))) if made else [b""] * len(rows)


#: Varints of 0 to 2^14 - 1, which most numbers are.
_SHORT = [varint(n) for n in range(1 << 14)]


def _number_of(n: int) -> bytes:
    return _SHORT[n] if 0 <= n < 1 << 14 else varint(n & MASK)


def _writer(tag: int, kind: DataType):
    """A function of a value that makes its field."""
    if isinstance(kind, (LongType, IntegerType, BooleanType)):
        key = varint(tag << 3)
        return lambda value: key + _number_of(int(value))
    if isinstance(kind, (DoubleType, FloatType)):
        key, pack = varint(tag << 3 | (1 if isinstance(kind, DoubleType) else 5)), struct.Struct("<d" if isinstance(kind, DoubleType) else "<f").pack
        return lambda value: key + pack(value)
    key, body_of = varint(tag << 3 | 2), encoder(kind) if isinstance(kind, StructType) else lambda value: value.encode() if isinstance(value, str) else bytes(value)

    def sized(value):
        body = body_of(value)
        return key + _number_of(len(body)) + body

    return sized


def encoder(schema: StructType):
    """A function of a row (dict) that makes the bytes of a message; what hangs on the types is settled once."""
    made = []
    for k, f in enumerate(schema):
        repeated = isinstance(f.dataType, ArrayType)
        made.append((f.name, repeated, _writer(tag_of(schema, k), f.dataType.elementType if repeated else f.dataType)))

    def encoded(row: dict) -> bytes:
        out = []
        for name, repeated, write_one in made:
            value = row.get(name)
            if repeated:
                out += [write_one(x) for x in value or () if x is not None]
            elif value is not None:
                out.append(write_one(value))
        return b"".join(out)

    return encoded


def encode(row: dict, schema: StructType) -> bytes:
    """Bytes of a message."""
    return encoder(schema)(row)


def fields(data: bytes):
    """(tag, wire type, value) of each field: a number, or bytes."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = read_varint(data, at)
        else:
            if wire == 2:
                size, at = read_varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise Corrupt(f"wire type {wire}")
            if at + size > len(data):
                raise Corrupt("truncated message")
            value, at = data[at : at + size], at + size
        yield key >> 3, wire, value


def _number(value: int, kind: DataType):
    if isinstance(kind, BooleanType):
        return bool(value)
    value = value - (1 << 64) if value >> 63 else value
    return (value & 0xFFFFFFFF ^ 1 << 31) - (1 << 31) if isinstance(kind, IntegerType) else value


def _values(wire: int, value, kind: DataType) -> list:
    """A field's values: one, or those of packed numbers."""
    if isinstance(kind, StructType):
        return [decode(value, kind)]
    if isinstance(kind, StringType):
        return [value.decode("utf-8", "replace")]
    if isinstance(kind, BinaryType):
        return [value]
    if isinstance(kind, (DoubleType, FloatType)):
        return [x[0] for x in struct.iter_unpack("<d" if isinstance(kind, DoubleType) else "<f", value)]
    if wire == 0:
        return [_number(value, kind)]
    out, at = [], 0
    while at < len(value):
        n, at = read_varint(value, at)
        out.append(_number(n, kind))
    return out


def _reader(kind: DataType):
    """A function of a field's wire type and value that gives its values, for types whose values are bytes."""
    if isinstance(kind, StructType):
        message = decoder(kind)
        return lambda wire, value: [message(value)]
    if isinstance(kind, StringType):
        return lambda wire, value: [value.decode("utf-8", "replace")]
    return lambda wire, value: _values(wire, value, kind)


def decoder(schema: StructType):
    """A function of a message's bytes that makes its row (dict); what hangs on the types is settled once."""
    known, empty = {}, {f.name: None for f in schema}
    for k, f in enumerate(schema):
        repeated = isinstance(f.dataType, ArrayType)
        kind = f.dataType.elementType if repeated else f.dataType
        known[tag_of(schema, k)] = f.name, repeated, _reader(kind), isinstance(kind, (LongType, IntegerType))
    many = [f.name for f in schema if isinstance(f.dataType, ArrayType)]

    def decoded(data: bytes) -> dict:
        out = empty.copy()
        for name in many:
            out[name] = []
        at, end = 0, len(data)
        while at < end:
            key = data[at]
            at += 1
            if key > 127:
                key, at = read_varint(data, at - 1)
            wire = key & 7
            if wire == 0 or wire == 2:
                value = data[at]
                at += 1
                if value > 127:
                    value, at = read_varint(data, at - 1)
            elif wire in (1, 5):
                value = 8 if wire == 1 else 4
            else:
                raise Corrupt(f"wire type {wire}")
            if wire:
                size = value
                if at + size > end:
                    raise Corrupt("truncated message")
                value = data[at : at + size]
                at += size
            own = known.get(key >> 3)
            if own is None:
                continue
            name, repeated, read_one, whole = own
            if wire == 0 and whole and value < 1 << 31:  # such a number is itself in all types of whole numbers
                if repeated:
                    out[name].append(value)
                else:
                    out[name] = value
            elif repeated:
                out[name] += read_one(wire, value)
            else:
                out[name] = read_one(wire, value)[-1]
        return out

    return decoded


def decode(data: bytes, schema: StructType) -> dict:
    """A message's fields; of a field that isn't repeated the last value counts, unknown fields are left out."""
    return decoder(schema)(data)


# Descriptors


def descriptor(schema: StructType, name: str) -> bytes:
    """A message type: 1 name, 2 fields (1 name, 3 tag, 4 label, 5 type, 6 name of the type), 3 messages inside."""
    text = lambda tag, x: _item(tag, x, StringType())
    out, inner = text(1, name), b""
    for k, f in enumerate(schema):
        kind = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        own = "struct" if isinstance(kind, StructType) else kind.simpleString()
        if own not in KINDS:
            raise TypeError(f"{f.name}: {own} has no form in a record")
        label = REPEATED if isinstance(f.dataType, ArrayType) else OPTIONAL
        body = text(1, f.name) + b"".join(_item(t, v, LongType()) for t, v in ((3, tag_of(schema, k)), (4, label), (5, KINDS[own])))
        if own == "struct":
            body += text(6, f"{name}.{f.name}_type")
            inner += _item(3, descriptor(kind, f"{f.name}_type"), BinaryType())
        out += _item(2, body, BinaryType())
    return out + inner


def schema_of(data: bytes) -> StructType:
    """The schema of a message type."""
    inner, own = {}, []
    for tag, _, value in fields(data):
        if tag == 3:
            name = next(v.decode() for t, _, v in fields(value) if t == 1)
            inner[name] = schema_of(value)
        elif tag == 2:
            own.append({t: v for t, _, v in fields(value)})
    out = StructType()
    for f in sorted(own, key=lambda f: f[3]):
        kind = inner[f[6].decode().rsplit(".", 1)[-1]] if f[5] == 11 else TYPES[f[5]]
        out.add(StructField(f[1].decode(), ArrayType(kind) if f[4] == REPEATED else kind, True, {"tag": f[3]}))
    return out


def write(df: DataFrame, path: str, name: str = "Record") -> None:
    """A folder of list files whose metadata has the message type."""
    schema = df.schema
    list_file.register(df.sparkSession)
    meta = base64.b64encode(descriptor(schema, name)).decode()

    @arrow_udf(BinaryType())
    def encoded(rows: pa.Array) -> pa.Array:
        return pa.array(encoded_rows(rows, schema), pa.binary())

    values = df.select(encoded(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    values.write.format("lst").mode("overwrite").option("meta.record.name", name).option("meta.record.type", meta).save(path)


def described(spark: SparkSession, path: str) -> StructType:
    """The schema in the metadata of a folder's first file."""
    from pyarrow import fs

    store, top = list_file._open(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(top)) if f.base_name.startswith("part-")] if store.get_file_info(top).type == fs.FileType.Directory else [top]
    if not found:
        raise Corrupt(f"{path} has no list file")
    with store.open_input_file(min(found)) as f:
        return schema_of(base64.b64decode(list_file.read_header(f)[1]["record.type"]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of self-describing list files, as columns."""
    schema = described(spark, path)
    list_file.register(spark)
    kind = to_arrow_type(schema)

    def decoded(batches):
        message = decoder(schema)
        for b in batches:
            rows = pa.array(list(map(message, b.column(0).to_pylist())), kind)
            yield pa.RecordBatch.from_arrays(rows.flatten(), schema.names)

    return spark.read.format("lst").load(path).where("value is not null").mapInArrow(decoded, schema)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(message, tag, name, type, label): a row for each field of the message type and of those inside it."""
    rows = []

    def walk(schema: StructType, name: str) -> None:
        for k, f in enumerate(schema):
            kind = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
            inner = isinstance(kind, StructType)
            rows.append((name, tag_of(schema, k), f.name, "message" if inner else kind.simpleString(), "repeated" if isinstance(f.dataType, ArrayType) else "optional"))
            if inner:
                walk(kind, f"{name}.{f.name}")

    walk(described(spark, path), "Record")
    return spark.createDataFrame(rows, "message string, tag int, name string, type string, label string")
