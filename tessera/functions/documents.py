"""JSON values by path and type, the printed form of JSON, maps, MIME types."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


def parsed(c: Column) -> Column:
    """A variant; null for what isn't JSON."""
    return F.try_parse_json(c)


#: Names of types by the names that a variant's schema has.
_TYPES = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "double", "FLOAT": "double"}


def json_type(v: Column, path: str = "$") -> Column:
    """integer, double, string, boolean, null, array or object; `missing` if nothing is at the path."""
    at = F.try_variant_get(v, path, "variant")
    schema = F.schema_of_variant(at)
    out = F.when(at.isNull(), "missing").when(F.is_variant_null(at), "null").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").when(schema.startswith("DECIMAL"), "double")
    for name, own in _TYPES.items():
        out = out.when(schema == name, own)
    return out.otherwise("string")


def get_int(v: Column, path: str) -> Column:
    """The integer at a path; null if there is none."""
    return F.when(json_type(v, path) == "integer", F.try_variant_get(v, path, "bigint"))


def get_double(v: Column, path: str) -> Column:
    """The number at a path, integers widened."""
    return F.when(json_type(v, path).isin("integer", "double"), F.try_variant_get(v, path, "double"))


def get_string(v: Column, path: str) -> Column:
    return F.when(json_type(v, path) == "string", F.try_variant_get(v, path, "string"))


def get_bool(v: Column, path: str) -> Column:
    return F.when(json_type(v, path) == "boolean", F.try_variant_get(v, path, "boolean"))


def json_status(c: Column) -> Column:
    """ok, more (a beginning of JSON whose brackets or quotes are still open) or invalid."""
    bare = F.regexp_replace(F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', '""'), r'"(?:[^"\\]|\\.)*$', '"')
    opened, closed = (F.char_length(bare) - F.char_length(F.translate(bare, x, "")) for x in ("{[", "}]"))
    open_string = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', "").contains('"')
    starts = bare.rlike(r'^\s*[\[{"]')
    return F.when(F.try_parse_json(c).isNotNull(), "ok").when(starts & ((opened > closed) | open_string), "more").when(F.trim(c) == "", "more").otherwise("invalid")


def _printed(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_printed, x)) + "]"
    if isinstance(x, dict):
        return "{" + "".join(f"{k}: {_printed(v)}, " for k, v in x.items()) + "}\n"
    if isinstance(x, str):
        return f'"{x}"'
    return json.dumps(x) if not isinstance(x, float) else f"{x:.15g}"


@arrow_udf(StringType())
def json_text(column: pa.Array) -> pa.Array:
    """Printed form: names without quotes, a comma behind every member, a line end behind every object; null for what isn't JSON."""
    out = []
    for text in column.to_pylist():
        try:
            out.append(None if text is None else _printed(json.loads(text)))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


# Maps


def map_get(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def map_update(m: Column, other: Column) -> Column:
    """With the entries of the other put in or in place."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k)), other)


def map_insert_absent(m: Column, other: Column) -> Column:
    return F.map_concat(m, F.map_filter(other, lambda k, _: ~F.map_contains_key(m, k)))


def map_erase(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_reverse(m: Column) -> Column:
    """Values to keys; of several keys with one value the last stays."""
    entries = F.map_entries(m)
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda x: x["value"] == e["value"])) == 0)
    return F.map_from_arrays(F.transform(last, lambda e: e["value"]), F.transform(last, lambda e: e["key"]))


#: MIME types of the extensions that files mostly have.
MIME = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "json": "application/json", "xml": "text/xml", "txt": "text/plain", "csv": "text/csv", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/x-gzip",
    "tar": "application/x-tar", "bz2": "application/x-bzip2", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "ico": "image/x-icon", "svg": "image/svg+xml", "tiff": "image/tiff", "mp3": "audio/mpeg",
    "wav": "audio/x-wav", "mp4": "video/mp4", "mpeg": "video/mpeg", "avi": "video/x-msvideo", "doc": "application/msword", "rtf": "application/rtf", "swf": "application/x-shockwave-flash", "woff": "application/font-woff",
}


def mime_type(name: Column, default: str = "application/octet-stream") -> Column:
    """MIME type by the extension, whatever its case."""
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(table, ext), F.lit(default))
