"""Queries of sources and sinks: each writes its whole table in a format and reads it back; its SQL is that of the table."""

from __future__ import annotations

import bz2
import gzip
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from .functions import strings as S
from .queries import query, read
from .sources import list_file, records, sorted_table, text


def scratch(spark, name: str) -> str:
    """A new folder beside the checkpoints; a temporary one where the session, a local one, has none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{top or tempfile.mkdtemp(prefix='tessera-')}/{name}-{uuid.uuid4().hex}"


@query("select doc_id, md5(text) as digest, strlen(text) as bytes from documents")
def list_file_scan(spark, d):
    """Documents as records of list files, large ones over several blocks."""
    list_file.register(spark)
    path = scratch(spark, "lst")
    row = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.col("text")).cast("binary")
    read(spark, d, "documents").select(row.alias("value")).write.format("lst").mode("overwrite").option("meta.table", "documents").save(path)
    found = spark.read.format("lst").load(path).select(F.col("value").cast("string").alias("v"))
    body = S.rest_of_tokens(F.col("v"), "\t")
    return found.select(S.first_token(F.col("v"), "\t").cast("bigint").alias("doc_id"), F.md5(body.cast("binary")).alias("digest"), F.octet_length(body).cast("bigint").alias("bytes"))


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey >= 100")
def sorted_table_scan(spark, d):
    """Orders as sorted tables, keys in eight bytes, read from the hundredth key on: blocks before it aren't read."""
    from .operators.tables import ordered_key

    sorted_table.register(spark)
    path = scratch(spark, "sst")
    rows = read(spark, d, "orders").select(ordered_key(F.col("o_orderkey")).alias("key"), F.concat_ws(",", F.col("o_custkey").cast("string"), "o_orderstatus").cast("binary").alias("value"))
    rows.repartitionByRange("key").sortWithinPartitions("key").write.format("sst").mode("overwrite").save(path)
    found = spark.read.format("sst").load(path).where(F.col("key") >= F.lit((100 ^ 1 << 63).to_bytes(8, "big")))
    parts = F.split(F.col("value").cast("string"), ",")
    key = F.conv(F.substring(F.hex("key"), 2, 15), 16, 10).cast("bigint")
    return found.select(key.alias("o_orderkey"), parts[0].cast("bigint").alias("o_custkey"), parts[1].alias("o_orderstatus"))


@query("select p_partkey, p_name || ', \"' || p_brand || '\"' as described, p_size, p_partkey % 3 = 0 as unsized from part")
def separated_values(spark, d):
    """Parts as separated values with quotes, a header and nulls, written and read back."""
    path = scratch(spark, "csv")
    p = read(spark, d, "part")
    described = F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"'))
    line = text.joined(F.col("p_partkey"), described, F.col("p_size"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")))
    text.write_lines(p, line, path)
    f = text.separated(spark, path).select("fields")
    return f.select(F.col("fields")[0].cast("bigint").alias("p_partkey"), F.col("fields")[1].alias("described"), F.col("fields")[2].cast("int").alias("p_size"), (F.col("fields")[3] == "\\N").alias("unsized"))


@query("select c_custkey, c_name, length(c_name)::integer + 1 as shown from customer union all select c_custkey, c_name, length(c_name)::integer + 1 from customer")
def lines_of_files(spark, d):
    """Names on lines with either end, with empty lines between, two folders read as one."""
    a, b = scratch(spark, "lines"), scratch(spark, "lines")
    c = read(spark, d, "customer")
    own = F.concat(F.col("c_custkey").cast("string"), F.lit("\t"), F.col("c_name"))
    text.write_lines(c, F.concat(own, F.lit("\r\n")), a)
    text.write_lines(c, own, b)
    found = text.lines(spark, a, b).where("value != ''")
    name = S.rest_of_tokens(F.col("value"), "\t")
    return found.select(S.first_token(F.col("value"), "\t").cast("bigint").alias("c_custkey"), name.alias("c_name"), (F.char_length(name) + 1).alias("shown"))


@arrow_udf(BinaryType())
def _packed(data: pa.Array, how: pa.Array) -> pa.Array:
    ways = (gzip.compress, zlib.compress, bz2.compress, bytes)
    return pa.array([ways[k](x.encode()) for x, k in zip(data.to_pylist(), how.to_pylist())], pa.binary())


@query("select c_nationkey, count(*) as n, min(c_name) as first from customer group by 1")
def compressed_files(spark, d):
    """Names of each nation's customers in gzip, zlib, bzip2 or plain form, told apart by their first bytes."""
    names = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_name")), "\n").alias("names"))
    made = names.select("c_nationkey", text.uncompressed(_packed("names", (F.col("c_nationkey") % 4).cast("int"))).cast("string").alias("back"))
    return made.select("c_nationkey", F.size(F.split("back", "\n")).cast("bigint").alias("n"), F.split("back", "\n")[0].alias("first"))


@query("select n_nationkey, n_name from nation")
def whole_files(spark, d):
    """A file for each nation, all found by listing the folder, each read as one text."""
    top = scratch(spark, "files")
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit("\n"), F.col("n_name")).alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").option("lineSep", "\n").text(top)
    paths = [r.path for r in text.listing(spark, top).where(~F.col("path").contains("_SUCCESS")).collect()]  # one a nation
    found = text.whole(spark, *paths)
    return found.select(F.split("value", "\n")[0].cast("int").alias("n_nationkey"), F.split("value", "\n")[1].alias("n_name"))


@query("""select o_orderkey, 'id: ' || o_orderkey || ' status: "' || o_orderstatus || '" cust { key: ' || o_custkey || ' } tag: "a" tag: "b"' as short,
'id: ' || o_orderkey || chr(10) || 'status: "' || o_orderstatus || '"' || chr(10) || 'cust {' || chr(10) || '  key: ' || o_custkey || chr(10) || '}' || chr(10) || 'tag: "a"' || chr(10) || 'tag: "b"' as long from orders""")
def text_print(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key"), F.lit(None).cast("int").alias("unset")).alias("cust"), F.array(F.lit("a"), F.lit("b")).alias("tag"))
    return o.select(F.col("id").alias("o_orderkey"), text.printed(o, short=True).alias("short"), text.printed(o).alias("long"))


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def columnar_round(spark, d):
    """Orders in columnar files with filters of keys, written and read back."""
    path = scratch(spark, "columns")
    read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.option("parquet.bloom.filter.enabled#o_custkey", "true").parquet(path)
    return spark.read.parquet(path)


@query("select p_partkey, p_size from part where false")
def empty_relation(spark, d):
    """No rows, with the schema of the table."""
    return read(spark, d, "part").select("p_partkey", "p_size").limit(0)


def _messages(spark, d):
    from .queries import nested

    o = nested(spark, d).select("id", "cust", "status", "priority", F.transform("item", lambda i: F.struct(i["number"].alias("number"), i["part"].alias("part"), i["flag"].alias("flag"))).alias("item"))
    return o.select("*", (F.col("cust") / 4).alias("quarter"), (F.col("id") % 2 == 0).alias("even"), (-F.col("id")).alias("minus"))


@query("""select o_orderkey as id, o_custkey as cust, nullif(o_orderpriority, '5-LOW') as priority, o_custkey / 4 as quarter, o_orderkey % 2 = 0 as even, -o_orderkey as minus, coalesce(n, 0)::integer as items, coalesce(parts, 0)::bigint as parts
from orders left join (select l_orderkey, count(*) as n, sum(l_partkey)::bigint as parts from lineitem group by 1) on l_orderkey = o_orderkey""")
def typed_records(spark, d):
    """Orders with their items as messages in self-describing list files, written and read back by the type that the files name."""
    path = scratch(spark, "records")
    records.write(_messages(spark, d), path)
    r = records.read(spark, path)
    total = F.aggregate("item", F.lit(0).cast("bigint"), lambda s, x: s + x["part"])
    return r.select("id", "cust", "priority", "quarter", "even", "minus", F.size("item").alias("items"), total.alias("parts"))


@query("""select * from (values ('Record', 1, 'id', 'bigint', 'optional'), ('Record', 2, 'cust', 'bigint', 'optional'), ('Record', 3, 'status', 'string', 'optional'), ('Record', 4, 'priority', 'string', 'optional'), ('Record', 5, 'item', 'message', 'repeated'), ('Record', 6, 'quarter', 'double', 'optional'),
('Record', 7, 'even', 'boolean', 'optional'), ('Record', 8, 'minus', 'bigint', 'optional'), ('Record.item', 1, 'number', 'int', 'optional'), ('Record.item', 2, 'part', 'bigint', 'optional'), ('Record.item', 3, 'flag', 'string', 'optional')) v(message, tag, name, type, label)""")
def schema_catalogue(spark, d):
    path = scratch(spark, "records")
    records.write(_messages(spark, d), path)
    return records.catalogue(spark, path)
