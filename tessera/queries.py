"""Registered queries of the engine and, where SQL can express them, their SQL. All run over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import codec, geo, shapes
from .functions import numbers as N
from .functions import strings as S
from .operators import order, stats, tables
from .plans.plang import where
from .plans.project import project

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their items as a repeated field; a tag for each field, an enum and an optional field with a default."""
    items = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("ship"))).alias("item"))
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))
    out = orders.join(items, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    out = out.withColumn("item", F.coalesce("item", F.array().cast(items.schema["item"].dataType)))
    enum = {"enum": {"F": 0, "O": 1, "P": 2}, "default": "F", "tag": 3}
    return out.withMetadata("id", {"tag": 1}).withMetadata("cust", {"tag": 2}).withMetadata("status", enum).withMetadata("priority", {"tag": 4, "default": "5-LOW"}).withMetadata("item", {"tag": 5})


def coordinates(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.withColumn("lat", ((k * 7919) % 180001).cast("double") / 1000 - 90).withColumn("lng", ((k * 104729) % 360001).cast("double") / 1000 - 180)


LAT, LNG = "(cast(({0} * 7919) % 180001 as double) / 1000 - 90)", "(cast(({0} * 104729) % 360001 as double) / 1000 - 180)"
C_LAT, C_LNG = LAT.format("c_custkey"), LNG.format("c_custkey")


# Predicates

@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' and o_custkey < 500")
def plang_eq(spark, d):
    return where(read(spark, d, "orders"), "o_orderstatus = 'F' and o_custkey < 500").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey as id from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')")
def plang_neq_repeated(spark, d):
    return where(nested(spark, d), "item.flag != 'R'").select("id")


@query("""select o_orderkey as id from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_partkey < 100)
and exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_linenumber >= 3) and o_custkey <= 5000""")
def plang_order_ops(spark, d):
    return where(nested(spark, d), "(item.part < 100 and item.number >= 3) and cust <= 5000").select("id")


@query("select o_orderkey as id from orders where (o_orderstatus = 'F' or o_orderstatus = 'P') and o_custkey > 700")
def plang_and_or_prec(spark, d):
    return where(nested(spark, d), "status = 'F' or status = 'P' and cust > 700").select("id")


@query("select o_orderkey as id from orders where not (o_orderstatus = 'F' and o_custkey > 700)")
def plang_not(spark, d):
    return where(nested(spark, d), "not status = 'F' and cust > 700").select("id")


@query("select o_orderkey as id from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey) and o_orderpriority <> '5-LOW'")
def plang_def(spark, d):
    return where(nested(spark, d), "def(item) and def(priority)").select("id")


@query("select o_orderkey as id from orders where o_orderstatus = 'O' or o_orderstatus = 'P'")
def plang_enum(spark, d):
    return where(nested(spark, d), "status = 1 or status = 'P'").select("id")


@query("select o_orderkey as id from orders where o_orderpriority = '5-LOW'")
def plang_default(spark, d):
    return where(nested(spark, d), "priority = '5-LOW'").select("id")


@query("select o_orderkey as id from orders where length(o_orderpriority) = 5")
def plang_function(spark, d):
    return where(nested(spark, d), "length(priority) = 5", {"length": lambda c: (F.char_length(c), "int")}).select("id")


@query("select o_orderkey as id from orders o where exists (select 1 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey where a.l_orderkey = o.o_orderkey and a.l_partkey < b.l_linenumber * 1)")
def plang_many_to_many(spark, d):
    return where(nested(spark, d), "item.part < item.number").select("id")


# Projection

@query("select o_orderkey as c1, o_orderstatus as c3 from orders")
def project_tags(spark, d):
    return project(nested(spark, d), ["1", "3"])


@query("select l_orderkey as c1, l_partkey as c5_2 from lineitem where l_orderkey in (select o_orderkey from orders)")
def unnest_one(spark, d):
    return project(nested(spark, d), ["1", "5.2"])


@query("select a.l_orderkey as c1, a.l_linenumber as c5_1, b.l_returnflag as c5_3 from lineitem a join lineitem b using (l_orderkey) where a.l_orderkey in (select o_orderkey from orders)")
def unnest_cross(spark, d):
    return project(nested(spark, d), ["1", "5.1", "5.3"])


@query("select l_orderkey as c1, l_linenumber as c5_1, l_returnflag as c5_3 from lineitem where l_orderkey in (select o_orderkey from orders)")
def unnest_zip(spark, d):
    return project(nested(spark, d), ["1", "5.1", "5.3"], mode="zip")


@query("select cast(o_orderkey as varchar) as c1, coalesce(nullif(o_orderpriority, '5-LOW'), '\\N') as c4 from orders")
def csv_null(spark, d):
    return project(nested(spark, d), ["1", "4"], null="\\N")


# Key-value tables

@query("select cast(o_orderkey as varchar) as key, o_custkey from orders")
def lst2sst_sorted(spark, d):
    return tables.rekey(read(spark, d, "orders").select("o_orderkey", "o_custkey"), tables.text_key(F.col("o_orderkey"))).select("key", "o_custkey")


@query("select o_orderkey as key, o_custkey from orders where o_orderkey >= 1000 order by key limit 50")
def sst_seek(spark, d):
    return tables.seek(read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey"), 1000).limit(50)


@query("select o_orderkey as key, o_custkey from orders where o_orderkey between 100 and 900")
def sst_range(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey").where(F.col("key").between(100, 900))


@query("select o_orderkey as key, o_custkey from orders order by key desc limit 100")
def sst_reverse(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey").orderBy(F.desc("key")).limit(100)


@query("select p_partkey as key, coalesce(sum(strlen(p_name)) over (order by p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from part")
def approx_offset(spark, d):
    return tables.approximate_offsets(read(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name"), F.octet_length("p_name")).select("key", "offset")


def _base(spark, d):
    o = read(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.lit("base").alias("value")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.lit("new").alias("value"))


@query("select o_orderkey as key, case when o_orderkey % 3 = 0 then 'new' else 'base' end as value from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def kv_upsert(spark, d):
    return tables.upsert(*_base(spark, d))


@query("select o_orderkey as key, case when o_orderkey % 2 = 0 then 'base' else 'new' end as value from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def kv_put_if_absent(spark, d):
    return tables.put_if_absent(*_base(spark, d))


@query("select o_orderkey as key, 'base' as value from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0")
def kv_delete(spark, d):
    return tables.delete(*_base(spark, d))


# Joins

@query("select c_custkey, coalesce(case when n_regionkey < 3 then n_name end, 'none') as n_name from customer left join nation on c_nationkey = n_nationkey")
def lookup_join(spark, d):
    dim = read(spark, d, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return tables.lookup(read(spark, d, "customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey", "n_name", "none").select("c_custkey", "n_name")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def semi_join(spark, d):
    o = read(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_join(spark, d):
    return read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# Aggregates

@query("select event_type, round(sum(value), 4) as total from events group by 1")
def varz_map_count(spark, d):
    return stats.map_count(read(spark, d, "events"), "event_type", F.col("value")).withColumn("total", F.round("total", 4))


@query("select user_id, count(value) as n, round(sum(value), 4) as total, round(avg(value), 6) as average from events group by 1")
def varz_map_avg(spark, d):
    return stats.map_average(read(spark, d, "events"), "user_id", F.col("value")).withColumn("total", F.round("total", 4)).withColumn("average", F.round("average", 6))


@query("select w as token, count(*) as n from (select unnest(string_split(text, ' ')) as w from documents) where w <> '' group by 1")
def token_counts(spark, d):
    return read(spark, d, "documents").select(F.explode(S.split_literal(F.col("text"), " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


_SQL_LIMITS = ", ".join(repr(x) for x in stats.LIMITS)


@query(f"with b as (select len(list_filter([{_SQL_LIMITS}], lambda x: x <= value)) as bucket from events where value is not null) select cast(bucket as integer) as bucket, count(*) as n from b group by 1")
def hist_buckets(spark, d):
    return stats.histogram(read(spark, d, "events"), F.col("value")).select("bucket", "n")


@query(f"""with l as (select [0.0, {_SQL_LIMITS}] as lim), v as (select value, len(list_filter([{_SQL_LIMITS}], lambda x: x <= value)) as b from events where value is not null),
t as (select b, count(*) as n from v group by 1), s as (select b, n, sum(n) over (order by b) as cum, sum(n) over () as total from t),
f as (select * from s where cum >= floor(total * 0.95) order by b limit 1)
select round(least(greatest(lim[b + 1] + (lim[b + 2] - lim[b + 1]) * ((floor(total * 0.95) - (cum - n)) / (n + 1)), (select min(value) from v)), (select max(value) from v)), 6) as value from f, l""")
def hist_percentile(spark, d):
    return stats.percentile(read(spark, d, "events"), F.col("value"), 95.0).select(F.round("value", 6).alias("value"))


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as dev, min(value) as least, max(value) as most from events group by 1")
def hist_stats(spark, d):
    v = F.col("value")
    return read(spark, d, "events").groupBy("event_type").agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("dev"), F.min(v).alias("least"), F.max(v).alias("most"))


@query("select user_id, cast(dense_rank() over (order by user_id) - 1 as integer) as id from (select distinct user_id from events)")
def distinct_dense_id(spark, d):
    users = read(spark, d, "events").select(F.col("user_id").alias("key")).distinct()
    return tables.approximate_offsets(users, F.lit(1)).select(F.col("key").alias("user_id"), F.col("offset").cast("int").alias("id"))


@query("select l_returnflag, min(l_extendedprice) as least, max(l_extendedprice) as most from lineitem group by 1")
def minmax(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@query("select o_custkey, bool_and(o_totalprice > 1000) as every_one, bool_or(o_totalprice > 200000) as any_one, not bool_or(o_orderstatus = 'P') as none_of from orders group by 1")
def all_any_none(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("every_one"), F.bool_or(F.col("o_totalprice") > 200000).alias("any_one"), (~F.bool_or(F.col("o_orderstatus") == "P")).alias("none_of"))


# Counters over time

_SECOND = lambda: F.unix_timestamp(F.col("ts").cast("timestamp"))


@query("""with s as (select event_type, cast(floor(epoch(ts)) as bigint) // 600 as slot, count(*) as n from events group by 1, 2)
select event_type, slot, cast(sum(n) over (partition by event_type order by slot range between 5 preceding and current row) as bigint) as total from s""")
def sliding_sum(spark, d):
    e = read(spark, d, "events").withColumn("slot", F.floor(_SECOND() / 600))
    return stats.sum_last(e, F.col("slot"), F.lit(1), 0, 6, "event_type").select("event_type", F.col("second").alias("slot"), "total")


@query("""with s as (select event_type, cast(floor(epoch(ts)) as bigint) // 60 as slot, count(*) as n from events group by 1, 2)
select event_type, slot, cast(coalesce(sum(n) over (partition by event_type order by slot range between 31 preceding and 2 preceding), 0) as bigint) as total from s""")
def sum_last(spark, d):
    e = read(spark, d, "events").withColumn("slot", F.floor(_SECOND() / 60))
    return stats.sum_last(e, F.col("slot"), F.lit(1), 2, 30, "event_type").select("event_type", F.col("second").alias("slot"), "total")


@query("""with s as (select event_type, cast(floor(epoch(ts)) as bigint) as second, count(*) as n from events group by 1, 2)
select event_type, second, n, cast(coalesce(sum(n) over (partition by event_type order by second range between 9 preceding and 1 preceding), 0) as bigint) // 9 as qps from s""")
def qps(spark, d):
    return stats.qps(read(spark, d, "events"), _SECOND(), "event_type").select("event_type", "second", "n", "qps")


@query("""with h as (select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2)
select event_type, cast(epoch(hour) as bigint) as hour, n from h where hour = (select max(hour) from h g where g.event_type = h.event_type)""")
def hour_counter(spark, d):
    return stats.hour_counter(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("ts"), "event_type").select("event_type", F.unix_timestamp("hour").alias("hour"), "n")


# Sorts, samples, sets

@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def topk(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query()
def sample_k(spark, d):
    """A sample of 100 rows: the least values of a seeded hash, so a top-k without a full sort."""
    return read(spark, d, "orders").select("o_orderkey").orderBy(F.xxhash64(F.lit(17), "o_orderkey"), "o_orderkey").limit(100)


@query("select c_name as name, regexp_extract(c_name, '^([^0-9]*)', 1) || lpad(regexp_replace(regexp_extract(c_name, '([0-9]+)$', 1), '^0+', ''), 20, '0') as key from customer")
def natural_sort(spark, d):
    return read(spark, d, "customer").select(F.col("c_name").alias("name"), S.natural_key(F.col("c_name")).alias("key"))


def _keys(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("k")), read(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("k"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b)


@query("select o_custkey as k from orders except select c_custkey from customer where c_acctbal > 0")
def set_except(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("(select c_custkey as k from customer except select o_custkey from orders) union all (select o_custkey from orders except select c_custkey from customer where c_acctbal > 0)")
def set_symdiff(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.select(F.col("c_custkey").alias("k")).subtract(o).unionByName(o.subtract(c.where("c_acctbal > 0").select("c_custkey")))


@query("""with a as (select o_custkey, list(distinct o_orderstatus) as x from orders group by 1)
select o_custkey, array_to_string(list_sort(list_filter(['F', 'O'], lambda s: list_contains(x, s))), ',') as both_of, array_to_string(list_sort(list_filter(['F', 'O'], lambda s: not list_contains(x, s))), ',') as missing, list_has_any(x, ['P']) as meets from a""")
def array_setops(spark, d):
    a = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("x"))
    fo = F.array(F.lit("F"), F.lit("O"))
    return a.select("o_custkey", F.array_join(F.array_sort(F.array_intersect(fo, "x")), ",").alias("both_of"), F.array_join(F.array_sort(F.array_except(fo, F.col("x"))), ",").alias("missing"), F.arrays_overlap("x", F.array(F.lit("P"))).alias("meets"))


# Strings

@query("select p_partkey, array_to_string(string_split(p_name, ' '), '|') as joined, len(string_split(p_name, ' '))::integer as n, string_split(p_type, ' ')[1] as first_word from part")
def str_split_join(spark, d):
    a = S.split_literal(F.col("p_name"), " ")
    return read(spark, d, "part").select("p_partkey", F.array_join(a, "|").alias("joined"), F.size(a).alias("n"), S.split_any(F.col("p_type"), " ,;")[0].alias("first_word"))


@query("select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as text from pages")
def str_strip(spark, d):
    return read(spark, d, "pages").select("page_id", S.strip_extra(S.strip_markup(F.col("html"))).alias("text"))


@query("select doc_id, cast((length(text) - length(replace(text, 'an', ''))) // 2 as bigint) as n, md5(replace(text, 'an', '#')) as replaced from documents")
def str_replace(spark, d):
    return read(spark, d, "documents").select("doc_id", S.replace_count(F.col("text"), "an").alias("n"), F.md5(F.replace("text", F.lit("an"), F.lit("#")).cast("binary")).alias("replaced"))


@query("""select p_partkey, cast(instr(p_name, 'a') - 1 as integer) as first_a, contains(lower(p_name), 'e') as has_e, starts_with(p_brand, 'Brand#1') as brand1,
case when starts_with(p_brand, 'Brand#') then substr(p_brand, 7) else p_brand end as tail from part""")
def str_search(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", S.find(n, "a").alias("first_a"), F.lower(n).contains("e").alias("has_e"), F.col("p_brand").startswith("Brand#1").alias("brand1"), S.strip_prefix(F.col("p_brand"), "Brand#").alias("tail"))


@query("select p_partkey, upper(p_name) as up, lower(p_type) as low, cast(length(p_name) as integer) as chars from part")
def str_case(spark, d):
    return read(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), F.char_length("p_name").alias("chars"))


@query("select p_partkey, 'p=' || p_partkey || ', $=' || p_size as line from part")
def str_substitute(spark, d):
    return read(spark, d, "part").select("p_partkey", S.substitute("p=$0, $$=$1", F.col("p_partkey"), F.col("p_size")).alias("line"))


@query("select c_custkey, c_name as f1, c_mktsegment || ', \"x\"' as f2, 3 as n from customer")
def csv_split(spark, d):
    line = F.concat(F.col("c_name"), F.lit(' , "'), S.escape_csv(F.concat(F.col("c_mktsegment"), F.lit(', "x"'))), F.lit('" , 7'))
    a = S.split_csv(line)
    return read(spark, d, "customer").select("c_custkey", a[0].alias("f1"), a[1].alias("f2"), F.size(a).alias("n"))


@query("select event_id, replace(replace(props, '\"', '\\\"'), ':', '\\:') as escaped, props as plain from events")
def escape_unescape(spark, d):
    e = S.backslash_escape(F.col("props"), '":')
    return read(spark, d, "events").select("event_id", e.alias("escaped"), S.backslash_unescape(e, '":').alias("plain"))


@query("select doc_id, rtrim(replace(replace(base64(encode(text)), '+', '-'), '/', '_'), '=') as coded, md5(text) as plain from documents")
def base64_websafe(spark, d):
    c = S.base64(F.col("text"), web_safe=True, padding=False)
    return read(spark, d, "documents").select("doc_id", c.alias("coded"), F.md5(S.unbase64(c, web_safe=True)).alias("plain"))


@query("select p_partkey, lower(hex(p_brand)) as h, p_brand as back, bin(p_size) as bits from part")
def hex_bin(spark, d):
    return read(spark, d, "part").select("p_partkey", S.hex_lower(F.col("p_brand")).alias("h"), F.unhex(S.hex_lower(F.col("p_brand"))).cast("string").alias("back"), F.bin("p_size").alias("bits"))


@query("select page_id, replace(replace(replace(replace(replace(url_encode(url), '%20', '+'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')') as coded, url as plain from pages")
def url_codec(spark, d):
    c = S.url_encode(F.col("url"))
    return read(spark, d, "pages").select("page_id", c.alias("coded"), S.url_decode(c).alias("plain"))


@query("select o_orderkey, printf('%016X', (o_orderkey::hugeint - 5000 + 9223372036854775808)::ubigint) as key from orders")
def ordered_keys(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.hex(tables.ordered_key(F.col("o_orderkey") - 5000)).alias("key"))


@query("select c_custkey, row_number() over (order by c_acctbal, c_custkey) as place from customer")
def double_keys(spark, d):
    """The place of every customer in the order of the keys' bytes."""
    keyed = read(spark, d, "customer").select("c_custkey", N.double_key("c_acctbal").alias("key"))
    return order.ranked(keyed, "key", "c_custkey").select("c_custkey", F.col("rank").alias("place"))


@query("select p_partkey, p_name as plain from part")
def quoted_printable(spark, d):
    return read(spark, d, "part").select("p_partkey", S.unquoted_printable(S.quoted_printable("p_name")).cast("string").alias("plain"))


@query("select s_suppkey, 'f(' || s_suppkey || ',1)' as first_part, 3 as n from supplier")
def split_structured(spark, d):
    a = S.split_structured(F.concat(F.lit("f("), F.col("s_suppkey").cast("string"), F.lit(",1),[a,b],{c}")))
    return read(spark, d, "supplier").select("s_suppkey", a[0].alias("first_part"), F.size(a).alias("n"))


# Numbers

@query("select c_custkey, cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint) as n, cast(null as bigint) as bad, -1::bigint as dflt from customer")
def num_parse(spark, d):
    tail = F.regexp_extract("c_name", "([0-9]+)$", 1)
    return read(spark, d, "customer").select("c_custkey", N.safe_int(tail).alias("n"), N.safe_int(F.col("c_name")).alias("bad"), N.leading_int(F.col("c_name"), -1).cast("long").alias("dflt"))


@query("select o_orderkey, format('{:,}', o_orderkey * 1000) as commas, printf('%02d', o_orderkey % 100) as two from orders")
def num_format(spark, d):
    return read(spark, d, "orders").select("o_orderkey", N.commas(F.col("o_orderkey") * 1000).alias("commas"), F.format_string("%02d", F.col("o_orderkey") % 100).alias("two"))


@query("""select o_orderkey, case when b < 1024 then b || 'B' when b < 1048576 then printf('%.1f', b / 1024.0) || 'K' when b < 1073741824 then printf('%.2f', (b // 1024) / 1024.0) || 'M' else printf('%.2f', (b // 1048576) / 1024.0) || 'G' end as size
from (select o_orderkey, o_orderkey * o_orderkey * 37 as b from orders)""")
def human_bytes(spark, d):
    return read(spark, d, "orders").select("o_orderkey", N.human_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("size"))


@query("""select o_orderkey, case when s < 0.001 then 'us' when s < 60 then 's' when s < 3600 then 'min' when s < 86400 then 'h' when s < 2592000 then 'days' else 'months' end as unit,
round(case when s < 60 then s when s < 3600 then s / 60.0 when s < 86400 then s / 3600.0 when s < 2592000 then s / 86400.0 else s / (30.436875 * 86400) end, 6) as amount from (select o_orderkey, o_orderkey * 61.0::double as s from orders where o_orderkey < 500000)""")
def human_elapsed(spark, d):
    u = N.human_elapsed_unit(F.col("o_orderkey") * F.lit(61.0))
    # rounded by its binary value, as SQL does; F.round takes the shortest decimals and so finds halves that aren't there
    return read(spark, d, "orders").select("o_orderkey", u["unit"].alias("unit"), (F.floor(u["amount"] * 1e6 + 0.5) / 1e6).alias("amount"))


@query("select o_orderkey, case when b >> 30 > 1 then (b >> 30) || 'G' when b >> 20 > 1 then (b >> 20) || 'M' when b >> 10 > 1 then (b >> 10) || 'K' else b || '' end as short from (select o_orderkey, o_orderkey * 1001 as b from orders)")
def kmgt(spark, d):
    return read(spark, d, "orders").select("o_orderkey", N.itoa_kmgt(F.col("o_orderkey") * 1001).alias("short"))


@query("select o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') as shown, cast(epoch(o_orderdate) as bigint) as seconds, hour(o_orderdate) || ':' || minute(o_orderdate) || ':' || second(o_orderdate) as hms from orders")
def time_parse_format(spark, d):
    t = F.col("o_orderdate")
    shown = F.date_format(t, "yyyy/MM/dd HH:mm:ss")
    return read(spark, d, "orders").select("o_orderkey", F.substring(shown, 1, 16).alias("shown"), F.unix_timestamp(F.try_to_timestamp(shown, F.lit("yyyy/MM/dd HH:mm:ss"))).alias("seconds"), F.concat_ws(":", F.hour(t), F.minute(t), F.second(t)).alias("hms"))


@query("select o_orderkey, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as integer) as days from orders")
def days_since_epoch(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("days"))


@query("""select l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25))), 9) as sig, round(l_discount / (1 - l_discount), 9) as odds, gcd(l_partkey, l_suppkey)::bigint as gcd,
round(greatest(least(l_extendedprice, 50000), 10000), 4) as clamped from lineitem""")
def math_scalar(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.sigmoid(q - 25), 9).alias("sig"), F.round(N.odds(F.col("l_discount")), 9).alias("odds"), N.gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("gcd"), F.round(F.greatest(F.least("l_extendedprice", F.lit(50000.0)), F.lit(10000.0)), 4).alias("clamped"))


@query("select p_partkey, case when p_size * p_size - 400 < 0 then 0 else 2 end as n, round(case when p_size * p_size - 400 < 0 then null else (-p_size - sqrt(p_size * p_size - 400)) / 2 end, 9) as low from part")
def math_roots(spark, d):
    r = N.quadratic_roots(F.lit(1.0), F.col("p_size").cast("double"), F.lit(100.0))
    return read(spark, d, "part").select("p_partkey", F.size(r).alias("n"), F.round(F.try_element_at(r, F.lit(1)), 9).alias("low"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as norm, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) as total from embeddings")
def vec_ops(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(N.norm(e), 6).alias("norm"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("""with m as (select vec_id, list_transform(embedding[1:9], lambda x: cast(x as double)) as e from embeddings)
select vec_id, round(e[1] * (e[5] * e[9] - e[6] * e[8]) - e[2] * (e[4] * e[9] - e[6] * e[7]) + e[3] * (e[4] * e[8] - e[5] * e[7]), 9) as det, round(e[1] + e[5] + e[9], 9) as trace from m""")
def matrix_ops(spark, d):
    m = F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double"))
    return read(spark, d, "embeddings").select("vec_id", F.round(N.det3(m), 9).alias("det"), F.round(m[0] + m[4] + m[8], 9).alias("trace"))


@query("""with m as (select vec_id, list_transform(embedding[1:9], lambda x: cast(x as double)) as e from embeddings),
k as (select vec_id, e, e[1] * (e[5] * e[9] - e[6] * e[8]) - e[2] * (e[4] * e[9] - e[6] * e[7]) + e[3] * (e[4] * e[8] - e[5] * e[7]) as det from m)
select vec_id, round((e[5] * e[9] - e[6] * e[8]) / det, 4) as first, round((e[1] * e[5] - e[2] * e[4]) / det, 4) as last from k where abs(det) > 0.0001""")
def matrix_inverse(spark, d):
    m = read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double")).alias("m")).where(F.abs(N.det3(F.col("m"))) > 0.0001)
    i = m.withColumn("i", N.inverse3("m"))
    return i.select("vec_id", F.round(F.col("i")[0], 4).alias("first"), F.round(F.col("i")[8], 4).alias("last"))


@query("select o_orderkey, cast(bit_count(o_orderkey) as integer) as ones, cast(case when o_orderkey = 0 then -1 else length(bin(o_orderkey)) - 1 end as integer) as top, o_orderkey & -o_orderkey as low, case when o_orderkey % 2 = 0 then -o_orderkey else o_orderkey end as plain from orders")
def bit_ops(spark, d):
    k = F.col("o_orderkey")
    signed = F.when(k % 2 == 0, -k).otherwise(k)
    return read(spark, d, "orders").select("o_orderkey", F.bit_count(k).alias("ones"), N.log2_floor(k).alias("top"), N.lowest_bit(k).alias("low"), N.unzigzag(N.zigzag(signed)).alias("plain"))


_HEX = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: cast('0x' || h as bigint))"
_SCRAMBLED = "(((({0} * 3432918353) % 4294967296 << 15) & 4294967295 | (({0} * 3432918353) % 4294967296 >> 17)) * 461845907) % 4294967296"
_ROUND = _SCRAMBLED.format("k")
_WORDS = "list_transform(range(0, len(b) // 4), lambda i: (b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216)::hugeint)"


@query(f"""with b as (select p_partkey, {_HEX.format("p_name")} as b from part), w as (select p_partkey, b, {_WORDS} as w, (len(b) - len(b) % 4)::integer as n from b),
h as (select p_partkey, len(b) as size, list_reduce(w, lambda h, k: ((((xor(h, {_ROUND}) << 13) & 4294967295 | (xor(h, {_ROUND}) >> 19)) * 5 + 3864292196) % 4294967296)::hugeint, 0::hugeint) as h,
(coalesce(b[n + 1], 0) + coalesce(b[n + 2], 0) * 256 + coalesce(b[n + 3], 0) * 65536)::hugeint as k from w),
t as (select p_partkey, xor(case when size % 4 > 0 then xor(h, {_ROUND}) else h end, size::hugeint) as h from h),
u as (select p_partkey, (xor(h, h >> 16) * 2246822507) % 4294967296 as h from t), v as (select p_partkey, (xor(h, h >> 13) * 3266489909) % 4294967296 as h from u)
select p_partkey, xor(h, h >> 16)::bigint as murmur from v""")
def hash_fp(spark, d):
    return read(spark, d, "part").select("p_partkey", codec.murmur3("p_name").alias("murmur"))


@query(f"""select p_partkey, xor(list_reduce({_HEX.format("p_name")}, lambda c, b: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, 2197175160 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295::bigint) as crc from part""")
def crc32c(spark, d):
    return read(spark, d, "part").select("p_partkey", codec.crc32c("p_name").alias("crc"))


# JSON

@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_type(props, '$.k') is not null as has_k from events")
def json_get(spark, d):
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", k.cast("bigint").alias("k"), k.isNotNull().alias("has_k"))


@query("select event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' as strict from events")
def json_lenient(spark, d):
    n = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", codec.lenient_json(F.concat(F.lit("{ k : "), n, F.lit(", /* c */ }"))).alias("strict"))


@query("select event_id, 'k' as name, json_extract_string(props, '$.k') as value from events")
def json_iterate(spark, d):
    return read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


# Geometry

@query(f"""select c_custkey, round(2 * atan2(sqrt(x), sqrt(greatest(0, 1 - x))), 9) as angle from (select c_custkey,
power(sin((radians(48.0) - radians({C_LAT})) / 2), 2) + power(sin((radians(11.0) - radians({C_LNG})) / 2), 2) * cos(radians({C_LAT})) * cos(radians(48.0)) as x from customer)""")
def geo_haversine(spark, d):
    c = coordinates(read(spark, d, "customer"), "c_custkey")
    return c.select("c_custkey", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.lit(48.0), F.lit(11.0)), 9).alias("angle"))


@query(f"select c_custkey, round(cos(radians({C_LAT})) * cos(radians({C_LNG})), 9) + 0.0 as x, round(cos(radians({C_LAT})) * sin(radians({C_LNG})), 9) + 0.0 as y, round(sin(radians({C_LAT})), 9) + 0.0 as z, round({C_LAT}, 6) as lat from customer")
def geo_point(spark, d):
    c = coordinates(read(spark, d, "customer"), "c_custkey").withColumn("p", geo.point(F.col("lat"), F.col("lng")))
    return c.select("c_custkey", *[(F.round(f"p.{k}", 9) + 0.0).alias(k) for k in "xyz"], F.round(geo.lat_lng(F.col("p"))["lat"], 6).alias("lat"))


@query(f"select c_custkey from customer where power(cos(radians({C_LAT})) * cos(radians({C_LNG})) - 1, 2) + power(cos(radians({C_LAT})) * sin(radians({C_LNG})), 2) + power(sin(radians({C_LAT})), 2) <= 4 * power(sin(0.35), 2)")
def geo_cap_contains(spark, d):
    c = coordinates(read(spark, d, "customer"), "c_custkey")
    axis = geo.point(F.lit(0.0), F.lit(0.0))
    return c.where(geo.cap_contains(axis, geo.cap_height(F.lit(0.7)), geo.point(F.col("lat"), F.col("lng")))).select("c_custkey")


@query(f"select c_custkey from customer where {C_LAT} between -20 and 40 and ({C_LNG} >= 150 or {C_LNG} <= -120)")
def geo_rect_contains(spark, d):
    return coordinates(read(spark, d, "customer"), "c_custkey").where(geo.rect_contains(F.col("lat"), F.col("lng"), -20, 40, 150, -120)).select("c_custkey")


_CELL = "((o_orderkey * 1000003 % 1000000007) * 2 + 1)"


@query(f"""with c as (select o_orderkey, {_CELL}::bigint as id from orders), p as (select o_orderkey, id, ((id::hugeint // 1048576) * 1048576 + 524288)::hugeint as x from c)
select o_orderkey, ((id // 2097152) * 2097152 + 1048576)::bigint as parent, 20::integer as level, ((id // 2097152) * 2097152 + 1)::bigint as lo, ((id // 2097152) * 2097152 + 2097151)::bigint as hi, true as inside from p""")
def geo_cell_algebra(spark, d):
    c = read(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 1000003 % 1000000007) * 2 + 1).alias("id")).withColumn("parent", geo.parent(F.col("id"), 20))
    p = F.col("parent")
    return c.select("o_orderkey", "parent", geo.level(p).alias("level"), geo.range_min(p).alias("lo"), geo.range_max(p).alias("hi"), geo.contains(p, F.col("id")).alias("inside"))


@query(f"select o_orderkey, rtrim(lower(printf('%016X', {_CELL}::bigint)), '0') as token, {_CELL}::bigint as id from orders")
def geo_cell_token(spark, d):
    c = read(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 1000003 % 1000000007) * 2 + 1).alias("id"))
    return c.select("o_orderkey", geo.token(F.col("id")).alias("token"), geo.from_token(geo.token(F.col("id"))).alias("id"))


@query()
def geo_cellunion_normalize(spark, d):
    c = coordinates(read(spark, d, "customer"), "c_custkey").select("c_nationkey", geo.parent(geo.cell_id("lat", "lng"), 4).alias("cell"))
    return c.groupBy("c_nationkey").agg(F.collect_set("cell").alias("cells")).select("c_nationkey", geo.cell_union("cells").alias("cells"))


@query()
def geo_covering(spark, d):
    s = coordinates(read(spark, d, "supplier"), "s_suppkey")
    return s.select("s_suppkey", geo.covering("lat", "lng", F.lit(0.05)).alias("cells"))


_S_LAT, _S_LNG = LAT.format("s_suppkey"), LNG.format("s_suppkey")


@query(f"""select c_custkey as id, s_suppkey as cap from customer, supplier where 2 * asin(sqrt(least(1, power(sin((radians({_S_LAT}) - radians({C_LAT})) / 2), 2)
+ power(sin((radians({_S_LNG}) - radians({C_LNG})) / 2), 2) * cos(radians({C_LAT})) * cos(radians({_S_LAT}))))) <= 0.05""")
def geo_spatial_join(spark, d):
    points = coordinates(read(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lat", "lng")
    caps = coordinates(read(spark, d, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("cap"), "lat", "lng", F.lit(0.05).alias("angle"))
    return geo.points_in_caps(points, caps)


@query(f"""with p as (select c_nationkey, c_custkey, radians({C_LAT}) as a, radians({C_LNG}) as b from customer),
s as (select c_nationkey, a, b, lead(a) over w as a2, lead(b) over w as b2 from p window w as (partition by c_nationkey order by c_custkey))
select c_nationkey, round(sum(case when a2 is null then 0 else 2 * asin(sqrt(least(1, power(sin((a2 - a) / 2), 2) + power(sin((b2 - b) / 2), 2) * cos(a) * cos(a2)))) end), 5) as length from s group by 1""")
def geo_polyline(spark, d):
    c = coordinates(read(spark, d, "customer"), "c_custkey").select("c_nationkey", F.struct("c_custkey", geo.point(F.col("lat"), F.col("lng")).alias("p")).alias("v"))
    lines = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return lines.select("c_nationkey", F.round(shapes.length(F.transform("v", lambda x: x["p"])), 5).alias("length"))


def _square(lat: Column, lng: Column, half: float) -> Column:
    return F.array(*[geo.point(lat + a * half, lng + b * half) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))])


def _centres(df: DataFrame) -> DataFrame:
    """With lat at 84 degrees from the equator at most, so that squares of half side 5 don't reach over a pole."""
    return df.withColumn("lat", F.greatest(F.lit(-84.0), F.least(F.lit(84.0), F.col("lat"))))


_TRIANGLE = "2 * atan2(abs({a}.x * ({b}.y * {c}.z - {b}.z * {c}.y) + {a}.y * ({b}.z * {c}.x - {b}.x * {c}.z) + {a}.z * ({b}.x * {c}.y - {b}.y * {c}.x)), 1 + {ab} + {bc} + {ca})"
_DOT = "({0}.x * {1}.x + {0}.y * {1}.y + {0}.z * {1}.z)"


def _triangle(a: str, b: str, c: str) -> str:
    return _TRIANGLE.format(a=a, b=b, c=c, ab=_DOT.format(a, b), bc=_DOT.format(b, c), ca=_DOT.format(c, a))


_CORNERS = ", ".join(f"{{{{'x': cos(radians(lat + {i} * h)) * cos(radians(lng + {j} * h)), 'y': cos(radians(lat + {i} * h)) * sin(radians(lng + {j} * h)), 'z': sin(radians(lat + {i} * h))}}}} as p{k}".replace("{{", "{").replace("}}", "}") for k, (i, j) in enumerate(((-1, -1), (-1, 1), (1, 1), (1, -1))))
_SQUARES = f"""with s as (select s_suppkey, greatest(-84.0, least(84.0, {_S_LAT})) as lat, {_S_LNG} as lng from supplier), q as (select s_suppkey, h, lat, lng from s, (values (5.0), (2.0)) v(h)),
c as (select s_suppkey, h, {_CORNERS} from q), areas as (select s_suppkey, h, {_triangle("p0", "p1", "p2")} + {_triangle("p0", "p2", "p3")} as area from c)"""


@query(_SQUARES + " select s_suppkey, round(area, 7) as area from areas where h = 5")
def geo_loop(spark, d):
    s = _centres(coordinates(read(spark, d, "supplier"), "s_suppkey"))
    return s.select("s_suppkey", F.round(shapes.area(_square(F.col("lat"), F.col("lng"), 5.0)), 7).alias("area"))


@query(_SQUARES + " select s_suppkey, round(sum(case when h = 5 then area else -area end), 7) as area, false as centre, true as frame from areas group by 1")
def geo_polygon(spark, d):
    """Squares with a square hole: points at the centre are outside, those in the frame inside."""
    s = _centres(coordinates(read(spark, d, "supplier"), "s_suppkey"))
    frame = F.array(_square(F.col("lat"), F.col("lng"), 5.0), _square(F.col("lat"), F.col("lng"), 2.0))
    return s.select("s_suppkey", F.round(shapes.polygon_area(frame), 7).alias("area"), shapes.polygon_contains(frame, geo.point(F.col("lat"), F.col("lng"))).alias("centre"), shapes.polygon_contains(frame, geo.point(F.col("lat") + 3.5, F.col("lng"))).alias("frame"))


@query()
def geo_cellunion_setops(spark, d):
    c = coordinates(read(spark, d, "customer"), "c_custkey").withColumn("cell", geo.parent(geo.cell_id("lat", "lng"), 3))
    a = c.groupBy("c_nationkey").agg(F.collect_set(F.when(F.col("c_custkey") % 2 == 0, F.col("cell"))).alias("a"), F.collect_set(F.when(F.col("c_custkey") % 3 == 0, F.col("cell"))).alias("b"))
    return a.select("c_nationkey", shapes.cells_union("a", "b").alias("either"), shapes.cells_intersection("a", "b").alias("both"), shapes.cells_difference("a", "b").alias("only"))


@query("select c_custkey, true as mutual, 4 as n from customer")
def geo_neighbors(spark, d):
    """Every neighbour has the cell among its own neighbours."""
    c = coordinates(read(spark, d, "customer"), "c_custkey").select("c_custkey", geo.parent(geo.cell_id("lat", "lng"), 9).alias("cell"))
    each = c.select("c_custkey", "cell", F.explode(geo.neighbours("cell")).alias("other")).withColumn("back", F.array_contains(geo.neighbours("other"), F.col("cell")))
    return each.groupBy("c_custkey").agg(F.bool_and("back").alias("mutual"), F.countDistinct("other").cast("int").alias("n"))


# Tables of the star schema, through the same operators

@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, d):
    return read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


# The other queries register themselves
from . import scalar_queries, shape_queries, source_queries  # noqa: E402, F401
