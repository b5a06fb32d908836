"""Queries of scalar functions: strings, numbers, mathematics, vectors, JSON, maps, order; each over its whole table, with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import documents as D
from .functions import numbers as N
from .functions import strings as S
from .operators import order
from .queries import query, read

# Strings

_LINE = "replace(p_name, ' ', '\\,') || ',' || p_brand || ',,' || p_type"


def _line():
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("\\,")), F.lit(","), F.col("p_brand"), F.lit(",,"), F.col("p_type"))


@query("select p_partkey, list_aggregate([replace(p_name, ' ', ','), p_brand, p_type], 'string_agg', '|') as parts, 4::integer as all_parts from part")
def split_escaped(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(S.split_escaped(_line()), "|").alias("parts"), F.size(S.split_escaped(_line(), allow_empty=True)).alias("all_parts"))


@query("""select p_partkey, case when p_partkey % 5 in (0, 1, 2) then p_partkey::integer end as low, case when p_partkey % 5 in (0, 3) then p_size end as high from part""")
def split_range(spark, d):
    key, size, k = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(key, F.lit("-"), size)).when(k == 1, key).when(k == 2, F.concat(key, F.lit("-"))).when(k == 3, F.concat(F.lit("-"), size)).otherwise(F.concat(key, F.lit("-"), size, F.lit("x")))
    return read(spark, d, "part").select("p_partkey", S.split_range(text)["from"].alias("low"), S.split_range(text)["to"].alias("high"))


@query("select p_partkey, case when p_partkey % 3 > 0 then p_size + 2 * p_partkey end as total, case when p_partkey % 3 > 0 then 3 else 2 end::integer as n from part")
def split_parse(spark, d):
    tail = F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")).otherwise("x1")
    text = F.concat(F.col("p_size").cast("string"), F.lit(","), F.col("p_partkey").cast("string"), F.lit(","), tail)
    return read(spark, d, "part").select("p_partkey", F.aggregate(S.split_parse(text, ",", "bigint"), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.size(S.leading_decimals(text)).alias("n"))


@query("""select p_partkey, string_split(p_name, ' ')[1] as first, case when contains(p_name, ' ') then substring(p_name, strpos(p_name, ' ') + 1) end as rest, p_brand as key,
[p_type, p_name] as vals from part""")
def token_and_values(spark, d):
    line = F.concat(F.col("p_brand"), F.lit(":"), F.col("p_type"), F.lit(","), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", S.first_token(F.col("p_name"), " ").alias("first"), S.rest_of_tokens(F.col("p_name"), " ").alias("rest"), S.key_and_values(line)["key"].alias("key"), S.key_and_values(line)["values"].alias("vals"))


@query("""select p_partkey, case when length(t) <= 16 then t when regexp_matches(substring(t, 14, 1), '^\\s') or regexp_extract(left(t, 13), '^(.*\\S)\\s+\\S*$', 1) = '' then left(t, 13) || '...'
else regexp_extract(left(t, 13), '^(.*\\S)\\s+\\S*$', 1) || '...' end as clipped, regexp_extract_all(t, '(.{1,9}(?:\\s|$)|.{1,9})', 1) as lines from (select p_partkey, p_name || ' ' || p_type as t from part)""")
def clip_and_wrap(spark, d):
    t = F.concat_ws(" ", "p_name", "p_type")
    return read(spark, d, "part").select("p_partkey", S.clip(t, 16).alias("clipped"), S.wrap(t, 9).alias("lines"))


@query("""select p_partkey, ltrim(t, '#*') as l, rtrim(t, '#*') as r, trim(t, '#*') as b, regexp_replace(trim(t, '#*'), '[*#]+', '#', 'g') as runs, regexp_replace(t, '#+', '#', 'g') as dups from
(select p_partkey, '##*' || replace(p_name, ' ', '*##*') || '*#' as t from part)""")
def trims(spark, d):
    t = F.concat(F.lit("##*"), F.replace("p_name", F.lit(" "), F.lit("*##*")), F.lit("*#"))
    return read(spark, d, "part").select("p_partkey", S.trim_left(t, "#*").alias("l"), S.trim_right(t, "#*").alias("r"), S.trim_both(t, "#*").alias("b"), S.trim_runs(t, "#*").alias("runs"), S.strip_dup(t, "#").alias("dups"))


@query("""select p_partkey, p_brand || ' ' || p_type as plain, case when ends_with(p_name, 'widget') then left(p_name, length(p_name) - 6) || 'gadget' else p_name end as renamed from part""")
def brackets_and_suffix(spark, d):
    t = F.concat(F.col("p_brand"), F.lit("[x "), F.col("p_name"), F.lit("] "), F.col("p_type"), F.lit("[]"))
    return read(spark, d, "part").select("p_partkey", S.strip_brackets(t).alias("plain"), S.replace_suffix(F.col("p_name"), "widget", "gadget").alias("renamed"))


@query("""select p_partkey, strpos(lower(p_name), 'widget') - 1 as place, case when regexp_matches(p_brand, '(?i)d[^a-z0-9]*1') then 4 else -1 end::integer as alnum,
case when p_size = 7 then 2 when p_partkey = 7 then 5 + length(p_size::varchar) else -1 end::integer as whole, ends_with(lower(p_type), 'mo') as suffix, starts_with(lower(p_type), 'pr') as prefix from part""")
def searches(spark, d):
    listed = F.concat(F.lit("a,"), F.col("p_size").cast("string"), F.lit(",b,"), F.col("p_partkey").cast("string"))
    p = read(spark, d, "part")
    return p.select("p_partkey", S.find_ignoring_case(F.upper("p_name"), "Widget").cast("bigint").alias("place"), S.find_alnum(F.col("p_brand"), "D-1").alias("alnum"), S.find_delimited(listed, "7", ",").alias("whole"), S.suffix_ignoring_case(F.col("p_type"), "mo").alias("suffix"), S.prefix_ignoring_case(F.col("p_type"), "PR").alias("prefix"))


@query("""select p_partkey, case when regexp_matches(p_name, '[aeiou]') then length(p_name) - length(regexp_extract(p_name, '[aeiou][^aeiou]*$')) else -1 end as last_of, length(regexp_extract(p_name, '^[bcdfghjklmnpqrst]*')) as first_not,
length(regexp_replace(p_name, '[gte]+$', '')) - 1 as last_not, case when p_type < p_brand then -1 when p_type > p_brand then 1 else 0 end::integer as cmp from part""")
def slices(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", S.find_last_of(n, "aeiou").cast("bigint").alias("last_of"), S.find_first_not_of(n, "bcdfghjklmnpqrst").cast("bigint").alias("first_not"), S.find_last_not_of(n, "gte").cast("bigint").alias("last_not"), S.compare(F.col("p_type"), F.col("p_brand")).alias("cmp"))


@query("""select p_partkey, length(p_name)::integer as place, (p_partkey % 3)::integer as len, string_split(p_name, ' ')[1] as word, not contains(p_brand, '#') as ident, p_size::varchar as tagged from part""")
def line_parts(spark, d):
    ends = F.element_at(F.array(F.lit(""), F.lit("\n"), F.lit("\r\n")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.concat(F.col("p_name"), ends, F.when(F.col("p_partkey") % 3 > 0, "tail").otherwise(""))
    tagged = F.concat(F.lit("x=1 size="), F.col("p_size").cast("string"), F.lit(" y=2"))
    return read(spark, d, "part").select("p_partkey", S.end_of_line(text)["place"].alias("place"), S.end_of_line(text)["length"].alias("len"), S.first_word(F.concat(F.lit(" \t"), "p_name")).alias("word"), S.is_identifier(F.col("p_brand")).alias("ident"), S.tag_value(tagged, "size").alias("tagged"))


@query("""select p_partkey, p_partkey % 2 = 0 as plain, length(regexp_replace(p_brand, '[^0-9]', '', 'g')) as digits, length(regexp_replace(p_brand, '[^A-Z]', '', 'g')) as uppers,
length(p_brand) - length(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) as puncts, regexp_matches(p_name, '^[a-m ]*$') as early, p_partkey % 4 = 0 as blank from part""")
def character_classes(spark, d):
    b = F.col("p_brand")
    mixed = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("é"))
    blank = F.when(F.col("p_partkey") % 4 == 0, " \t\n").otherwise(" x ")
    return read(spark, d, "part").select("p_partkey", S.is_ascii(mixed).alias("plain"), *[S.count_class(b, k).cast("bigint").alias(a) for k, a in (("digit", "digits"), ("upper", "uppers"), ("punct", "puncts"))], S.in_charset(F.col("p_name"), "abcdefghijklm ").alias("early"), S.only_whitespace(blank).alias("blank"))


@query("""select p_partkey, list_transform(string_split(left(t, 6), ''), lambda c: unicode(c)) as points, length(t) as n, strlen(t) as bytes from (select p_partkey, 'é日😀' || p_name as t from part)""")
def rune_functions(spark, d):
    t = F.concat(F.lit("é日😀"), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", S.runes(F.left(t, F.lit(6))).alias("points"), F.char_length(t).cast("bigint").alias("n"), F.aggregate(S.rune_length(t), F.lit(0), lambda s, x: s + x).cast("bigint").alias("bytes"))


@query("""select p_partkey, 'it\\''s ' || p_name as in_sql, '\\"' || p_name || '\\\\' as in_json, case when contains(p_name, ' ') then '''' || p_name || '''' else p_name end as in_shell, replace(replace(p_brand, '#', '%23'), ' ', '%20') || '%2F' || replace(p_name, ' ', '%20') as file,
p_brand || '/' || p_name as back from part""")
def escapes(spark, d):
    n, path = F.col("p_name"), F.concat_ws("/", "p_brand", "p_name")
    p = read(spark, d, "part")
    return p.select("p_partkey", S.escape_sql(F.concat(F.lit("it's "), n)).alias("in_sql"), S.escape_json(F.concat(F.lit('"'), n, F.lit("\\"))).alias("in_json"), S.escape_shell(n).alias("in_shell"), S.escape_file_name(path).alias("file"), S.unescape_file_name(S.escape_file_name(path)).alias("back"))


@query("""select p_partkey, left(p_brand, length(p_brand) - 1) || chr(ascii(right(p_brand, 1)) + 1) as successor, '\\x' || list_aggregate(regexp_extract_all(lower(hex(encode(p_brand))), '..'), 'string_agg', '\\x') as escaped from part""")
def successors(spark, d):
    return read(spark, d, "part").select("p_partkey", S.prefix_successor(F.concat("p_brand", F.lit("\x7f"))).alias("successor"), S.hex_escape(F.col("p_brand")).alias("escaped"))


# Codecs that Spark lacks

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BITS = "list_aggregate(list_transform(regexp_extract_all(hex(encode(p_brand)), '..'), lambda h: lpad(bin(cast('0x' || h as integer)), 8, '0')), 'string_agg', '')"


@query(f"""with b as (select p_partkey, {_BITS} as bits from part), g as (select p_partkey, list_transform(regexp_extract_all(rpad(bits, ((length(bits) + 4) // 5 * 5)::integer, '0'), '.....'),
lambda x: list_reduce(list_transform(string_split(x, ''), lambda c: cast(c as integer)), lambda s, y: 2 * s + y, 0)) as n from b)
select p_partkey, rpad(list_aggregate(list_transform(n, lambda k: substring('{_ALPHABET}', k + 1, 1)), 'string_agg', ''), ((len(n) + 7) // 8 * 8)::integer, '=') as standard,
rpad(list_aggregate(list_transform(n, lambda k: substring('0123456789ABCDEFGHIJKLMNOPQRSTUV', k + 1, 1)), 'string_agg', ''), ((len(n) + 7) // 8 * 8)::integer, '=') as ordered from g""")
def base32_text(spark, d):
    return read(spark, d, "part").select("p_partkey", S.base32(F.col("p_brand")).alias("standard"), S.base32hex(F.col("p_brand")).alias("ordered"))


@query("""select p_partkey, replace(p_name, 'w', '\\t') || '\\303\\251\\n' as escaped, replace(p_name, 'w', chr(9)) || 'é' || chr(10) as back from part""")
def c_escapes(spark, d):
    t = F.concat(F.replace("p_name", F.lit("w"), F.lit("\t")), F.lit("é\n"))
    return read(spark, d, "part").select("p_partkey", S.c_escape(t).alias("escaped"), S.c_unescape(S.c_escape(t)).cast("string").alias("back"))


# Numbers

@query("""select o_orderkey, case when v < 1000 then v::varchar when v < 1000000 then printf('%.2f', (v + 5) // 10 / 100.0) || 'k' when v < 1000000000 then printf('%.2f', (v // 1000 + 5) // 10 / 100.0) || 'M' when v < 1000000000000 then printf('%.2f', (v // 1000000 + 5) // 10 / 100.0) || 'B'
else printf('%.2f', (v // 1000000000 + 5) // 10 / 100.0) || 'T' end as text from (select o_orderkey, o_orderkey * o_orderkey * (o_orderkey % 7 + 1) as v from orders)""")
def human_ints(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", N.human_int(k * k * (k % 7 + 1)).alias("text"))


@query("""select p_partkey, (p_size::bigint * case p_partkey % 4 when 0 then 1000 when 1 then 1000000 when 2 then 1000000000 else 1 end)::double as value, (p_size::bigint * case p_partkey % 4 when 0 then 1024 when 1 then 1048576 when 2 then 1073741824 else 1 end)::bigint as bytes from part""")
def human_parse(spark, d):
    k = (F.col("p_partkey") % 4 + 1).cast("int")
    unit, binary = (F.element_at(F.array(*map(F.lit, x)), k) for x in ("kMB ", "KMG "))
    size = F.col("p_size").cast("string")
    return read(spark, d, "part").select("p_partkey", N.parse_human(F.rtrim(F.concat(size, unit))).alias("value"), N.parse_human_bytes(F.rtrim(F.concat(size, binary))).alias("bytes"))


@query("select p_partkey, row_number() over (order by p_size * case p_partkey % 3 when 0 then 1 when 1 then 1024 else 1048576 end, p_partkey) as place from part")
def human_byte_order(spark, d):
    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit("B"), F.lit("K"), F.lit("M")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return order.ranked(read(spark, d, "part").select("p_partkey", N.parse_human_bytes(text).alias("bytes")), "bytes", "p_partkey").select("p_partkey", F.col("rank").alias("place"))


@query("""select p_partkey, case when p_partkey % 3 = 2 then '-inf'::double else p_retailprice end as low, case p_partkey % 3 when 0 then p_retailprice when 1 then 'inf'::double else p_size::double end as high, lower(printf('%016X', p_partkey * 2654435761)) as fp,
lpad(p_size::varchar, 8, '0') as padded, length(regexp_extract(p_name, '^[0-9a-fA-F]*')) as hexes from part""")
def number_texts(spark, d):
    price, k = F.col("p_retailprice").cast("string"), F.col("p_partkey") % 3
    text = F.when(k == 0, price).when(k == 1, F.concat(price, F.lit(".."))).otherwise(F.concat(F.lit(".. "), F.col("p_size").cast("string")))
    r = N.double_range(text)
    return read(spark, d, "part").select("p_partkey", r["low"].alias("low"), r["high"].alias("high"), N.fingerprint_text(F.col("p_partkey") * 2654435761).alias("fp"), N.zero_padded(F.col("p_size"), 8).alias("padded"), N.hex_digits(F.col("p_name")).cast("bigint").alias("hexes"))


@query("""select o_orderkey, gcd(o_orderkey, o_custkey)::bigint as g, (case when o_orderkey = 0 or o_custkey = 0 then 0 else o_orderkey // gcd(o_orderkey, o_custkey) * o_custkey end)::bigint as l, true as bezout from orders""")
def divisors(spark, d):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    e = N.extended_gcd(a, b)
    return read(spark, d, "orders").select("o_orderkey", N.gcd(a, b).alias("g"), N.lcm(a, b).alias("l"), (e["x"] * a + e["y"] * b == N.gcd(a, b)).alias("bezout"))


@query("""select p_partkey, round(p_partkey / 1000.0 + 1, 6) as low, round(p_partkey / 500.0 + 3, 6) as middle, round(p_partkey / 250.0 + 9, 6) as high, round(p_size::double, 6) as one from part""")
def cubic(spark, d):
    """The cubics with given roots, and one with a single real root."""
    p, q, r = F.col("p_partkey") / 1000.0 + 1, F.col("p_partkey") / 500.0 + 3, F.col("p_partkey") / 250.0 + 9
    roots = N.cubic_roots(-(p + q + r), p * q + q * r + p * r, -(p * q * r))
    s = F.col("p_size").cast("double")
    one = N.cubic_roots(1 - s, 1 - s, -s)  # (x - s) (x^2 + x + 1)
    return read(spark, d, "part").select("p_partkey", *[F.round(roots[k], 6).alias(n) for k, n in enumerate(("low", "middle", "high"))], F.round(one[0], 6).alias("one"))


@query("""select p_partkey, round_even(p_partkey / 2.0, 0)::double as even, floor(p_partkey / 2.0 + 0.5) as up, round(ln(x / (1 - x)), 9) as inv, round(1 / (1 + exp(-(p_size - 25) * ln(9) * 2 / 40.0)), 9) as between2, round(sin(p_size) / p_size, 9) as sinc
from (select *, (p_size + 0.5) / 60.0 as x from part)""")
def rounding(spark, d):
    x, size = (F.col("p_size") + 0.5) / 60.0, F.col("p_size").cast("double")
    return read(spark, d, "part").select("p_partkey", N.round_even(F.col("p_partkey") / 2.0).alias("even"), N.round_half_up(F.col("p_partkey") / 2.0).cast("double").alias("up"), F.round(N.inverse_sigmoid(x), 9).alias("inv"), F.round(N.sigmoid_between(size, 5.0, 45.0, 0.1), 9).alias("between2"), F.round(N.sinc(size), 9).alias("sinc"))


@query("""select p_partkey, round(list_sum(list_transform(range(1, p_size + 101), lambda i: 1.0::double / i)), 6) as harmonic, round(lgamma(p_size + 101), 6) as fact, round(lgamma(p_size + 101) - lgamma(p_size + 1) - lgamma(101), 5) as comb from part""")
def combinatorics(spark, d):
    n = F.col("p_size") + 100
    return read(spark, d, "part").select("p_partkey", F.round(N.harmonic(n), 6).alias("harmonic"), F.round(N.stirling(n), 6).alias("fact"), F.round(N.log_combinations(n, F.col("p_size")), 5).alias("comb"))


@query("""select c_custkey, sign(c_acctbal)::integer as sign, abs(c_acctbal - 500) as diff, greatest(0.0, least(1000.0, c_acctbal)) as clamped, abs(c_acctbal - 500) <= 100 as near, abs(c_acctbal - 500) <= 0.1 * greatest(abs(c_acctbal), 500) as fraction, true as same, c_custkey % 3 > 0 as finite from customer""")
def closeness(spark, d):
    b = F.col("c_acctbal")
    odd = F.when(F.col("c_custkey") % 3 > 0, b).otherwise(F.when(F.col("c_custkey") % 2 == 0, float("inf")).otherwise(float("nan")))
    return read(spark, d, "customer").select("c_custkey", N.sign(b).alias("sign"), N.abs_diff(b, F.lit(500.0)).alias("diff"), N.clamp(b, 0.0, 1000.0).alias("clamped"), N.within_margin(b, F.lit(500.0), 100.0).alias("near"), N.within_fraction(b, F.lit(500.0), 0.1).alias("fraction"), (N.almost_equal(b, b * (1 + 1e-15)) & ~N.almost_equal(b + 1, b)).alias("same"), N.is_finite(odd).alias("finite"))


@query("""with o as (select o_orderkey, o_orderkey + 1 as k, lpad(bin(o_orderkey + 1), 64, '0') as b from orders)
select o_orderkey, (length(ltrim(b, '0')) - 1)::integer as low2, (case when bit_count(k) = 1 then length(ltrim(b, '0')) - 1 else length(ltrim(b, '0')) end)::integer as high2, pow(2, length(ltrim(b, '0')) - 1)::bigint as top, reverse(b) as turned from o""")
def more_bits(spark, d):
    k = F.col("o_orderkey") + 1
    return read(spark, d, "orders").select("o_orderkey", N.log2_floor(k).cast("int").alias("low2"), N.log2_ceil(k).cast("int").alias("high2"), N.highest_bit(k).alias("top"), F.lpad(F.bin(N.reverse_bits(k)), 64, "0").alias("turned"))


@query("select p_partkey, list_transform(range(0, 12), lambda n: list_bool_or(list_transform(range(0, 8), lambda m: (p_partkey >> m) % 2 = 1 and m % 4 = n % 4))) as reads from part")
def reshard_plan(spark, d):
    """Eight output shards, some of which are written, of twelve input shards."""
    written = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda m: F.call_function("shiftright", F.col("p_partkey"), m) % 2 == 1)
    return read(spark, d, "part").select("p_partkey", N.shards_to_read(written, 12).alias("reads"))


@query("select p_partkey, round(p_retailprice * 8) / 8 as eighths from part where p_retailprice >= 512 and p_retailprice < 1024 and (p_retailprice * 8) % 1 <> 0.5")
def round_off_bits(spark, d):
    """In [512, 1024) a double has 43 bits behind the point: 40 of them go."""
    p = read(spark, d, "part").where("p_retailprice >= 512 and p_retailprice < 1024 and (p_retailprice * 8) % 1 <> 0.5")
    return p.select("p_partkey", N.round_off_bits(F.col("p_retailprice"), 40).alias("eighths"))


# Vectors and matrices

_V = "[(c_custkey % 7 + 1)::double, (c_custkey % 5 - 2)::double, (c_custkey % 3 - 1)::double]"


def _vector():
    k = F.col("c_custkey")
    return F.array((k % 7 + 1).cast("double"), (k % 5 - 2).cast("double"), (k % 3 - 1).cast("double"))


@query(f"""with v as (select c_custkey, {_V} as v from customer), n as (select *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) as n from v)
select c_custkey, round(v[1] / n, 9) as first, round(acos(v[1] / n), 7) as angle, (case when abs(v[1]) >= abs(v[2]) and abs(v[1]) >= abs(v[3]) then 0 when abs(v[2]) >= abs(v[3]) then 1 else 2 end)::integer as largest, true as square from n""")
def vector_shapes(spark, d):
    v = _vector()
    ex = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    square = N.let(N.ortho(v), lambda o: (F.abs(N.dot(o, v)) < 1e-12) & (F.abs(N.norm(o) - 1) < 1e-12))
    return read(spark, d, "customer").select("c_custkey", F.round(N.normalized(v)[0], 9).alias("first"), F.round(N.vector_angle(v, ex), 7).alias("angle"), N.largest_component(v).alias("largest"), square.alias("square"))


@query(f"""with v as (select c_custkey, {_V} as v from customer)
select c_custkey, 3 + v[1] + v[2] + v[3] as trace, [1 + v[1], v[2], v[3], v[1], 1 + v[2], v[3], v[1], v[2], 1 + v[3]] as turned, round(sqrt(list_sum(list_transform([1 + v[1], v[1], v[1], v[2], 1 + v[2], v[2], v[3], v[3], 1 + v[3]], lambda x: x * x))), 9) as size,
list_transform(v, lambda x: x * (1 + v[1] + v[2] + v[3]) + 0.0) as image, round(1 + v[1] + v[2] + v[3], 6) as det from v""")
def matrix_shapes(spark, d):
    """Identity plus the vector times a row of ones."""
    v = _vector()
    m = F.array(*[v[i] + (1.0 if i == j else 0.0) for i in range(3) for j in range(3)])
    c = N.cofactors(m)
    det = m[0] * c[0] + m[1] * c[1] + m[2] * c[2]
    return read(spark, d, "customer").select("c_custkey", N.trace(m).alias("trace"), N.transposed(m).alias("turned"), F.round(N.frobenius(m), 9).alias("size"), F.transform(N.matvec(m, v), lambda x: x + 0.0).alias("image"), F.round(det, 6).alias("det"))


@query(f"""with v as (select c_custkey, {_V} as v from customer) select c_custkey, [1.0, 1.0, round(1 + v[1] * v[1] + v[2] * v[2] + v[3] * v[3], 6)] as eigen from v""")
def matrix_eigenvalues(spark, d):
    """Identity plus the vector times itself: 1 twice, and one plus the squared length."""
    v = _vector()
    m = F.array(*[v[i] * v[j] + (1.0 if i == j else 0.0) for i in range(3) for j in range(3)])
    return read(spark, d, "customer").select("c_custkey", F.transform(N.symmetric_eigenvalues(m), lambda x: F.round(x, 6)).alias("eigen"))


# JSON

_DOC = """'{"id": ' || event_id || ', "v": ' || value || ', "s": "' || event_type || '", "n": null, "b": ' || case when event_id % 2 = 0 then 'true' else 'false' end || ', "a": [1, 2, ' || user_id || '], "o": ' || props || '}'"""


def _document():
    return F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "v": '), F.format_string("%.2f", F.col("value")), F.lit(', "s": "'), F.col("event_type"), F.lit('", "n": null, "b": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(', "a": [1, 2, '), F.col("user_id").cast("string"), F.lit('], "o": '), F.col("props"), F.lit("}"))


@query("select event_id, 'integer,double,string,null,boolean,array,object,missing' as kinds, event_id as whole, event_id::double as widened, value as real, event_type as text, event_id % 2 = 0 as flag, null::bigint as wrong from events")
def json_types(spark, d):
    v = D.parsed(_document())
    kinds = F.concat_ws(",", *[D.json_type(v, f"$.{k}") for k in ("id", "v", "s", "n", "b", "a", "o", "x")])
    return read(spark, d, "events").select("event_id", kinds.alias("kinds"), D.get_int(v, "$.id").alias("whole"), D.get_double(v, "$.id").alias("widened"), F.round(D.get_double(v, "$.v"), 2).alias("real"), D.get_string(v, "$.s").alias("text"), D.get_bool(v, "$.b").alias("flag"), D.get_int(v, "$.s").alias("wrong"))


@query("select event_id, 3::integer as size, user_id as third, ['id', 'v', 's', 'n', 'b', 'a', 'o'] as names, case event_id % 3 when 0 then 'ok' when 1 then 'more' else 'invalid' end as status from events")
def json_shape(spark, d):
    doc = _document()
    k = F.col("event_id") % 3
    broken = F.when(k == 0, doc).when(k == 1, F.left(doc, F.char_length(doc) - 1)).otherwise(F.concat(F.lit("}"), doc))
    return read(spark, d, "events").select("event_id", F.json_array_length(F.get_json_object(doc, "$.a")).alias("size"), F.get_json_object(doc, "$.a[2]").cast("bigint").alias("third"), F.json_object_keys(doc).alias("names"), D.json_status(broken).alias("status"))


@query("""select event_id, '{id: ' || event_id || ', s: "' || event_type || '", a: [1, ' || user_id || '], }' || chr(10) as text from events""")
def json_text(spark, d):
    doc = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "s": "'), F.col("event_type"), F.lit('", "a": [1, '), F.col("user_id").cast("string"), F.lit("]}"))
    return read(spark, d, "events").select("event_id", D.json_text(doc).alias("text"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'text/html' when 1 then 'image/png' when 2 then 'application/json' else 'application/octet-stream' end as mime from part")
def mime_types(spark, d):
    name = F.concat(F.lit("a/b."), F.element_at(F.array(*map(F.lit, ("html", "PNG", "json", "nosuch"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return read(spark, d, "part").select("p_partkey", D.mime_type(name).alias("mime"))


# Maps, arrays, order

@query("""select c_custkey, c_nationkey as found, -1::integer as missing, [c_custkey % 2, 2] as keys, case when c_custkey % 2 = 0 then c_nationkey + 1 else c_nationkey end::integer as merged, 1::integer as left_over from customer""")
def map_functions(spark, d):
    k, n = (F.col("c_custkey") % 2), F.col("c_nationkey")
    m = F.create_map(k, n, F.lit(2).cast("bigint"), F.lit(0))
    put = D.map_update(m, F.create_map(F.lit(0).cast("bigint"), n + 1))
    return read(spark, d, "customer").select("c_custkey", D.map_get(m, k, F.lit(-1)).alias("found"), D.map_get(m, F.lit(9).cast("bigint"), F.lit(-1)).alias("missing"), F.map_keys(m).alias("keys"), D.map_get(put, k, F.lit(-1)).alias("merged"), F.size(D.map_erase(m, k)).alias("left_over"))


@query("select c_nationkey, min(c_custkey) as a, max(c_custkey) as b from customer group by 1")
def map_reverse(spark, d):
    """Least and greatest customer by nation, there and back."""
    m = read(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    back = D.map_reverse(F.create_map(F.lit("lo"), F.col("lo"), F.lit("hi"), -F.col("hi") - 1))
    keys = F.map_keys(D.map_reverse(back))
    return m.select("c_nationkey", D.map_reverse(back)[F.array_min(F.filter(keys, lambda k: k == "lo"))].alias("a"), (-D.map_reverse(back)["hi"] - 1).alias("b"))


@query("""with l as (select o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as before from orders)
select o_custkey, bool_and(before is null or before <= o_totalprice) as sorted from l group by 1""")
def is_sorted(spark, d):
    return order.is_sorted(read(spark, d, "orders"), "o_orderkey", "o_totalprice", "o_custkey").select("o_custkey", "sorted")


@query("""with l as (select o_custkey, o_orderkey, o_totalprice >= 100000 as yes, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place from orders)
select o_custkey, coalesce(max(case when yes then place end), -1) < coalesce(min(case when not yes then place end), count(*)) as partitioned, sum(yes::integer)::bigint as point from l group by 1""")
def partition_point(spark, d):
    return order.partition_point(read(spark, d, "orders"), "o_orderkey", F.col("o_totalprice") >= 100000, "o_custkey")


@query("""select c_custkey, row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) = 1 as first from customer""")
def unique_partition(spark, d):
    first, rest = order.unique_partition(read(spark, d, "customer"), "c_custkey", "c_mktsegment", "c_nationkey")
    return first.select("c_custkey", F.lit(True).alias("first")).unionByName(rest.select("c_custkey", F.lit(False).alias("first")))


@query("select event_type, count(*) as n, round(min(value), 2) as least, round(max(value), 2) as most from events group by 1")
def histogram_report(spark, d):
    """The text report of a histogram of each type, read back."""
    t = order.report(read(spark, d, "events"), F.col("value"), "event_type")
    return t.select("event_type", F.regexp_extract("text", r"Count: (\d+)", 1).cast("bigint").alias("n"), F.regexp_extract("text", r"Min: (-?[0-9.]+)", 1).cast("double").alias("least"), F.regexp_extract("text", r"Max: (-?[0-9.]+)", 1).cast("double").alias("most"))


@query("select p_type, count(distinct p_name) as n, min(p_name) as first from part group by 1")
def distinct_strings(spark, d):
    found = read(spark, d, "part").groupBy("p_type").agg(order.sorted_distinct(F.col("p_name")).alias("names"))
    return found.select("p_type", F.size("names").cast("bigint").alias("n"), F.col("names")[0].alias("first"))


# Time

@query("select event_id, strftime(ts, '%H').ltrim('0') as h, (date_diff('hour', timestamp '1970-01-01', ts))::bigint as hours, 0.0::double as zone from events where hour(ts) > 0")
def time_parts(spark, d):
    e = read(spark, d, "events").where("hour(ts) > 0")
    return e.select("event_id", F.hour("ts").cast("string").alias("h"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hours"), order.zone_hours(F.col("ts").cast("timestamp"), "UTC").alias("zone"))
