"""Numbers: parsing, printing for people, mathematics and bits as Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType


def safe_int(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[-+]?[0-9]+\s*$"), c.try_cast("bigint"))


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def leading_int(c: Column, default: int) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^\s*([-+]?[0-9]+)", 1).try_cast("bigint"), F.lit(default))


def commas(c: Column) -> Column:
    return F.format_number(c, 0)


def base36(c: Column) -> Column:
    return F.conv(c.cast("string"), 10, 36)


def itoa_kmgt(c: Column) -> Column:
    """Whole K, M, G or T if there are two or more."""
    a, out = F.abs(c), None
    for bits, unit in ((40, "T"), (30, "G"), (20, "M"), (10, "K")):
        hit, text = F.shiftright(a, bits) > 1, F.concat(F.shiftright(a, bits).cast("string"), F.lit(unit))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return F.concat(F.when(c < 0, "-").otherwise(""), out.otherwise(a.cast("string")))


def parse_kmgt(c: Column) -> Column:
    n = F.regexp_extract(c, r"^\s*([-+]?[0-9]+)", 1).try_cast("bigint")
    unit = F.upper(F.regexp_extract(c, r"([KMGTkmgt])\s*$", 1))
    return n * F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)


def human_bytes(c: Column) -> Column:
    """Bytes plain; K with one digit, larger units with two, after whole divisions by 1024."""
    a, sign = F.abs(c), F.when(c < 0, "-").otherwise("")
    out = F.when(a < 1024, F.concat(a.cast("string"), F.lit("B"))).when(a < 1 << 20, F.concat(F.format_string("%.1f", F.bround(a / 1024.0, 1)), F.lit("K")))
    for k, unit in enumerate("MGTP", 2):
        out = out.when(a < 1 << 10 * (k + 1), F.concat(F.format_string("%.2f", F.bround(F.shiftright(a, 10 * (k - 1)) / 1024.0, 2)), F.lit(unit)))
    return F.concat(sign, out.otherwise(F.concat(F.format_string("%.2f", F.shiftright(a, 50) / 1024.0), F.lit("E"))))


def human_bytes_exact(c: Column) -> Column:
    """The largest unit that divides the number."""
    a, out = F.abs(c), None
    for k, unit in reversed(list(enumerate("BKMGTPE"))):
        hit = (F.pmod(a, F.lit(1 << 10 * k)) == 0) & (a >= 1 << 10 * k) if k else F.lit(True)
        text = F.concat(F.shiftright(a, 10 * k).cast("string"), F.lit(unit))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return F.concat(F.when(c < 0, "-").otherwise(""), out)


def human_elapsed_unit(seconds: Column) -> Column:
    """(amount, unit) as a struct: the amount before it is rounded for print."""
    s = F.abs(seconds.cast("double"))
    rows = [(0.001, 1e6, 1, "us"), (1.0, 1e3, 1, "ms"), (60.0, 1, 1, "s"), (3600.0, 1, 60, "min"), (86400.0, 1, 3600, "h"), (2592000.0, 1, 86400, "days"), (365.2425 * 86400, 1, 30.436875 * 86400, "months")]
    out = None
    for limit, times, per, unit in rows:
        own = F.struct((s * times / per).alias("amount"), F.lit(unit).alias("unit"))
        out = F.when(s < limit, own) if out is None else out.when(s < limit, own)
    return out.otherwise(F.struct((s / (365.2425 * 86400)).alias("amount"), F.lit("years").alias("unit")))


def parse_elapsed(c: Column) -> Column:
    """Seconds of texts such as `1d 2h 30m 5s`."""
    units = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    total = sum((F.coalesce(F.regexp_extract(c, rf"([0-9.]+)\s*{u}(?![a-z])", 1).try_cast("double"), F.lit(0.0)) * n for u, n in units.items()), F.lit(0.0))
    return F.when(c.startswith("-"), -total).otherwise(total)


def sigmoid(x: Column, rate: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-rate * x))


def odds(p: Column) -> Column:
    return p / (1 - p)


def probability(o: Column) -> Column:
    return o / (1 + o)


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots, the smaller first; two equal ones where they meet."""
    d = b * b - 4 * a * c
    q = -(b + F.when(b >= 0, F.sqrt(d)).otherwise(-F.sqrt(d))) / 2
    pair = F.array_sort(F.array(q / a, F.when(q == 0, 0.0).otherwise(c / q)))
    return F.when(d < 0, F.array().cast("array<double>")).otherwise(pair)


@arrow_udf(LongType())
def _gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (v.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (a, b))
    return pa.array(np.gcd(x, y), mask=np.array(pa.compute.or_(a.is_null(), b.is_null()).to_pylist(), bool))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of 64-bit numbers, never negative; of 0 and 0 it is 0."""
    return _gcd(a.cast("long"), b.cast("long"))


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple, in whole numbers throughout."""
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a.cast("long"), g) * b.cast("long")))


def log2_floor(c: Column) -> Column:
    """Place of the highest bit; -1 for 0."""
    return F.when(c == 0, -1).otherwise(F.char_length(F.bin(c)) - 1)


def lowest_bit(c: Column) -> Column:
    return c.bitwiseAND(-c)


def zigzag(c: Column) -> Column:
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1).cast("long"))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f names it; a plain expression is computed anew at each place, and for each element in a lambda."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(let(a, lambda v: dot(v, v)))


def cross(a: Column, b: Column) -> Column:
    x = lambda v, i: v[i].cast("double")
    of = lambda a, b: F.array(x(a, 1) * x(b, 2) - x(a, 2) * x(b, 1), x(a, 2) * x(b, 0) - x(a, 0) * x(b, 2), x(a, 0) * x(b, 1) - x(a, 1) * x(b, 0))
    return let(a, lambda v: let(b, lambda w: of(v, w)))


def det3(m: Column) -> Column:
    """Determinant of nine numbers, row by row."""
    e = [m[i] for i in range(9)]
    return e[0] * (e[4] * e[8] - e[5] * e[7]) - e[1] * (e[3] * e[8] - e[5] * e[6]) + e[2] * (e[3] * e[7] - e[4] * e[6])


@arrow_udf(ArrayType(DoubleType()))
def inverse3(m: pa.Array) -> pa.Array:
    """Inverse of nine numbers, row by row; null if there is none."""
    out = []
    for x in m.to_pylist():
        a = None if x is None or len(x) != 9 else np.array(x, float).reshape(3, 3)
        out.append(None if a is None or abs(np.linalg.det(a)) < 1e-300 else np.linalg.inv(a).ravel().tolist())
    return pa.array(out, pa.list_(pa.float64()))


@arrow_udf(BinaryType())
def double_key(column: pa.Array) -> pa.Array:
    """Eight bytes whose order is that of the doubles: the sign bit is turned, negative numbers turn wholly."""
    known = ~np.array(column.is_null().to_pylist(), bool)
    bits = np.nan_to_num(column.to_numpy(zero_copy_only=False).astype(float), nan=np.nan).view(np.uint64)
    keys = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)).astype(">u8").tobytes()
    return pa.array([keys[8 * k : 8 * k + 8] if ok else None for k, ok in enumerate(known)], pa.binary())


def extended_gcd(a: Column, b: Column) -> Column:
    """(gcd, x, y) with x * a + y * b = gcd, of numbers that aren't negative."""
    return _extended(a.cast("long"), b.cast("long"))


@arrow_udf(StructType().add("gcd", LongType()).add("x", LongType()).add("y", LongType()))
def _extended(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (v.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (a, b))
    one, two = (np.ones_like(x), np.zeros_like(x)), (np.zeros_like(x), np.ones_like(x))
    while y.any():
        q = np.where(y != 0, x // np.where(y == 0, 1, y), 0)
        going = y != 0
        x, y = np.where(going, y, x), np.where(going, x - q * y, y)
        one, two = tuple(np.where(going, t, o) for o, t in zip(one, two)), tuple(np.where(going, o - q * t, t) for o, t in zip(one, two))
    gone = np.array(pa.compute.or_(a.is_null(), b.is_null()).to_pylist(), bool)
    return pa.StructArray.from_arrays([pa.array(v) for v in (x, *one)], ["gcd", "x", "y"], mask=pa.array(gone))


def cubic_roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots of x^3 + a x^2 + b x + c, ascending: three, or the one there is (three equal ones where they meet)."""
    q, r = (a * a - 3 * b) / 9, (2 * a * a * a - 9 * a * b + 27 * c) / 54
    q3 = q * q * q
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r / F.sqrt(F.when(q3 > 0, q3))))) / 3
    three = F.array_sort(F.array(*[-2 * F.sqrt(q) * F.cos(theta + k * 2 * math.pi / 3) - a / 3 for k in (0, 1, -1)]))
    big = -F.signum(r) * F.cbrt(F.abs(r) + F.sqrt(F.greatest(r * r - q3, F.lit(0.0))))
    return F.when(r * r < q3, three).when(big != 0, F.array(big + q / big - a / 3)).otherwise(F.array(-a / 3, -a / 3, -a / 3))


def inverse_sigmoid(x: Column, rate: float = 1.0) -> Column:
    return -F.ln(1 / x - 1) / rate


def sigmoid_between(x: Column, start: float, finish: float, tolerance: float) -> Column:
    """A sigmoid that is `tolerance` at start and 1 - tolerance at finish."""
    return sigmoid(x - (start + finish) / 2, math.log((1 - tolerance) / tolerance) * 2 / (finish - start))


def round_even(x: Column) -> Column:
    """Nearest whole number; halves go to the even one."""
    return F.rint(x)


def round_half_up(x: Column) -> Column:
    """Nearest whole number; halves go away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def sinc(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-8, 1.0).otherwise(F.sin(x) / x)


def harmonic(n: Column) -> Column:
    """The sum of 1 / k up to n, approximately: the error is below 1 / (256 n^4)."""
    d = n.cast("double")
    return F.ln(d) + 0.5772156649 + 1 / (2 * d) - 1 / (12 * d * d) + 1 / (120 * d * d * d * d)


def stirling(n: Column) -> Column:
    """ln n!, approximately."""
    d = n.cast("double")
    return d * F.ln(d) - d + 0.5 * (math.log(2 * math.pi) + F.ln(d)) + 1 / (12 * d) - 1 / (360 * d * d * d)


def log_combinations(n: Column, k: Column) -> Column:
    """ln of n over k: a sum of at most fifteen terms, beyond that by Stirling's formula."""
    k = F.least(k, n - k)
    terms = F.transform(F.sequence(F.lit(1), F.greatest(F.least(k, F.lit(15)), F.lit(1)).cast("int")), lambda i: F.ln((n - k + i).cast("double")) - F.ln(i.cast("double")))
    return F.when(k == 0, 0.0).when(k > 15, stirling(n) - stirling(k) - stirling(n - k)).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def abs_diff(a: Column, b: Column) -> Column:
    return F.when(a > b, a - b).otherwise(b - a)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: What two doubles may differ by and still be taken as equal: five bits of the mantissa.
STANDARD_ERROR = 2.0**-52 * 32


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def within_margin(a: Column, b: Column, margin: float) -> Column:
    return abs_diff(a, b) <= margin


def within_fraction(a: Column, b: Column, fraction: float) -> Column:
    return (is_finite(a) | is_finite(b)) & (abs_diff(a, b) <= fraction * F.greatest(F.abs(a), F.abs(b)))


def almost_equal(a: Column, b: Column) -> Column:
    near = within_margin(a, b, STANDARD_ERROR) | within_fraction(a, b, STANDARD_ERROR)
    return (a == b) | (is_finite(a) & is_finite(b) & near)


def shards_to_read(written: Column, inputs: int) -> Column:
    """For booleans by output shard whether each of `inputs` input shards can have a record for one of them: their numbers are equal modulo the gcd."""
    common = lambda size: let(size, lambda m: F.aggregate(F.sequence(F.lit(1), F.lit(inputs)), F.lit(1), lambda s, k: F.when((F.lit(inputs) % k == 0) & (m % k == 0), k).otherwise(s)))
    marked = lambda own, g: F.transform(own, lambda w, m: F.when(w, m % g))
    read = lambda held, g: F.transform(F.sequence(F.lit(0), F.lit(inputs - 1)), lambda n: let(n % g, lambda k: F.exists(held, lambda m: F.coalesce(m == k, F.lit(False)))))
    return let(written, lambda own: let(common(F.size(own)), lambda g: let(marked(own, g), lambda held: read(held, g))))


def _si(value: Column, whole: Column) -> Column:
    """k, M, B or T with two digits, by steps of a thousand while a million or more is left."""
    out = F.when(value < 1e6, F.concat(F.format_string("%.2f", whole[0] / 1000.0), F.lit("k")))
    for k, unit in enumerate("MBT", 1):
        out = out.when(value < 10.0 ** (6 + 3 * k), F.concat(F.format_string("%.2f", whole[k] / 1000.0), F.lit(unit)))
    return out


def human_int(c: Column) -> Column:
    """Whole numbers below a thousand, then k, M, B, T with two digits, from 1e15 on in exponential form with three."""
    a, sign_ = F.abs(c.cast("long")), F.when(c < 0, "-").otherwise("")
    steps = [a, *[F.call_function("div", a, F.lit(10 ** (3 * k))) for k in (1, 2, 3)]]
    whole = [F.call_function("div", x + 5, F.lit(10)) * 10.0 for x in steps]  # halves of a hundredth go up
    return F.concat(sign_, F.when(a < 1000, a.cast("string")).when(a >= 10**15, three_digits(a.cast("double"))).otherwise(_si(a, whole)))


def human_num(c: Column) -> Column:
    """Three digits below a thousand, as human_int beyond."""
    a, sign_ = F.abs(c), F.when(c < 0, "-").otherwise("")
    out = F.when(a < 1.0, F.format_string("%.3f", a)).when(a < 10, F.format_string("%.2f", a)).when(a < 1e2, F.format_string("%.1f", a)).when(a < 1e3, F.format_string("%.0f", a))
    return F.concat(sign_, out.when(a >= 1e15, three_digits(a)).otherwise(_si(a, [a / 10.0 ** (3 * k) for k in range(4)])))


def three_digits(x: Column) -> Column:
    """A number in exponential form with at most three digits, zeros at the end left out."""
    text = F.format_string("%.2E", x)
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+E", "$1E"), r"\.E", "E")


def parse_human(c: Column) -> Column:
    """Numbers with k, M, B or T behind them; null for what is none."""
    unit = F.regexp_extract(c, r"([kKMBT])$", 1)
    scale = F.when(F.lower(unit) == "k", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    return F.regexp_replace(c, "[kKMBT]$", "").try_cast("double") * scale


def parse_human_bytes(c: Column) -> Column:
    """Bytes of 1.5K, 2M, 300B or 300: the key by which human-readable sizes are ordered."""
    parts = F.regexp_extract(c, r"^\s*(-?[0-9.]+)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(c, r"([BKMGTPEbkmgtpe])\s*$", 1))
    scale = F.lit(1.0)
    for k, u in enumerate("KMGTPE", 1):
        scale = F.when(unit == u, float(1 << 10 * k)).otherwise(scale)
    return F.round(parts * scale).cast("long")


def fingerprint_text(c: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def zero_padded(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def hex_digits(c: Column) -> Column:
    """How many hex digits a text begins with."""
    return F.char_length(F.regexp_extract(c, "^([0-9A-Fa-f]*)", 1))


def double_range(c: Column) -> Column:
    """(low, high) of `a..b`, of `a..` and `..b` with no limit on one side, and of one number, which is both."""
    number = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    split = c.rlike(rf"^\s*(?:{number})?\s*\.\.\s*(?:{number})?\s*$") & c.rlike("[0-9]")
    low, high = F.regexp_extract(c, rf"^\s*({number}?)\s*\.\.", 1), F.regexp_extract(c, rf"\.\.\s*({number})\s*$", 1)
    one = strip_number(c)
    infinite = float("inf")
    return F.struct(F.when(split, F.coalesce(low.try_cast("double"), F.lit(-infinite))).otherwise(one).alias("low"), F.when(split, F.coalesce(high.try_cast("double"), F.lit(infinite))).otherwise(one).alias("high"))


def strip_number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def reverse_bits(c: Column) -> Column:
    """The 64 bits in the other order."""
    half = lambda x: F.conv(x, 2, 10).cast("long")
    text = F.reverse(F.lpad(F.bin(c), 64, "0"))
    return F.shiftleft(half(F.substring(text, 1, 32)), 32).bitwiseOR(half(F.substring(text, 33, 32)))


def highest_bit(c: Column) -> Column:
    return F.when(c == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), log2_floor(c)))


def log2_ceil(c: Column) -> Column:
    return F.when(c <= 1, F.when(c == 1, 0).otherwise(-1)).otherwise(log2_floor(c - 1) + 1)


@arrow_udf(DoubleType())
def _rounded_off(x: pa.Array, bits: pa.Array) -> pa.Array:
    own = x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float).view(np.int64)
    n = bits.to_numpy(zero_copy_only=False).astype(np.int64)
    unit = np.int64(1) << n
    low, odd = own & (unit - 1), (own & unit) != 0
    up = (low > unit >> 1) | ((low == unit >> 1) & odd)
    return pa.array(((own & ~(unit - 1)) + np.where(up, unit, 0)).view(np.float64), mask=np.array(x.is_null().to_pylist(), bool))


def round_off_bits(x: Column, bits: int) -> Column:
    """The nearest double whose last `bits` bits are zero; halves go to the even one."""
    return _rounded_off(x.cast("double"), F.lit(bits).cast("long"))


# Vectors and matrices as arrays


def vector_map(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def normalized(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def vector_angle(a: Column, b: Column) -> Column:
    """Angle between vectors of three components."""
    return let(a, lambda v: let(b, lambda w: F.atan2(norm(cross(v, w)), dot(v, w))))


def largest_component(a: Column) -> Column:
    """Place of the component with the greatest size, the first of equals."""
    return let(F.transform(a, lambda x: F.abs(x.cast("double"))), lambda sizes: F.array_position(sizes, F.array_max(sizes)).cast("int") - 1)


def ortho(a: Column) -> Column:
    """A unit vector at right angles to one of three components."""
    unit = lambda k: F.array(*[F.when(k == i, 1.0).otherwise(0.0) for i in (1, 2, 0)])
    return let(a, lambda v: normalized(cross(v, let(largest_component(v), unit))))


def transposed(m: Column) -> Column:
    return F.array(*[m[3 * (i % 3) + i // 3] for i in range(9)])


def trace(m: Column) -> Column:
    return m[0] + m[4] + m[8]


def matmul(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def matvec(m: Column, v: Column) -> Column:
    return F.array(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


def frobenius(m: Column) -> Column:
    return norm(m)


def cofactors(m: Column) -> Column:
    """Matrix of cofactors, so that its transpose over the determinant is the inverse."""
    e = lambda i, j: m[3 * (i % 3) + j % 3]
    return F.array(*[e(i + 1, j + 1) * e(i + 2, j + 2) - e(i + 1, j + 2) * e(i + 2, j + 1) for i in range(3) for j in range(3)])


@arrow_udf(ArrayType(DoubleType()))
def symmetric_eigenvalues(m: pa.Array) -> pa.Array:
    """Eigenvalues of symmetric matrices of nine numbers, ascending."""
    good = [x is not None and len(x) == 9 and None not in x for x in m.to_pylist()]
    rows = np.array([x for x, ok in zip(m.to_pylist(), good) if ok], float).reshape(-1, 3, 3)
    found = iter(np.linalg.eigvalsh(rows).tolist() if len(rows) else [])
    return pa.array([next(found) if ok else None for ok in good], pa.list_(pa.float64()))
