"""String functions as Columns."""

from __future__ import annotations

import base64 as b64
import quopri
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, StringType

SPACE = r"[ \t\n\x0B\f\r]"


def _text(c: Column) -> Column:
    return c.cast("string")


def str_cat(*cols: Column) -> Column:
    return F.concat(*[_text(c) for c in cols])


def substitute(template: str, *args: Column) -> Column:
    """`$0` to `$9` are arguments, `$$` is a dollar."""
    parts = []
    for piece in re.split(r"(\$\$|\$[0-9])", template):
        parts.append(F.lit("$") if piece == "$$" else _text(args[int(piece[1])]) if re.fullmatch(r"\$[0-9]", piece) else F.lit(piece))
    return F.concat(*parts)


def split_literal(c: Column, sep: str, limit: int = -1) -> Column:
    return F.split(c, re.escape(sep), limit + 1 if limit >= 0 else -1)


def split_any(c: Column, chars: str) -> Column:
    return F.split(c, "[" + re.escape(chars) + "]")


def split_length(c: Column, n: int) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{n}}}"), 0)


def skip_empty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def skip_whitespace(a: Column) -> Column:
    return F.filter(a, lambda x: ~x.rlike(f"^{SPACE}*$"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def strip_leading(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+", "")


def strip_trailing(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def strip_extra(c: Column) -> Column:
    """Outer white space goes, inner runs become one space."""
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def strip_markup(c: Column) -> Column:
    """Tags go; an open `<` takes the rest with it."""
    return F.regexp_replace(c, "<[^>]*(>|$)", "")


def remove_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.char_length(c) - len(suffix))).otherwise(c)


def count_substring(c: Column, part: str) -> Column:
    """Occurrences, overlapping ones too."""
    return F.regexp_count(c, F.lit(f"(?={re.escape(part)})"))


def replace_count(c: Column, part: str) -> Column:
    """How often a replacement of all occurrences would take place."""
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def find(c: Column, part: str) -> Column:
    """Place from 0, -1 if it isn't there."""
    return F.instr(c, part) - 1


def rfind(c: Column, part: str) -> Column:
    at = F.instr(F.reverse(c), part[::-1])
    return F.when(at == 0, -1).otherwise(F.char_length(c) - at - len(part) + 1)


def find_any(c: Column, chars: str) -> Column:
    return F.regexp_instr(c, F.lit("[" + re.escape(chars) + "]")) - 1


def find_nth(c: Column, char: str, n: int) -> Column:
    head = F.substring_index(c, char, n)
    return F.when(replace_count(c, char) >= n, F.char_length(head)).otherwise(-1)


def extension(c: Column) -> Column:
    return F.when(c.contains("."), F.substring_index(c, ".", -1)).otherwise("")


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def path_join(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", ""))


def escape_csv(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('""'))


def backslash_escape(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, "([" + re.escape(chars) + r"])", r"\\$1")


def backslash_unescape(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, r"\\([" + re.escape(chars) + "])", "$1")


def clean_line_ends(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def base64(c: Column, web_safe: bool = False, padding: bool = True) -> Column:
    out = F.translate(F.base64(c.cast("binary")), "\r\n", "")
    out = F.translate(out, "+/", "-_") if web_safe else out
    return out if padding else F.rtrim(out, F.lit("="))


def unbase64(c: Column, web_safe: bool = False) -> Column:
    plain = F.translate(c, "-_", "+/") if web_safe else c
    short = F.pmod(-F.char_length(plain), F.lit(4))
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), short)))


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c.cast("binary")))


def url_encode(c: Column, plus: bool = True) -> Column:
    """Letters, digits and -_.!~*'() stay."""
    out = F.url_encode(c)
    for code, char in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out if plus else F.replace(out, F.lit("+"), F.lit("%20"))


def url_decode(c: Column, plus: bool = True) -> Column:
    return F.url_decode(c if plus else F.replace(c, F.lit("+"), F.lit("%2B")))


def natural_key(c: Column, width: int = 20) -> Column:
    """Sort key in which runs of digits have the order of their numbers."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), width, "0")).otherwise(x)), "")


def key_values(c: Column, pair: str = ",", inner: str = ":") -> Column:
    return F.str_to_map(c, F.lit(re.escape(pair)), F.lit(re.escape(inner)))


def split_csv(c: Column, sep: str = ",") -> Column:
    """Fields of one line: outer space goes, quotes may hold separators, two quotes are one."""
    q = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), c), F.lit(rf'{q}\s*("(?:[^"]|"")*"|[^{q}]*)'), 1)
    return F.transform(raw, lambda x: F.when(strip(x).startswith('"'), F.replace(F.regexp_replace(strip(x), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(strip(x)))


_ESCAPES = {ord("\n"): "\\n", ord("\r"): "\\r", ord("\t"): "\\t", ord('"'): '\\"', ord("'"): "\\'", ord("\\"): "\\\\"}


@arrow_udf(StringType())
def c_escape(column: pa.Array) -> pa.Array:
    """C escapes; bytes outside printable ASCII as three octal digits."""
    out = [None if x is None else "".join(_ESCAPES.get(b) or (chr(b) if 32 <= b < 127 else f"\\{b:03o}") for b in (x if isinstance(x, bytes) else x.encode())) for x in column.to_pylist()]
    return pa.array(out, pa.string())


_UNESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|x([0-9a-fA-F]+)|(.))", re.S)
_PLAIN = {b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v"}


@arrow_udf(BinaryType())
def c_unescape(column: pa.Array) -> pa.Array:
    def one(m):
        if m[1] or m[2]:
            return bytes([int(m[1], 8) & 255 if m[1] else int(m[2], 16) & 255])
        return _PLAIN.get(m[3], m[3])

    return pa.array([None if x is None else _UNESCAPE.sub(one, x.encode()) for x in column.to_pylist()], pa.binary())


@arrow_udf(StringType())
def base32(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else b64.b32encode(x if isinstance(x, bytes) else x.encode()).decode() for x in column.to_pylist()], pa.string())


@arrow_udf(StringType())
def base32hex(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else b64.b32hexencode(x if isinstance(x, bytes) else x.encode()).decode() for x in column.to_pylist()], pa.string())


@arrow_udf(StringType())
def quoted_printable(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else quopri.encodestring(x if isinstance(x, bytes) else x.encode()).decode() for x in column.to_pylist()], pa.string())


@arrow_udf(BinaryType())
def unquoted_printable(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else quopri.decodestring(x.encode()) for x in column.to_pylist()], pa.binary())


@arrow_udf(ArrayType(StringType()))
def split_structured(column: pa.Array) -> pa.Array:
    """Comma-separated parts; commas inside brackets don't separate."""
    closing = {")": "(", "]": "[", "}": "{"}

    def one(text):
        out, depth, start = [], [], 0
        for k, ch in enumerate(text):
            if ch in "([{":
                depth.append(ch)
            elif ch in closing and depth and depth[-1] == closing[ch]:
                depth.pop()
            elif ch == "," and not depth:
                out.append(text[start:k])
                start = k + 1
        return [*out, text[start:]]

    return pa.array([None if x is None else one(x) for x in column.to_pylist()], pa.list_(pa.string()))


# Splitting with escapes, ranges and parsed values


def split_escaped(c: Column, sep: str = ",", allow_empty: bool = False) -> Column:
    """Parts between separators; a backslash makes the character behind it an ordinary one."""
    q = re.escape(sep)
    parts = F.regexp_extract_all(F.concat(F.lit(sep), c), F.lit(rf"(?s){q}((?:\\.|[^{q}\\])*)"), 1)
    plain = F.transform(parts, lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1"))
    return plain if allow_empty else skip_empty(plain)


def split_range(c: Column) -> Column:
    """(from, to) of `a-b`, `a-`, `-b`, `a` or `-`; an end that isn't there is null, and both are for what is no range."""
    good = c.rlike(r"^(-|-?[0-9]+|[0-9]+-[0-9]*)?$") & ~c.rlike(r"^-[0-9]+-")
    first, last = F.regexp_extract(c, "^([0-9]+)", 1).try_cast("int"), F.regexp_extract(c, "-([0-9]+)$", 1).try_cast("int")
    return F.struct(F.when(good, first).alias("from"), F.when(good, last).alias("to"))


def split_parse(c: Column, sep: str, kind: str) -> Column:
    """Parts as values of a type; null if any part isn't one."""
    values = F.transform(skip_empty(split_literal(c, sep)), lambda x: strip(x).try_cast(kind))
    return F.when(F.forall(values, lambda v: v.isNotNull()), values)


def leading_decimals(c: Column) -> Column:
    """Integers of a comma-separated list, up to the first part that isn't one."""
    return F.transform(F.split(F.regexp_extract(c, r"^\s*((?:-?[0-9]+)(?:,-?[0-9]+)*)", 1), ","), lambda x: x.try_cast("bigint"))


def first_token(c: Column, chars: str) -> Column:
    """What stands before the first of some characters, all if there is none."""
    return F.regexp_extract(c, "^([^" + re.escape(chars) + "]*)", 1)


def rest_of_tokens(c: Column, chars: str) -> Column:
    """What stands behind the first of some characters; null if there is none."""
    q = re.escape(chars)
    return F.when(c.rlike(f"[{q}]"), F.regexp_extract(c, f"(?s)^[^{q}]*[{q}](.*)$", 1))


def key_and_values(c: Column, pair: str = ":", inner: str = ",") -> Column:
    """(key, values) of a line `key:v1,v2`."""
    return F.struct(F.substring_index(c, pair, 1).alias("key"), skip_empty(F.split(rest_of_tokens(c, pair), re.escape(inner))).alias("values"))


def clip(c: Column, most: int) -> Column:
    """At most so many characters; what is longer ends with an ellipsis, behind a whole word where one fits."""
    room = most - 3
    head = F.left(c, F.lit(room))
    whole = F.regexp_extract(head, r"(?s)^(.*\S)\s+\S*$", 1)
    at_end = F.substring(c, room + 1, 1).rlike(r"^\s")
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.when(at_end | (whole == ""), head).otherwise(whole), F.lit("...")))


def wrap(c: Column, width: int) -> Column:
    """Lines of at most so many characters, cut behind white space where there is some."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(.{{1,{width}}}(?:\s|$)|.{{1,{width}}})"), 1)


# Trims


def trim_left(c: Column, chars: str) -> Column:
    return F.ltrim(c, F.lit(chars))


def trim_right(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def trim_both(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def trim_runs(c: Column, chars: str) -> Column:
    """Outer runs of the characters go, inner ones become the first of them."""
    return F.regexp_replace(trim_both(c, chars), "[" + re.escape(chars) + "]+", re.escape(chars[0]) if chars[0] in "\\$" else chars[0])


def strip_dup(c: Column, char: str) -> Column:
    """Runs of one character become one."""
    return F.regexp_replace(c, f"{re.escape(char)}+", char if char not in "\\$" else "\\" + char)


def strip_brackets(c: Column, left: str = "[", right: str = "]") -> Column:
    """Brackets go with what they hold."""
    a, b = re.escape(left), re.escape(right)
    return F.regexp_replace(c, f"{a}[^{b}]*{b}", "")


def replace_suffix(c: Column, old: str, new: str) -> Column:
    return F.when(c.endswith(old) & F.lit(bool(old)), F.concat(F.left(c, F.char_length(c) - len(old)), F.lit(new))).otherwise(c)


# Searches


def find_ignoring_case(c: Column, part: str) -> Column:
    """Place from 0, whatever the case of ASCII letters; -1 if it isn't there."""
    return F.regexp_instr(c, F.lit("(?i)" + re.escape(part))) - 1


def find_alnum(c: Column, part: str) -> Column:
    """Place from 0 where letters and digits follow one another as in `part`, whatever else stands between them; -1 if nowhere."""
    letters = [ch for ch in part if ch.isascii() and ch.isalnum()]
    return F.regexp_instr(c, F.lit("(?i)" + "[^a-z0-9]*".join(letters))) - 1


def find_delimited(c: Column, part: str, sep: str) -> Column:
    """Place from 0 of a whole part between separators; -1 if there is none."""
    q = re.escape(sep)
    return F.regexp_instr(c, F.lit(rf"(?<![^{q}]){re.escape(part)}(?![^{q}])")) - 1


def suffix_ignoring_case(c: Column, part: str) -> Column:
    return F.lower(c).endswith(part.lower())


def prefix_ignoring_case(c: Column, part: str) -> Column:
    return F.lower(c).startswith(part.lower())


def find_last_of(c: Column, chars: str) -> Column:
    at = F.regexp_instr(F.reverse(c), F.lit("[" + re.escape(chars) + "]"))
    return F.when(at == 0, -1).otherwise(F.char_length(c) - at)


def find_first_not_of(c: Column, chars: str) -> Column:
    return F.regexp_instr(c, F.lit("[^" + re.escape(chars) + "]")) - 1


def find_last_not_of(c: Column, chars: str) -> Column:
    at = F.regexp_instr(F.reverse(c), F.lit("[^" + re.escape(chars) + "]"))
    return F.when(at == 0, -1).otherwise(F.char_length(c) - at)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the order of bytes."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def end_of_line(c: Column) -> Column:
    """(place, length) of the next line end; behind the text and 0 if there is none."""
    at = F.regexp_instr(c, F.lit("\r\n|\n|\r"))
    return F.struct(F.when(at == 0, F.char_length(c)).otherwise(at - 1).alias("place"), F.char_length(F.regexp_extract(c, "(\r\n|\n|\r)", 1)).alias("length"))


def first_word(c: Column) -> Column:
    return F.regexp_extract(c, rf"^{SPACE}*([^ \t\n\x0B\f\r]+)", 1)


def is_identifier(c: Column) -> Column:
    return c.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def tag_value(c: Column, tag: str) -> Column:
    """The value of `tag=value`, which ends with white space."""
    return F.when(c.rlike(rf"\b{re.escape(tag)}="), F.regexp_extract(c, rf"\b{re.escape(tag)}=(\S*)", 1))


# Classes of characters


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def only_whitespace(c: Column) -> Column:
    return c.rlike(f"^{SPACE}*$")


#: Classes of ASCII characters as sets of a pattern.
CLASSES = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "xdigit": "0-9A-Fa-f", "punct": r"!-/:-@\[-`{-~", "space": r" \t\n\x0B\f\r", "print": " -~", "graph": "!-~", "cntrl": r"\x00-\x1F\x7F"}


def count_class(c: Column, name: str) -> Column:
    """How many characters of a class there are."""
    return F.char_length(F.regexp_replace(c, f"[^{CLASSES[name]}]", ""))


def all_of_class(c: Column, name: str) -> Column:
    return c.rlike(f"^[{CLASSES[name]}]*$")


def in_charset(c: Column, chars: str) -> Column:
    """Whether every character is one of the set."""
    return c.rlike("^[" + re.escape(chars) + "]*$")


def runes(c: Column) -> Column:
    """Code points of a text."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))


def rune_length(c: Column) -> Column:
    """Bytes of each code point in UTF-8."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.octet_length)


def title_case(c: Column) -> Column:
    return F.initcap(c)


# Escapes of other languages


def escape_sql(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def escape_json(c: Column) -> Column:
    """A text as it stands between the quotes of JSON."""
    whole = F.to_json(F.struct(c.alias("x")))
    return F.substring(F.left(whole, F.char_length(whole) - 2), 7, 1 << 30)


def escape_shell(c: Column) -> Column:
    """As it is if every character is safe, else between single quotes, in which a quote is closed, escaped and opened again."""
    return F.when(c.rlike(r"^[A-Za-z0-9+@%_:,./=-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def escape_file_name(c: Column) -> Column:
    """Letters, digits, dots, dashes and underscores stay; other bytes become % and two hex digits."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def unescape_file_name(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def hex_escape(c: Column) -> Column:
    """Each byte as \\x and two hex digits."""
    return F.regexp_replace(F.lower(F.hex(c.cast("binary"))), "(..)", r"\\x$1")


def prefix_successor(c: Column) -> Column:
    """The least ASCII text over all that begin with this one: the last character below 0x7F goes up by one, what follows goes."""
    cut = F.regexp_replace(c, "\x7f+$", "")
    return F.when(cut != "", F.concat(F.left(cut, F.char_length(cut) - 1), F.chr(F.ascii(F.right(cut, F.lit(1))) + 1)))
