"""A predicate language over nested records, compiled to Column expressions.

Comparisons are existential over repeated fields; `!=` is NOT (=); unset fields read as their default. AND, OR and the comparison signs
<= >= != have one precedence, to the left; NOT takes the longest operand. Ordering is for integers only, and strings don't equal integers:
both are errors of analysis here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PlangError(ValueError):
    """The expression can't be parsed, or its types don't fit the schema."""


@dataclass
class Node:
    kind: str
    args: list = field(default_factory=list)
    value: object = None


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<op>&&|\|\||<=|>=|!=|[=<>(),])|(?P<word>[A-Za-z_][A-Za-z0-9_.]*)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'))""", re.S)
_WORDS = {"and": "AND", "AND": "AND", "or": "OR", "OR": "OR", "not": "NOT", "NOT": "NOT", "def": "DEF", "DEF": "DEF"}
_TRUTH = {"True": 1, "true": 1, "TRUE": 1, "False": 0, "false": 0, "FALSE": 0}


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise PlangError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        at = m.end()
        if m["num"]:
            out.append(("NUM", int(m["num"])))
        elif m["str"]:
            out.append(("STR", m["str"][1:-1]))
        elif m["op"]:
            out.append(({"&&": "AND", "||": "OR"}.get(m["op"], m["op"]), None))
        elif m["word"] in _TRUTH:
            out.append(("NUM", _TRUTH[m["word"]]))
        elif m["word"] in _WORDS:
            out.append((_WORDS[m["word"]], None))
        else:
            out.append(("ID", m["word"]))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = [*tokens(text), ("END", None)], 0

    def peek(self) -> str:
        return self.tokens[self.at][0]

    def take(self, *kinds: str):
        kind, value = self.tokens[self.at]
        if kinds and kind not in kinds:
            raise PlangError(f"expected {' or '.join(kinds)}, found {kind}")
        self.at += 1
        return value if kinds else (kind, value)

    def boolean(self) -> Node:
        left = self.unary()
        while self.peek() in ("AND", "OR"):
            kind, _ = self.take()
            left = Node(kind, [left, self.unary()])
        return left

    def unary(self) -> Node:
        if self.peek() == "NOT":
            self.take()
            return Node("NOT", [self.boolean()])
        if self.peek() == "DEF":
            self.take()
            self.take("(")
            name = self.take("ID")
            self.take(")")
            return Node("DEF", value=name)
        if self.peek() == "(":
            start = self.at
            try:
                return self.comparison()
            except PlangError:
                self.at = start
            self.take("(")
            inner = self.boolean()
            self.take(")")
            return inner
        return self.comparison()

    def comparison(self) -> Node:
        left = self.scalar()
        sign, _ = self.tokens[self.at][0], self.take("=", "!=", "<", "<=", ">", ">=")
        right = self.scalar()
        if sign == "!=":
            return Node("NOT", [Node("=", [left, right])])
        if sign in (">", ">="):
            left, right, sign = right, left, {">": "<", ">=": "<="}[sign]
        return Node(sign, [left, right])

    def scalar(self) -> Node:
        kind, value = self.take()
        if kind == "NUM":
            return Node("INT", value=value)
        if kind == "STR":
            return Node("STR", value=value)
        if kind == "(":
            inner = self.scalar()
            self.take(")")
            return inner
        if kind == "ID":
            if self.peek() != "(":
                return Node("PATH", value=value)
            self.take("(")
            args = [self.scalar()]
            while self.peek() == ",":
                self.take()
                args.append(self.scalar())
            self.take(")")
            return Node("CALL", args, value.lower())
        raise PlangError(f"unexpected {kind}")


def parse(text: str) -> Node:
    """The tree of an expression; an empty one is None."""
    p = _Parser(text)
    if p.peek() == "END":
        return None
    out = p.boolean()
    p.take("END")
    return out


_DEFAULTS = {"string": "", "int": 0}


def _kind(t: T.DataType, meta: dict) -> str:
    if "enum" in meta:
        return "enum"
    if isinstance(t, (T.StringType, T.BinaryType)):
        return "string"
    if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)) or isinstance(t, T.DecimalType) and t.scale == 0:
        return "int"
    raise PlangError(f"fields of type {t.simpleString()} can't be compared")


@dataclass
class _Value:
    """A value, or an array of values where the path goes through repeated fields."""

    col: Column
    kind: str
    many: bool = False
    enum: dict | None = None
    const: object = None


def _getter(name: str):
    return lambda x: x[name]


class _Compiler:
    def __init__(self, schema: T.StructType, functions: dict):
        self.schema, self.functions = schema, functions

    def path(self, name: str) -> _Value:
        col, t, many, meta = None, self.schema, False, {}
        for part in name.split("."):
            if isinstance(t, T.ArrayType):
                t = t.elementType
            if not isinstance(t, T.StructType) or part not in t.fieldNames():
                raise PlangError(f"no field {name}")
            f = t[part]
            step = F.col(f"`{part}`") if col is None else F.transform(col, _getter(part)) if many else col[part]
            t, meta = f.dataType, f.metadata or {}
            if isinstance(t, T.ArrayType):
                empty = F.array().cast(t)
                col = F.flatten(F.transform(step, lambda x: F.coalesce(x, empty))) if many else F.coalesce(step, empty)
                many = True
            else:
                col = step
        if isinstance(t, T.ArrayType):
            t = t.elementType
        kind = _kind(t, meta)
        default = meta.get("default", "" if kind in ("string", "enum") else 0)
        wide = (lambda c: c.cast("int")) if isinstance(t, T.BooleanType) else (lambda c: c)
        read = lambda c: F.coalesce(wide(c), F.lit(default))
        return _Value(F.transform(col, read) if many else read(col), kind, many, meta.get("enum"))

    def scalar(self, n: Node) -> _Value:
        if n.kind == "INT":
            return _Value(F.lit(n.value if n.value < 1 << 63 else Decimal(n.value)), "int", const=n.value)
        if n.kind == "STR":
            return _Value(F.lit(n.value), "string", const=n.value)
        if n.kind == "PATH":
            return self.path(n.value)
        if n.value not in self.functions:
            raise PlangError(f"unknown function {n.value}")
        col, kind = self.functions[n.value](*[self.scalar(a).col for a in n.args])
        return _Value(col, kind)

    def equal(self, a: _Value, b: _Value) -> Column:
        for x, y in ((a, b), (b, a)):
            if x.kind == "enum" and y.const is not None:
                names = {v: k for k, v in x.enum.items()}
                y.col, y.kind = F.lit(names.get(y.const, f"#{y.const}") if y.kind == "int" else y.const), "enum"
        if {a.kind, b.kind} == {"string", "int"} or "int" in (a.kind, b.kind) and "enum" in (a.kind, b.kind):
            raise PlangError("a string can't be compared with an integer")
        if a.many and b.many:
            return F.coalesce(F.arrays_overlap(a.col, b.col), F.lit(False))
        if a.many or b.many:
            many, one = (a, b) if a.many else (b, a)
            return F.coalesce(F.exists(many.col, lambda x: x == one.col), F.lit(False))
        return a.col == b.col

    def order(self, a: _Value, b: _Value, sign: str) -> Column:
        if a.kind != "int" or b.kind != "int":
            raise PlangError("only integers have an order")
        low = F.array_min(a.col) if a.many else a.col
        high = F.array_max(b.col) if b.many else b.col
        return F.coalesce(low < high if sign == "<" else low <= high, F.lit(False))

    def present(self, name: str) -> Column:
        parts = name.split(".")

        def walk(col: Column | None, t: T.DataType, rest: list[str]) -> Column:
            if not isinstance(t, T.StructType) or rest[0] not in t.fieldNames():
                raise PlangError(f"no field {name}")
            f = t[rest[0]]
            own = F.col(f"`{rest[0]}`") if col is None else col[rest[0]]
            if isinstance(f.dataType, T.ArrayType):
                if len(rest) == 1:
                    return F.coalesce(F.size(own) > 0, F.lit(False))
                return F.coalesce(F.exists(own, lambda x: walk(x, f.dataType.elementType, rest[1:])), F.lit(False))
            return own.isNotNull() if len(rest) == 1 else walk(own, f.dataType, rest[1:])

        return walk(None, self.schema, parts)

    def boolean(self, n: Node) -> Column:
        if n.kind == "AND":
            return self.boolean(n.args[0]) & self.boolean(n.args[1])
        if n.kind == "OR":
            return self.boolean(n.args[0]) | self.boolean(n.args[1])
        if n.kind == "NOT":
            return ~self.boolean(n.args[0])
        if n.kind == "DEF":
            return self.present(n.value)
        a, b = map(self.scalar, n.args)
        return self.equal(a, b) if n.kind == "=" else self.order(a, b, n.kind)


def compile_where(text: str, schema: T.StructType, functions: dict | None = None) -> Column:
    """A Column that is never null. functions: name -> callable of Columns that gives (Column, "int" or "string")."""
    tree = parse(text)
    return F.lit(True) if tree is None else _Compiler(schema, functions or {}).boolean(tree)


def where(df, text: str, functions: dict | None = None):
    return df.where(compile_where(text, df.schema, functions))
