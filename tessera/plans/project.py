"""Projection by tag paths: fields are addressed by number, repeated ones are unnested, several give the cross product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_tags(schema: T.StructType, start: int = 1) -> T.StructType:
    """A schema whose fields, nested ones too, have their place as tag where they have none."""

    def tagged(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(tagged(t.elementType), t.containsNull)
        return with_tags(t, start) if isinstance(t, T.StructType) else t

    return T.StructType([T.StructField(f.name, tagged(f.dataType), f.nullable, {"tag": k, **(f.metadata or {})}) for k, f in enumerate(schema, start)])


def resolve(schema: T.StructType, path: str) -> list[T.StructField]:
    """Fields along a path of tags such as `4.1`; the leaf must be a scalar."""
    out, t = [], schema
    for part in path.split("."):
        tag = int(part)
        if isinstance(t, T.ArrayType):
            t = t.elementType
        found = [f for f in with_tags(t)] if isinstance(t, T.StructType) else []
        own = next((f for f in found if f.metadata["tag"] == tag), None)
        if own is None:
            raise ValueError(f"no field with tag {tag} in {path}")
        out.append(own)
        t = own.dataType
    if isinstance(t.elementType if isinstance(t, T.ArrayType) else t, T.StructType):
        raise ValueError(f"{path} is a message")
    return out


def project(df: DataFrame, paths: list[str], names: list[str] | None = None, mode: str = "cross", null: str | None = None) -> DataFrame:
    """One column for each path. mode `cross`: every repeated path is unnested by itself; `zip`: paths under one repeated parent go together.

    A record whose repeated path is empty goes. null: how an unset optional leaf is shown (values become strings); unnested ones never are.
    """
    names = names or [f"c{p.replace('.', '_')}" for p in paths]
    out, kept, parents = df, [], {}
    for k, path in enumerate(paths):
        fields, col, steps, repeated = resolve(df.schema, path), None, (), False
        for f in fields:
            steps += (f.name,)
            col = F.col(f"`{f.name}`") if col is None else col[f.name]
            if isinstance(f.dataType, T.ArrayType):
                repeated = True
                key = steps if mode == "zip" else (k, *steps)
                if key not in parents:
                    parents[key] = f"__u{len(parents)}"
                    out = out.withColumn(parents[key], F.explode(col))
                col = F.col(parents[key])
        if null is not None:
            col = col.cast("string") if repeated else F.coalesce(col.cast("string"), F.lit(null))
        kept.append(col.alias(names[k]))
    return out.select(*kept)
