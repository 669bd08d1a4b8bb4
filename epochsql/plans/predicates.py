"""Predicates as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import ast as A

EPSILON = 1e-4
Resolve = Callable[[object], tuple[Column, T.DataType]]


def resolver(df: DataFrame) -> Resolve:
    """Names of a frame, qualified or not."""

    def resolve(x) -> tuple[Column, T.DataType]:
        name = ".".join(f"`{p}`" for p in x.name.split("."))
        return F.col(name), df.select(name).schema[0].dataType

    return resolve


def literal(v, kind: T.DataType) -> Column:
    """A literal in the column's type where that loses nothing."""
    if v is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(v, str):
        return F.lit(v).cast(kind)
    if isinstance(kind, T.BooleanType) and isinstance(v, str):
        return F.lit(v).cast(kind)
    if isinstance(kind, T.StringType) and not isinstance(v, str):
        return F.lit(str(v).lower() if isinstance(v, bool) else str(v))
    if isinstance(kind, T.NumericType) and isinstance(v, str):
        return F.lit(v).cast(kind)
    return F.lit(v)


def equals(c: Column, kind: T.DataType, v) -> Column:
    """Equality with a literal. DECIMAL columns (doubles) are equal within EPSILON; the range goes to the scan."""
    if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(v, (int, float)) and not isinstance(v, bool):
        x = float(v)
        return c.between(x - EPSILON, x + EPSILON) & (F.abs(c - F.lit(x)) < EPSILON)
    return c == literal(v, kind)


def compare(c: Column, kind: T.DataType, op: str, v) -> Column:
    if op == "=":
        return equals(c, kind, v)
    if op == "!=":
        return ~equals(c, kind, v)
    x = literal(v, kind)
    if op in ("<", ">"):
        return c < x if op == "<" else c > x
    if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(v, (int, float)):
        near = EPSILON if op == "<=" else -EPSILON
        return (c < float(v) + near) if op == "<=" else (c > float(v) + near)
    return c <= x if op == "<=" else c >= x


def between_columns(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def compile_predicate(p, resolve: Resolve) -> Column:
    if isinstance(p, A.Chain):
        out = compile_predicate(p.first, resolve)
        for op, term in p.rest:
            right = compile_predicate(term, resolve)
            out = (out & right) if op == "AND" else (out | right)
        return out
    if isinstance(p, A.Not):
        return ~compile_predicate(p.inner, resolve)
    c, kind = resolve(p.left)
    if isinstance(p, A.Compare):
        if isinstance(p.right, A.Lit):
            return compare(c, kind, p.op, p.right.value)
        return between_columns(c, p.op, resolve(p.right)[0])
    if isinstance(p, A.In):
        values = [v.value for v in p.values]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out = equals(c, kind, values[0])
            for v in values[1:]:
                out = out | equals(c, kind, v)
        else:
            out = c.isin([literal(v, kind) for v in values])
    elif isinstance(p, A.Like):
        # % and _ are the only wildcards: a backslash is itself
        out = c.like(p.pattern.replace("\\", "\\\\"))
    elif isinstance(p, A.Between):
        out = compare(c, kind, ">=", p.low.value) & compare(c, kind, "<=", p.high.value)
    elif isinstance(p, A.IsNull):
        out = c.isNull()
    else:
        raise TypeError(f"no predicate: {p!r}")
    return ~out if p.negated else out
