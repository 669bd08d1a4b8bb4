"""SELECT as a DataFrame. Catalyst does the rest: pushdown, pruning, join choice and order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang import ast as A
from .predicates import between_columns, compile_predicate, resolver

Tables = Callable[[str, object], DataFrame]


class PlanError(ValueError):
    pass


def _col(name: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


def _aggregate(a: A.Agg) -> Column:
    if a.arg is None:
        return F.count(F.lit(1))
    c = _col(a.arg)
    if a.distinct:
        return {"COUNT": F.count_distinct, "SUM": F.sum_distinct}.get(a.func, lambda x: getattr(F, a.func.lower())(x))(c)
    return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[a.func](c)


def _leaf_aggs(p, out: list[A.Agg]) -> None:
    if isinstance(p, A.Agg):
        if p not in out:
            out.append(p)
    elif isinstance(p, A.Chain):
        for x in (p.first, *(t for _, t in p.rest)):
            _leaf_aggs(x, out)
    elif isinstance(p, A.Not):
        _leaf_aggs(p.inner, out)
    elif p is not None and not isinstance(p, (A.Col, A.Lit, str)):
        _leaf_aggs(p.left, out)
        if isinstance(p, A.Compare):
            _leaf_aggs(p.right, out)


def _on(p, resolve) -> Column:
    """Join conditions. Column against column is exact equality, so that equi-joins stay hash or merge joins."""
    if isinstance(p, A.Compare) and not isinstance(p.right, A.Lit):
        return between_columns(resolve(p.left)[0], p.op, resolve(p.right)[0])
    if isinstance(p, A.Chain):
        out = _on(p.first, resolve)
        for op, term in p.rest:
            out = (out & _on(term, resolve)) if op == "AND" else (out | _on(term, resolve))
        return out
    return compile_predicate(p, resolve)


def source(s: A.Select, tables: Tables) -> DataFrame:
    df = tables(s.table.name, s.as_of).alias(s.table.alias or s.table.name)
    for j in s.joins:
        right = tables(j.table.name, s.as_of).alias(j.table.alias or j.table.name)
        if j.kind == "cross":
            df = df.crossJoin(right)
            continue
        both = df.crossJoin(right)  # only to resolve names and types; the plan is never run
        df = df.join(right, _on(j.on, resolver(both)), j.kind)
    return df


def build(s: A.Select, tables: Tables) -> DataFrame:
    df = source(s, tables)
    if s.where is not None:
        df = df.where(compile_predicate(s.where, resolver(df)))
    aggs: list[A.Agg] = []
    for x in (*(i.expr for i in s.items), *(k.expr for k in s.order), s.having):
        _leaf_aggs(x, aggs)
    if aggs or s.group:
        return _grouped(s, df, aggs)
    if s.having is not None:
        raise PlanError("HAVING needs GROUP BY or an aggregate")
    columns, names = [], {}
    for i in s.items:
        if i.expr == "*":
            columns.append("*")
        elif isinstance(i.expr, str):
            columns.append(f"`{i.expr[:-2]}`.*")
        else:
            out = i.alias or i.expr.name.split(".")[-1]
            names[out] = names[i.expr.name] = out
            columns.append(_col(i.expr.name).alias(out))
    keys = lambda known: [_sorted(_col(known.get(k.expr.name, k.expr.name)), k) for k in s.order]
    if s.distinct:
        df = df.select(*columns).distinct()
        df = df.orderBy(*keys(names)) if s.order else df
        return _cut(df, s)
    if s.order:
        # a key may be an alias of the select list or any column of the source
        aliases = {i.alias: i.expr.name for i in s.items if i.alias and isinstance(i.expr, A.Col)}
        df = df.orderBy(*[_sorted(_col(aliases.get(k.expr.name, k.expr.name)), k) for k in s.order])
    if len(s.items) == 1 and s.items[0].expr == "*":
        return _cut(df, s)
    return _cut(df.select(*columns), s)


def _sorted(c: Column, k: A.SortKey) -> Column:
    """Nulls first when ascending, last when descending."""
    return c.asc_nulls_first() if k.ascending else c.desc_nulls_last()


def _cut(df: DataFrame, s: A.Select) -> DataFrame:
    if s.offset:
        df = df.offset(s.offset)
    return df if s.limit is None else df.limit(s.limit)


def _grouped(s: A.Select, df: DataFrame, aggs: list[A.Agg]) -> DataFrame:
    group = {g.name: f"__g{n}" for n, g in enumerate(s.group)}
    short = {g.name.split(".")[-1]: v for g, v in zip(s.group, group.values(), strict=True)}
    inner = {a: f"__a{n}" for n, a in enumerate(aggs)}
    keyed = [_col(g.name).alias(group[g.name]) for g in s.group]
    columns = [_aggregate(a).alias(n) for a, n in inner.items()]
    df = df.groupBy(*keyed).agg(*columns) if columns else df.select(*keyed).distinct()
    aliases = {i.alias: i.expr for i in s.items if i.alias}

    def name_of(x) -> str:
        if isinstance(x, A.Agg):
            return inner[x]
        if x.name in group:
            return group[x.name]
        if x.name in aliases:
            return name_of(aliases[x.name])
        if x.name.split(".")[-1] in short:
            return short[x.name.split(".")[-1]]
        raise PlanError(f"{x.name} is neither grouped nor aggregated")

    kinds = {f.name: f.dataType for f in df.schema}
    if s.having is not None:
        df = df.where(compile_predicate(s.having, lambda x: (F.col(name_of(x)), kinds[name_of(x)])))
    out = []
    for i in s.items:
        if isinstance(i.expr, str):
            raise PlanError("* can't stand beside GROUP BY or aggregates")
        out.append((name_of(i.expr), i.alias or (i.expr.label if isinstance(i.expr, A.Agg) else i.expr.name.split(".")[-1])))
    chosen = [F.col(a).alias(b) for a, b in out]
    if s.distinct:
        renamed = dict(out)
        df = df.select(*chosen).distinct()
        if s.order:
            df = df.orderBy(*[_sorted(F.col(f"`{renamed[name_of(k.expr)]}`"), k) for k in s.order])
        return _cut(df, s)
    if s.order:
        df = df.orderBy(*[_sorted(F.col(name_of(k.expr)), k) for k in s.order])
    return _cut(df.select(*chosen), s)
