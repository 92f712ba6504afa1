"""Typed relational programs: the shapes of question that a planner fills with parameters.

``Program`` covers rows and groups over tables joined along declared links, with filters, formulas,
baselines and top-k per partition; functions below it cover periods, trends, absence, cohorts, ratios,
and business rules. All are DataFrame lineage; ``to_sql`` renders a program for review.
"""

from __future__ import annotations

import ast
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """``left`` refers to a unique key of ``right`` by one or more columns."""

    left: str
    right: str
    on: tuple[tuple[str, str], ...]


def join_path(links: list[Link], start: str, goal: str) -> list[tuple[Link, bool]]:
    """The shortest chain of links between two tables (breadth first, by the order of the links)."""
    queue, seen = deque([(start, [])]), {start}
    while queue:
        at, path = queue.popleft()
        if at == goal:
            return path
        for k in links:
            for here, there, forward in ((k.left, k.right, True), (k.right, k.left, False)):
                if here == at and there not in seen:
                    seen.add(there)
                    queue.append((there, [*path, (k, forward)]))
    raise ValueError(f"no links join {start} and {goal}")


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: object = None

    def test(self) -> Column:
        c, v = F.col(self.column), self.value
        made = {
            "eq": lambda: c == v, "ne": lambda: c != v, "lt": lambda: c < v, "le": lambda: c <= v, "gt": lambda: c > v, "ge": lambda: c >= v,
            "between": lambda: c.between(*v), "null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(), "zero_or_null": lambda: c.isNull() | (c == 0), "in": lambda: c.isin(*v),
            "semantic": lambda: F.col(f"{self.column}.value_bool") == v, "none": lambda: F.lit(True),
        }
        return made[self.op]()

    def sql(self) -> str:
        v = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
        signs = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
        if self.op in signs:
            return f"{self.column} {signs[self.op]} {v(self.value)}"
        return {"between": lambda: f"{self.column} BETWEEN {v(self.value[0])} AND {v(self.value[1])}", "null": lambda: f"{self.column} IS NULL", "not_null": lambda: f"{self.column} IS NOT NULL", "in": lambda: f"{self.column} IN ({', '.join(map(v, self.value))})"}[self.op]()


@dataclass(frozen=True)
class Program:
    """``family``: rows or groups. ``statistic``: count, count_distinct, sum, avg, min, max, weighted.
    ``formula``: (ratio | product | sum | difference, a, b) in the place of a column. ``baseline``:
    None, ``partition:<column>`` or ``global``: what the measure is compared with."""

    root: str
    family: str = "rows"
    columns: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()
    groups: tuple[str, ...] = ()
    statistic: str | None = None
    measure: str | None = None
    weight: str | None = None
    formula: tuple[str, str, str] | None = None
    baseline: str | None = None
    rank_by: str | None = None
    top_k: int | None = None
    order: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    links: tuple[Link, ...] = field(default=())


def _formula(p: Program) -> Column:
    if p.formula is None:
        return F.col(p.measure)
    kind, a, b = p.formula
    x, y = F.col(a), F.col(b)
    return {"ratio": x * F.lit(1.0) / F.nullif(y, F.lit(0)), "product": x * y, "sum": x + y, "difference": x - y}[kind]


def weighted_mean(value: Column, weight: Column) -> Column:
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0.0))


def _statistic(p: Program) -> Column:
    if p.statistic == "count":
        return F.count("*")
    x = _formula(p)
    if p.statistic == "weighted":
        return weighted_mean(x, F.col(p.weight))
    return {"count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[p.statistic](x)


def joined(p: Program, tables: dict[str, DataFrame]) -> DataFrame:
    out, have = tables[p.root], {p.root}
    for goal in p.tables:
        for link, forward in join_path(list(p.links), p.root, goal):
            there = link.right if forward else link.left
            if there in have:
                continue
            on = [F.col(a) == F.col(b) for a, b in link.on]
            out, have = out.join(tables[there], on), have | {there}
    return out


def run(p: Program, tables: dict[str, DataFrame]) -> DataFrame:
    df = joined(p, tables)
    for c in p.conditions:
        df = df.where(c.test())
    if p.baseline and p.family == "rows":
        kind, _, column = p.baseline.partition(":")
        df = df.withColumn("measure", _formula(p))
        if kind == "partition":
            df = df.withColumn("baseline", F.avg("measure").over(W.partitionBy(column)))
        else:
            df = df.crossJoin(F.broadcast(df.agg(F.avg("measure").alias("baseline"))))  # one row
        df = df.where(F.col("measure") > F.col("baseline"))
    if p.family == "groups":
        df = df.groupBy(*p.groups).agg(_statistic(p).alias("value"))
    elif p.formula and not p.baseline:
        df = df.withColumn("value", _formula(p))
    if p.rank_by:
        best = W.partitionBy(*p.groups[:1] if p.family == "groups" else p.groups).orderBy(F.col(p.rank_by).desc_nulls_last(), *p.columns)
        df = df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= p.top_k).drop("_r")
    if p.order:
        df = df.orderBy(*(F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in p.order))
    if p.offset:
        df = df.offset(p.offset)
    if p.limit is not None:
        df = df.limit(p.limit)
    if p.columns:
        df = df.select(*p.columns)
    return df.distinct() if p.distinct else df


def to_sql(p: Program) -> str:
    """The program as text for review: the plain families."""
    froms, have = p.root, {p.root}
    for goal in p.tables:
        for link, forward in join_path(list(p.links), p.root, goal):
            there = link.right if forward else link.left
            if there not in have:
                froms += f" JOIN {there} ON " + " AND ".join(f"{a} = {b}" for a, b in link.on)
                have.add(there)
    if p.family == "groups":
        stat = {"count": "COUNT(*)", "count_distinct": f"COUNT(DISTINCT {p.measure})", "weighted": f"SUM({p.measure} * {p.weight}) / NULLIF(SUM({p.weight}), 0)"}.get(p.statistic, f"{(p.statistic or '').upper()}({p.measure})")
        select = ", ".join([*p.groups, f"{stat} AS value"])
    else:
        select = ", ".join(p.columns) or "*"
    sql = f"SELECT {'DISTINCT ' if p.distinct else ''}{select} FROM {froms}"
    if p.conditions:
        sql += " WHERE " + " AND ".join(c.sql() for c in p.conditions)
    if p.family == "groups" and p.groups:
        sql += " GROUP BY " + ", ".join(p.groups)
    if p.order:
        sql += " ORDER BY " + ", ".join(f"{c} {d.upper()} NULLS LAST" for c, d in p.order)
    return sql + (f" LIMIT {p.limit}" if p.limit is not None else "") + (f" OFFSET {p.offset}" if p.offset else "")


def periods(df: DataFrame, *, entity: str, period: str, measure: str, first, second, kind: str = "gain", weight: str | None = None) -> DataFrame:
    """Change of an entity's measure between two periods, in one pass: gain, loss, percent or weighted."""
    a, b = (F.sum(F.when(F.col(period) == x, F.col(measure))) for x in (first, second))
    df = df.where(F.col(period).isin(first, second))
    if kind == "weighted":
        a, b = (weighted_mean(F.when(F.col(period) == x, F.col(measure)), F.when(F.col(period) == x, F.col(weight))) for x in (first, second))
    out = df.groupBy(entity).agg(a.alias("before"), b.alias("after")).where("before is not null and after is not null")
    change = {"gain": F.col("after") - F.col("before"), "weighted": F.col("after") - F.col("before"), "loss": F.col("before") - F.col("after"), "percent": (F.col("after") - F.col("before")) * 100.0 / F.nullif(F.col("before"), F.lit(0))}[kind]
    return out.withColumn("change", change)


def trend(df: DataFrame, *, entity: str, period: str, measure: str, wanted: list, direction: str = "up") -> DataFrame:
    """Entities that have every wanted period and move in the direction at each step."""
    per = df.where(F.col(period).isin(*wanted)).groupBy(entity, period).agg(F.sum(measure).alias("m"))
    w = W.partitionBy(entity).orderBy(period)
    step = F.col("m") > F.lag("m").over(w) if direction == "up" else F.col("m") < F.lag("m").over(w)
    return per.withColumn("ok", F.coalesce(step, F.lag("m").over(w).isNull())).groupBy(entity).agg(F.count("*").alias("n"), F.bool_and("ok").alias("all_ok")).where((F.col("n") == len(set(wanted))) & F.col("all_ok")).select(entity)


def absence(root: DataFrame, path: list[tuple[DataFrame, list[tuple[str, str]]]], conditions: list[Column] = ()) -> DataFrame:
    """Rows with nothing at the end of a chain of joins that satisfies the conditions."""
    (first, on), *rest = path
    end = first
    for table, keys in rest:
        end = end.join(table, [F.col(a) == F.col(b) for a, b in keys])
    for c in conditions:
        end = end.where(c)
    return root.join(end.select(*(b for _, b in on)).distinct(), [root[a] == F.col(b) for a, b in on], "left_anti")


def conditional_ratio(df: DataFrame, numerator: Column, denominator: Column | None = None, *, groups=(), value: Column | None = None, scale: float = 100.0) -> DataFrame:
    """``scale`` times the measure where the numerator's test holds, over the denominator's."""
    x = F.lit(1.0) if value is None else value
    base = F.lit(True) if denominator is None else denominator
    return df.groupBy(*groups).agg((F.sum(F.when(numerator & base, x)) * scale / F.nullif(F.sum(F.when(base, x)), F.lit(0))).alias("ratio"))


def cohorts(df: DataFrame, first: Column, second: Column, measure: Column, *, shared: Column | None = None) -> DataFrame:
    """Sums of two filtered populations of one source in one pass, their difference, ratio, percentage."""
    df = df if shared is None else df.where(shared)
    out = df.agg(F.sum(F.when(first, measure)).alias("first_value"), F.sum(F.when(second, measure)).alias("second_value"))
    safe = F.nullif(F.col("second_value"), F.lit(0))
    return out.select("*", (F.col("first_value") - F.col("second_value")).alias("difference"), (F.col("first_value") / safe).alias("ratio"), (F.col("first_value") * 100.0 / safe).alias("percentage"))


# -- business rules

_BIN = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a * F.lit(1.0) / F.nullif(b, F.lit(0)), ast.Pow: F.pow}
_CMP = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def rule(text: str, columns: list[str]) -> Column:
    """A formula over columns: arithmetic, chains of comparisons, and/or/not, ``a if test else b``,
    json(column, 'key'), num(x), log10, sqrt, exp, abs."""

    def walk(n) -> Column:
        match n:
            case ast.Expression():
                return walk(n.body)
            case ast.Constant() if isinstance(n.value, (int, float, str, bool)):
                return F.lit(n.value)
            case ast.Name() if n.id in columns:
                return F.col(n.id)
            case ast.BinOp() if type(n.op) in _BIN:
                return _BIN[type(n.op)](walk(n.left), walk(n.right))
            case ast.UnaryOp(op=ast.USub()):
                return -walk(n.operand)
            case ast.UnaryOp(op=ast.Not()):
                return ~walk(n.operand)
            case ast.BoolOp():
                out = walk(n.values[0])
                for v in n.values[1:]:
                    out = out & walk(v) if isinstance(n.op, ast.And) else out | walk(v)
                return out
            case ast.Compare() if all(type(o) in _CMP for o in n.ops):
                sides, out = [walk(x) for x in (n.left, *n.comparators)], None
                for a, o, b in zip(sides, n.ops, sides[1:]):
                    t = _CMP[type(o)](a, b)
                    out = t if out is None else out & t
                return out
            case ast.IfExp():
                return F.when(walk(n.test), walk(n.body)).otherwise(walk(n.orelse))
            case ast.Call(func=ast.Name(id="json"), args=[a, ast.Constant(value=str() as key)]):
                return F.get_json_object(walk(a), f"$.{key}")
            case ast.Call(func=ast.Name(id="num"), args=[a]):
                return walk(a).try_cast("double")
            case ast.Call(func=ast.Name(id=("log10" | "sqrt" | "exp" | "abs") as fn), args=[a]):
                return getattr(F, fn)(walk(a))
        raise ValueError(f"not allowed in a rule: {ast.dump(n)[:80]}")

    return walk(ast.parse(text, mode="eval"))


def rule_reduction(parent: DataFrame, child: DataFrame, on: list[tuple[str, str]], *, kind: str, column: str | None, alias: str) -> DataFrame:
    """A sum, max, min or count over related rows beside each parent, aggregated before the join."""
    agg = F.count("*") if kind == "count" else {"sum": F.sum, "max": F.max, "min": F.min}[kind](column)
    reduced = child.groupBy(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(on))).agg(agg.alias(alias))
    out = parent.join(reduced, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(on)], "left").drop(*(f"_k{i}" for i in range(len(on))))
    return out.fillna(0, [alias]) if kind == "count" else out


def quartile(value: Column, partition=()) -> Column:
    """1 to 4 by the percent rank at .25, .5 and .75; null operands are ordered last, and stay null."""
    p = F.percent_rank().over(W.partitionBy(*partition).orderBy(value.asc_nulls_last()))
    return F.when(value.isNull(), F.lit(None)).when(p <= 0.25, 1).when(p <= 0.5, 2).when(p <= 0.75, 3).otherwise(4).cast("int")


def scoped_rank(df: DataFrame, scope: Column, value: str, *, partition: list[str], key: str, alias: str) -> DataFrame:
    """percent_rank within the rows of a scope, beside every row; null outside it."""
    inside = df.where(scope).select(key, F.percent_rank().over(W.partitionBy(*partition).orderBy(F.col(value).asc_nulls_last())).alias(alias))
    return df.join(inside, key, "left")


def scoped_mean(value: Column, scope: Column, partition=()) -> Column:
    return F.avg(F.when(scope, value)).over(W.partitionBy(*partition))


def message_plan(messages: DataFrame, predicate: Column, *, grain: str, customer: str, mode: str = "exists") -> DataFrame:
    """Messages, or customers with one (``exists``) or known to have none (``not_exists``) that satisfy
    a three-valued predicate: one positive settles existence, an unknown prevents absence."""
    if grain == "message":
        return messages.where(predicate)
    per = messages.groupBy(customer).agg(F.bool_or(predicate).alias("_any"), F.bool_or(predicate.isNull()).alias("_open"))
    return per.where("_any" if mode == "exists" else "not coalesce(_any, false) and not _open").select(customer)
