"""Scalar terms of stage plans: small typed trees that lower to columns.

A term is ``["op", args...]``: ``["col", "x"]``, ``["lit", 3]``, ``["add", t, t]`` and so on. Lowering
checks types against the stage's columns: arithmetic needs numbers that aren't identifiers, logic needs
Booleans, the branches of a case must agree.
"""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("integer", "number")


@dataclass(frozen=True)
class Field:
    kind: str  # integer, number, text, boolean, date, datetime, json, other
    nullable: bool = True
    unit: str | None = None
    label: str | None = None


AGGREGATES = frozenset("avg sum max min count count_distinct".split())
RANKS = frozenset("cume_dist percent_rank dense_rank rank row_number".split())


_ARITHMETIC = frozenset("abs add div exp log10 mul power round sqrt sub".split())
_COMPARISONS = frozenset("ge gt le lt ne eq".split())


class TermError(ValueError):
    pass


def kind_of(value) -> str:
    for cls, kind in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "text"), (dt.datetime, "datetime"), (dt.date, "date")):
        if isinstance(value, cls):
            return kind
    return "other"


def lower(term, fields: dict[str, Field], *, aggregates: bool = False) -> tuple[Column, Field]:
    """The column of a term and what it is."""
    op, *args = term
    if op == "col":
        if args[0] not in fields:
            raise TermError(f"no column {args[0]!r}")
        return F.col(f"`{args[0]}`"), fields[args[0]]
    if op == "lit":
        return F.lit(args[0]), Field(kind_of(args[0]), args[0] is None)
    if op in AGGREGATES:
        if not aggregates:
            raise TermError(f"{op} isn't allowed here")
        if op == "count" and not args:
            return F.count("*"), Field("integer", False)
        c, f = lower(args[0], fields)
        if op in ("sum", "avg") and (f.kind not in NUMERIC or f.unit == "identifier"):
            raise TermError(f"{op} needs numbers, not {f.unit or f.kind}")
        made = getattr(F, op)(c)
        return made, Field("integer" if op.startswith("count") else "number" if op == "avg" else f.kind, not op.startswith("count"), f.unit)
    if op == "case":
        *pairs, default = args
        out, kinds = None, []
        for test, then in pairs:
            t, tf = lower(test, fields, aggregates=aggregates)
            if tf.kind != "boolean":
                raise TermError("a case tests Booleans")
            v, vf = lower(then, fields, aggregates=aggregates)
            kinds.append(vf.kind)
            out = F.when(t, v) if out is None else out.when(t, v)
        d, df = lower(default, fields, aggregates=aggregates)
        kinds = {"number" if k in NUMERIC else k for k in (*kinds, df.kind) if k != "other"}
        if len(kinds) > 1:
            raise TermError(f"a case gives {sorted(kinds)}")
        return out.otherwise(d), Field(kinds.pop() if kinds else "other")
    if op == "in":
        c, _ = lower(args[0], fields, aggregates=aggregates)
        return c.isin(*args[1]), Field("boolean")
    low = [lower(a, fields, aggregates=aggregates) if isinstance(a, (list, tuple)) else (F.lit(a), Field(kind_of(a), False)) for a in args]
    cols, kinds = [c for c, _ in low], [f.kind for _, f in low]
    if op in _ARITHMETIC:
        for _, f in low:
            if f.kind not in NUMERIC or f.unit == "identifier":
                raise TermError(f"{op} needs numbers, not {f.unit or f.kind}")
        whole = "integer" if set(kinds) == {"integer"} else "number"
        made = {
            "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a * F.lit(1.0) / F.nullif(b, F.lit(0)),
            "power": F.pow, "sqrt": F.sqrt, "exp": F.exp, "log10": F.log10, "abs": F.abs,
        }
        if op == "round":
            return F.round(cols[0], args[1] if len(args) > 1 else 0), Field(kinds[0])
        return made[op](*cols), Field(whole if op in ("add", "sub", "mul", "abs") else "number", True, low[0][1].unit if op in ("add", "sub", "abs") else None)
    if op in _COMPARISONS:
        a, b = cols
        return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op], Field("boolean")
    if op in ("and", "or", "not"):
        if set(kinds) != {"boolean"}:
            raise TermError(f"{op} needs Booleans")
        joined = ~cols[0] if op == "not" else functools.reduce((lambda x, y: x & y) if op == "and" else (lambda x, y: x | y), cols)
        return joined, Field("boolean")
    if op == "like":
        return cols[0].like(args[1] if isinstance(args[1], str) else args[1][1]), Field("boolean")
    if op == "json_text":
        return F.get_json_object(cols[0], f"$.{args[1]}"), Field("text")
    if op in ("is_null", "not_null"):
        return (cols[0].isNull() if op == "is_null" else cols[0].isNotNull()), Field("boolean", False)
    if op == "coalesce":
        return F.coalesce(*cols), Field(kinds[0])
    if op == "number":
        return cols[0].try_cast("double"), Field("number")
    if op == "clean_number":
        return F.nullif(F.regexp_replace(cols[0].cast("string"), r"[^0-9.\-]", ""), F.lit("")).try_cast("double"), Field("number")
    if op in ("year", "month"):
        return {"year": F.year, "month": F.month}[op](cols[0]), Field("integer")
    if op == "age_years":
        return F.year(F.current_date()) - F.year(cols[0]), Field("integer")
    if op == "suffix":
        return F.split_part(cols[0], F.lit("_"), F.lit(-1)), Field("text")
    if op == "lower":
        return F.lower(cols[0]), Field("text")
    raise TermError(f"unknown term {op!r}")
