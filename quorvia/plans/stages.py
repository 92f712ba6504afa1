"""A typed DAG of relational and semantic stages over DataFrames.

Every stage knows its columns, its grain and its keys; the checks that need only these are made while
the plan is built, and nothing runs until a stage's frame is used. Equal stages are one node. Nodes
with several consumers can be persisted by the caller; Catalyst reuses their exchanges anyway.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorvia.decision import Policy, choice_of, coverage_columns, missing, proposition, score_on
from quorvia.judge import judge
from quorvia.plans.terms import AGGREGATES, RANKS, Field, TermError, lower
from quorvia.session import checkpointed

_KINDS = {"byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "number", "double": "number", "decimal": "number", "string": "text", "boolean": "boolean", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "variant": "json"}


def fields_of(df: DataFrame, identifiers: tuple[str, ...] = ()) -> dict[str, Field]:
    return {f.name: Field(_KINDS.get(f.dataType.typeName(), "other"), f.nullable, "identifier" if f.name in identifiers else f.metadata.get("unit")) for f in df.schema.fields}


@dataclass(frozen=True)
class Stage:
    name: str
    frame: DataFrame
    fields: dict[str, Field]
    grain: str
    keys: tuple = ()  # of tuples of columns

    def unique_on(self, columns) -> bool:
        return any(set(k) <= set(columns) for k in self.keys)


def _order(order, fields):
    out = []
    for term, direction in order:
        c, _ = lower(term if isinstance(term, (list, tuple)) else ["col", term], fields)
        out.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())
    return out


class StageDag:
    def __init__(self):
        self.stages: dict[str, Stage] = {}
        self._made: dict[str, str] = {}

    def _add(self, kind: str, spec, build: Callable[[], Stage], name: str | None) -> Stage:
        """One node for equal stages, whatever name they were asked for under."""
        print_ = json.dumps([kind, spec], sort_keys=True, default=str)
        if print_ in self._made:
            return self.stages[self._made[print_]]
        stage = build()
        label = name or f"{kind}_{len(self.stages)}"
        stage = Stage(label, stage.frame, stage.fields, stage.grain, stage.keys)
        self.stages[label] = stage
        self._made[print_] = label
        return stage

    def source(self, df: DataFrame, *, grain: str, keys=(), identifiers=(), name: str) -> Stage:
        return self._add("source", [name, grain], lambda: Stage(name, df, fields_of(df, tuple(identifiers)), grain, tuple(map(tuple, keys))), name)

    def filter(self, s: Stage, predicate, name: str | None = None) -> Stage:
        def build():
            c, f = lower(predicate, s.fields)
            if f.kind != "boolean":
                raise TermError("a filter needs a Boolean")
            return Stage("", s.frame.where(c), s.fields, s.grain, s.keys)

        return self._add("filter", [s.name, predicate], build, name)

    def project(self, s: Stage, expressions: dict, *, keep=(), distinct=False, order=(), limit: int | None = None, name: str | None = None) -> Stage:
        def build():
            if limit is not None and not 1 <= limit <= 100_000:
                raise TermError("a limit of 1 to 100,000")
            fields = {k: s.fields[k] for k in keep}
            cols = [F.col(f"`{k}`") for k in keep]
            renamed = {k: k for k in keep}
            for alias, term in expressions.items():
                c, f = lower(term, s.fields)
                fields[alias] = f
                cols.append(c.alias(alias))
                if term[0] == "col":
                    renamed.setdefault(term[1], alias)
            keys = tuple(tuple(renamed[c] for c in k) for k in s.keys if set(k) <= set(renamed))
            df = s.frame.orderBy(*_order(order, s.fields)) if order else s.frame
            df = df.limit(limit) if limit and not distinct else df
            df = df.select(*cols)
            if distinct and not keys:  # a visible key makes rows distinct already
                df = df.distinct()
                keys = (tuple(fields),)
            df = df.limit(limit) if limit and distinct else df
            return Stage("", df, fields, s.grain, keys)

        return self._add("project", [s.name, expressions, keep, distinct, order, limit], build, name)

    def aggregate(self, s: Stage, groups, metrics: dict, name: str | None = None) -> Stage:
        def build():
            made, fields = [], {g: s.fields[g] for g in groups}
            for alias, term in metrics.items():
                if term[0] not in AGGREGATES:
                    raise TermError("a metric is an aggregate")
                c, f = lower(term, s.fields, aggregates=True)
                made.append(c.alias(alias))
                fields[alias] = f
            return Stage("", s.frame.groupBy(*groups).agg(*made), fields, ",".join(groups) or "all", (tuple(groups),))

        return self._add("aggregate", [s.name, groups, metrics], build, name)

    def windows(self, s: Stage, functions: dict, *, order=(), partition=(), name: str | None = None, frame=None) -> Stage:
        def build():
            w = W.partitionBy(*(F.col(f"`{p}`") for p in partition))
            if order:
                w = w.orderBy(*_order(order, s.fields))
            if frame:
                lo, hi = (W.unboundedPreceding if frame[0] is None else frame[0]), (W.unboundedFollowing if frame[1] is None else frame[1])
                if any(x is not None and abs(x) > 10_000 for x in frame):
                    raise TermError("frame offsets of at most 10,000 rows")
                w = w.rowsBetween(lo, hi)
            df, fields = s.frame, dict(s.fields)
            for alias, (fn, *args) in functions.items():
                if fn in RANKS:
                    if not order:
                        raise TermError(f"{fn} needs an order")
                    c, f = getattr(F, fn)(), Field("number" if fn in ("percent_rank", "cume_dist") else "integer", False)
                elif fn in ("lag", "lead"):
                    if not order:
                        raise TermError(f"{fn} needs an order")
                    x, f = lower(args[0], s.fields)
                    c = getattr(F, fn)(x, args[1] if len(args) > 1 else 1)
                else:
                    c, f = lower([fn, *args], s.fields, aggregates=True)
                df, fields[alias] = df.withColumn(alias, c.over(w)), f
            return Stage("", df, fields, s.grain, s.keys)

        return self._add("window", [s.name, functions, partition, order, frame], build, name)

    def window(self, s: Stage, alias: str, fn, **options) -> Stage:
        return self.windows(s, {alias: fn}, **options)

    def row_identity(self, s: Stage, column: str, *, order=None, name: str | None = None) -> Stage:
        """A number for each row that is the same wherever the stage is used: from the order of a key
        if there is one, else fixed by a reliable checkpoint."""

        def build():
            if s.keys and s.keys[0]:
                df = s.frame.withColumn(column, F.sha2(F.to_json(F.struct(*s.keys[0]), {"ignoreNullFields": "false"}), 256))
                f = Field("text", False, "identifier")
            else:
                df = checkpointed(s.frame.withColumn(column, F.monotonically_increasing_id()))
                f = Field("integer", False, "identifier")
            return Stage("", df, s.fields | {column: f}, s.grain, (*s.keys, (column,)))

        return self._add("row_identity", [s.name, column], build, name)

    def latest(self, s: Stage, partition, order, name: str | None = None) -> Stage:
        """One row for each entity: the first in the order."""

        def build():
            w = W.partitionBy(*partition).orderBy(*_order(order, s.fields))
            df = s.frame.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
            return Stage("", df, s.fields, ",".join(partition), (tuple(partition),))

        return self._add("latest", [s.name, partition, order], build, name)

    def join(self, left: Stage, right: Stage, on, outputs: dict, *, how: str = "inner", name: str | None = None) -> Stage:
        """Join whose right side is unique on the join's columns, so rows never fan out."""

        def build():
            if how == "cross":
                if () not in right.keys:
                    raise TermError("a cross join takes one row on the right")
                pairs = left.frame.alias("l").crossJoin(F.broadcast(right.frame.alias("r")))
            else:
                if how not in ("inner", "left"):
                    raise TermError(f"no join {how!r}")
                if not right.unique_on([b for _, b in on]):
                    raise TermError(f"{right.name} isn't unique on {[b for _, b in on]}")
                test = F.lit(True)
                for a, b in on:
                    test = test & (F.col(f"l.`{a}`") == F.col(f"r.`{b}`"))
                pairs = left.frame.alias("l").join(right.frame.alias("r"), test, how)
            fields, cols, kept = {}, [], {}
            for alias, (side, column) in outputs.items():
                fields[alias] = (left if side == "left" else right).fields[column]
                cols.append(F.col(f"{side[0]}.`{column}`").alias(alias))
                if side == "left":
                    kept[column] = alias
            keys = tuple(tuple(kept[c] for c in k) for k in left.keys if set(k) <= set(kept))
            return Stage("", pairs.select(*cols), fields, left.grain, keys)

        return self._add("join", [left.name, right.name, on, outputs, how], build, name)

    def order_limit(self, s: Stage, order, limit: int | None = None, name: str | None = None) -> Stage:
        def build():
            df = s.frame.orderBy(*_order(order, s.fields)) if order else s.frame
            return Stage("", df.limit(limit) if limit else df, s.fields, s.grain, s.keys)

        return self._add("order_limit", [s.name, order, limit], build, name)

    def semantic(self, s: Stage, questions: dict, evaluator, *, guard=None, policy: Policy = Policy(), context=None, name: str | None = None) -> Stage:
        """Decisions beside a stage's rows; rows that the guard doesn't let through are skipped."""

        def build():
            needed = None
            if guard is not None:
                column, want = guard
                g = F.col(column)
                lane = "value_bool" if isinstance(want, bool) else "value_text"
                needed = (g["output_state"] == "VALUE") & (g[lane] == F.lit(want))
            df = judge(s.frame, questions, evaluator, policy=policy, needed=needed, context=context)
            if guard is not None:
                for q in questions:
                    df = df.withColumn(q, F.when(g["output_state"] != "VALUE", missing("BLOCKED_BY_DEPENDENCY")).when(g[lane].isNull(), missing("BLOCKED_BY_POLICY")).otherwise(F.col(q)))
            return Stage("", df, s.fields | {q: Field("other") for q in questions}, s.grain, s.keys)

        return self._add("semantic", [s.name, {k: q.key for k, q in questions.items()}, guard, str(policy), context], build, name)

    def merge(self, s: Stage, selector: str, cases: dict, default: str | None, out: str, name: str | None = None) -> Stage:
        """One of several decision columns in each row, picked by a known selector decision."""

        def build():
            d = F.col(selector)
            kinds = {type(k) for k in cases}
            if len(kinds) != 1:
                raise TermError("cases of one type")
            lane = "value_bool" if kinds == {bool} else "value_text" if kinds == {str} else "value_num"
            c = F.when(d["output_state"] != "VALUE", missing("BLOCKED_BY_DEPENDENCY"))
            for want, column in cases.items():
                c = c.when(d[lane] == F.lit(want), F.col(column))
            c = c.otherwise(F.col(default) if default else missing("SKIPPED"))
            return Stage("", s.frame.withColumn(out, c), s.fields | {out: Field("other")}, s.grain, s.keys)

        return self._add("merge", [s.name, selector, [[str(k), v] for k, v in cases.items()], default, out], build, name)

    def receipt(self, s: Stage, decision: str) -> DataFrame:
        return s.frame.agg(*coverage_columns(F.col(decision)))

    def require_complete(self, s: Stage, decisions: list[str]) -> Stage:
        """The stage, once every required decision of every row is known; an action checks it."""
        open_ = None
        for d in decisions:
            bad = F.col(d)["output_state"] != "VALUE"
            open_ = bad if open_ is None else open_ | bad
        if s.frame.where(open_).limit(1).count():
            raise TermError(f"{s.name} has decisions that aren't known")
        return s

    def stage_guard(self, s: Stage, column: str):
        """The value of a stage that must have exactly one row."""
        rows = s.frame.select(column).limit(2).collect()
        if len(rows) != 1:
            raise TermError(f"{s.name} must have one row to be a guard")
        return rows[0][0]

    def verify(self, s: Stage) -> DataFrame:
        """``check, violations``: nulls in columns that mustn't have any, and repeated keys."""
        rows = s.frame.select(F.lit(1).alias("_"), *s.fields)
        strict = [k for k, f in s.fields.items() if not f.nullable]
        out = rows.agg(F.count_if(F.lit(False) if not strict else ~F.array_compact(F.array(*(F.col(k).isNotNull() for k in strict))).isNull() & F.exists(F.array(*(F.col(k).isNull() for k in strict)), lambda x: x)).alias("violations")).select(F.lit("not_null").alias("check"), "violations")
        for k in s.keys:
            again = rows.groupBy(*k).count().where("count > 1").agg(F.count("*").alias("violations")) if k else rows.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("violations"))
            out = out.unionByName(again.select(F.lit("key:" + ",".join(k)).alias("check"), "violations"))
        return out


def _question(spec: dict):
    return proposition(spec["instructions"]) if spec["type"] == "boolean" else choice_of(spec["instructions"], spec["options"]) if spec["type"] == "choice" else score_on(spec["instructions"], spec["levels"])


def run_plan(plan: dict | str, tables: dict[str, DataFrame], evaluator=None) -> dict[str, Stage]:
    """A JSON plan of up to 32 stages, each ``{name, operator, input(s), ...}``, over named tables."""
    plan = json.loads(plan) if isinstance(plan, str) else plan
    if not 1 <= len(plan["stages"]) <= 32:
        raise TermError("a plan has 1 to 32 stages")
    dag, by = StageDag(), {}
    for spec in plan["stages"]:
        op, name = spec["operator"], spec["name"]
        if name in by:
            raise TermError(f"two stages are called {name}")
        ins = [by[i] for i in spec.get("inputs", [])]
        if op == "source":
            made = dag.source(tables[spec["table"]], grain=spec.get("grain", name), keys=spec.get("keys", ()), identifiers=spec.get("identifiers", ()), name=name)
        elif op == "filter":
            made = dag.filter(ins[0], spec["predicate"], name)
        elif op == "project":
            made = dag.project(ins[0], spec.get("expressions", {}), keep=spec.get("keep", ()), distinct=spec.get("distinct", False), order=spec.get("order", ()), limit=spec.get("limit"), name=name)
        elif op == "aggregate":
            made = dag.aggregate(ins[0], spec.get("groups", []), spec["metrics"], name)
        elif op == "window":
            made = dag.windows(ins[0], {k: tuple(v) for k, v in spec["functions"].items()}, partition=spec.get("partition", ()), order=spec.get("order", ()), frame=spec.get("frame"), name=name)
        elif op == "row_identity":
            made = dag.row_identity(ins[0], spec["column"], name=name)
        elif op == "latest":
            made = dag.latest(ins[0], spec["partition"], spec["order"], name)
        elif op == "join":
            made = dag.join(ins[0], ins[1], spec.get("on", []), {k: tuple(v) for k, v in spec["outputs"].items()}, how=spec.get("how", "inner"), name=name)
        elif op == "order_limit":
            made = dag.order_limit(ins[0], spec.get("order", ()), spec.get("limit"), name)
        elif op == "semantic":
            made = dag.semantic(ins[0], {k: _question(q) for k, q in spec["questions"].items()}, evaluator, guard=tuple(spec["guard"]) if "guard" in spec else None, name=name)
        elif op == "merge":
            made = dag.merge(ins[0], spec["selector"], dict(map(tuple, spec["cases"])), spec.get("default"), spec["out"], name)
        else:
            raise TermError(f"unknown operator {op!r}")
        by[name] = made
    used = {i for s in plan["stages"] for i in s.get("inputs", [])} | {plan["target"]}
    if dead := set(by) - used:
        raise TermError(f"stages that don't reach the target: {sorted(dead)}")
    return by
