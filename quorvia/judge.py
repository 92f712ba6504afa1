"""The judgment operator: questions over rows, answered once for each distinct context.

Where an evaluator is an expression, judging is a projection: no shuffle, and Catalyst prunes and
pushes as usual. Otherwise the distinct contexts that are needed are looked up among saved answers,
admitted within limits, answered and joined back, so equal rows cost one answer.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorvia.decision import RAW_TYPE, Limits, Policy, Question, missing, resolve
from quorvia.evaluators import ColumnEvaluator, PythonEvaluator, TableEvaluator
from quorvia.ordering import range_of

RANGE_ROWS = 250_000


def context_json(columns: list[str]) -> Column:
    """Canonical text of a projected row: sorted names, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def context_key(columns: list[str]) -> Column:
    return F.sha2(context_json(columns), 256)


def judge(
    df: DataFrame, questions: dict[str, Question], evaluator, *, policy: Policy = Policy(), context: list[str] | None = None,
    needed: Column | None = None, observations: DataFrame | None = None, limits: Limits = Limits(),
) -> DataFrame:
    """``df`` with a decision column for each question. Rows where ``needed`` isn't true, and rows
    whose subject is null, are skipped, not answered."""
    out = df
    for name, q in questions.items():
        ask = F.lit(True) if needed is None else F.coalesce(needed, F.lit(False))
        if q.subject:
            ask = ask & F.col(q.subject).isNotNull()
        if isinstance(evaluator, ColumnEvaluator):
            answer = resolve(q, evaluator.column(q), policy)
            out = out.withColumn(name, F.when(ask, answer).otherwise(missing("SKIPPED")))
        elif isinstance(evaluator, TableEvaluator):
            source = evaluator.answers.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(evaluator.keys)), F.col(evaluator.columns[q.instructions]).alias("_a"))
            on = [out[k] == F.col(f"_k{i}") for i, k in enumerate(evaluator.keys)]
            raw = ColumnEvaluator({q.instructions: F.col("_a")}).column(q)
            found = out.join(source, on, "left")
            out = found.withColumn(name, F.when(ask & F.col("_a").isNotNull(), resolve(q, raw, policy)).otherwise(missing("SKIPPED"))).drop("_a", *(f"_k{i}" for i in range(len(on))))
        else:
            out = _judge_distinct(out, name, q, evaluator, policy, context or df.columns, ask, observations, limits)
    return out


def observation_rows(answers: DataFrame, question: Question, evaluator) -> DataFrame:
    """Raw answers in the form of the observation table."""
    return answers.select("context_key", F.lit(question.key).alias("question_key"), F.lit(evaluator.identity).alias("evaluator"), "raw", F.current_timestamp().alias("observed_at"))


def latest_observations(observations: DataFrame, invalidations: DataFrame | None = None) -> DataFrame:
    """The last observation of each key that hasn't been invalidated."""
    if invalidations is not None:
        observations = observations.join(invalidations, "observation_id", "left_anti")
    keys = ["context_key", "question_key", "evaluator"]
    order = W.partitionBy(*keys).orderBy(F.desc("observed_at"), F.desc("observation_id")) if "observation_id" in observations.columns else W.partitionBy(*keys).orderBy(F.desc("observed_at"))
    return observations.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def answer_contexts(work: DataFrame, question: Question, evaluator: PythonEvaluator) -> DataFrame:
    """``context_key, raw`` of each (context_key, context)."""
    asked = asdict(question) | {"key": question.key}

    def run(batches):
        for batch in batches:
            got = evaluator.answer(asked, batch.column("context").to_pylist())
            raw = [{"p": g.get("p"), "probabilities": list((g.get("probabilities") or {}).items()) or None, "score": g.get("score"), "confidence": g.get("confidence"), "error": g.get("error")} for g in got]
            kind = pa.struct([("p", pa.float64()), ("probabilities", pa.map_(pa.string(), pa.float64())), ("score", pa.float64()), ("confidence", pa.float64()), ("error", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column("context_key"), pa.array(raw, kind)], ["context_key", "raw"])

    return work.select("context_key", "context").mapInArrow(run, f"context_key string, raw {RAW_TYPE}")


def _fills(sizes: np.ndarray, most: int, room: int) -> list[tuple[int, int, int]]:
    """For each of the first places where a bundle may begin: how many bundles there are from there to the
    end, and the items and bytes of the last."""
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(n)
    after = np.maximum(np.minimum(np.searchsorted(upto, upto[:-1] + room, "right") - 1, at + most), at + 1)
    known: dict[int, tuple[int, int, int]] = {}
    for first in range(min(most + 1, n)):
        path, i = [], first
        while i not in known:
            path.append(i)
            if after[i] >= n:
                known[i] = (1, n - i, int(upto[n] - upto[i]))
                break
            i = int(after[i])
        for i in reversed(path):
            if i not in known:
                count, items, total = known[int(after[i])]
                known[i] = (count + 1, items, total)
    return [known[i] for i in range(min(most + 1, n))]


def _carried(parts: list, most: int, room: int) -> dict[tuple, tuple[int, int, int]]:
    """By range and group: bundle, items and bytes with which the group comes into the range."""
    carry, state, last = {}, (0, 0, 0), None
    for r in sorted(parts, key=lambda r: (r["_group"], r["_range"])):
        if r["_group"] != last:
            last, state = r["_group"], (0, 0, 0)
        carry[r["_range"], r["_group"]] = state
        bundle, items, total = state
        if not items:
            count, items, total = r["fills"][0]
            state = (bundle + count - 1, items, total)
            continue
        for size, fill in zip(r["head"], r["fills"]):
            if items >= most or total + size > room:
                state = (bundle + fill["count"], fill["items"], fill["total"])
                break
            items, total = items + 1, total + size
            state = (bundle, items, total)
    return carry


def bundled(work: DataFrame, group: list[str], limits: Limits, payload: Column, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """With ``bundle`` numbers within each group, filled in the order of the context key: an item that
    would be one over ``batch`` items or pass ``request_bytes`` begins the next bundle. ``too_large`` for
    items over ``item_bytes``, which no bundle takes.

    The order is cut into ranges of about ``range_rows`` rows, each sorted in one task. Where a group goes
    over several, a first pass finds, for each of the at most ``batch`` + 1 places where the first new bundle
    of a range may begin, how the range ends; the driver strings two such rows a range together."""
    size = (F.octet_length(payload) + 32).cast("bigint")
    rows = work.withColumns({"too_large": F.coalesce(size > limits.item_bytes, F.lit(False)), "_size": F.coalesce(size, F.lit(32)), "_group": F.to_json(F.struct(*group), {"ignoreNullFields": "false"})})
    order = ["_group", "too_large", "context_key", "_size"]  # with the size, equal keys come alike in both passes
    count = rows.count()
    ranges = -(-count // range_rows)
    most, room, carry = limits.batch, limits.request_bytes, {}
    if ranges > 1:
        rows = rows.withColumn("_range", range_of(rows, order, count, range_rows)).repartition(ranges, "_range").sortWithinPartitions("_range", *order)

        def summed(batches):
            pending, edge, sizes = None, None, []  # first and last groups of a range alone go on into others

            def row(at):
                found = np.concatenate(sizes)
                return {"_range": at[0], "_group": at[1], "head": found[: most + 1].tolist(), "fills": [dict(zip(("count", "items", "total"), f)) for f in _fills(found, most, room)]}

            out = []
            for batch in batches:
                batch = batch.filter(pc.invert(batch.column("too_large")))
                at, gs, ss = batch.column("_range").to_pylist(), batch.column("_group").to_pylist(), batch.column("_size").to_numpy()
                cuts = [0] + [i for i in range(1, len(gs)) if gs[i] != gs[i - 1] or at[i] != at[i - 1]] if gs else []
                for lo, hi in zip(cuts, [*cuts[1:], len(gs)]):
                    here = (at[lo], gs[lo])
                    if here != pending:
                        if pending is not None and (edge != pending[0] or here[0] != pending[0]):
                            out.append(row(pending))
                        edge = None if pending is None else pending[0]
                        pending, sizes = here, []
                    sizes.append(ss[lo:hi])
            if pending is not None:
                out.append(row(pending))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_range", pa.int32()), ("_group", pa.string()), ("head", pa.list_(pa.int64())), ("fills", pa.list_(pa.struct([(c, pa.int64()) for c in ("count", "items", "total")])))]))

        kind = "_range int, _group string, head array<bigint>, fills array<struct<count: bigint, items: bigint, total: bigint>>"
        carry = _carried(rows.select("_range", "_group", "too_large", "_size").mapInArrow(summed, kind).collect(), most, room)
    else:
        rows = rows.withColumn("_range", F.lit(0)).repartition("_group").sortWithinPartitions(*order)
    names = [c for c in rows.columns if c not in ("_size", "_group", "_range")]

    def run(batches):
        last, bundle, items, total = None, 0, 0, 0
        for batch in batches:
            out = []
            for r, g, large, s in zip(*(batch.column(c).to_pylist() for c in ("_range", "_group", "too_large", "_size"))):
                if (r, g) != last:
                    last = (r, g)
                    bundle, items, total = carry.get(last, (0, 0, 0))
                if large:
                    out.append(None)
                    continue
                if items and (items >= most or total + s > room):
                    bundle, items, total = bundle + 1, 0, 0
                items, total = items + 1, total + s
                out.append(bundle)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64())], [*names, "bundle"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField("bundle", T.LongType())]))


def admitted(work: DataFrame, limits: Limits) -> DataFrame:
    """With ``admitted``: whether a row is within the limits, in the order of the context key. The
    running number is taken over a range-sorted order, in two passes, not in one task."""
    if limits.judgments is None:
        return work.withColumn("admitted", F.lit(True))
    head = work.select("context_key").orderBy("context_key").limit(limits.judgments).withColumn("admitted", F.lit(True))
    return work.join(head, "context_key", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def _judge_distinct(df, name, q, evaluator, policy, context, ask, observations, limits) -> DataFrame:
    keyed = df.withColumn("_key", F.when(ask, context_key(context))).withColumn("_context", context_json(context))
    work = keyed.where("_key is not null").groupBy(F.col("_key").alias("context_key")).agg(F.first("_context").alias("context"))
    known = None
    if observations is not None:
        mine = observations.where((F.col("question_key") == q.key) & (F.col("evaluator") == evaluator.identity))
        known = latest_observations(mine).select("context_key", "raw", F.lit(True).alias("cached"))
        work = work.join(known.select("context_key"), "context_key", "left_anti")
    work = admitted(work, limits)
    fresh = answer_contexts(work.where("admitted"), q, evaluator).withColumn("cached", F.lit(False)).withColumn("blocked", F.lit(False))
    rows = fresh
    if limits.judgments is not None:
        rows = rows.unionByName(work.where("not admitted").select("context_key", F.lit(None).cast(RAW_TYPE).alias("raw"), F.lit(False).alias("cached"), F.lit(True).alias("blocked")))
    if known is not None:
        rows = rows.unionByName(known.withColumn("blocked", F.lit(False)))
    joined = keyed.join(rows, keyed["_key"] == rows["context_key"], "left")
    decision = F.when(F.col("_key").isNull(), missing("SKIPPED")).when(F.col("blocked"), missing("BLOCKED_BY_BUDGET")).otherwise(resolve(q, F.col("raw"), policy, cached=F.col("cached")))
    return joined.withColumn(name, decision).drop("_key", "_context", "context_key", "raw", "cached", "blocked")
