"""Control execution: waves, state machines, workflows, routes and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorvia.decision import Policy, choice_of, make_decision, missing, proposition
from quorvia.ordering import BUCKET_ROWS, running_sum
from quorvia.judge import judge


def settled(objective: str, target: int, positive: int, unresolved: int) -> bool | None:
    """Whether bounds [positive, positive + unresolved] decide the objective, and how; None: not yet."""
    low, high = positive, positive + unresolved
    if objective == "exists":
        return True if low >= 1 else False if high == 0 else None
    if objective == "count_at_least":
        return low >= target if low >= target or target > high else None
    if objective == "count_at_most":
        return True if high <= target else False if low > target else None
    if objective == "exact_count":
        return None if low != high else low == target
    raise ValueError(f"unknown objective {objective}")


def resolve_objective(population: DataFrame, predicate: str, evaluator, *, order_by: list[str], objective: str, target: int = 1, wave: int = 16, waves: int = 3, policy: Policy = Policy()) -> dict:
    """Judge rows in waves until the objective is settled: ``{settled, positive, unresolved, judged, waves}``.

    Each wave takes the next rows of the order by a limit, not a numbering of all rows; only its counts
    come to the driver.
    """
    total, positive, open_, seen, used = population.count(), 0, 0, 0, 0
    answer = settled(objective, target, 0, total)
    while answer is None and used < waves and seen < total:
        rows = population.orderBy(*order_by).offset(seen).limit(wave)
        got = judge(rows, {"d": proposition(predicate)}, evaluator, policy=policy).agg(F.count("*").alias("n"), F.count_if("d.value_bool").alias("t"), F.count_if(F.col("d.value_bool").isNull()).alias("u")).first()
        used, seen, positive, open_ = used + 1, seen + got.n, positive + got.t, open_ + got.u
        answer = settled(objective, target, positive, open_ + total - seen)
    return {"settled": answer, "positive": positive, "unresolved": open_ + total - seen, "judged": seen, "waves": used, "operation_state": "SUCCEEDED" if answer is not None or seen == total else "TRUNCATED"}


def _options(events: list[str]) -> list[str]:
    return [*events, "unknown"]


def trace(records: DataFrame, events: list[str], transitions: dict[tuple[str, str], str], initial: str, evaluator, *, entity: str, time_col: str, tie: list[str] = (), instructions: str = "event", policy: Policy = Policy(), timeline: bool = False) -> DataFrame:
    """Current states of each entity after its records in order of time.

    An event that isn't known may be any, so a set of states is carried: every state that some event
    leads to. An event without a transition from a state leaves it. Records of one entity at the same
    time are told apart by ``tie``; without it equal times are refused.
    """
    states = sorted({initial, *(s for s, _ in transitions), *transitions.values()})
    judged = judge(records, {"event": choice_of(instructions, _options(events))}, evaluator, policy=policy)
    item = F.struct(time_col, *tie, F.col("event.value_text").alias("_event"))
    rows = judged.groupBy(entity).agg(F.array_sort(F.collect_list(item)).alias("_r"), F.count("*").alias("n_records"), F.count_distinct(time_col).alias("_times"))
    if not tie:
        rows = rows.withColumn("_r", F.when(F.col("_times") == F.col("n_records"), F.col("_r")).otherwise(F.raise_error(F.lit("records of an entity share a time")).cast(rows.schema["_r"].dataType)))

    def follow(have: Column, event: Column) -> Column:
        parts = []
        for s in states:
            by_event = {e: transitions.get((s, e), s) for e in events}
            known = F.lit(s)
            for e, to in by_event.items():
                known = F.when(event == e, F.lit(to)).otherwise(known)
            anywhere = F.array(*map(F.lit, sorted(set(by_event.values()))))
            parts.append(F.when(F.array_contains(have, s), F.when(event.isNull(), anywhere).otherwise(F.array(known))).otherwise(F.array().cast("array<string>")))
        return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))

    start = F.array(F.lit(initial))
    out = rows.withColumn("states", F.aggregate("_r", start, lambda acc, x: follow(acc, x["_event"])))
    out = out.withColumn("current_state", F.when(F.size("states") == 1, F.col("states")[0])).withColumn("output_state", F.when(F.size("states") == 1, "VALUE").otherwise("UNKNOWN"))
    keep = [entity, "n_records", "states", "current_state", "output_state"]
    if timeline:
        empty = F.array(F.struct(F.lit(None).cast(records.schema[time_col].dataType).alias("at"), start.alias("states")))
        grown = F.aggregate("_r", empty, lambda acc, x: F.concat(acc, F.array(F.struct(x[time_col].alias("at"), follow(F.element_at(acc, -1)["states"], x["_event"]).alias("states")))))
        out, keep = out.withColumn("timeline", F.slice(grown, 2, F.greatest(F.size("_r"), F.lit(1)))), [*keep, "timeline"]
    return out.select(*keep)


def compose(first: dict[str, frozenset], then: dict[str, frozenset]) -> dict[str, frozenset]:
    """Composition of set-valued transition tables; it is associative."""
    return {s: frozenset().union(*(then[m] for m in mid)) if mid else frozenset() for s, mid in first.items()}


def state_scan(blocks: DataFrame, states: list[str], initial: str, evaluator, *, sequence: str | None, order_col: str, instructions: str = "next state", policy: Policy = Policy()) -> DataFrame:
    """Set-valued states after each sequence of blocks. For every block and state (at most eight), the
    next state is a choice; the evaluator sees the state as column ``from_state``. An unknown next
    state may be any. The tables of a sequence are composed in order within an aggregate."""
    if not 1 <= len(states) <= 8:
        raise ValueError("one to eight states")
    rows = blocks
    for s in states:
        judged = judge(rows.withColumn("from_state", F.lit(s)), {f"_to_{s}": choice_of(instructions, [*states, "unknown"])}, evaluator, policy=policy)
        rows = judged.drop("from_state")
    everything = F.array(*map(F.lit, sorted(states)))
    tables = F.create_map(*(x for s in states for x in (F.lit(s), F.when(F.col(f"_to_{s}.value_text").isNull(), everything).otherwise(F.array(F.col(f"_to_{s}.value_text"))))))
    keys = [sequence] if sequence else []
    grouped = rows.select(*keys, order_col, tables.alias("_t")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order_col, F.map_entries("_t").alias("_t")))), lambda x: x["_t"]).alias("_ts"), F.count("*").alias("n_blocks"))
    step = lambda acc, t: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(t, lambda e: F.array_contains(acc, e["key"])), lambda e: e["value"]))))
    out = grouped.withColumn("states", F.aggregate("_ts", F.array(F.lit(initial)), step))
    return out.withColumn("final_state", F.when(F.size("states") == 1, F.col("states")[0])).drop("_ts")


def layers(stages: dict[str, dict]) -> list[list[str]]:
    """Stage names by topological layer; a cycle is refused before anything is judged."""
    left, out = dict(stages), []
    if len(stages) > 64:
        raise ValueError("at most 64 stages")
    while left:
        ready = sorted(n for n, s in left.items() if not set(_needs(s)) & set(left))
        if not ready:
            raise ValueError(f"stages in a circle: {sorted(left)}")
        out.append(ready)
        for n in ready:
            del left[n]
    return out


def _needs(stage: dict) -> list[str]:
    return [*stage.get("depends_on", ()), *([stage["when"]["stage"]] if "when" in stage else [])]


def workflow(rows: DataFrame, stages: dict[str, dict], evaluator, *, policy: Policy = Policy()) -> DataFrame:
    """A decision column for each stage of a conditional DAG over each row.

    A stage has a ``question`` or a ``literal``; ``depends_on`` names stages that must be known;
    ``when: {stage, equals}`` runs it only on that known value, skips it on another, blocks it as
    policy where the types can't be equal, and as dependency where the value isn't known.
    """
    unknown = {d for s in stages.values() for d in _needs(s)} - set(stages)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    out = rows
    for layer in layers(stages):
        for name in layer:
            stage = stages[name]
            blocked: Column = F.lit(False)
            for d in stage.get("depends_on", ()):
                blocked = blocked | (F.col(f"{d}.output_state") != "VALUE")
            skip: Column = F.lit(False)
            mismatch: Column = F.lit(False)
            if guard := stage.get("when"):
                g, want = F.col(guard["stage"]), guard["equals"]
                lane, kind = ("value_bool", bool) if isinstance(want, bool) else ("value_text", str) if isinstance(want, str) else ("value_num", float)
                blocked = blocked | (g["output_state"] != "VALUE")
                mismatch = (g["output_state"] == "VALUE") & g[lane].isNull()
                skip = g[lane] != F.lit(kind(want))
            if "question" in stage:
                run = ~blocked & ~F.coalesce(skip, F.lit(False)) & ~mismatch
                out = judge(out, {"_new": stage["question"]}, evaluator, policy=policy, needed=run)
                made = F.col("_new")
            else:
                lit = stage["literal"]
                lanes = {"boolean": F.lit(lit)} if isinstance(lit, bool) else {"text": F.lit(lit)} if isinstance(lit, str) else {"num": F.lit(float(lit))}
                made = make_decision(F.lit("VALUE"), F.lit("SUCCEEDED"), **lanes)
            decision = F.when(blocked, missing("BLOCKED_BY_DEPENDENCY")).when(mismatch, missing("BLOCKED_BY_POLICY")).when(skip, missing("SKIPPED")).otherwise(made)
            out = out.withColumn(name, decision).drop("_new")
    return out


def route(requests: DataFrame, handlers: dict[str, dict[str, list[str]]], evaluator, *, policy: Policy = Policy()) -> DataFrame:
    """A handler of the allow-list for each request, then its arguments from theirs; nothing runs."""
    out = judge(requests, {"handler": choice_of("handler", [*handlers, "unknown"])}, evaluator, policy=policy)
    for h, arguments in handlers.items():
        for a, allowed in arguments.items():
            out = judge(out, {f"{h}_{a}": choice_of(f"argument:{h}.{a}", [*allowed, "unknown"])}, evaluator, policy=policy, needed=F.col("handler.value_text") == h)
    return out


def estimate(judgments: int, payload_bytes: int, *, batch: int = 32, tokens_limit: int = 2_000_000, usd_per_million: float = 0.0, usd_limit: float = 2.0, judgment_limit: int = 1_000) -> dict:
    """Requests, token bound, cost and warnings of missing work: W02 asks for approval, W03 blocks."""
    requests, tokens = -(-judgments // batch), payload_bytes + 32 * judgments
    usd = tokens * usd_per_million / 1e6
    warnings = (["W02"] if judgments >= 10_000 else []) + (["W03"] if tokens > tokens_limit or usd > usd_limit or judgments > judgment_limit else [])
    return {"warnings": warnings, "usd": usd, "tokens": tokens, "requests": requests, "judgments": judgments}


def expansion(operator: str, **n: int) -> int:
    """How many judgments an operator asks for."""
    rows = n.get("rows", 1)
    table = {"TAG": rows * n.get("concepts", 1), "JOIN": n.get("left", 1) * n.get("right", 1), "ALIGN": n.get("pairs", 1) * (1 + n.get("fields", 0)), "RELATE": 2 * n.get("pairs", 1), "STATE_SCAN": rows * n.get("states", 1), "COVER": 2 * n.get("obligations", 1) * n.get("sources", 1)}
    s = n.get("sources", 0)
    table["EVIDENCE_JOIN"] = 2 * n.get("claims", 1) * (s + s * (s - 1) // 2)
    return table.get(operator, rows)


def admit_expansion(count: int, approved: bool = False, cap: int = 100_000) -> str:
    """ADMITTED, or why not: 10,000 judgments and more need approval, over the cap none helps."""
    return "BLOCKED_BY_POLICY" if count > cap else "BLOCKED_BY_REVIEW" if count >= 10_000 and not approved else "ADMITTED"


def explain_plan(work: DataFrame, context: list[str], question_key: str, evaluator_id: str, observations: DataFrame | None = None, **prices) -> dict:
    """Estimate of the contexts that still have to be judged; two numbers come to the driver."""
    from quorvia.judge import context_json, context_key

    need = work.select(context_key(context).alias("context_key"), F.octet_length(context_json(context)).alias("size")).dropDuplicates(["context_key"])
    if observations is not None:
        need = need.join(observations.where((F.col("question_key") == question_key) & (F.col("evaluator") == evaluator_id)), "context_key", "left_anti")
    n, size = need.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return estimate(n, int(size), **prices)


def budget_states(work: DataFrame, *, cost: str, limit: int, order_by: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``operation_state`` of each row when costs are reserved in order until the limit is reached."""
    out = running_sum(work, order_by, cost, "_spent", bucket_rows=bucket_rows)
    return out.withColumn("operation_state", F.when(F.col("_spent") <= limit, "SUCCEEDED").otherwise("BLOCKED_BY_BUDGET")).drop("_spent")
