"""Candidate pairs and the operators on them: JOIN, ALIGN, RELATE, MATCH, EVIDENCE_JOIN."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorvia.decision import Policy, bool_value, choice_of, missing, proposition, stance, text_value
from quorvia.evaluators import ColumnEvaluator
from quorvia.judge import judge

#: Pairs that a task should get; at most so many tasks, and copies of a right row.
TASK_PAIRS, MOST_TASKS, MOST_COPIES = 4_000_000, 1_024, 128


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns)), right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))


def _keyed_pairs(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], left_id: str, task_pairs: int) -> DataFrame:
    """The equi-join on the keys. The pairs, counted by key first, are what it costs, not the bytes of the
    sides, by which Spark would choose the tasks: where they are many, the left rows of a key are dealt
    out to cells, each of which has a copy of the key's right rows, and the cells to tasks. What a
    task holds of a key is one right side, which Spark spills if it is large."""
    left, right = [F.col(f"l_{k}") for k, _ in keys], [F.col(f"r_{m}") for _, m in keys]
    on = functools.reduce(lambda x, y: x & y, [x == y for x, y in zip(left, right)])
    n = a.groupBy(*left).agg(F.count("*").alias("_a")).join(b.groupBy(*right).agg(F.count("*").alias("_b")), on).select((F.col("_a").cast("double") * F.col("_b")).alias("n"))
    total, most = n.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0.0))).first()
    if total <= task_pairs:
        return a.join(b, on)
    tasks, copies = int(min(MOST_TASKS, -(-total // task_pairs))), int(min(MOST_COPIES, -(-most // task_pairs)))
    if copies == 1:
        return a.repartition(tasks, *left).join(b.repartition(tasks, *right).hint("merge"), on)
    dealt = a.withColumn("_l_cell", F.pmod(F.xxhash64(f"l_{left_id}"), F.lit(copies)).cast("int"))
    copied = b.withColumn("_r_cell", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt, copied = dealt.repartition(tasks, *left, "_l_cell"), copied.repartition(tasks, *right, "_r_cell")
    return dealt.join(copied.hint("merge"), on & (F.col("_l_cell") == F.col("_r_cell"))).drop("_l_cell", "_r_cell")


def candidate_pairs(left: DataFrame, right: DataFrame, policy: dict, *, left_id: str, right_id: str, limit: int | None = 100_000, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Pairs to be judged, with columns prefixed ``l_`` and ``r_``.

    ``{"kind": "exact_keys", "keys": [(left, right), ...]}`` blocks by equality, null matching nothing;
    ``explicit`` takes a table ``pairs`` of ids; ``all_pairs`` is every pair and is admitted only up to
    ``limit`` of them, as its size is the product of the sides.
    """
    a, b = _sides(left, right)
    kind = policy["kind"]
    if kind == "exact_keys":
        return _keyed_pairs(a, b, policy["keys"], left_id, task_pairs)
    if kind == "explicit":
        pairs = policy["pairs"].select("left_id", "right_id").distinct()
        return pairs.join(a, pairs.left_id == F.col(f"l_{left_id}")).join(b, pairs.right_id == F.col(f"r_{right_id}")).drop("left_id", "right_id")
    if kind != "all_pairs":
        raise ValueError(f"unknown candidate policy {kind}")
    if limit is not None and left.count() * right.count() > limit:
        raise ValueError(f"all pairs are over the admitted {limit}; block by keys, or raise the limit")
    return a.crossJoin(b)


def join(left: DataFrame, right: DataFrame, predicate: str, evaluator, *, candidates: dict, how: str = "inner", left_id: str, right_id: str, policy: Policy = Policy(), limit: int | None = 100_000) -> DataFrame:
    """Semantic join on the pairs known to be true.

    ``left`` adds, and ``anti`` gives, left rows *known* to match nothing: all their pairs are known
    false, or they have none. Explicit pairs are no exhaustive scope, so nothing is unmatched there.
    """
    pairs = candidate_pairs(left, right, candidates, left_id=left_id, right_id=right_id, limit=limit)
    if isinstance(evaluator, ColumnEvaluator):  # a plain condition, which stays in the join's generated code
        judged = pairs.withColumn("_value", bool_value(evaluator.column(proposition(predicate))["p"], policy))
    else:
        judged = judge(pairs, {"decision": proposition(predicate)}, evaluator, policy=policy).withColumn("_value", F.col("decision.value_bool"))
    edges = judged.where("_value").select(F.col(f"l_{left_id}").alias("left_id"), F.col(f"r_{right_id}").alias("right_id"))
    if how == "inner":
        return edges
    ids = left.select(F.col(left_id).alias("left_id"))
    if candidates["kind"] == "explicit":
        alone = ids.limit(0)
    else:
        maybe = judged.where("_value is null or _value").select(F.col(f"l_{left_id}").alias("left_id")).distinct()
        alone = ids.join(maybe, "left_id", "left_anti")
    if how == "anti":
        return alone
    return edges.unionByName(alone.withColumn("right_id", F.lit(None).cast(edges.schema["right_id"].dataType)))


def align(pairs: DataFrame, identity: str, fields: list[str], evaluator, *, policy: Policy = Policy()) -> DataFrame:
    """Identity of each pair and consistency of up to 32 fields; nothing is merged. ``same`` and ``fields``
    have the known values alone; where an evaluator is an expression they cost no decisions."""
    if len(fields) > 32:
        raise ValueError("at most 32 fields")
    questions = {"identity": proposition(identity)} | {f"field_{f}": choice_of(f"consistent:{f}", ("consistent", "inconsistent", "unknown")) for f in fields}
    same, known = F.col("identity.value_bool"), {f: F.col(f"field_{f}.value_text") for f in fields}
    if isinstance(evaluator, ColumnEvaluator):
        same = bool_value(evaluator.column(questions["identity"])["p"], policy)
        plain = {f: evaluator.options(questions[f"field_{f}"]) for f in fields}
        known |= {f: text_value(questions[f"field_{f}"], p, policy) for f, p in plain.items() if p}
    judged = judge(pairs, questions, evaluator, policy=policy)
    return judged.withColumns({"same": same, "fields": F.array(*(F.struct(F.lit(f).alias("field"), known[f].alias("consistency")) for f in fields))})


def relate(pairs: DataFrame, support: str, opposition: str, evaluator, *, policy: Policy = Policy(), refused: Column | None = None) -> DataFrame:
    """Directed stance of each pair. Pairs that are ``refused`` aren't judged and say so."""
    judged = judge(pairs, {"support": proposition(support), "opposition": proposition(opposition)}, evaluator, policy=policy, needed=None if refused is None else ~refused)
    if refused is not None:
        for name in ("support", "opposition"):
            judged = judged.withColumn(name, F.when(refused, missing("BLOCKED_BY_POLICY")).otherwise(F.col(name)))
    return judged.withColumn("stance", stance(F.col("support"), F.col("opposition")))


def match(
    records: DataFrame, nodes: dict[str, str], evaluator, *, id_col: str, same: list[tuple[str, str, str]] = (), before: list[tuple[str, str]] = (), time_col: str | None = None,
    verify: Column | None = None, cap: int = 20, max_matches: int | None = 100, policy: Policy = Policy(),
) -> DataFrame:
    """Bindings of a finite pattern of up to six nodes to different records.

    Each node's proposition picks its records; ``same`` (a, b, column) ties nodes by equality, which
    makes the join an equi-join, ``before`` by strict order of time. Of each anchor (the first node's
    record) at most ``cap`` neighbours are taken at each further node, in the order of time and id.
    """
    if not 1 <= len(nodes) <= 6:
        raise ValueError("one to six nodes")
    names = list(nodes)
    judged = judge(records, {f"_{n}": proposition(p) for n, p in nodes.items()}, evaluator, policy=policy)
    picked = {n: judged.where(f"`_{n}`.value_bool").select(*(F.col(c).alias(f"{n}_{c}") for c in records.columns)) for n in names}
    out = picked[names[0]]
    for i, n in enumerate(names[1:], 1):
        tests = [F.col(f"{a}_{c}") == F.col(f"{b}_{c}") for a, b, c in same if n in (a, b) and {a, b} <= set(names[: i + 1])]
        if not tests:
            raise ValueError(f"node {n} must share a column with an earlier one")
        tests += [F.col(f"{a}_{time_col}") < F.col(f"{b}_{time_col}") for a, b in before if n in (a, b) and {a, b} <= set(names[: i + 1])]
        tests += [F.col(f"{m}_{id_col}") != F.col(f"{n}_{id_col}") for m in names[:i]]
        out = out.join(picked[n], functools.reduce(lambda x, y: x & y, tests))
        order = W.partitionBy(*(f"{m}_{id_col}" for m in names[:i])).orderBy(*([f"{n}_{time_col}"] if time_col else []), f"{n}_{id_col}")
        out = out.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= cap).drop("_nth")
    if verify is not None:
        out = out.where(verify)
    out = out.select(*(F.col(f"{n}_{id_col}").alias(n) for n in names))
    return out if max_matches is None else out.orderBy(*names).limit(max_matches)


def evidence_join(claims: DataFrame, sources: DataFrame, support: str, opposition: str, evaluator, *, claim_id: str, source_id: str, max_bundle: int = 2, policy: Policy = Policy()) -> DataFrame:
    """Stance of every bundle of one or two sources (at most eight of them) towards each claim."""
    if max_bundle not in (1, 2):
        raise ValueError("bundles of one or two")
    if sources.limit(9).count() > 8:
        raise ValueError("at most eight sources")
    a = sources.select(*(F.col(c).alias(f"a_{c}") for c in sources.columns))
    b = sources.select(*(F.col(c).alias(f"b_{c}") for c in sources.columns))
    single = a.select("*", *(F.lit(None).cast(sources.schema[c].dataType).alias(f"b_{c}") for c in sources.columns))
    bundles = single
    if max_bundle == 2:
        bundles = single.unionByName(a.join(F.broadcast(b), F.col(f"a_{source_id}") < F.col(f"b_{source_id}")))
    pairs = claims.crossJoin(F.broadcast(bundles))  # at most 36 bundles
    judged = relate(pairs, support, opposition, evaluator, policy=policy)
    members = F.array_compact(F.array(f"a_{source_id}", f"b_{source_id}"))
    return judged.withColumn("bundle", members).select(claim_id, "bundle", "stance")
