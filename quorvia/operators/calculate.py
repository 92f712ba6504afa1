"""Aggregates over decisions that never take the unresolved for false."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.decision import Policy, all_of, proposition
from quorvia.judge import judge

_METRICS = {"count": lambda c: F.count(c), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate(
    relation: DataFrame, predicates: list[str], evaluator, *, group_by: list[str] = (), metric: tuple[str, str | None] = ("count", None),
    null_policy: str = "ignore", policy: Policy = Policy(),
) -> DataFrame:
    """Per group, the metric over rows known to satisfy all predicates.

    ``value`` is null while any row of the group is unresolved; ``known_subset_value`` is over the rows
    known; ``count_lower`` and ``count_upper`` bound the count. Decimals stay exact.
    """
    kind, column = metric
    questions = {f"_d{i}": proposition(p) for i, p in enumerate(predicates)}
    judged = judge(relation, questions, evaluator, policy=policy)
    names = list(questions)
    known: Column = functools.reduce(lambda a, b: a & b, [F.col(f"{n}.value_bool") for n in names])
    judged = judged.withColumn("_in", known)
    if kind == "count" and column is None:
        value = F.count_if("_in")
    else:
        x = F.col(column)
        if null_policy == "error":
            x = F.when(F.col("_in") & x.isNull(), F.raise_error(F.lit(f"{column} is null"))).otherwise(x)
        value = _METRICS[kind](F.when(F.col("_in"), x))
    grouped = judged.groupBy(*group_by).agg(
        F.count("*").alias("eligible"), F.count_if("_in").alias("included"), F.count_if(F.col("_in").isNull()).alias("unresolved"), value.alias("known_subset_value")
    )
    return grouped.select(
        *group_by, F.when(F.col("unresolved") == 0, F.col("known_subset_value")).alias("value"), "known_subset_value", "eligible", "included", "unresolved",
        F.col("included").alias("count_lower"), (F.col("included") + F.col("unresolved")).alias("count_upper"),
    )


def contrast(left: DataFrame, right: DataFrame, concepts: dict[str, str], evaluator, *, unit: str, policy: Policy = Policy(), check: bool = True) -> DataFrame:
    """Per concept, the rate in each of two cohorts, bounds while rows are unresolved, and the difference.

    Units must be there, unique and in one cohort only; ``check`` raises if they aren't.
    """
    both = left.withColumn("_side", F.lit("left")).unionByName(right.withColumn("_side", F.lit("right")))
    if check:
        bad = both.groupBy(unit).agg(F.count("*").alias("n")).where(F.col(unit).isNull() | (F.col("n") > 1)).limit(1).collect()
        if bad:
            raise ValueError(f"the unit {unit} must be non-null, unique and in one cohort")
    judged = judge(both, {k: proposition(v) for k, v in concepts.items()}, evaluator, policy=policy)
    long = judged.select("_side", F.explode(F.array(*(F.struct(F.lit(k).alias("concept"), F.col(f"{k}.value_bool").alias("v")) for k in concepts))).alias("x")).select("_side", "x.*")
    aggs = []
    for side in ("left", "right"):
        mine = F.col("_side") == side
        aggs += [F.count_if(mine).alias(f"{side}_denominator"), F.count_if(mine & F.col("v")).alias(f"{side}_positive"), F.count_if(mine & F.col("v").isNull()).alias(f"{side}_unresolved")]
    out = long.groupBy("concept").agg(*aggs)
    for side in ("left", "right"):
        n, pos, open_ = (F.col(f"{side}_{k}") for k in ("denominator", "positive", "unresolved"))
        size = F.nullif(n, F.lit(0))
        out = out.withColumn(f"{side}_rate", F.when(open_ == 0, pos / size)).withColumn(f"{side}_low", pos / size).withColumn(f"{side}_high", (pos + open_) / size)
    return out.withColumn("difference", F.col("left_rate") - F.col("right_rate"))


def conjunction(decided: DataFrame, names: list[str], out: str = "decision") -> DataFrame:
    return decided.withColumn(out, all_of(*(F.col(n) for n in names)))
