"""Compare, rank and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorvia.decision import VALUE, Policy, choice_of, proposition, score_on
from quorvia.judge import judge
from quorvia.ordering import running_sum


def compare(pairs: DataFrame, criterion: str, evaluator, *, policy: Policy = Policy(), name: str = "verdict") -> DataFrame:
    """left, right, tie or (unknown) insufficient for each pair row."""
    return judge(pairs, {name: choice_of(criterion, ("left", "right", "tie", "insufficient"))}, evaluator, policy=policy)


def rank(subjects: DataFrame, criterion: str, evaluator, *, id_col: str, levels: int | None = None, top_k: int | None = None, policy: Policy = Policy()) -> DataFrame:
    """Competition ranks of resolved rows by their rating: the probability of a proposition, or a
    score. ``top_k`` keeps ties. The k best are taken by a distributed sort with a limit first."""
    q = proposition(criterion) if levels is None else score_on(criterion, levels)
    judged = judge(subjects, {"decision": q}, evaluator, policy=policy).where(F.col("decision.output_state") == VALUE)
    rated = judged.withColumn("rating", F.col("decision.p_true") if levels is None else F.col("decision.value_num"))
    if top_k is not None:
        worst = rated.select("rating").orderBy(F.desc("rating")).limit(top_k).agg(F.min("rating").alias("_least"))
        rated = rated.join(F.broadcast(worst), F.col("rating") >= F.col("_least")).drop("_least")  # one row
    # counts by rating are summed up, at most k of them with k; rows only join theirs, so ties may be many
    counts = rated.groupBy("rating").agg(F.count("*").alias("_n")).withColumn("_down", -F.col("rating"))
    upto = running_sum(counts, ["_down"], "_n", "_upto").select("rating", (F.col("_upto") - F.col("_n") + 1).alias("rank"))
    return rated.join(upto, "rating").orderBy(F.desc("rating"), id_col)


def rerank(query: str, candidates: DataFrame, criterion: str, evaluator, *, id_col: str, top_k: int = 10, policy: Policy = Policy()) -> DataFrame:
    """RANK over candidates beside a query; the scope is a shortlist."""
    return rank(candidates.withColumn("query", F.lit(query)), criterion, evaluator, id_col=id_col, top_k=top_k, policy=policy).withColumn("scope", F.lit("shortlist"))


def composite_score(subjects: DataFrame, rubrics: dict[str, tuple[str, int]], weights: dict[str, float], evaluator, *, missing: str = "unknown", policy: Policy = Policy()) -> DataFrame:
    """Weighted mean of scores scaled to 0..1; a missing score makes it null (``unknown``), or the
    weights of the others are renormalised (``renormalize``)."""
    if missing not in ("unknown", "renormalize") or any(w <= 0 for w in weights.values()):
        raise ValueError("missing is unknown or renormalize, and weights are positive")
    judged = judge(subjects, {k: score_on(text, levels) for k, (text, levels) in rubrics.items()}, evaluator, policy=policy)
    total: Column = F.lit(0.0)
    have: Column = F.lit(0.0)
    whole: Column = F.lit(True)
    for k, (_, levels) in rubrics.items():
        known = F.col(f"{k}.output_state") == VALUE
        total += F.when(known, F.lit(float(weights[k])) * F.col(f"{k}.value_num") / (levels - 1)).otherwise(0.0)
        have += F.when(known, F.lit(float(weights[k]))).otherwise(0.0)
        whole = whole & known
    usable = (have > 0) if missing == "renormalize" else whole
    return judged.withColumn("composite", F.when(usable, total / have)).withColumn("output_state", F.when(usable, VALUE).otherwise("UNKNOWN"))
