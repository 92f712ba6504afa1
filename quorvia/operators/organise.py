"""Classify, tag and filter a population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorvia.decision import NOT_EVALUATED, VALUE, Policy, choice_of, proposition
from quorvia.judge import judge


def classify(subjects: DataFrame, taxonomy, evaluator, *, instructions: str = "classify", policy: Policy = Policy(), name: str = "label", **options) -> DataFrame:
    """A choice among the taxonomy's labels and ``unknown``."""
    labels = dict(taxonomy) if isinstance(taxonomy, dict) else {t: t for t in taxonomy}
    return judge(subjects, {name: choice_of(instructions, labels | {"unknown": "none of these"})}, evaluator, policy=policy, **options)


def tag(subjects: DataFrame, concepts: dict[str, str], evaluator, *, policy: Policy = Policy(), **options) -> DataFrame:
    """Independent propositions side by side: a decision column for each concept, in one pass."""
    return judge(subjects, {k: proposition(v) for k, v in concepts.items()}, evaluator, policy=policy, **options)


def bucket(decision: Column) -> Column:
    return F.when(decision["value_bool"], "matches").when(~decision["value_bool"], "rejected").otherwise("unresolved")


def filter_rows(relation: DataFrame, concept: str, evaluator, *, policy: Policy = Policy(), keep: str | None = "matches", **options) -> DataFrame:
    """Rows known to match (``keep``: matches, rejected, unresolved), or all with a ``bucket``."""
    out = judge(relation, {"decision": proposition(concept)}, evaluator, policy=policy, **options).withColumn("bucket", bucket(F.col("decision")))
    return out if keep is None else out.where(F.col("bucket") == keep)


def classify_hierarchy(subjects: DataFrame, edges: dict[str, list[str]], level_probabilities: dict[str, Column], *, id_col: str, root: str = "root", beam: int = 2, depth: int = 6) -> DataFrame:
    """Beam search down a taxonomy: ``id, path, weight, level, finished``.

    ``edges``: children of each label. ``level_probabilities``: of each inner label, a map column of
    the probabilities of its children and of ``unknown``. A path keeps its ``beam`` best children and
    a subject its ``beam`` best paths by the product of probabilities, ties by path. A path ends at a
    leaf, at ``unknown`` or at ``depth``. The taxonomy is a plan-time table, so the levels unroll into
    one lineage with a window a level.
    """
    if not (1 <= beam <= 4 and 1 <= depth <= 6):
        raise ValueError("beam of 1 to 4 and depth of 1 to 6")
    done = None
    front = subjects.withColumn("path", F.array(F.lit(root))).withColumn("weight", F.lit(1.0)).withColumn("at", F.lit(root))
    per_path, per_subject = W.partitionBy(id_col, "path"), W.partitionBy(id_col)
    for level in range(1, depth + 1):
        inner = [k for k in edges if edges[k]]
        answer = None
        for label in inner:
            test = F.col("at") == label
            answer = F.when(test, level_probabilities[label]) if answer is None else answer.when(test, level_probabilities[label])
        open_rows = front.where(F.col("at").isin(*inner)).withColumn("_p", answer)
        shut = front.where(~F.col("at").isin(*inner)).withColumn("level", F.lit(level - 1)).withColumn("finished", F.col("at") != "unknown")
        shut = shut.select(id_col, "path", "weight", "level", "finished")
        done = shut if done is None else done.unionByName(shut)
        grown = open_rows.select(*[c for c in open_rows.columns if c != "_p"], F.explode(F.map_entries("_p")).alias("_e"))
        grown = grown.withColumn("_w", F.col("_e.value")).withColumn("at", F.col("_e.key"))
        grown = grown.withColumn("_r", F.row_number().over(per_path.orderBy(F.desc("_w"), "at"))).where(F.col("_r") <= beam)
        grown = grown.withColumn("path", F.concat("path", F.array("at"))).withColumn("weight", F.col("weight") * F.col("_w"))
        front = grown.withColumn("_r", F.row_number().over(per_subject.orderBy(F.desc("weight"), F.array_join("path", "/")))).where(F.col("_r") <= beam).drop("_r", "_w", "_e")
    last = front.withColumn("level", F.lit(depth)).withColumn("finished", ~F.col("at").isin("unknown", *[k for k in edges if edges[k]])).select(id_col, "path", "weight", "level", "finished")
    return done.unionByName(last)


def partition_counts(decided: DataFrame, decision: str = "decision") -> DataFrame:
    d = F.col(decision)
    return decided.agg(F.count_if(d["value_bool"]).alias("matches"), F.count_if(~d["value_bool"]).alias("rejected"), F.count_if((d["output_state"] != VALUE) & (d["output_state"] != NOT_EVALUATED)).alias("unknown"), F.count_if(d["output_state"] == NOT_EVALUATED).alias("not_evaluated"))
