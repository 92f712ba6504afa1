"""One typed question over subjects, and explicit work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.decision import RAW_TYPE, Policy, choice_of, proposition, score_on
from quorvia.judge import answer_contexts, context_json, context_key, judge, observation_rows


def as_subjects(df: DataFrame, id_cols: list[str], state_cols: list[str] | None = None) -> DataFrame:
    """``subject_id, state, revisions`` of a population."""
    state = state_cols or [c for c in df.columns if c not in id_cols]
    return df.select(
        F.sha2(F.to_json(F.struct(*id_cols), {"ignoreNullFields": "false"}), 256).alias("subject_id"),
        F.struct(*state).alias("state"),
        F.array(F.sha2(context_json(state), 256)).alias("revisions"),
    )


def population_hash(df: DataFrame) -> DataFrame:
    """One row that changes when any row of the population does, in whatever order they are read."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash"), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0)).alias("sum"))


def prompt(subjects: DataFrame, instructions: str, evaluator, *, output_type: str = "boolean", criteria=None, policy: Policy = Policy(), name: str = "answer", **options) -> DataFrame:
    """A decision for each subject."""
    if output_type == "boolean":
        q = proposition(instructions)
    elif output_type == "choice":
        q = choice_of(instructions, criteria)
    else:
        q = score_on(instructions, criteria if isinstance(criteria, int) else len(criteria))
    return judge(subjects, {name: q}, evaluator, policy=policy, **options)


def noul(state: DataFrame, statement: str, evaluator, *, policy: Policy = Policy(), name: str = "answer") -> DataFrame:
    """A proposition about each state."""
    return judge(state, {name: proposition(statement)}, evaluator, policy=policy)


def choice(state: DataFrame, instructions: str, options, evaluator, *, policy: Policy = Policy(), name: str = "answer") -> DataFrame:
    return judge(state, {name: choice_of(instructions, options)}, evaluator, policy=policy)


def score(state: DataFrame, instructions: str, levels: int, evaluator, *, policy: Policy = Policy(), name: str = "answer") -> DataFrame:
    return judge(state, {name: score_on(instructions, levels)}, evaluator, policy=policy)


def evaluate(work: DataFrame, questions: dict, evaluator, *, policy: Policy = Policy(), **options) -> DataFrame:
    """Explicit work items: rows of a user's own table, each question over each."""
    return judge(work, questions, evaluator, policy=policy, **options)


def ensure_semantics(subjects: DataFrame, question, evaluator, observations: DataFrame, *, context: list[str] | None = None) -> DataFrame:
    """Observations for every distinct context of the subjects: those there are, and fresh ones for
    the rest. Only the missing contexts are answered."""
    columns = context or subjects.columns
    need = subjects.select(context_key(columns).alias("context_key"), context_json(columns).alias("context")).dropDuplicates(["context_key"])
    mine = observations.where((F.col("question_key") == question.key) & (F.col("evaluator") == evaluator.identity))
    fresh = answer_contexts(need.join(mine.select("context_key"), "context_key", "left_anti"), question, evaluator)
    return mine.select("context_key", "question_key", "evaluator", F.col("raw").cast(RAW_TYPE).alias("raw"), "observed_at").unionByName(observation_rows(fresh, question, evaluator))
