"""Decisions over the rows of SQL statements: one statement, distinct contexts, or several at once."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.decision import Limits, Policy, Question, coverage_columns
from quorvia.functions.sql import run_sql
from quorvia.judge import judge

MAX_SOURCES = 32


def scan(spark: SparkSession, text: str, questions: dict[str, Question], evaluator, *, policy: Policy = Policy(), tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The statement's rows with a decision for each question."""
    return judge(run_sql(spark, text, tables=tables), questions, evaluator, policy=policy)


def scan_mapped(spark: SparkSession, text: str, questions: dict[str, Question], evaluator, *, context: list[str], policy: Policy = Policy(), limits: Limits = Limits(), observations: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """As ``scan``, each distinct projection on the context columns being answered once."""
    return judge(run_sql(spark, text, tables=tables), questions, evaluator, policy=policy, context=context, limits=limits, observations=observations)


def scan_many(spark: SparkSession, sources: dict[str, str], questions: dict[str, Question], evaluator, *, columns: list[str], policy: Policy = Policy(), tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Several statements under one plan and one budget: their rows' common columns, tagged by
    ``source_id``; the scheduler interleaves their partitions."""
    if not 1 <= len(sources) <= MAX_SOURCES:
        raise ValueError(f"1 to {MAX_SOURCES} sources")
    parts = [run_sql(spark, text, tables=tables).select(F.lit(name).alias("source_id"), *columns) for name, text in sources.items()]
    return judge(functools.reduce(DataFrame.unionByName, parts), questions, evaluator, policy=policy)


def receipt(scanned: DataFrame, decision: str, by: list[str] = ()) -> DataFrame:
    return scanned.groupBy(*by).agg(*coverage_columns(F.col(decision)))
