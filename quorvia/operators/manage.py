"""Reusable meaning: discovery, review, promotion, materialisation, refresh, schema choice, SQL planning."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorvia.decision import Policy, choice_of, proposition
from quorvia.judge import judge
from quorvia.operators.typed import population_hash


def tokens(text):
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)))


def jaccard(a, b):
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def discover(records: DataFrame, catalog: list[str], facet: str, evaluator, *, id_col: str, text_col: str, exemplars: int = 20, similarity: float = 0.8, policy: Policy = Policy()) -> DataFrame:
    """Provisional definitions from records that no catalog concept covers.

    Uncovered records in the order of their fingerprint give up to ``exemplars`` exemplars that differ
    (token Jaccard at most ``similarity`` from those before). Equal texts are one record, of the
    smallest id. A bounded head of the order at a time comes to the driver, of the records that differ
    from all exemplars so far; each head that isn't empty has one more, until there are enough or the
    records end.
    """
    spark = records.sparkSession
    judged = judge(records, {"_covered": choice_of(facet, [*catalog, "unknown"])}, evaluator, policy=policy) if catalog else records
    open_rows = judged.where("_covered.value_text is null") if catalog else judged
    texts = open_rows.where(F.col(text_col).isNotNull()).groupBy(F.sha2(F.col(text_col), 256).alias("fingerprint")).agg(F.min(F.col(id_col)).alias(id_col), F.first(text_col).alias("_t")).persist(StorageLevel.DISK_ONLY)
    chosen: list[tuple] = []

    def differs(text: str) -> bool:
        mine = _words(text)
        return bool(mine) and all(len(mine & t) <= similarity * len(mine | t) for *_, t in chosen)

    def next_head() -> list:
        @F.pandas_udf("boolean")
        def fresh(x: pd.Series) -> pd.Series:
            return x.map(differs).astype(bool)

        rest = texts.where(F.col("fingerprint") > chosen[-1][0]) if chosen else texts
        return rest.where(fresh("_t")).orderBy("fingerprint").limit(exemplars * 10).collect()

    while len(chosen) < exemplars and (head := next_head()):
        for row in head:
            if len(chosen) < exemplars and differs(row["_t"]):
                chosen.append((row["fingerprint"], row[id_col], row["_t"], _words(row["_t"])))
    texts.unpersist()
    kind = records.schema[id_col].dataType.simpleString()
    return spark.createDataFrame([(f, i, t, "PROVISIONAL") for f, i, t, _ in chosen], f"fingerprint string, {id_col} {kind}, text string, status string")


def _words(text: str) -> set[str]:
    return set(re.findall(r"\w+", text.lower()))


def nearest_by_tokens(records: DataFrame, exemplars: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The exemplar of greatest token overlap for each record; exemplars are at most twenty."""
    a = records.select(id_col, tokens(F.col(text_col)).alias("_a"))
    b = exemplars.select(F.col("fingerprint"), tokens(F.col("text")).alias("_b")).limit(20)
    scored = a.crossJoin(F.broadcast(b)).withColumn("overlap", F.coalesce(jaccard(F.col("_a"), F.col("_b")), F.lit(0.0)))
    return scored.groupBy(id_col).agg(F.max(F.struct("overlap", "fingerprint")).alias("x")).select(id_col, "x.overlap", "x.fingerprint")


def review(observations: DataFrame, assertions: DataFrame) -> DataFrame:
    """Observations with the effective value: the last human assertion, else the decision's own."""
    w = W.partitionBy("observation_id").orderBy(F.desc("asserted_at"))
    last = assertions.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("observation_id", "asserted", "reviewer")
    return observations.join(last, "observation_id", "left").withColumn("effective", F.coalesce("asserted", "value"))


def promote(definitions: DataFrame, candidate: str, *, owner: str, holdout_accuracy: float, least: float = 0.8) -> DataFrame:
    """The definitions with a candidate made ACTIVE, if its holdout evidence suffices."""
    if holdout_accuracy < least:
        raise ValueError(f"holdout accuracy {holdout_accuracy} is under {least}")
    mine = (F.col("definition_id") == candidate) & (F.col("status") == "PROVISIONAL")
    return definitions.withColumn("owner", F.when(mine, owner).otherwise(F.col("owner"))).withColumn("status", F.when(mine, "ACTIVE").otherwise(F.col("status")))


def materialize(dataset: DataFrame, concept: str, evaluator, path: str, *, policy: Policy = Policy()) -> dict:
    """Write a concept's decisions as a new generation; PUBLISHED if all are known and the population
    didn't change meanwhile, else PARTIAL. The manifest row is written last, beside it."""
    spark = dataset.sparkSession
    before = population_hash(dataset).first()
    generation = uuid.uuid4().hex
    out = judge(dataset, {"decision": proposition(concept)}, evaluator, policy=policy)
    out.write.parquet(f"{path}/generation={generation}")
    saved = spark.read.parquet(f"{path}/generation={generation}")
    n, unresolved = saved.agg(F.count("*"), F.count_if(F.col("decision.output_state") != "VALUE")).first()
    fresh = population_hash(dataset).first() == before
    status = "PUBLISHED" if not unresolved and fresh else "STALE" if not fresh else "PARTIAL"
    manifest = {"generation": generation, "concept": concept, "rows": n, "unresolved": unresolved, "population": f"{before['n_rows']}:{before['hash']}", "status": status}
    spark.createDataFrame([manifest], "generation string, concept string, rows bigint, unresolved bigint, population string, status string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return manifest


def refresh(observations: DataFrame, changed: list[str], *, reason: str = "source changed") -> DataFrame:
    """Invalidation rows for observations whose source revisions changed."""
    hit = F.arrays_overlap("revisions", F.array(*map(F.lit, changed)).cast("array<string>")) if changed else F.lit(False)
    return observations.where(hit).select("observation_id", F.lit(reason).alias("reason"), F.current_timestamp().alias("invalidated_at"))


def catalog_frame(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """``table, column, type`` of some DataFrames' schemas."""
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string")


def select_schema(catalog: DataFrame, request: str, evaluator, *, max_tables: int = 20, max_columns: int = 150, policy: Policy = Policy()) -> DataFrame:
    """Columns of a catalog relevant to a request, of relevant tables only."""
    tables = judge(catalog.select("table").distinct().withColumn("request", F.lit(request)), {"_t": proposition("table relevant")}, evaluator, policy=policy).where("_t.value_bool")
    tables = tables.orderBy(F.desc("_t.p_true"), "table").limit(max_tables).select("table")
    rows = catalog.join(tables, "table").withColumn("request", F.lit(request))
    found = judge(rows, {"_c": proposition("column relevant")}, evaluator, policy=policy).where("_c.value_bool")
    return found.orderBy(F.desc("_c.p_true"), "table", "column").limit(max_columns).select("table", "column", "type", F.col("_c.p_true").alias("relevance"))


def plan_sql(program) -> str:
    """SQL text of a typed program, proposed and never executed."""
    from quorvia.plans.programs import Program, to_sql

    if not isinstance(program, Program):
        raise TypeError("a typed program is asked for")
    return to_sql(program)
