"""Extract source material: spans, dates, summaries, structure and tables."""

from __future__ import annotations

import datetime as dt
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorvia.decision import NOT_EVALUATED, UNKNOWN, VALUE, Policy, choice_of, proposition
from quorvia.functions import spans as S
from quorvia.judge import judge


def span_rows(subjects: DataFrame, id_col: str, text_col: str, candidates: Column | None = None) -> DataFrame:
    """``id, ordinal, start, end, text`` of each candidate span: sentences, unless spans are given."""
    found = S.sentences(F.col(text_col)) if candidates is None else candidates
    return subjects.select(F.col(id_col), F.posexplode(found).alias("ordinal", "_s")).select(id_col, "ordinal", "_s.start", "_s.end", "_s.text")


def extract(subjects: DataFrame, field: str, evaluator, *, id_col: str, text_col: str, cardinality: str = "one", candidates: Column | None = None, policy: Policy = Policy()) -> DataFrame:
    """Spans that state the field. ``many``: every span known to; ``one``: the likeliest known one (the
    first of equals), or none, with the subject's ``output_state``."""
    rows = span_rows(subjects, id_col, text_col, candidates)
    judged = judge(rows, {"decision": proposition(field)}, evaluator, policy=policy)
    if cardinality == "many":
        return judged.where("decision.value_bool").select(id_col, "ordinal", "start", "end", "text")
    best = F.max(F.when(F.col("decision.value_bool"), F.struct(F.col("decision.p_true").alias("p"), (-F.col("ordinal")).alias("o"), "start", "end", "text")))
    open_ = F.bool_or(F.col("decision.output_state") != VALUE)
    per = judged.groupBy(id_col).agg(best.alias("b"), open_.alias("open"))
    state = F.when(F.col("b").isNotNull(), VALUE).otherwise(UNKNOWN)
    return subjects.select(id_col).join(per, id_col, "left").select(id_col, "b.start", "b.end", "b.text", state.alias("output_state"))


def extract_date(subjects: DataFrame, *, id_col: str, text_col: str, reference: dt.datetime, locale: str = "en-US") -> DataFrame:
    """``id, start, end, text, value, output_state`` of every date; no model is asked. ``reference`` is
    a time with its zone, whose day is today."""
    if reference.tzinfo is None:
        raise ValueError("the reference time needs a zone")
    today = reference.date()

    @F.pandas_udf("array<struct<start: int, end: int, text: string, value: date>>")
    def dates(x: pd.Series) -> pd.Series:
        return x.map(lambda t: S.date_spans(t, today, locale))

    out = subjects.select(id_col, F.explode(dates(F.col(text_col))).alias("d")).select(id_col, "d.*")
    return out.withColumn("output_state", F.when(F.col("value").isNull(), UNKNOWN).otherwise(VALUE))


def iso_dates(text: Column) -> Column:
    """ISO dates in a text without offsets, by built-in expressions."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b[0-9]{4}(?:-[0-9]{2}){2}\b"), F.lit(0)), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    return F.filter(found, lambda d: d.isNotNull())


def find(corpus: DataFrame, query: str, evaluator, *, id_col: str, text_col: str, max_spans: int = 20, policy: Policy = Policy()) -> DataFrame:
    """The first spans that match, in the order of subject and place; ``truncated`` if there are more."""
    hits = extract(corpus, query, evaluator, id_col=id_col, text_col=text_col, cardinality="many", policy=policy)
    top = hits.orderBy(id_col, "start").limit(max_spans + 1)
    nth = W.orderBy(id_col, "start")  # over at most max_spans + 1 rows
    return top.withColumn("_n", F.row_number().over(nth)).withColumn("truncated", F.max("_n").over(W.partitionBy()) > max_spans).where(F.col("_n") <= max_spans).drop("_n")


def summary_extractive(subjects: DataFrame, facet: str, evaluator, *, id_col: str, text_col: str, max_spans: int = 10, one_per_source: bool = False, policy: Policy = Policy()) -> DataFrame:
    """The sentences likeliest to be about the facet: each text once (its first place), known ones
    only, at most one a source if asked, by probability, then source and place."""
    rows = subjects.select(id_col, F.posexplode(S.sentence_texts(F.col(text_col))).alias("ordinal", "text"))
    first = rows.groupBy("text").agg(F.min(F.struct(id_col, "ordinal")).alias("x")).select("x.*", "text")
    judged = judge(first, {"decision": proposition(facet)}, evaluator, policy=policy).where("decision.output_state = 'VALUE'").withColumn("rating", F.col("decision.p_true"))
    if one_per_source:
        judged = judged.withColumn("_n", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("rating"), "ordinal"))).where("_n = 1").drop("_n")
    return judged.orderBy(F.desc("rating"), id_col, "ordinal").limit(max_spans).select(id_col, "ordinal", "text", "rating")


def structure(lines: DataFrame, boundary: str, blocks, evaluator, *, doc_col: str, order_col: str, text_col: str, policy: Policy = Policy()) -> DataFrame:
    """Lines grouped into blocks, each classified. A boundary that isn't known to be absent parts the
    lines; blocks joined by line ends give the text back."""
    w = W.partitionBy(doc_col).orderBy(order_col)
    pairs = lines.withColumn("previous", F.lag(text_col).over(w))
    judged = judge(pairs, {"boundary": proposition(boundary)}, evaluator, policy=policy, needed=F.col("previous").isNotNull())
    start = F.coalesce(~F.col("boundary.value_bool"), F.lit(False))
    numbered = judged.withColumn("block", F.sum(F.when(start, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    grouped = numbered.groupBy(doc_col, "block").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col]), "\n").alias("text"))
    labels = dict(blocks) if isinstance(blocks, dict) else {b: b for b in blocks}
    return judge(grouped, {"label": choice_of("block type", labels | {"unknown": "none of these"})}, evaluator, policy=policy)


def _typed(ddl: str, kind: str, options: dict):
    @F.pandas_udf(ddl)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: S.convert(t, kind, **options)).astype(object)

    return run


def extract_table(documents: DataFrame, columns: dict[str, dict], evaluator, *, id_col: str, text_col: str, record_mode: str = "line", missing: str = "unknown", max_rows: int = 200, policy: Policy = Policy()) -> DataFrame:
    """Records of documents as typed columns with their evidence.

    Lines, paragraphs or documents (by ``record_mode``), whole whatever their length, or in mode
    ``auto`` passages, are records if known to be (question ``record``). Of more than ``max_rows``
    records of a document the first are kept and ``truncated`` is true. For each column a
    passage's literal spans, or the passage's part that its ``pattern`` finds, are candidates; the one
    likeliest to be the field (question ``field:<name>``, with ``candidate``) is converted exactly to
    the column's ``type``. A value that doesn't convert is missing: null with state UNKNOWN, or with
    ``missing='drop'`` its row is left out.
    """
    units = S.passages(F.col(text_col), record_mode) if record_mode == "auto" else S.passages(F.col(text_col), record_mode, sys.maxsize)
    rows = documents.select(id_col, F.posexplode(units).alias("record", "_p")).select(id_col, "record", F.col("_p.text").alias("passage"), F.col("_p.start").alias("passage_start"))
    rows = judge(rows, {"_record": proposition("record")}, evaluator, policy=policy).where("_record.value_bool").drop("_record")
    nth = W.partitionBy(id_col).orderBy("record")
    rows = rows.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= max_rows + 1)
    rows = rows.withColumn("truncated", F.max("_n").over(W.partitionBy(id_col)) > max_rows).where(F.col("_n") <= max_rows)
    for name, spec in columns.items():
        kind = spec.get("type", "text")
        if pattern := spec.get("pattern"):
            candidates = F.regexp_extract_all("passage", F.lit(pattern), F.lit(1))
        else:

            @F.pandas_udf("array<string>")
            def scalars(x: pd.Series) -> pd.Series:
                return x.map(lambda t: [s["text"] for s in S.scalar_spans(t)])

            candidates = scalars(F.col("passage"))
        # a record's candidates meet again by its number, where the window above has put its document
        # already: nothing is joined, so no passage is cut out twice
        cells = rows.select("*", F.posexplode_outer(candidates).alias("ordinal", "candidate"))
        judged = judge(cells, {"_field": proposition(f"field:{name}")}, evaluator, policy=policy, context=[id_col, "record", "passage", "ordinal", "candidate"], needed=F.col("ordinal").isNotNull())
        best = F.max(F.when(F.col("_field.value_bool"), F.struct(F.col("_field.p_true").alias("p"), (-F.col("ordinal")).alias("o"), "candidate")))
        rest = [c for c in rows.columns if c not in (id_col, "_n")]
        grouped = judged.groupBy(id_col, "_n").agg(*(F.first(c).alias(c) for c in rest), best.alias("_best"))
        rows = grouped.select(*rows.columns, F.col("_best.candidate").alias(f"{name}_evidence"))
        ddl = {"text": "string", "integer": "bigint", "number": "decimal(38,10)", "date": "date"}[kind]
        options = {k: v for k, v in spec.items() if k in ("decimal", "group", "percent", "locale")}

        rows = rows.withColumn(name, _typed(ddl, kind, options)(F.col(f"{name}_evidence")))
    rows, whole = rows.drop("_n"), None
    for name in columns:
        whole = F.col(name).isNotNull() if whole is None else whole & F.col(name).isNotNull()
    if missing == "drop":
        rows = rows.where(whole)
    return rows.withColumn("output_state", F.when(whole, VALUE).otherwise(UNKNOWN))


def table_is_complete(rows: DataFrame) -> DataFrame:
    known = F.col("output_state") == VALUE
    whole = known & ~F.col("truncated") if "truncated" in rows.columns else known
    return rows.agg(F.coalesce(F.bool_and(whole), F.lit(True)).alias("complete"), F.count_if(F.col("output_state") == NOT_EVALUATED).alias("not_evaluated"))
