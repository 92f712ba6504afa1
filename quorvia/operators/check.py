"""Check claims against evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.decision import NOT_EVALUATED, UNKNOWN, VALUE, Policy, proposition
from quorvia.operators.connect import relate
from quorvia.judge import judge


def verify(claims: DataFrame, evidence: DataFrame, support: str, opposition: str, evaluator, *, claim_id: str, evidence_claim: str, text_col: str, max_evidence: int | None = 64, policy: Policy = Policy()) -> DataFrame:
    """Each claim against all its evidence jointly: the texts in order, as one state. More pieces than
    ``max_evidence`` make a bundle too large to judge, which is reported and not cut short. With None
    bundles of any size are judged; each is then one row, where its texts are read at all."""
    pieces = evidence.select(F.col(evidence_claim).alias("_claim"), F.col(text_col).alias("_text"))
    number, texts = F.count("*").alias("n_evidence"), F.array_sort(F.collect_list("_text")).alias("evidence")
    if max_evidence is None:
        joint = pieces.groupBy("_claim").agg(number, texts)
    else:
        counts = pieces.groupBy("_claim").agg(number)
        few = counts.where(F.col("n_evidence") <= max_evidence).select("_claim")  # larger bundles are never gathered
        joint = counts.join(pieces.join(few, "_claim").groupBy("_claim").agg(texts), "_claim", "left")
    rows = claims.join(joint, claims[claim_id] == F.col("_claim"), "left").drop("_claim")
    rows = rows.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    return relate(rows, support, opposition, evaluator, policy=policy, refused=None if max_evidence is None else F.col("n_evidence") > max_evidence)


def cover(obligations: DataFrame, evidence: DataFrame, support: str, opposition: str, evaluator, *, obligation_id: str, source_id: str, on: list[tuple[str, str]] | None = None, policy: Policy = Policy(), limit: int = 100_000) -> DataFrame:
    """Per obligation, OR over sources of support and of opposition, the stance, and who supports.

    ``on`` blocks obligations and sources by equal columns; without it every pair is judged, up to
    ``limit`` pairs.
    """
    a = obligations.select(*(F.col(c).alias(f"l_{c}") for c in obligations.columns))
    b = evidence.select(*(F.col(c).alias(f"r_{c}") for c in evidence.columns))
    if on:
        test = F.lit(True)
        for k, m in on:
            test = test & (F.col(f"l_{k}") == F.col(f"r_{m}"))
        pairs = a.join(b, test)
    elif obligations.count() * evidence.count() > limit:
        raise ValueError(f"more than {limit} pairs")
    else:
        pairs = a.crossJoin(b)
    judged = judge(pairs, {"support": proposition(support), "opposition": proposition(opposition)}, evaluator, policy=policy)

    def joint(side: str) -> list:
        d = F.col(side)
        return [F.bool_or(d["value_bool"]).alias(f"{side}_any"), F.bool_or(d["output_state"] == UNKNOWN).alias(f"{side}_unknown"), F.bool_or(d["output_state"] == NOT_EVALUATED).alias(f"{side}_missing")]

    out = judged.groupBy(F.col(f"l_{obligation_id}").alias(obligation_id)).agg(*joint("support"), *joint("opposition"), F.array_sort(F.collect_set(F.when(F.col("support.value_bool"), F.col(f"r_{source_id}")))).alias("supporting"))
    state = lambda side: F.when(F.col(f"{side}_any"), VALUE).when(F.col(f"{side}_missing"), NOT_EVALUATED).when(F.col(f"{side}_unknown"), UNKNOWN).otherwise(VALUE)
    out = out.withColumn("_s", state("support")).withColumn("_o", state("opposition"))
    yes, no = F.coalesce("support_any", F.lit(False)), F.coalesce("opposition_any", F.lit(False))
    text = F.when(yes & no, "conflict").when(yes, "support").when(no, "opposition").otherwise("insufficient")
    worst = F.when((F.col("_s") == NOT_EVALUATED) | (F.col("_o") == NOT_EVALUATED), NOT_EVALUATED).when((F.col("_s") == UNKNOWN) | (F.col("_o") == UNKNOWN), UNKNOWN).otherwise(VALUE)
    out = out.withColumn("output_state", worst).withColumn("stance", F.when(worst == VALUE, text))
    rest = obligations.select(obligation_id).join(out, obligation_id, "left")
    none = F.col("output_state").isNull()
    return rest.select(
        obligation_id, F.when(none, VALUE).otherwise(F.col("output_state")).alias("output_state"), F.when(none, "insufficient").otherwise(F.col("stance")).alias("stance"),
        F.coalesce("supporting", F.expr(f"cast(array() as array<{evidence.schema[source_id].dataType.simpleString()}>)")).alias("supporting"),
    )
