"""The registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.decision import Limits, Policy, all_of, any_of, choice_of, coverage_columns, decide, negated, proposition, require_bool, resolve, run_state_columns, stance
from quorvia.evaluators import ColumnEvaluator, PythonEvaluator, TableEvaluator, one_hot, one_hot_options, option_map
from quorvia.functions import matrices as M
from quorvia.functions import spans as S
from quorvia.functions import scans as SC
from quorvia.functions.sql import Semantics, preview_change, run_sql
from quorvia.judge import bundled, context_key, judge, latest_observations
from quorvia.operators import calculate, check, compare, connect, control, extract, manage, organise, typed
from quorvia.plans import programs as P
from quorvia.plans.stages import StageDag, run_plan
from quorvia.session import shared_dir, table
from quorvia.sources import catalog as C
from quorvia.sources import csvfile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


col, lit = F.col, F.lit


def clip(x):
    return F.least(lit(1.0), F.greatest(lit(0.0), x))


#: A numeric ramp that reaches all three bands of the default policy.
EXPENSIVE = ColumnEvaluator({"the order is expensive": lambda q: clip(col("o_totalprice") / 500000.0), "the order is recent": lambda q: clip((F.year("o_orderdate") - 1995) / 6.0)})
P_SQL = "least(1.0, greatest(0.0, o_totalprice / 500000.0))"
R_SQL = "least(1.0, greatest(0.0, (year(o_orderdate) - 1995) / 6.0))"
V = lambda p: f"CASE WHEN {p} >= 0.8 THEN true WHEN {p} <= 0.2 THEN false END"
S_ = lambda p: f"CASE WHEN {p} >= 0.8 OR {p} <= 0.2 THEN 'VALUE' ELSE 'UNKNOWN' END"


# -- typed decisions


@query(f"SELECT o_orderkey, {S_(P_SQL)} AS output_state, {V(P_SQL)} AS v, {P_SQL} AS p FROM orders")
def prompt(spark, d):
    out = typed.prompt(Tables(spark, d).orders, "the order is expensive", EXPENSIVE)
    return out.select("o_orderkey", "answer.output_state", col("answer.value_bool").alias("v"), col("answer.p_true").alias("p"))


@query(f"SELECT {S_(P_SQL)} AS output_state, {V(P_SQL)} AS v FROM orders WHERE o_orderkey = 1")
def noul(spark, d):
    return typed.noul(Tables(spark, d).orders.where("o_orderkey = 1"), "the order is expensive", EXPENSIVE).select("answer.output_state", col("answer.value_bool").alias("v"))


PRIORITY = ColumnEvaluator({"priority": lambda q: option_map([(o, F.when(col("o_orderpriority") == o, 0.7).otherwise(0.1)) for o in ("1-URGENT", "2-HIGH", "3-MEDIUM")] + [("other", F.when(col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), 0.1).otherwise(0.7))])})


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'VALUE' ELSE 'UNKNOWN' END AS output_state, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS v FROM orders")
def choice(spark, d):
    out = typed.choice(Tables(spark, d).orders, "priority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "other"), PRIORITY)
    return out.select("o_orderkey", "answer.output_state", col("answer.value_text").alias("v"))


SIZE = ColumnEvaluator({"size": lambda q: (col("p_size") - 1) / 49.0 * 4, "price": lambda q: clip((col("p_retailprice") - 900) / 1200.0) * 2})


@query("SELECT p_partkey, (p_size - 1) / 49.0::DOUBLE * 4 AS v FROM part")
def score(spark, d):
    return typed.score(Tables(spark, d).part, "size", 5, SIZE).select("p_partkey", col("answer.value_num").alias("v"))


@query(f"SELECT o_orderkey, {V(P_SQL)} AS a, {V(R_SQL)} AS b FROM orders WHERE o_orderstatus = 'F'")
def evaluate(spark, d):
    work = Tables(spark, d).orders.where("o_orderstatus = 'F'")
    out = typed.evaluate(work, {"a": proposition("the order is expensive"), "b": proposition("the order is recent")}, EXPENSIVE)
    return out.select("o_orderkey", col("a.value_bool").alias("a"), col("b.value_bool").alias("b"))


def _quality(question: dict, contexts: list[dict]) -> list[dict]:
    return [{"p": min(1.0, c["p_size"] / 50.0)} for c in contexts]


@query("SELECT count(*) AS n, sum(CASE WHEN least(1.0, p_size / 50.0) >= 0.8 THEN 1 ELSE 0 END)::BIGINT AS yes FROM (SELECT DISTINCT p_size, p_brand FROM part)")
def ensure_semantics(spark, d):
    parts, q, e = Tables(spark, d).part.select("p_size", "p_brand"), proposition("the part is large"), PythonEvaluator(_quality)
    empty = spark.createDataFrame([], "context_key string, question_key string, evaluator string, raw struct<p: double, probabilities: map<string, double>, score: double, confidence: double, error: string>, observed_at timestamp")
    first = typed.ensure_semantics(parts.where("p_size < 25"), q, e, empty)
    both = typed.ensure_semantics(parts, q, e, first)
    return both.agg(F.count("*").alias("n"), F.count_if(col("raw.p") >= 0.8).alias("yes"))


@query("SELECT p_partkey, CASE WHEN p_size / 50.0 >= 0.8 THEN true WHEN p_size / 50.0 <= 0.2 THEN false END AS v FROM part")
def judge_distinct_contexts(spark, d):
    out = judge(Tables(spark, d).part, {"x": proposition("the part is large")}, PythonEvaluator(_quality), context=["p_size"])
    return out.select("p_partkey", col("x.value_bool").alias("v"))


@query("SELECT doc_id, quality = 1 AS v, quality IS NULL AS skipped FROM documents LEFT JOIN labels USING (doc_id)")
def judge_recorded_answers(spark, d):
    t = Tables(spark, d)
    e = TableEvaluator(t.labels.select("doc_id", col("quality").cast("double").alias("q")), ["doc_id"], {"good": "q"})
    return judge(t.documents.select("doc_id"), {"x": proposition("good")}, e).select("doc_id", col("x.value_bool").alias("v"), (col("x.operation_state") == "SKIPPED").alias("skipped"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN {V(P_SQL)} END AS v, CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' ELSE 'SKIPPED' END AS operation_state FROM orders")
def row_guard(spark, d):
    out = judge(Tables(spark, d).orders, {"x": proposition("the order is expensive")}, EXPENSIVE, needed=col("o_orderstatus") == "F")
    return out.select("o_orderkey", col("x.value_bool").alias("v"), "x.operation_state")


# -- runtime


def _ab(spark, d):
    return judge(Tables(spark, d).orders, {"a": proposition("the order is expensive"), "b": proposition("the order is recent")}, EXPENSIVE)


@query(f"SELECT o_orderkey, ({V(P_SQL)}) AND ({V(R_SQL)}) AS both_v, ({V(P_SQL)}) OR ({V(R_SQL)}) AS any_v, NOT ({V(P_SQL)}) AS not_v FROM orders")
def logical(spark, d):
    return _ab(spark, d).select("o_orderkey", all_of(col("a"), col("b"))["value_bool"].alias("both_v"), any_of(col("a"), col("b"))["value_bool"].alias("any_v"), negated(col("a"))["value_bool"].alias("not_v"))


@query(f"SELECT count(*) AS eligible, sum(({S_(P_SQL)} = 'VALUE')::INT)::BIGINT AS \"values\", sum(({S_(P_SQL)} = 'UNKNOWN')::INT)::BIGINT AS \"unknown\", 0::BIGINT AS not_evaluated, count(*) AS succeeded, 0::BIGINT AS failed, 0::BIGINT AS skipped, 0::BIGINT AS blocked, false AS complete FROM orders")
def coverage(spark, d):
    return _ab(spark, d).agg(*coverage_columns(col("a")))


@query(f"""SELECT o_orderpriority, CASE WHEN count(*) FILTER (NOT open) < count(*) THEN 'UNKNOWN' ELSE 'VALUE' END AS output_state, CASE WHEN count(*) FILTER (open AND o_totalprice <= 100000) > 0 THEN 'SKIPPED' ELSE 'SUCCEEDED' END AS operation_state
FROM (SELECT *, o_totalprice <= 100000 OR ({V(P_SQL)}) IS NULL AS open FROM orders WHERE o_totalprice > 400000 OR o_totalprice <= 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY 1""")
def run_state(spark, d):
    rows = Tables(spark, d).orders.where("o_totalprice > 400000 or o_totalprice <= 100000 and o_orderpriority in ('1-URGENT', '2-HIGH')")
    judged = judge(rows, {"x": proposition("the order is expensive")}, EXPENSIVE, needed=col("o_totalprice") > 100000)
    return judged.groupBy("o_orderpriority").agg(*run_state_columns(col("x")))


@query(f"SELECT o_orderkey, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a AND b THEN 'conflict' WHEN a THEN 'support' WHEN b THEN 'opposition' ELSE 'insufficient' END AS s FROM (SELECT o_orderkey, {V(P_SQL)} AS a, {V(R_SQL)} AS b FROM orders)")
def stance_table(spark, d):
    return _ab(spark, d).select("o_orderkey", stance(col("a"), col("b"))["value_text"].alias("s"))


@query(f"SELECT count(*) AS n FROM orders WHERE {P_SQL} >= 0.5")
def policy_replay(spark, d):
    q = proposition("the order is expensive")
    rows = Tables(spark, d).orders.withColumn("raw", EXPENSIVE.column(q))
    return rows.where(resolve(q, col("raw"), Policy(accept=0.5, reject=0.4))["value_bool"]).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, {V(P_SQL)} AS v, 'SUCCEEDED' AS operation_state FROM orders")
def decide_saved(spark, d):
    q = proposition("the order is expensive")
    rows = Tables(spark, d).orders.withColumn("raw", EXPENSIVE.column(q)).withColumn("sha", context_key(["o_totalprice"]))
    x = decide(q, col("sha"), context_key(["o_totalprice"]), col("raw"))
    return rows.select("o_orderkey", x["value_bool"].alias("v"), x["operation_state"].alias("operation_state"))


@query(f"SELECT o_orderkey, {V(P_SQL)} AS v FROM orders WHERE {P_SQL} >= 0.8 OR {P_SQL} <= 0.2")
def require_bool_values(spark, d):
    return _ab(spark, d).where("a.output_state = 'VALUE'").select("o_orderkey", require_bool(col("a")).alias("v"))


@query("SELECT o_orderkey, CASE WHEN sum(o_orderkey % 7 + 1) OVER (ORDER BY o_orderdate, o_orderkey) <= 2000 THEN 'SUCCEEDED' ELSE 'BLOCKED_BY_BUDGET' END AS operation_state FROM orders")
def budget_reservation(spark, d):
    work = Tables(spark, d).orders.select("o_orderkey", "o_orderdate", (col("o_orderkey") % 7 + 1).alias("cost"))
    return control.budget_states(work, cost="cost", limit=2000, order_by=["o_orderdate", "o_orderkey"]).select("o_orderkey", "operation_state")


@query("""WITH RECURSIVE r AS (SELECT o_orderpriority AS g, o_orderkey AS k, s, s > 32000 AS large, row_number() OVER (PARTITION BY o_orderpriority, s > 32000 ORDER BY o_orderkey) AS n
  FROM (SELECT *, 32 + CASE WHEN o_orderkey % 50 = 7 THEN 40000 WHEN o_orderkey % 10 = 3 THEN 20000 + o_orderkey % 9000 ELSE 10 + o_orderkey % 300 END AS s FROM orders)),
w AS (SELECT g, k, n, 0::BIGINT AS bundle, 1 AS items, s::BIGINT AS total FROM r WHERE n = 1 AND NOT large UNION ALL
  SELECT r.g, r.k, r.n, CASE WHEN items >= 32 OR total + s > 64000 THEN bundle + 1 ELSE bundle END, CASE WHEN items >= 32 OR total + s > 64000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 32 OR total + s > 64000 THEN s ELSE total + s END
  FROM w JOIN r ON r.g = w.g AND r.n = w.n + 1 AND NOT r.large)
SELECT g AS o_orderpriority, k AS o_orderkey, bundle, false AS too_large FROM w UNION ALL SELECT g, k, NULL, true FROM r WHERE large""")
def request_packing(spark, d):
    size = F.when(col("o_orderkey") % 50 == 7, 40000).when(col("o_orderkey") % 10 == 3, 20000 + col("o_orderkey") % 9000).otherwise(10 + col("o_orderkey") % 300)
    work = Tables(spark, d).orders.select("o_orderpriority", "o_orderkey", col("o_orderkey").alias("context_key"), size.cast("int").alias("length"))
    # only the payload's length goes on to the bundles, the text of no row is shuffled
    return bundled(work, ["o_orderpriority"], Limits(), F.repeat(lit("x"), col("length"))).select("o_orderpriority", "bundle", "o_orderkey", "too_large")


@query("SELECT user_id, max(event_id) AS event_id, 'k' AS question_key FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1 GROUP BY user_id")
def observation_latest(spark, d):
    e = Tables(spark, d).events
    rows = e.select(col("user_id").alias("context_key"), lit("k").alias("question_key"), lit("e").alias("evaluator"), col("event_id").alias("observation_id"), col("ts").alias("observed_at"))
    bad = e.where("event_type = 'error'").select(col("event_id").alias("observation_id"))
    return latest_observations(rows, bad).select(col("context_key").alias("user_id"), col("observation_id").alias("event_id"), "question_key")


@query("SELECT count(*) AS n_rows, true AS same_in_any_order, true AS changed_by_a_value, true AS changed_by_a_copy FROM orders")
def population_fingerprint(spark, d):
    o = Tables(spark, d).orders
    last = o.agg({"o_orderkey": "max"}).first()[0]
    same = lambda df, n: typed.population_hash(df).select(*(col(c).alias(f"{c}_{n}") for c in ("n_rows", "hash", "sum")))
    others = {"order": o.repartition(7, "o_custkey"), "value": o.withColumn("o_totalprice", F.when(col("o_orderkey") == last, col("o_totalprice") + 0.01).otherwise(col("o_totalprice"))), "copy": o.unionByName(o.where(col("o_orderkey") == last))}
    out = typed.population_hash(o)
    for n, df in others.items():
        out = out.crossJoin(F.broadcast(same(df, n)))  # one row each
    equal = lambda n: (col("hash") == col(f"hash_{n}")) & (col("sum") == col(f"sum_{n}")) & (col("n_rows") == col(f"n_rows_{n}"))
    return out.select("n_rows", equal("order").alias("same_in_any_order"), (~equal("value")).alias("changed_by_a_value"), (~equal("copy")).alias("changed_by_a_copy"))


@query("SELECT c_custkey, c_nationkey FROM customer")
def subjects(spark, d):
    return typed.as_subjects(Tables(spark, d).customer, ["c_custkey"]).select(F.regexp_extract("state.c_name", r"(\d+)", 1).cast("bigint").alias("c_custkey"), "state.c_nationkey")


# -- organise

TYPE = ColumnEvaluator({"classify": lambda q: one_hot(col("p_type"), ("ECONOMY", "PROMO", "STANDARD", "unknown"), 0.85)})


@query("SELECT coalesce(CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'STANDARD') THEN p_type END, 'unresolved') AS label, count(*) AS n FROM part GROUP BY 1")
def classify(spark, d):
    out = organise.classify(Tables(spark, d).part, ("ECONOMY", "PROMO", "STANDARD"), TYPE)
    return out.groupBy(F.coalesce("label.value_text", lit("unresolved")).alias("label")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, {V(P_SQL)} AS expensive, {V(R_SQL)} AS recent FROM orders")
def tag(spark, d):
    out = organise.tag(Tables(spark, d).orders, {"expensive": "the order is expensive", "recent": "the order is recent"}, EXPENSIVE)
    return out.select("o_orderkey", col("expensive.value_bool").alias("expensive"), col("recent.value_bool").alias("recent"))


def _filtered(spark, d, keep):
    return organise.filter_rows(Tables(spark, d).orders, "the order is expensive", EXPENSIVE, keep=keep).select("o_orderkey", "bucket")


@query(f"SELECT o_orderkey, 'matches' AS bucket FROM orders WHERE {P_SQL} >= 0.8")
def filter_matches(spark, d):
    return _filtered(spark, d, "matches")


@query(f"SELECT o_orderkey, 'rejected' AS bucket FROM orders WHERE {P_SQL} <= 0.2")
def filter_rejected(spark, d):
    return _filtered(spark, d, "rejected")


@query(f"SELECT o_orderkey, 'unresolved' AS bucket FROM orders WHERE {P_SQL} > 0.2 AND {P_SQL} < 0.8")
def filter_unresolved(spark, d):
    return _filtered(spark, d, "unresolved")


@query("""SELECT p_partkey, path, round(weight::DOUBLE, 6) AS weight FROM (
  SELECT p_partkey, 'root/' || k.g || '/' || k.l AS path, k.w AS weight, row_number() OVER (PARTITION BY p_partkey ORDER BY k.w DESC, 'root/' || k.g || '/' || k.l) AS r
  FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN 0.7 ELSE 0.2 END AS big, p_type FROM part) p,
  LATERAL (SELECT 'big' AS g, 'promo' AS l, big * CASE WHEN p_type = 'PROMO' THEN 0.8 ELSE 0.3 END AS w UNION ALL SELECT 'big', 'rest', big * CASE WHEN p_type = 'PROMO' THEN 0.15 ELSE 0.65 END
    UNION ALL SELECT 'small', 'promo', (0.95 - big) * CASE WHEN p_type = 'PROMO' THEN 0.8 ELSE 0.3 END UNION ALL SELECT 'small', 'rest', (0.95 - big) * CASE WHEN p_type = 'PROMO' THEN 0.15 ELSE 0.65 END) k) WHERE r <= 2""")
def classify_hierarchy(spark, d):
    big = F.when(col("p_size") > 25, 0.7).otherwise(0.2)
    promo = col("p_type") == "PROMO"
    kinds = option_map([("promo", F.when(promo, 0.8).otherwise(0.3)), ("rest", F.when(promo, 0.15).otherwise(0.65)), ("unknown", lit(0.05))])
    probs = {"root": option_map([("big", big), ("small", 0.95 - big), ("unknown", lit(0.05))]), "big": kinds, "small": kinds}
    out = organise.classify_hierarchy(Tables(spark, d).part, {"root": ["big", "small"], "big": ["promo", "rest"], "small": ["promo", "rest"]}, probs, id_col="p_partkey", depth=2)
    return out.where("finished").select("p_partkey", F.array_join("path", "/").alias("path"), F.round("weight", 6).alias("weight"))


# -- compare


@query("SELECT a.n_nationkey AS l, b.n_nationkey AS r, CASE WHEN a.n_regionkey < b.n_regionkey THEN 'left' WHEN a.n_regionkey > b.n_regionkey THEN 'right' ELSE 'tie' END AS v FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def compare_pairs(spark, d):
    n = Tables(spark, d).nation
    a, b = n.select(col("n_nationkey").alias("l"), col("n_regionkey").alias("lr")), n.select((col("n_nationkey") - 1).alias("l"), col("n_nationkey").alias("r"), col("n_regionkey").alias("rr"))
    verdict = F.when(col("lr") < col("rr"), "left").when(col("lr") > col("rr"), "right").otherwise("tie")
    e = ColumnEvaluator({"lower region": one_hot(verdict, ("left", "right", "tie", "insufficient"))})
    return compare.compare(a.join(b, "l"), "lower region", e).select("l", "r", col("verdict.value_text").alias("v"))


@query("SELECT p_partkey, (p_size - 1) / 49.0::DOUBLE * 4 AS rating, rank() OVER (ORDER BY p_size DESC)::BIGINT AS rank FROM part")
def rank(spark, d):
    return compare.rank(Tables(spark, d).part, "size", SIZE, id_col="p_partkey", levels=5).select("p_partkey", "rating", col("rank").cast("bigint").alias("rank"))


@query("SELECT p_partkey, r::BIGINT AS rank FROM (SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def rank_topk_ties(spark, d):
    return compare.rank(Tables(spark, d).part, "size", SIZE, id_col="p_partkey", levels=5, top_k=10).select("p_partkey", col("rank").cast("bigint").alias("rank"))


@query("SELECT p_partkey, 'shortlist' AS scope, r::BIGINT AS rank FROM (SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS r FROM part WHERE p_type = 'PROMO') WHERE r <= 5")
def rerank(spark, d):
    return compare.rerank("large parts", Tables(spark, d).part.where("p_type = 'PROMO'"), "size", ColumnEvaluator({"size": lit(0.8) + col("p_size") / 1000.0}), id_col="p_partkey", top_k=5).select("p_partkey", "scope", col("rank").cast("bigint").alias("rank"))


@query("SELECT p_partkey, (0.0::DOUBLE + 1.0::DOUBLE * ((p_size - 1) / 49.0::DOUBLE * 4) / 4 + 3.0::DOUBLE * (least(1.0, greatest(0.0, (p_retailprice - 900) / 1200.0::DOUBLE)) * 2) / 2) / 4.0::DOUBLE AS composite FROM part")
def composite_score(spark, d):
    out = compare.composite_score(Tables(spark, d).part, {"a": ("size", 5), "b": ("price", 3)}, {"a": 1.0, "b": 3.0}, SIZE)
    return out.select("p_partkey", "composite")


# -- calculate


def _aggregate(kind: str, column: str | None):
    def run(spark, d):
        out = calculate.aggregate(Tables(spark, d).orders, ["the order is expensive"], EXPENSIVE, group_by=["o_orderpriority"], metric=(kind, column))
        value = F.round(col("known_subset_value"), 2) if column else col("known_subset_value")
        return out.select("o_orderpriority", value.alias("known"), "eligible", "included", "unresolved", "count_lower", "count_upper", col("value").isNull().alias("open"))

    return run


for _kind, _column in (("count", None), ("sum", "o_totalprice"), ("avg", "o_totalprice"), ("min", "o_totalprice"), ("max", "o_totalprice")):
    _known = "count(*) FILTER (v)" if _column is None else f"round({_kind}(o_totalprice) FILTER (v), 2)"
    QUERIES[f"aggregate_{_kind}"] = _aggregate(_kind, _column)
    SQL[f"aggregate_{_kind}"] = (
        f"SELECT o_orderpriority, {_known} AS known, count(*) AS eligible, count(*) FILTER (v) AS included, count(*) FILTER (v IS NULL) AS unresolved, count(*) FILTER (v) AS count_lower, "
        f"count(*) FILTER (v) + count(*) FILTER (v IS NULL) AS count_upper, count(*) FILTER (v IS NULL) > 0 AS open FROM (SELECT *, {V(P_SQL)} AS v FROM orders) GROUP BY 1"
    )


@query(f"SELECT (SELECT CASE WHEN count(*) FILTER (v IS NULL) = 0 THEN count(*) FILTER (v) END FROM (SELECT {V(P_SQL)} AS v FROM orders WHERE o_totalprice > 400000 OR o_totalprice < 100000)) AS value")
def aggregate_complete(spark, d):
    rows = Tables(spark, d).orders.where("o_totalprice > 400000 or o_totalprice < 100000")
    return calculate.aggregate(rows, ["the order is expensive"], EXPENSIVE).select("value")


@query(f"""WITH x AS (SELECT o_orderstatus AS s, {V(P_SQL)} AS v FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT 'expensive' AS concept, count(*) FILTER (s = 'F') AS left_denominator, count(*) FILTER (s = 'F' AND v) AS left_positive, count(*) FILTER (s = 'F' AND v IS NULL) AS left_unresolved,
 count(*) FILTER (s = 'O') AS right_denominator, count(*) FILTER (s = 'O' AND v) AS right_positive, round(count(*) FILTER (s = 'F' AND v) / count(*) FILTER (s = 'F'), 6) AS left_low,
 round((count(*) FILTER (s = 'F' AND v) + count(*) FILTER (s = 'F' AND v IS NULL)) / count(*) FILTER (s = 'F'), 6) AS left_high FROM x""")
def contrast(spark, d):
    o = Tables(spark, d).orders
    out = calculate.contrast(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), {"expensive": "the order is expensive"}, EXPENSIVE, unit="o_orderkey", check=False)
    return out.select("concept", "left_denominator", "left_positive", "left_unresolved", "right_denominator", "right_positive", F.round("left_low", 6).alias("left_low"), F.round("left_high", 6).alias("left_high"))


# -- connect

NEAR = ColumnEvaluator({"same region": lambda q: F.when(col("l_n_regionkey") == col("r_r_regionkey"), 0.95).when(F.abs(col("l_n_regionkey") - col("r_r_regionkey")) == 1, 0.5).otherwise(0.05)})
NEAR_V = "CASE WHEN n_regionkey = r_regionkey THEN true WHEN abs(n_regionkey - r_regionkey) = 1 THEN NULL ELSE false END"


def _join(spark, d, how, candidates=None, right=None):
    t = Tables(spark, d)
    return connect.join(t.nation, t.region if right is None else right, "same region", NEAR, candidates=candidates or {"kind": "all_pairs"}, how=how, left_id="n_nationkey", right_id="r_regionkey")


@query("SELECT n_nationkey AS left_id, r_regionkey AS right_id FROM nation, region WHERE n_regionkey = r_regionkey")
def join_inner(spark, d):
    return _join(spark, d, "inner")


@query(f"WITH p AS (SELECT n_nationkey AS l, r_regionkey AS r, {NEAR_V} AS v FROM nation, region WHERE r_regionkey < 3) SELECT l AS left_id, r AS right_id FROM p WHERE v UNION ALL SELECT n_nationkey, NULL FROM nation WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = n_nationkey AND (v OR v IS NULL))")
def join_left(spark, d):
    return _join(spark, d, "left", right=Tables(spark, d).region.where("r_regionkey < 3"))


@query(f"SELECT n_nationkey AS left_id FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey < 3 AND coalesce({NEAR_V}, true))")
def join_anti(spark, d):
    return _join(spark, d, "anti", right=Tables(spark, d).region.where("r_regionkey < 3"))


@query("SELECT c_custkey AS left_id, s_suppkey AS right_id FROM customer, supplier WHERE c_nationkey = s_nationkey AND least(1.0, greatest(0.0, (c_acctbal + s_acctbal) / 20000.0)) >= 0.8")
def join_exact_keys(spark, d):
    t = Tables(spark, d)
    e = ColumnEvaluator({"both are rich": clip((col("l_c_acctbal") + col("r_s_acctbal")) / 20000.0)})
    return connect.join(t.customer, t.supplier, "both are rich", e, candidates={"kind": "exact_keys", "keys": [("c_nationkey", "s_nationkey")]}, left_id="c_custkey", right_id="s_suppkey")


@query("SELECT n_nationkey AS left_id, r_regionkey AS right_id FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey % 5 = r_regionkey")
def join_explicit(spark, d):
    pairs = Tables(spark, d).nation.select(col("n_nationkey").alias("left_id"), (col("n_nationkey") % 5).alias("right_id"))
    return _join(spark, d, "inner", {"kind": "explicit", "pairs": pairs})


@query("SELECT c_custkey, s_suppkey, CASE WHEN c_acctbal = s_acctbal THEN 'consistent' ELSE 'inconsistent' END AS acctbal, abs(c_acctbal - s_acctbal) < 100 AS same FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_custkey < 200")
def align(spark, d):
    t = Tables(spark, d)
    return _aligned(t.customer.where("c_custkey < 200"), t.supplier)


@query("SELECT c_custkey, s_suppkey, CASE WHEN c_acctbal = s_acctbal THEN 'consistent' ELSE 'inconsistent' END AS acctbal, abs(c_acctbal - s_acctbal) < 100 AS same FROM customer, supplier WHERE c_nationkey = s_nationkey")
def align_whole(spark, d):
    t = Tables(spark, d)
    return _aligned(t.customer, t.supplier)


def _aligned(customer, supplier):
    pairs = connect.candidate_pairs(customer, supplier, {"kind": "exact_keys", "keys": [("c_nationkey", "s_nationkey")]}, left_id="c_custkey", right_id="s_suppkey")
    e = ColumnEvaluator({"same": F.when(F.abs(col("l_c_acctbal") - col("r_s_acctbal")) < 100, 0.9).otherwise(0.1), "consistent:acctbal": one_hot_options(F.when(col("l_c_acctbal") == col("r_s_acctbal"), "consistent").otherwise("inconsistent"), ("consistent", "inconsistent", "unknown"))})
    out = connect.align(pairs, "same", ["acctbal"], e)
    return out.select(col("l_c_custkey").alias("c_custkey"), col("r_s_suppkey").alias("s_suppkey"), col("fields")[0]["consistency"].alias("acctbal"), "same")


RICH = ColumnEvaluator({"supports": lambda q: clip(col("c_acctbal") / 10000.0), "opposes": lambda q: clip(1 - col("c_acctbal") / 10000.0), "rich": lambda q: clip(col("c_acctbal") / 10000.0)})


@query("SELECT c_custkey, CASE WHEN p >= 0.8 AND 1 - p <= 0.2 THEN 'support' WHEN p <= 0.2 AND 1 - p >= 0.8 THEN 'opposition' END AS s FROM (SELECT c_custkey, least(1.0, greatest(0.0, c_acctbal / 10000.0)) AS p FROM customer WHERE c_acctbal < 1900 OR c_acctbal > 8100)")
def relate(spark, d):
    out = connect.relate(Tables(spark, d).customer.where("c_acctbal < 1900 or c_acctbal > 8100"), "supports", "opposes", RICH)
    return out.select("c_custkey", col("stance.value_text").alias("s"))


@query("""SELECT * FROM (SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts < b.ts AND a.event_id <> b.event_id AND a.event_type = 'signup' AND b.event_type = 'purchase'
 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) <= 3) ORDER BY a, b LIMIT 100""")
def match(spark, d):
    e = ColumnEvaluator({"signs up": F.when(col("event_type") == "signup", 0.9).otherwise(0.1), "buys": F.when(col("event_type") == "purchase", 0.9).otherwise(0.1)})
    return connect.match(Tables(spark, d).events, {"a": "signs up", "b": "buys"}, e, id_col="event_id", same=[("a", "b", "user_id")], before=[("a", "b")], time_col="ts", cap=3)


@query("""WITH b AS (SELECT a.r_regionkey AS x, NULL::INT AS y FROM region a UNION ALL SELECT a.r_regionkey, b.r_regionkey FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey)
SELECT n_nationkey, CASE WHEN y IS NULL THEN x::VARCHAR ELSE x::VARCHAR || ',' || y::VARCHAR END AS bundle, CASE WHEN n_regionkey = x OR n_regionkey = coalesce(y, -1) THEN 'support' ELSE 'opposition' END AS s FROM nation, b""")
def evidence_join(spark, d):
    t = Tables(spark, d)
    hit = (col("n_regionkey") == col("a_r_regionkey")) | (col("n_regionkey") == F.coalesce("b_r_regionkey", lit(-1)))
    e = ColumnEvaluator({"supports": F.when(hit, 0.9).otherwise(0.1), "opposes": F.when(hit, 0.1).otherwise(0.9)})
    out = connect.evidence_join(t.nation, t.region, "supports", "opposes", e, claim_id="n_nationkey", source_id="r_regionkey")
    return out.select("n_nationkey", F.array_join(col("bundle").cast("array<string>"), ",").alias("bundle"), col("stance.value_text").alias("s"))


@query("SELECT n_nationkey, count(c_custkey) AS n_evidence, CASE WHEN count(c_custkey) >= 10 THEN 'support' ELSE 'opposition' END AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey < 300 GROUP BY 1")
def verify(spark, d):
    t = Tables(spark, d)
    many = col("n_evidence") >= 10
    e = ColumnEvaluator({"supports": F.when(many, 0.9).otherwise(0.1), "opposes": F.when(many, 0.1).otherwise(0.9)})
    out = check.verify(t.nation, t.customer.where("c_custkey < 300"), "supports", "opposes", e, claim_id="n_nationkey", evidence_claim="c_nationkey", text_col="c_name")
    return out.select("n_nationkey", "n_evidence", col("stance.value_text").alias("s"))


@query("SELECT n_nationkey, count(c_custkey) AS n_evidence, CASE WHEN count(c_custkey) <= 64 THEN string_agg(c_name, ',' ORDER BY c_name) END AS evidence, CASE WHEN count(c_custkey) >= 10 THEN 'support' ELSE 'opposition' END AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def verify_whole(spark, d):
    t = Tables(spark, d)
    enough = col("n_evidence") >= 10
    e = ColumnEvaluator({"supports": F.when(enough, 0.9).otherwise(0.1), "opposes": F.when(enough, 0.1).otherwise(0.9)})
    keys = {"claim_id": "n_nationkey", "evidence_claim": "c_nationkey", "text_col": "c_name"}
    few = check.verify(t.nation, t.customer, "supports", "opposes", e, **keys).where("n_evidence <= 64")
    many = check.verify(t.nation, t.customer, "supports", "opposes", e, max_evidence=None, **keys).where("n_evidence > 64").withColumn("evidence", lit(None))  # judged by number, so not gathered
    names = F.when(F.size("evidence") > 0, F.array_join("evidence", ","))
    return few.unionByName(many).select("n_nationkey", "n_evidence", names.alias("evidence"), col("stance.value_text").alias("s"))


@query("""WITH p AS (SELECT n_nationkey, s_suppkey, s_acctbal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey),
g AS (SELECT n_nationkey, coalesce(bool_or(s_acctbal >= 8000), false) AS yes, coalesce(bool_or(s_acctbal > 2000 AND s_acctbal < 8000), false) AS open, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (s_acctbal >= 8000) AS ids FROM p GROUP BY 1)
SELECT n_nationkey, CASE WHEN NOT yes AND open THEN NULL WHEN yes THEN 'support' ELSE 'insufficient' END AS s, coalesce(ids, '') AS ids FROM g""")
def cover(spark, d):
    t = Tables(spark, d)
    e = ColumnEvaluator({"supports": clip(col("r_s_acctbal") / 10000.0), "opposes": lit(0.0)})
    out = check.cover(t.nation, t.supplier, "supports", "opposes", e, obligation_id="n_nationkey", source_id="s_suppkey", on=[("n_nationkey", "s_nationkey")])
    return out.select("n_nationkey", col("stance").alias("s"), F.array_join(col("supporting").cast("array<string>"), ",").alias("ids"))


# -- control

EVENT = ColumnEvaluator({"event": lambda q: one_hot(col("event_type"), ("signup", "purchase", "error", "unknown"))})
_TRACE = {("new", "signup"): "member", ("member", "purchase"): "buyer", ("buyer", "error"): "member", ("new", "error"): "new", ("new", "purchase"): "new"}


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
t AS (SELECT user_id, 0::BIGINT AS n, 'new' AS s FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT t.user_id, t.n + 1, CASE WHEN s = 'new' AND event_type = 'signup' THEN 'member' WHEN s = 'member' AND event_type = 'purchase' THEN 'buyer' WHEN s = 'buyer' AND event_type = 'error' THEN 'member' ELSE s END FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
SELECT user_id, n AS n_records, s AS current_state FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def trace(spark, d):
    rows = Tables(spark, d).events.where("event_type in ('signup', 'purchase', 'error')")
    out = control.trace(rows, ["signup", "purchase", "error"], _TRACE, "new", EVENT, entity="user_id", time_col="ts", tie=["event_id"])
    return out.select("user_id", "n_records", "current_state")


@query("""WITH RECURSIVE b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role FROM conversations),
t AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 'closed' AS s FROM b UNION ALL SELECT t.conv_id, t.n + 1, CASE WHEN role = 'user' THEN 'open' WHEN s = 'open' THEN 'closed' ELSE s END FROM t JOIN b ON b.conv_id = t.conv_id AND b.n = t.n + 1)
SELECT conv_id, n AS n_blocks, s AS final_state FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1""")
def state_scan(spark, d):
    nxt = F.when(col("role") == "user", "open").otherwise(F.when(col("from_state") == "open", "closed").otherwise(col("from_state")))
    e = ColumnEvaluator({"next state": one_hot(nxt, ("open", "closed", "unknown"))})
    return control.state_scan(Tables(spark, d).conversations, ["open", "closed"], "closed", e, sequence="conv_id", order_col="turn").select("conv_id", "n_blocks", "final_state")


@query(f"SELECT target, n >= target AS settled, n < target AS open_to_the_end FROM (SELECT count(*) AS n FROM orders WHERE {P_SQL} >= 0.8), (SELECT unnest([5, 1000000000]) AS target)")
def resolve_count(spark, d):
    o = Tables(spark, d).orders
    rows = []
    for target, wave in ((5, 64), (1_000_000_000, 100_000)):
        out = control.resolve_objective(o, "the order is expensive", EXPENSIVE, order_by=["o_orderkey"], objective="count_at_least", target=target, wave=wave)
        rows.append((target, bool(out["settled"]), not out["settled"]))
    return spark.createDataFrame(rows, "target int, settled boolean, open_to_the_end boolean")


@query(f"SELECT o_orderkey, {V(P_SQL)} AS a, CASE WHEN {P_SQL} >= 0.8 THEN {V(R_SQL)} END AS b, CASE WHEN {P_SQL} >= 0.8 THEN 'SUCCEEDED' WHEN {P_SQL} <= 0.2 THEN 'SKIPPED' ELSE 'BLOCKED_BY_DEPENDENCY' END AS b_state FROM orders")
def workflow(spark, d):
    stages = {"a": {"question": proposition("the order is expensive")}, "b": {"question": proposition("the order is recent"), "when": {"stage": "a", "equals": True}}}
    return control.workflow(Tables(spark, d).orders, stages, EXPENSIVE).select("o_orderkey", col("a.value_bool").alias("a"), col("b.value_bool").alias("b"), col("b.operation_state").alias("b_state"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'alert' WHEN event_type = 'purchase' THEN 'ship' END AS handler, CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'high' ELSE 'low' END END AS level FROM events")
def route(spark, d):
    h = F.when(col("event_type") == "error", "alert").when(col("event_type") == "purchase", "ship").otherwise("unknown")
    e = ColumnEvaluator({"handler": one_hot(h, ("alert", "ship", "unknown")), "argument:alert.level": one_hot(F.when(col("value") > 50, "high").otherwise("low"), ("high", "low", "unknown"))})
    return control.route(Tables(spark, d).events, {"alert": {"level": ["high", "low"]}, "ship": {}}, e).select("event_id", col("handler.value_text").alias("handler"), col("alert_level.value_text").alias("level"))


@query("SELECT count(DISTINCT p_size) AS judgments, ceil(count(DISTINCT p_size) / 32.0)::BIGINT AS requests FROM part")
def explain_plan(spark, d):
    out = control.explain_plan(Tables(spark, d).part, ["p_size"], "q", "e")
    return spark.createDataFrame([(out["judgments"], out["requests"])], "judgments bigint, requests bigint")


@query("""SELECT conv_id, block, n_lines, n_chars, label FROM (SELECT conv_id, block, count(*) AS n_lines, sum(length(text)) + count(*) - 1 AS n_chars, CASE WHEN sum(length(text)) + count(*) - 1 > 200 THEN 'long' ELSE 'short' END AS label
 FROM (SELECT *, sum(CASE WHEN p IS NOT NULL AND length(p) <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)) GROUP BY conv_id, block)""")
def structure(spark, d):
    rows = Tables(spark, d).conversations
    e = ColumnEvaluator({"topic changes": F.when(F.length("previous") > 100, 0.9).otherwise(0.1), "block type": one_hot(F.when(F.length("text") > 200, "long").otherwise("short"), ("long", "short", "unknown"))})
    out = extract.structure(rows, "topic changes", ("long", "short"), e, doc_col="conv_id", order_col="turn", text_col="text")
    return out.select("conv_id", "block", "n_lines", F.length("text").cast("bigint").alias("n_chars"), col("label.value_text").alias("label"))


# -- extract

SENTENCES = r"list_filter(list_transform(regexp_extract_all(text, '[^.。!！?？\n]+(?:$|[.。!！?？])'), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT item_id, len({SENTENCES})::INT AS n, array_to_string({SENTENCES}, '~') AS s FROM benchmark")
def extract_sentences(spark, d):
    s = S.sentence_texts(col("text"))
    return Tables(spark, d).benchmark.select("item_id", F.size(s).alias("n"), F.array_join(s, "~").alias("s"))


@query(f"SELECT item_id, count(*) AS n, max(length(s))::INT AS longest FROM (SELECT item_id, unnest({SENTENCES}) AS s FROM benchmark) WHERE length(s) >= 80 GROUP BY 1")
def extract_many(spark, d):
    e = ColumnEvaluator({"long": F.when(F.length("text") >= 80, 0.9).otherwise(0.1)})
    out = extract.extract(Tables(spark, d).benchmark, "long", e, id_col="item_id", text_col="text", cardinality="many")
    return out.groupBy("item_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders")
def extract_date(spark, d):
    rows = Tables(spark, d).orders.select("o_orderkey", F.concat(lit("placed on "), F.date_format("o_orderdate", "yyyy-MM-dd"), lit(".")).alias("text"))
    out = extract.extract_date(rows, id_col="o_orderkey", text_col="text", reference=dt.datetime(2026, 9, 22, 10, tzinfo=dt.timezone.utc))
    return out.select("o_orderkey", col("value").cast("string").alias("value"))


@query(f"SELECT item_id, s AS text FROM (SELECT item_id, unnest({SENTENCES}) AS s, unnest(range(1, len({SENTENCES}) + 1)) AS o FROM benchmark) WHERE length(s) >= 80 ORDER BY item_id, o LIMIT 20")
def find(spark, d):
    e = ColumnEvaluator({"long": F.when(F.length("text") >= 80, 0.9).otherwise(0.1)})
    return extract.find(Tables(spark, d).benchmark, "long", e, id_col="item_id", text_col="text").select("item_id", "text")


@query(f"SELECT item_id, s AS text FROM (SELECT item_id, o, s, row_number() OVER (PARTITION BY s ORDER BY item_id, o) AS n FROM (SELECT item_id, unnest({SENTENCES}) AS s, unnest(range(1, len({SENTENCES}) + 1)) AS o FROM benchmark)) WHERE n = 1 ORDER BY least(1.0, length(s) / 200.0) DESC, item_id, o LIMIT 10")
def summary_extractive(spark, d):
    e = ColumnEvaluator({"about": clip(F.length("text") / 200.0)})
    return extract.summary_extractive(Tables(spark, d).benchmark, "about", e, id_col="item_id", text_col="text", policy=Policy(accept=0.01, reject=0.001)).select("item_id", "text")


@query("SELECT o_orderkey, o_totalprice::DECIMAL(38,10)::DOUBLE AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey < 500")
def extract_table(spark, d):
    return _order_table(Tables(spark, d).orders.where("o_orderkey < 500"))


@query("SELECT o_orderkey, o_totalprice::DECIMAL(38,10)::DOUBLE AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def extract_table_whole(spark, d):
    return _order_table(Tables(spark, d).orders)


def _order_table(orders):
    rows = orders.select("o_orderkey", F.format_string("order of %s for %s EUR", F.date_format("o_orderdate", "yyyy-MM-dd"), col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("text"))
    e = ColumnEvaluator({"record": lit(0.9), "field:amount": F.when(col("candidate").contains("."), 0.9).otherwise(0.1), "field:day": lit(0.9)})
    out = extract.extract_table(rows, {"amount": {"type": "number"}, "day": {"type": "date", "pattern": r"order of (\S+) for"}}, e, id_col="o_orderkey", text_col="text")
    return out.select("o_orderkey", col("amount").cast("double").alias("amount"), col("day").cast("string").alias("day"))


@query("SELECT c_custkey, c_acctbal::DECIMAL(38,10)::DOUBLE AS v FROM customer")
def convert_number(spark, d):
    money = F.when(col("c_acctbal") < 0, F.concat(lit("($"), F.format_number(-col("c_acctbal"), 2), lit(")"))).otherwise(F.concat(lit("$"), F.format_number("c_acctbal", 2)))
    return Tables(spark, d).customer.select("c_custkey", S.number_column(money).cast("double").alias("v"))


# -- stages


def _dag(spark, d):
    t, dag = Tables(spark, d), StageDag()
    o = dag.source(t.orders, grain="order", keys=[["o_orderkey"]], identifiers=["o_orderkey", "o_custkey"], name="orders")
    c = dag.source(t.customer, grain="customer", keys=[["c_custkey"]], identifiers=["c_custkey"], name="customers")
    return dag, o, c


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def stage_filter_project(spark, d):
    dag, o, _ = _dag(spark, d)
    f = dag.filter(o, ["and", ["gt", ["col", "o_totalprice"], ["lit", 100000]], ["eq", ["col", "o_orderstatus"], ["lit", "F"]]])
    return dag.project(f, {"twice": ["mul", ["col", "o_totalprice"], ["lit", 2]]}, keep=["o_orderkey"], order=[["o_totalprice", "desc"], ["o_orderkey", "asc"]], limit=50).frame


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS a, count(DISTINCT o_custkey) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def stage_aggregate(spark, d):
    dag, o, _ = _dag(spark, d)
    out = dag.aggregate(o, ["o_orderpriority"], {"n": ["count"], "a": ["avg", ["col", "o_totalprice"]], "c": ["count_distinct", ["col", "o_custkey"]], "lo": ["min", ["col", "o_totalprice"]], "hi": ["max", ["col", "o_totalprice"]]})
    return out.frame.withColumn("a", F.round("a", 4))


@query("SELECT o_orderkey, (rank() OVER w)::INT AS r, lag(o_totalprice) OVER w AS prev, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS roll, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def stage_window(spark, d):
    dag, o, _ = _dag(spark, d)
    order = [["o_orderdate", "asc"], ["o_orderkey", "asc"]]
    a = dag.windows(o, {"r": ("rank",), "prev": ("lag", ["col", "o_totalprice"]), "pr": ("percent_rank",), "cd": ("cume_dist",)}, partition=["o_custkey"], order=order)
    b = dag.window(a, "roll", ("sum", ["col", "o_totalprice"]), partition=["o_custkey"], order=order, frame=(-2, 0))
    return b.frame.select("o_orderkey", "r", "prev", F.round("roll", 2).alias("roll"), F.round("pr", 6).alias("pr"), F.round("cd", 6).alias("cd"))


@query("SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def stage_join(spark, d):
    dag, o, c = _dag(spark, d)
    return dag.join(o, c, [("o_custkey", "c_custkey")], {"o_orderkey": ("left", "o_orderkey"), "segment": ("right", "c_mktsegment")}, how="left").frame


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def stage_latest(spark, d):
    dag, o, _ = _dag(spark, d)
    return dag.latest(o, ["o_custkey"], [["o_orderdate", "desc"], ["o_orderkey", "asc"]]).frame.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, count(*) AS n, count(*) AS n_rows FROM (SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def stage_row_identity(spark, d):
    o = Tables(spark, d).orders
    dag = StageDag()  # copies of a row have identities of their own
    r = dag.row_identity(dag.source(o.unionByName(o.where("o_orderstatus = 'F'")), grain="order", keys=[], name="o"), "row")
    return dag.aggregate(r, ["o_orderstatus"], {"n": ["count_distinct", ["col", "row"]], "n_rows": ["count"]}).frame


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 10")
def stage_order_limit(spark, d):
    dag = StageDag()
    s = dag.source(Tables(spark, d).supplier, grain="supplier", keys=[["s_suppkey"]], name="s")
    return dag.order_limit(s, [["s_acctbal", "desc"], ["s_suppkey", "asc"]], 10).frame.select("s_suppkey", "s_acctbal")


@query(f"SELECT o_orderkey, CASE WHEN {P_SQL} >= 0.8 THEN {V(R_SQL)} WHEN {P_SQL} <= 0.2 THEN {V(P_SQL)} END AS v FROM orders")
def stage_merge(spark, d):
    dag, o, _ = _dag(spark, d)
    s = dag.semantic(o, {"a": proposition("the order is expensive"), "b": proposition("the order is recent")}, EXPENSIVE)
    return dag.merge(s, "a", {True: "b", False: "a"}, None, "m").frame.select("o_orderkey", col("m.value_bool").alias("v"))


@query(f"SELECT o_orderpriority, count(*) AS n FROM orders WHERE {P_SQL} >= 0.8 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def stage_plan_json(spark, d):
    plan = {
        "target": "top",
        "stages": [
            {"name": "o", "operator": "source", "table": "orders", "keys": [["o_orderkey"]]},
            {"name": "s", "operator": "semantic", "inputs": ["o"], "questions": {"a": {"type": "boolean", "instructions": "the order is expensive"}}},
            {"name": "p", "operator": "project", "inputs": ["s"], "keep": ["o_orderpriority", "o_totalprice"]},
            {"name": "f", "operator": "filter", "inputs": ["p"], "predicate": ["ge", ["div", ["col", "o_totalprice"], ["lit", 500000.0]], ["lit", 0.8]]},
            {"name": "g", "operator": "aggregate", "inputs": ["f"], "groups": ["o_orderpriority"], "metrics": {"n": ["count"]}},
            {"name": "top", "operator": "order_limit", "inputs": ["g"], "order": [["n", "desc"], ["o_orderpriority", "asc"]], "limit": 3},
        ],
    }
    return run_plan(plan, {"orders": Tables(spark, d).orders}, EXPENSIVE)["top"].frame


@query("SELECT 'key:o_custkey' AS \"check\", count(*) AS violations FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'key:o_orderkey', 0")
def stage_verify(spark, d):
    t = Tables(spark, d)
    dag = StageDag()
    good = dag.verify(dag.source(t.orders, grain="order", keys=[["o_orderkey"]], name="o"))
    bad = dag.verify(dag.source(t.orders, grain="customer", keys=[["o_custkey"]], name="c"))
    return good.union(bad).where("check like 'key:%'")


@query(f"SELECT count(*) AS eligible, sum(({S_(P_SQL)} = 'VALUE')::INT)::BIGINT AS known FROM orders")
def stage_receipt(spark, d):
    dag, o, _ = _dag(spark, d)
    s = dag.semantic(o, {"a": proposition("the order is expensive")}, EXPENSIVE)
    return dag.receipt(s, "a").select("eligible", col("values").alias("known"))


@query("SELECT c_custkey, c_acctbal * 1.0::DOUBLE / nullif(c_nationkey, 0) AS ratio, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS k, sqrt(abs(c_acctbal)) > 50 AS big, lower(c_mktsegment) AS seg, split_part(c_name, '#', 2) AS num FROM customer")
def stage_terms(spark, d):
    dag = StageDag()
    c = dag.source(Tables(spark, d).customer.withColumn("u", F.regexp_replace("c_name", "#", "_")), grain="customer", keys=[["c_custkey"]], identifiers=["c_custkey"], name="c")
    out = dag.project(c, {
        "ratio": ["div", ["col", "c_acctbal"], ["col", "c_nationkey"]], "k": ["case", [["lt", ["col", "c_acctbal"], ["lit", 0]], ["lit", "debt"]], ["lit", "credit"]],
        "big": ["gt", ["sqrt", ["abs", ["col", "c_acctbal"]]], ["lit", 50]], "seg": ["lower", ["col", "c_mktsegment"]], "num": ["suffix", ["col", "u"]],
    }, keep=["c_custkey"])
    return out.frame


# -- programs

LINKS = (P.Link("lineitem", "orders", (("l_orderkey", "o_orderkey"),)), P.Link("orders", "customer", (("o_custkey", "c_custkey"),)), P.Link("customer", "nation", (("c_nationkey", "n_nationkey"),)), P.Link("nation", "region", (("n_regionkey", "r_regionkey"),)))


def _program(spark, d, **spec):
    t = Tables(spark, d)
    return P.run(P.Program(links=LINKS, **spec), {n: getattr(t, n) for n in ("lineitem", "orders", "customer", "nation", "region")})


@query("SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 450000 AND r_name = 'ASIA'")
def prog_rows(spark, d):
    return _program(spark, d, root="orders", tables=("region",), columns=("o_orderkey", "r_name"), conditions=(P.Condition("o_totalprice", "gt", 450000), P.Condition("r_name", "eq", "ASIA")))


@query("SELECT r_name, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def prog_groups(spark, d):
    return _program(spark, d, root="orders", tables=("region",), family="groups", groups=("r_name",), statistic="sum", measure="o_totalprice").withColumn("value", F.round("value", 2))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 8) AS value FROM lineitem GROUP BY 1")
def prog_weighted(spark, d):
    return _program(spark, d, root="lineitem", family="groups", groups=("l_returnflag",), statistic="weighted", measure="l_discount", weight="l_quantity").withColumn("value", F.round("value", 8))


@query("SELECT l_linestatus, round(avg(l_extendedprice * 1.0 / nullif(l_quantity, 0)), 4) AS value FROM lineitem GROUP BY 1")
def prog_formula(spark, d):
    return _program(spark, d, root="lineitem", family="groups", groups=("l_linestatus",), statistic="avg", formula=("ratio", "l_extendedprice", "l_quantity")).withColumn("value", F.round("value", 4))


@query("SELECT c_custkey FROM (SELECT c_custkey, c_acctbal, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS a FROM customer) WHERE c_acctbal > a")
def prog_baseline(spark, d):
    return _program(spark, d, root="customer", measure="c_acctbal", baseline="partition:c_nationkey", columns=("c_custkey",))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def prog_baseline_global(spark, d):
    return _program(spark, d, root="customer", measure="c_acctbal", baseline="global", columns=("c_custkey",))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_nationkey, c_custkey) <= 3")
def prog_partition_rank(spark, d):
    return _program(spark, d, root="customer", groups=("c_nationkey",), columns=("c_nationkey", "c_custkey", "c_acctbal"), rank_by="c_acctbal", top_k=3)


@query("SELECT o_custkey, round(before, 2) AS before, round(after, 2) AS after, round((after - before) * 100.0 / nullif(before, 0), 4) AS change FROM (SELECT o_custkey, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS before, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS after FROM orders GROUP BY 1) WHERE before IS NOT NULL AND after IS NOT NULL")
def prog_periods(spark, d):
    out = P.periods(Tables(spark, d).orders.withColumn("y", F.year("o_orderdate")), entity="o_custkey", period="y", measure="o_totalprice", first=1996, second=1997, kind="percent")
    return out.select("o_custkey", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), F.round("change", 4).alias("change"))


@query("SELECT o_custkey FROM (SELECT o_custkey, y, m, lag(m) OVER (PARTITION BY o_custkey ORDER BY y) AS p FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS m FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1998) GROUP BY 1, 2)) GROUP BY 1 HAVING count(*) = 3 AND bool_and(p IS NULL OR m > p)")
def prog_trend(spark, d):
    return P.trend(Tables(spark, d).orders.withColumn("y", F.year("o_orderdate")), entity="o_custkey", period="y", measure="o_totalprice", wanted=[1996, 1997, 1998])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 40)")
def prog_absence(spark, d):
    t = Tables(spark, d)
    return P.absence(t.customer, [(t.orders, [("c_custkey", "o_custkey")]), (t.lineitem, [("o_orderkey", "l_orderkey")])], [(col("l_returnflag") == "R") & (col("l_quantity") > 40)]).select("c_custkey")


@query("SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS ratio FROM orders GROUP BY 1")
def prog_ratio(spark, d):
    return P.conditional_ratio(Tables(spark, d).orders, col("o_orderstatus") == "F", groups=["o_orderpriority"]).withColumn("ratio", F.round("ratio", 6))


@query("SELECT round(a, 2) AS first_value, round(b, 2) AS second_value, round(a - b, 2) AS difference, round(a / b, 6) AS ratio, round(a * 100.0 / b, 4) AS percentage FROM (SELECT sum(o_totalprice) FILTER (o_orderstatus = 'F') AS a, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')")
def prog_cohort(spark, d):
    out = P.cohorts(Tables(spark, d).orders, col("o_orderstatus") == "F", col("o_orderstatus") == "O", col("o_totalprice"), shared=col("o_orderdate") >= "1996-01-01")
    return out.select(*(F.round(c, n).alias(c) for c, n in (("first_value", 2), ("second_value", 2), ("difference", 2), ("ratio", 6), ("percentage", 4))))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 AND l_discount < 0.05 THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END AS v FROM lineitem")
def rule_formula(spark, d):
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber", P.rule("l_extendedprice * (1 - l_discount) if l_quantity > 25 and l_discount < 0.05 else 0.0", li.columns).alias("v"))


@query("SELECT c_custkey, round(coalesce(sum(o_totalprice), NULL), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rule_reduction(spark, d):
    t = Tables(spark, d)
    return P.rule_reduction(t.customer, t.orders, [("c_custkey", "o_custkey")], kind="sum", column="o_totalprice", alias="total").select("c_custkey", F.round("total", 2).alias("total"))


@query("SELECT c_custkey, CASE WHEN p <= 0.25 THEN 1 WHEN p <= 0.5 THEN 2 WHEN p <= 0.75 THEN 3 ELSE 4 END AS q FROM (SELECT c_custkey, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS p FROM customer)")
def rule_quartile(spark, d):
    return Tables(spark, d).customer.select("c_custkey", P.quartile(col("c_acctbal"), ["c_nationkey"]).alias("q"))


@query("SELECT c.c_custkey, round(r, 6) AS r, round(avg(c_acctbal) FILTER (c_acctbal > 0) OVER (PARTITION BY c_nationkey), 4) AS m FROM customer c LEFT JOIN (SELECT c_custkey, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r FROM customer WHERE c_acctbal > 0) s USING (c_custkey)")
def rule_scoped(spark, d):
    c = Tables(spark, d).customer
    out = P.scoped_rank(c, col("c_acctbal") > 0, "c_acctbal", partition=["c_nationkey"], key="c_custkey", alias="r")
    return out.select("c_custkey", F.round("r", 6).alias("r"), F.round(P.scoped_mean(col("c_acctbal"), col("c_acctbal") > 0, ["c_nationkey"]), 4).alias("m"))


@query("SELECT user_id FROM events GROUP BY 1 HAVING NOT coalesce(bool_or(CASE WHEN value > 300 THEN true WHEN value > 295 THEN NULL ELSE false END), false) AND NOT bool_or(value > 295 AND value <= 300)")
def message_not_exists(spark, d):
    p = F.when(col("value") > 300, True).when(col("value") > 295, lit(None).cast("boolean")).otherwise(False)
    return P.message_plan(Tables(spark, d).events, p, grain="customer", customer="user_id", mode="not_exists")


# -- sources


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_custkey > 100 OR o_custkey = 100 AND o_orderkey > 500) ORDER BY o_custkey, o_orderkey LIMIT 100")
def keyset_scan(spark, d):
    return C.keyset_page(Tables(spark, d).orders, ["o_custkey", "o_orderkey"], after=(100, 500), where=[("o_orderstatus", "in", ["F", "O"])], size=100).select("o_custkey", "o_orderkey")


@query("SELECT k, c_name, truncated FROM (SELECT 'rows' AS k, c_name, true AS truncated FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50) UNION ALL SELECT 'bytes', n_name, true FROM (SELECT n_name, sum(octet_length(encode(n_name)) + 13) OVER (ORDER BY n_name) AS b FROM nation) WHERE b <= 300 UNION ALL SELECT 'whole', r_name, false FROM region")
def result_window(spark, d):
    t = Tables(spark, d)
    rows = C.result_window(t.customer, ["c_acctbal", "c_custkey"], rows=50).select(lit("rows").alias("k"), "c_name", "truncated")
    size = C.result_window(t.nation.select("n_name"), ["n_name"], size=300).select(lit("bytes").alias("k"), col("n_name").alias("c_name"), "truncated")
    return rows.union(size).union(C.result_window(t.region, ["r_name"]).select(lit("whole").alias("k"), col("r_name").alias("c_name"), "truncated"))


@query("""SELECT 'c_nationkey' AS k, count(*) AS n_rows, count(c_nationkey) AS non_null, count(DISTINCT c_nationkey) AS "distinct", count(DISTINCT c_nationkey) = count(*) AS proven FROM customer
UNION ALL SELECT 'c_custkey', count(*), count(c_custkey), count(DISTINCT c_custkey), count(DISTINCT c_custkey) = count(*) FROM customer
UNION ALL SELECT 'with_null', count(*), count(*) - 1, count(*) - 1, false FROM customer""")
def uniqueness(spark, d):
    c = Tables(spark, d).customer.withColumn("with_null", F.nullif(col("c_custkey"), lit(1)))
    out = [C.uniqueness(c, n).select(lit(n).alias("k"), "*") for n in ("c_nationkey", "c_custkey", "with_null")]
    return out[0].union(out[1]).union(out[2])


@query("""SELECT count(*) AS n_rows, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (trim(v) = '') AS blanks, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT v AS x FROM c WHERE v IS NOT NULL ORDER BY x LIMIT 4)) AS examples FROM c""".replace("SELECT count(*) AS n_rows", "WITH c AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_mktsegment END AS v FROM customer) SELECT count(*) AS n_rows", 1))
def column_profile(spark, d):
    v = F.when(col("c_custkey") % 7 == 0, None).when(col("c_custkey") % 5 == 0, "  ").otherwise(col("c_mktsegment"))
    out = C.profile(Tables(spark, d).customer.withColumn("v", v), "v", examples=4)
    return out.withColumn("examples", F.array_join("examples", "|"))


@query("SELECT count(*) AS distinct_values, count(c_custkey) AS found FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey")
def link_overlap(spark, d):
    t = Tables(spark, d)
    return C.domain_overlap(t.orders, "o_custkey", t.customer, "c_custkey")


@query("SELECT user_id, max(event_id) FILTER (n = 1) AS event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY 1")
def latest_version(spark, d):
    return C.latest_versions(Tables(spark, d).events, ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("SELECT c_custkey, c_acctbal::DECIMAL(12,2)::DOUBLE AS b, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'a \"quoted\", ' || c_mktsegment END AS s FROM customer")
def csv_cells(spark, d):
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    text = F.when(col("c_custkey") % 9 == 0, None).otherwise(F.concat(lit('a "quoted", '), "c_mktsegment"))
    Tables(spark, d).customer.select(col("c_custkey").alias("k"), col("c_acctbal").cast("decimal(12,2)").alias("b"), text.alias("s")).write.option("header", True).option("escape", '"').csv(folder)
    cells = csvfile.read(spark, folder)
    return csvfile.typed(cells, csvfile.inferred(cells)).select(col("k").cast("bigint").alias("c_custkey"), col("b").cast("double").alias("b"), "s")


# -- answer matrices

BASIS = M.Basis((("a", proposition("the order is expensive")), ("c", choice_of("priority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "other")))), "column/1")
BOTH = ColumnEvaluator(EXPENSIVE.rules | PRIORITY.rules)
_K = "CASE WHEN o_orderpriority = '{0}' THEN 0.7 ELSE 0.1 END"
_O = "CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 0.7 ELSE 0.1 END"


@query(f"SELECT o_orderkey, [1 - {P_SQL}, {P_SQL}, {_K.format('1-URGENT')}, {_K.format('2-HIGH')}, {_K.format('3-MEDIUM')}, {_O}]::DOUBLE[] AS v FROM orders")
def answer_matrix(spark, d):
    out = M.embed(Tables(spark, d).orders, BASIS, BOTH)
    return out.select("o_orderkey", M.flat_vector(col("matrix")).alias("v"))


_MX = f"SELECT o_orderkey, [1 - {P_SQL}, {P_SQL}] AS a, [{_K.format('1-URGENT')}, {_K.format('2-HIGH')}, {_K.format('3-MEDIUM')}, {_O}] AS c FROM orders"
_H = "(0.5 * list_sum(list_transform(list_zip(x.{0}, q.{0}), lambda z: power(sqrt(z[1] / list_sum(x.{0})) - sqrt(z[2] / list_sum(q.{0})), 2))))"


@query(f"WITH m AS ({_MX}), q AS (SELECT * FROM m WHERE o_orderkey = 1) SELECT x.o_orderkey, round(sqrt(({_H.format('a')} + {_H.format('c')}) / 2), 6) AS distance FROM m x, q")
def embedding_distances(spark, d):
    rows = M.embed(Tables(spark, d).orders, BASIS, BOTH)
    return M.embedding_distances(rows.where("o_orderkey = 1"), rows, id_col="o_orderkey", basis=BASIS).select("o_orderkey", F.round("distance", 6).alias("distance"))


@query(f"WITH m AS ({_MX}) SELECT x.o_orderkey, round(sqrt(({_H.format('a')} + {_H.format('c')}) / 2), 6) AS distance FROM m x JOIN m q ON q.o_orderkey = x.o_orderkey + 1")
def embedding_distance(spark, d):
    rows = M.embed(Tables(spark, d).orders, BASIS, BOTH).select("o_orderkey", "matrix", "matrix_basis")
    nxt = rows.select((col("o_orderkey") - 1).alias("o_orderkey"), col("matrix").alias("m2"), col("matrix_basis").alias("b2"))
    out = M.pair_distances(rows.join(nxt, "o_orderkey"), BASIS, "matrix", "m2", left_basis="matrix_basis", right_basis="b2")
    return out.select("o_orderkey", F.round("distance", 6).alias("distance"))


@query(f"WITH m AS ({_MX}) SELECT x.o_orderkey, round(sqrt(({_H.format('a')} + {_H.format('c')}) / 2), 6) AS distance FROM m x JOIN m q ON q.o_orderkey = x.o_orderkey + 1 WHERE x.o_orderkey < 1000")
def embedding_distance_any_basis(spark, d):
    return _next_distances(Tables(spark, d).orders.where("o_orderkey <= 1000"))


@query(f"WITH m AS ({_MX}) SELECT x.o_orderkey, round(sqrt(({_H.format('a')} + {_H.format('c')}) / 2), 6) AS distance FROM m x JOIN m q ON q.o_orderkey = x.o_orderkey + 1")
def embedding_distance_any_basis_whole(spark, d):
    return _next_distances(Tables(spark, d).orders)


def _next_distances(orders):
    rows = M.embed(orders, BASIS, BOTH).select("o_orderkey", M.compact(col("matrix"), col("matrix_basis")).alias("m"))
    return M.keyed_distances(rows, rows.select((col("o_orderkey") - 1).alias("o_orderkey"), "m"), "o_orderkey", "m").select("o_orderkey", F.round("distance", 6).alias("distance"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_distance(embedding::DOUBLE[], e), 8) AS distance FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], e), vec_id LIMIT 20")
def vector_knn(spark, d):
    e = Tables(spark, d).embeddings
    return M.vector_distances(e.where("vec_id = 0"), e, id_col="vec_id", vector="embedding", top_k=20).select("vec_id", F.round("distance", 8).alias("distance"))


# -- managed meaning


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN false ELSE value > 50 END AS effective FROM events")
def review(spark, d):
    e = Tables(spark, d).events
    obs = e.select(col("event_id").alias("observation_id"), (col("value") > 50).alias("value"))
    said = e.where("user_id % 3 = 0").select(col("event_id").alias("observation_id"), lit(False).alias("asserted"), lit("a").alias("reviewer"), col("ts").alias("asserted_at"))
    return manage.review(obs, said).select(col("observation_id").alias("event_id"), "effective")


@query("SELECT event_id AS observation_id FROM events WHERE event_type IN ('error', 'signup')")
def refresh_invalidate(spark, d):
    obs = Tables(spark, d).events.select(col("event_id").alias("observation_id"), F.array("event_type").alias("revisions"))
    return manage.refresh(obs, ["error", "signup"]).select("observation_id")


@query("SELECT p_partkey::VARCHAR AS definition_id, CASE WHEN p_size <= 25 THEN 'RETIRED' WHEN p_partkey IN (7, 8) THEN 'ACTIVE' ELSE 'PROVISIONAL' END AS status, CASE WHEN p_size > 25 AND p_partkey IN (7, 8) THEN 'me' WHEN p_size > 40 THEN 'you' END AS owner FROM part")
def promote(spark, d):
    defs = Tables(spark, d).part.select(col("p_partkey").cast("string").alias("definition_id"), F.when(col("p_size") > 25, "PROVISIONAL").otherwise("RETIRED").alias("status"), F.when(col("p_size") > 40, "you").alias("owner"))
    return manage.promote(manage.promote(defs, "7", owner="me", holdout_accuracy=0.9), "8", owner="me", holdout_accuracy=0.8)


@query("""WITH RECURSIVE t AS (SELECT f, id, w, row_number() OVER (ORDER BY f) AS n FROM (SELECT sha256(text) AS f, min(item_id) AS id, list_sort(list_distinct(regexp_extract_all(lower(any_value(text)), '[a-z0-9_]+'))) AS w FROM benchmark WHERE length(text) <= 250 GROUP BY text)),
g AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS fs, []::VARCHAR[][] AS ws UNION ALL SELECT t.n, CASE WHEN len(fs) < 10 AND len(list_filter(ws, lambda v: len(list_intersect(v, t.w)) > 0.8 * (len(v) + len(t.w) - len(list_intersect(v, t.w))))) = 0 THEN list_append(fs, t.f) ELSE fs END,
 CASE WHEN len(fs) < 10 AND len(list_filter(ws, lambda v: len(list_intersect(v, t.w)) > 0.8 * (len(v) + len(t.w) - len(list_intersect(v, t.w))))) = 0 THEN list_append(ws, t.w) ELSE ws END FROM g JOIN t ON t.n = g.n + 1)
SELECT f AS fingerprint, id AS item_id, 'PROVISIONAL' AS status FROM t WHERE list_contains((SELECT fs FROM g ORDER BY n DESC LIMIT 1), f)""")
def discover(spark, d):
    e = ColumnEvaluator({"topic": one_hot(F.when(F.length("text") > 250, "long").otherwise("unknown"), ("long", "unknown"))})
    return manage.discover(Tables(spark, d).benchmark, ["long"], "topic", e, id_col="item_id", text_col="text", exemplars=10).select("fingerprint", "item_id", "status")


@query("""SELECT * FROM (VALUES ('customer', 'c_custkey', 'bigint'), ('customer', 'c_nationkey', 'int'), ('orders', 'o_orderkey', 'bigint'), ('orders', 'o_custkey', 'bigint')) v("table", "column", "type")""")
def select_schema(spark, d):
    t = Tables(spark, d)
    e = ColumnEvaluator({"table relevant": F.when(col("table").isin("orders", "customer"), 0.9).otherwise(0.1), "column relevant": F.when(col("column").contains("key"), 0.9).otherwise(0.1)})
    return manage.select_schema(manage.catalog_frame(spark, {n: getattr(t, n) for n in ("orders", "customer", "part")}), "orders of customers", e).select("table", "column", "type")


@query("SELECT r_name, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000 GROUP BY r_name")
def plan_sql(spark, d):
    p = P.Program(root="orders", tables=("region",), family="groups", groups=("r_name",), statistic="count", conditions=(P.Condition("o_totalprice", "gt", 100000),), links=LINKS)
    t = Tables(spark, d)
    return run_sql(spark, manage.plan_sql(p), tables={n: getattr(t, n) for n in ("orders", "customer", "nation", "region")})


@query()
def materialize(spark, d):
    import uuid

    folder = shared_dir(spark)
    out = manage.materialize(Tables(spark, d).orders.select("o_orderkey", "o_totalprice"), "the order is expensive", EXPENSIVE, f"{folder}/{uuid.uuid4().hex}")
    return spark.createDataFrame([(out["rows"], out["unresolved"], out["status"])], "rows bigint, unresolved bigint, status string")


SQL["materialize"] = f"SELECT count(*) AS rows, sum(({S_(P_SQL)} = 'UNKNOWN')::INT)::BIGINT AS unresolved, 'PARTIAL' AS status FROM orders"

# -- scans and changes


@query(f"SELECT o_orderkey, {V(P_SQL)} AS v FROM orders WHERE o_orderstatus = 'P'")
def scan(spark, d):
    out = SC.scan(spark, "SELECT * FROM orders WHERE o_orderstatus = 'P'", {"x": proposition("the order is expensive")}, EXPENSIVE, tables={"orders": Tables(spark, d).orders})
    return out.select("o_orderkey", col("x.value_bool").alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size / 50.0 >= 0.8 THEN true WHEN p_size / 50.0 <= 0.2 THEN false END AS v FROM part WHERE p_type = 'PROMO'")
def scan_mapped(spark, d):
    out = SC.scan_mapped(spark, "SELECT * FROM part WHERE p_type = 'PROMO'", {"x": proposition("the part is large")}, PythonEvaluator(_quality), context=["p_size"], tables={"part": Tables(spark, d).part})
    return out.select("p_partkey", col("x.value_bool").alias("v"))


@query(f"SELECT source_id, count(*) AS eligible, count(*) FILTER (v IS NOT NULL) AS known FROM (SELECT 'f' AS source_id, {V(P_SQL)} AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'o', {V(P_SQL)} FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def scan_many(spark, d):
    sources = {k.lower(): f"SELECT * FROM orders WHERE o_orderstatus = '{k}'" for k in ("F", "O")}
    out = SC.scan_many(spark, sources, {"x": proposition("the order is expensive")}, EXPENSIVE, columns=["o_orderkey", "o_totalprice"], tables={"orders": Tables(spark, d).orders})
    return SC.receipt(out, "x", ["source_id"]).select("source_id", "eligible", col("values").alias("known"))


@query("SELECT s_suppkey, s_acctbal AS was, s_acctbal * 2 AS will FROM supplier WHERE s_acctbal < 1000")
def preview_update(spark, d):
    out = preview_change(Tables(spark, d).supplier, ["s_suppkey"], col("s_acctbal") < 1000, {"s_acctbal": col("s_acctbal") * 2}, limit=None)
    return out.select("s_suppkey", col("before.s_acctbal").alias("was"), col("after.s_acctbal").alias("will"))


# -- SQL surface

SEMANTICS = Semantics({"expensive": "least(1.0, greatest(0.0, {col} / 500000.0))"}, {"priced": ("score", "least(1.0, greatest(0.0, {col} / 500000.0)) * 4"), "band": ("choice", "CASE WHEN {col} > 250000 THEN 'high' ELSE 'low' END")})
_ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: By name: the accepted text, and the twin where DuckDB needs another wording.
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "sql_join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000", None),
    "sql_join_left": ("SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 GROUP BY c.c_custkey", None),
    "sql_join_full": ("SELECT coalesce(a.k, b.k) AS k, a.n AS na, b.n AS nb FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k", None),
    "sql_join_cross": ("SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", None),
    "sql_join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "sql_semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)", None),
    "sql_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "sql_in": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderpriority LIKE '1%'", None),
    "sql_any": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_custkey < 20)", None),
    "sql_any_some": ("SELECT n_nationkey FROM nation WHERE n_nationkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 2) AND n_nationkey >= ANY (SELECT r_regionkey + 3 FROM region)", None),
    "sql_any_empty": ("SELECT n_nationkey, n_nationkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 90) AS a, n_nationkey < ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 90) AS b, n_nationkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey = 3) AS c FROM nation", None),
    "sql_any_nulls": ("SELECT n_nationkey, n_nationkey > ALL (SELECT nullif(r_regionkey, 2) FROM region) AS a, n_nationkey < ANY (SELECT nullif(r_regionkey, 4) FROM region) AS b, n_nationkey <> ANY (SELECT nullif(r_regionkey, 2) FROM region WHERE r_regionkey = 2) AS c, nullif(n_nationkey, 5) <= ALL (SELECT r_regionkey + 20 FROM region) AS e FROM nation", None),
    "sql_setops": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2 UNION SELECT 99", None),
    "sql_union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "sql_cte": ("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000) SELECT c.c_mktsegment, count(*) AS n FROM big JOIN customer c ON c.c_custkey = big.o_custkey GROUP BY c.c_mktsegment", None),
    "sql_recursive_cte": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t", None),
    "sql_scalar_subquery": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.6 * avg(o_totalprice) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)", None),
    "sql_derived": ("SELECT k, n FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY o_orderstatus) x WHERE n > 10", None),
    "sql_having_ordinal": ("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 3 OFFSET 1", None),
    "sql_distinct": ("SELECT DISTINCT p_brand, p_type FROM part", None),
    "sql_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)", None),
    "sql_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", None),
    "sql_grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "sql_window_rank": ("SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)", "SELECT c_custkey, (row_number() OVER w)::INT AS rn, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS dr, (ntile(4) OVER w)::INT AS nt FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"),
    "sql_window_values": ("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "sql_stats": ("SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS s, round(stddev_pop(c_acctbal), 4) AS sp, round(variance(c_acctbal), 2) AS v, round(var_pop(c_acctbal), 2) AS vp FROM customer GROUP BY c_mktsegment", None),
    "sql_bool_aggs": ("SELECT c_nationkey, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9900) AS o, logical_or(c_acctbal > 9900) AS l FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9900) AS o, bool_or(c_acctbal > 9900) AS l FROM customer GROUP BY c_nationkey"),
    "sql_percentile": ("SELECT c_mktsegment, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal), 4) AS m, percentile_disc(0.9) WITHIN GROUP (ORDER BY c_acctbal) AS d FROM customer GROUP BY c_mktsegment", None),
    "sql_string_agg": ("SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"),
    "sql_array_agg": ("SELECT n_regionkey, count(*) AS n, array_agg(n_regionkey) AS ks FROM nation GROUP BY n_regionkey", None),
    "sql_string": ("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substring(c_name, 1, 8) AS s, left(c_name, 3) AS lf, right(c_name, 4) AS rt, replace(c_name, '#', '-') AS rp, split_part(c_name, '#', 2) AS sp, concat(c_name, '/', c_mktsegment) AS ct, concat_ws('-', c_mktsegment, c_name) AS cw, trim('  x ') AS t FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name)::INT AS n, substring(c_name, 1, 8) AS s, left(c_name, 3) AS lf, right(c_name, 4) AS rt, replace(c_name, '#', '-') AS rp, split_part(c_name, '#', 2) AS sp, concat(c_name, '/', c_mktsegment) AS ct, concat_ws('-', c_mktsegment, c_name) AS cw, trim('  x ') AS t FROM customer"),
    "sql_regexp": ("SELECT c_custkey, regexp_replace(c_name, '0', 'x', 'g') AS a, regexp_replace(c_name, '0', 'x') AS b FROM customer", None),
    "sql_math": ("SELECT p_partkey, round(sqrt(p_retailprice), 4) AS a, round(power(p_size, 2), 2) AS b, round(log(p_retailprice), 6) AS c, round(ln(p_retailprice), 6) AS d, round(exp(p_size / 100.0), 6) AS e, mod(p_size, 7) AS m, abs(p_size - 25) AS ab, floor(p_retailprice / 7) AS f, ceil(p_retailprice / 7) AS g FROM part", "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS a, round(power(p_size, 2), 2) AS b, round(log10(p_retailprice), 6) AS c, round(ln(p_retailprice), 6) AS d, round(exp(p_size / 100.0), 6) AS e, mod(p_size, 7) AS m, abs(p_size - 25) AS ab, floor(p_retailprice / 7)::BIGINT AS f, ceil(p_retailprice / 7)::BIGINT AS g FROM part"),
    "sql_null_functions": ("SELECT c_custkey, nullif(c_nationkey, 3) AS n, coalesce(nullif(c_nationkey, 3), -1) AS c, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS k FROM customer", None),
    "sql_cast": ("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,1)) AS d, TRY_CAST(o_orderpriority AS INT) AS t, CAST(o_custkey AS VARCHAR(20)) AS v FROM orders", None),
    "sql_date": ("SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, date_trunc('month', o_orderdate) AS t, to_char(o_orderdate, 'YYYY-MM-DD') AS c, strftime(o_orderdate, '%d/%m/%Y') AS f FROM orders", "SELECT o_orderkey, extract(year FROM o_orderdate)::INT AS y, extract(month FROM o_orderdate)::INT AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, strftime(o_orderdate, '%Y-%m-%d') AS c, strftime(o_orderdate, '%d/%m/%Y') AS f FROM orders"),
    "sql_date_parse": ("SELECT o_orderkey, to_date(substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'YYYY-MM-DD') AS d, datediff(to_date('2002-01-01', 'YYYY-MM-DD'), o_orderdate) AS days, date_add(CAST(o_orderdate AS DATE), 7) AS w, date_sub(CAST(o_orderdate AS DATE), 7) AS b FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')::INT AS days, CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS w, CAST(CAST(o_orderdate AS DATE) - 7 AS DATE) AS b FROM orders"),
    "sql_json": ("SELECT event_id, CAST(json_extract_scalar(props, 'k') AS INT) AS k, jsonb_extract_scalar(props, '{k}') AS s FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') AS s FROM events"),
    "sql_between_like": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring%' AND NOT p_type IN ('SMALL', 'PROMO') AND p_brand IS NOT NULL", None),
    "sql_semantic_where": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND SEMANTIC(o_totalprice, 'expensive')", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND ({V(P_SQL)})"),
    "sql_semantic_not": ("SELECT o_orderkey FROM orders WHERE NOT SEMANTIC(o_totalprice, 'expensive')", f"SELECT o_orderkey FROM orders WHERE NOT ({V(P_SQL)})"),
    "sql_semantic_select": ("SELECT o_orderkey, SEMANTIC(o_totalprice, 'expensive') AS v FROM orders ORDER BY SEMANTIC(o_totalprice, 'expensive')", f"SELECT o_orderkey, {V(P_SQL)} AS v FROM orders"),
    "sql_semantic_group": ("SELECT SEMANTIC(o_totalprice, 'expensive') AS v, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1", f"SELECT {V(P_SQL)} AS v, count(*) AS n FROM orders GROUP BY 1"),
    "sql_semantic_case": ("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN SEMANTIC(o_totalprice, 'expensive') THEN 'hot' ELSE 'rest' END AS c FROM orders", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN {V(P_SQL)} THEN 'hot' ELSE 'rest' END AS c FROM orders"),
    "sql_semantic_cte": ("WITH f AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, count(*) AS n FROM f WHERE SEMANTIC(o_totalprice, 'expensive') GROUP BY o_custkey", f"SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND ({V(P_SQL)}) GROUP BY o_custkey"),
    "sql_semantic_join_on": ("SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND SEMANTIC(o.o_totalprice, 'expensive')", f"SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND ({V(P_SQL)})"),
    "sql_semantic_feature": ("SELECT o_orderkey, round(SEMANTIC_FEATURE(o_totalprice, 'priced'), 6) AS s, SEMANTIC_FEATURE(o_totalprice, 'band') AS b FROM orders", f"SELECT o_orderkey, round({P_SQL} * 4, 6) AS s, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS b FROM orders"),
}


def _statement(text: str) -> Query:
    def run(spark, d):
        used = [t for t in _ALL if f" {t}" in f" {text}"]
        return run_sql(spark, text, SEMANTICS, {t: table(spark, d, t) for t in used})

    return run


for _name, (_text, _twin) in STATEMENTS.items():
    QUERIES[_name] = _statement(_text)
    SQL[_name] = _twin or _text


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Per priority, how many orders are known to be expensive, and the bounds while some are open."""
    return calculate.aggregate(table(spark, folder, "orders"), ["the order is expensive"], EXPENSIVE, group_by=["o_orderpriority"], metric=("sum", "o_totalprice"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

