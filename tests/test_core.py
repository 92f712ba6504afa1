"""Decisions, judging, operators, plans, sources and SQL on small inputs."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quorvia.decision import Limits, Policy, Question, all_of, any_of, choice_of, make_decision, missing, negated, proposition, raw_answer, require_bool, resolve, score_on, stance
from quorvia.evaluators import ColumnEvaluator, PythonEvaluator, one_hot
from quorvia.functions import spans as S
from quorvia.functions.dialect import translate_pattern
from quorvia.functions.sql import Semantics, SqlError, check_partial, commit_change, guard, insert_rows, prepare, preview_change, run_sql
from quorvia.judge import bundled, judge
from quorvia.operators import OPERATORS, call, calculate, check, compare, connect, control, extract, manage, organise
from quorvia.plans import programs as P
from quorvia.plans.stages import StageDag, run_plan
from quorvia.plans.terms import TermError
from quorvia.sources import catalog as C
from quorvia.sources import csvfile

TEXT = ColumnEvaluator({"yes": lambda q: F.when(F.col("t") == "yes", 0.95).when(F.col("t") == "no", 0.05).when(F.col("t") == "maybe", 0.5)})


def test_there_are_all_operators():
    assert len(OPERATORS) == 42
    with pytest.raises(KeyError):
        call("NOTHING")


def test_states_are_kept_apart(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("maybe",), ("fail",), (None,)], "t string")
    out = judge(df, {"x": proposition("yes", subject="t")}, TEXT).select("t", "x.*").collect()
    assert [(r.t, r.output_state, r.operation_state, r.value_bool) for r in out] == [
        ("yes", "VALUE", "SUCCEEDED", True), ("no", "VALUE", "SUCCEEDED", False), ("maybe", "UNKNOWN", "SUCCEEDED", None), ("fail", "NOT_EVALUATED", "FAILED", None), (None, "NOT_EVALUATED", "SKIPPED", None)
    ]


def test_kleene_logic(spark):
    kinds = {"t": make_decision(F.lit("VALUE"), F.lit("SUCCEEDED"), boolean=F.lit(True)), "f": make_decision(F.lit("VALUE"), F.lit("SUCCEEDED"), boolean=F.lit(False)), "u": make_decision(F.lit("UNKNOWN"), F.lit("SUCCEEDED")), "n": missing("SKIPPED")}
    cols = {}
    for a in kinds:
        for b in kinds:
            cols[f"and_{a}{b}"], cols[f"or_{a}{b}"] = all_of(kinds[a], kinds[b]), any_of(kinds[a], kinds[b])
    row = spark.range(1).select(*(c.alias(k) for k, c in cols.items()), negated(kinds["u"]).alias("not_u"), stance(kinds["t"], kinds["t"]).alias("st"), stance(kinds["t"], kinds["n"]).alias("sn")).first()
    code = lambda d: {True: "t", False: "f", None: {"UNKNOWN": "u", "NOT_EVALUATED": "n"}.get(d.output_state)}[d.value_bool]
    order = {"f": 0, "n": 1, "u": 2, "t": 3}
    for a in kinds:
        for b in kinds:
            assert code(row[f"and_{a}{b}"]) == min(a, b, key=order.get)
            want = "t" if "t" in (a, b) else "n" if "n" in (a, b) else "u" if "u" in (a, b) else "f"
            assert code(row[f"or_{a}{b}"]) == want
    assert code(row.not_u) == "u" and row.st.value_text == "conflict" and row.sn.output_state == "NOT_EVALUATED"


def test_bad_answers_fail_and_are_never_negative(spark):
    q = choice_of("pick", ("a", "b", "unknown"))
    df = spark.createDataFrame([(dict(zip(k.split(), p)),) for k, p in (("a b unknown", (0.9, 0.1, 0.0)), ("a b unknown", (0.5, 0.5, 0.0)), ("a b unknown", (0.1, 0.1, 0.8)), ("a b unknown", (0.9, 0.9, 0.0)), ("a", (1.0,)), ("a b c", (0.5, 0.4, 0.1)))], "p map<string,double>")
    got = [(r.d.output_state, r.d.operation_state, r.d.value_text) for r in df.select(resolve(q, raw_answer(probabilities=F.col("p"))).alias("d")).collect()]
    assert got == [("VALUE", "SUCCEEDED", "a"), ("UNKNOWN", "SUCCEEDED", None), ("UNKNOWN", "SUCCEEDED", None)] + [("NOT_EVALUATED", "FAILED", None)] * 3
    s = spark.range(1).select(resolve(score_on("s", 3), raw_answer(score=F.lit(2.5))).alias("d")).first().d
    assert s.operation_state == "FAILED"
    with pytest.raises(Exception, match="complete"):
        spark.range(1).select(require_bool(missing("SKIPPED"))).collect()


def test_question_and_policy_checks():
    for bad in (lambda: Question("x", "y"), lambda: choice_of("c", ("a",)), lambda: score_on("s", 1), lambda: proposition(" "), lambda: Policy(accept=0.2, reject=0.8)):
        with pytest.raises(ValueError):
            bad()
    assert proposition("a").key != proposition("b").key


def _counting():
    def answer(question, contexts):  # nested, so it travels by value
        if any(c["t"] == "boom" for c in contexts):
            raise RuntimeError("no answer")
        return [{"p": 0.9 if c["t"] == "yes" else 0.1} for c in contexts]

    return answer


def test_python_evaluator_dedups_caches_and_keeps_failures(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "yes"), (3, "no"), (4, "boom")], "id int, t string")
    e = PythonEvaluator(_counting(), batch=1, attempts=2)
    rows = {r.id: r.x for r in judge(df, {"x": proposition("q")}, e, context=["t"]).collect()}
    assert rows[1].value_bool and rows[2].value_bool and rows[3].value_bool is False
    assert rows[4].operation_state == "FAILED" and rows[4].reason == "no answer"
    few = {r.id: r.x for r in judge(df.where("id < 4"), {"x": proposition("q")}, e, context=["t"], limits=Limits(judgments=1)).collect()}
    assert sorted({x.operation_state for x in few.values()}) == ["BLOCKED_BY_BUDGET", "SUCCEEDED"]


def test_filter_and_aggregate_never_drop_the_unresolved(spark):
    df = spark.createDataFrame([(1, "yes", Decimal("9007199254740993.01")), (2, "yes", Decimal("0.02")), (3, "maybe", Decimal(1)), (4, "no", Decimal(5))], "id int, t string, x decimal(38,10)")
    assert [r.bucket for r in organise.filter_rows(df, "yes", TEXT, keep=None).orderBy("id").collect()] == ["matches", "matches", "unresolved", "rejected"]
    r = calculate.aggregate(df, ["yes"], TEXT, metric=("sum", "x")).first()
    assert r.value is None and r.known_subset_value == Decimal("9007199254740993.03") and (r.count_lower, r.count_upper) == (2, 3)
    empty = calculate.aggregate(df.limit(0), ["yes"], TEXT).first()
    assert empty.value == 0 and empty.eligible == 0


def test_rank_keeps_ties(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 1.0)], "id string, s double")
    e = ColumnEvaluator({"r": lambda q: F.col("s")})
    top = compare.rank(df, "r", e, id_col="id", levels=3, top_k=1).collect()
    assert [(r.id, r["rank"]) for r in top] == [("a", 1), ("b", 1)]
    assert [(r.id, r["rank"]) for r in compare.rank(df, "r", e, id_col="id", levels=3).collect()] == [("a", 1), ("b", 1), ("c", 3)]


def test_composite_score_weights(spark):
    e = ColumnEvaluator({"a": lambda q: F.lit(1.0), "b": lambda q: F.lit(1.0), "c": lambda q: F.lit(None)})
    df = spark.range(1)
    for weights, want in (({"x": 1.0, "y": 1.0}, 0.75), ({"x": 3.0, "y": 1.0}, 0.875)):
        assert compare.composite_score(df, {"x": ("a", 2), "y": ("b", 3)}, weights, e).first().composite == want
    assert compare.composite_score(df, {"x": ("a", 2), "z": ("c", 3)}, {"x": 1.0, "z": 1.0}, e).first().composite is None
    assert compare.composite_score(df, {"x": ("a", 2), "z": ("c", 3)}, {"x": 1.0, "z": 1.0}, e, missing="renormalize").first().composite == 1.0


def test_unmatched_rows_need_all_pairs_known_false(spark):
    left = spark.createDataFrame([(1, "k"), (2, "k"), (3, None)], "id int, k string")
    right = spark.createDataFrame([(10, "k"), (11, "k")], "id int, k string")
    e = ColumnEvaluator({"m": lambda q: F.when(F.col("l_id") == 1, 0.5).otherwise(0.1)})
    keys = {"kind": "exact_keys", "keys": [("k", "k")]}
    assert sorted(r.left_id for r in connect.join(left, right, "m", e, candidates=keys, how="anti", left_id="id", right_id="id").collect()) == [2, 3]
    pairs = spark.createDataFrame([(2, 10)], "left_id int, right_id int")
    assert connect.join(left, right, "m", e, candidates={"kind": "explicit", "pairs": pairs}, how="anti", left_id="id", right_id="id").count() == 0
    with pytest.raises(ValueError):
        connect.candidate_pairs(left, right, {"kind": "all_pairs"}, left_id="id", right_id="id", limit=5)


def test_cover_and_verify(spark):
    need = spark.createDataFrame([(1,), (2,)], "o int")
    src = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.5), (3, 9, 0.9)], "o int, s int, p double")
    e = ColumnEvaluator({"s": lambda q: F.col("r_p"), "n": lambda q: F.lit(0.0)})
    got = {r.o: r for r in check.cover(need, src, "s", "n", e, obligation_id="o", source_id="s", on=[("o", "o")]).collect()}
    assert got[1].stance == "support" and got[1].supporting == [7] and got[2].stance == "insufficient" and got[2].supporting == []


def test_contrast_checks_its_units(spark):
    a, b = spark.createDataFrame([(1, "yes"), (2, "maybe")], "u int, t string"), spark.createDataFrame([(3, "no")], "u int, t string")
    r = calculate.contrast(a, b, {"c": "yes"}, TEXT, unit="u").first()
    assert r.left_rate is None and (r.left_low, r.left_high) == (0.5, 1.0) and r.right_rate == 0.0 and r.difference is None
    with pytest.raises(ValueError):
        calculate.contrast(a, a, {"c": "yes"}, TEXT, unit="u")


def test_resolve_stops_early(spark):
    df = spark.createDataFrame([(i, "yes" if i % 2 else "no") for i in range(100)], "id int, t string")
    out = control.resolve_objective(df, "yes", TEXT, order_by=["id"], objective="exists", wave=4)
    assert out["settled"] is True and out["judged"] == 4 and out["waves"] == 1
    short = control.resolve_objective(df, "yes", TEXT, order_by=["id"], objective="count_at_least", target=45, wave=4)
    assert short["settled"] is None and short["operation_state"] == "TRUNCATED"
    assert control.settled("count_at_most", 3, 4, 0) is False and control.settled("exact_count", 2, 2, 0) is True


def test_composition_is_associative():
    import itertools

    s = ("open", "done")
    tables = [dict(zip(s, map(frozenset, t))) for t in itertools.product((("open",), ("done",), ("open", "done")), repeat=2)][:3]
    for a, b, c in itertools.product(tables, repeat=3):
        assert control.compose(control.compose(a, b), c) == control.compose(a, control.compose(b, c))


def test_trace_carries_sets_of_states(spark):
    rows = spark.createDataFrame([(1, 1, "go"), (1, 2, "??"), (2, 1, "go")], "e int, at int, ev string")
    e = ColumnEvaluator({"event": lambda q: one_hot(F.col("ev"), ("go", "stop", "unknown"))})
    out = {r.e: r for r in control.trace(rows, ["go", "stop"], {("idle", "go"): "run", ("run", "stop"): "idle"}, "idle", e, entity="e", time_col="at", timeline=True).collect()}
    assert out[1].states == ["idle", "run"] and out[1].output_state == "UNKNOWN" and out[2].current_state == "run"
    assert [x.states for x in out[1].timeline] == [["run"], ["idle", "run"]]
    tied = spark.createDataFrame([(1, 1, "go"), (1, 1, "stop")], "e int, at int, ev string")
    with pytest.raises(Exception, match="share a time"):
        control.trace(tied, ["go", "stop"], {}, "idle", e, entity="e", time_col="at").collect()


def test_workflow_guards(spark):
    df = spark.createDataFrame([("yes",)], "t string")
    run = lambda stages: control.workflow(df, stages, TEXT).first()
    q = {"question": proposition("yes")}
    assert run({"a": {"literal": 1}, "b": q | {"when": {"stage": "a", "equals": True}}}).b.operation_state == "BLOCKED_BY_POLICY"
    assert run({"a": {"literal": False}, "b": q | {"when": {"stage": "a", "equals": True}}}).b.operation_state == "SKIPPED"
    assert run({"a": {"literal": True}, "b": q | {"when": {"stage": "a", "equals": True}}}).b.value_bool
    with pytest.raises(ValueError, match="circle"):
        control.workflow(df, {"a": q | {"depends_on": ["b"]}, "b": q | {"depends_on": ["a"]}}, TEXT)


def test_extract_one_and_many(spark):
    df = spark.createDataFrame([(1, "完成。承诺明天交付。"), (2, "Nothing here."), (3, None)], "id int, text string")
    e = ColumnEvaluator({"promise": lambda q: F.when(F.col("text").contains("承诺"), 0.9).otherwise(0.1)})
    one = {r.id: r for r in extract.extract(df, "promise", e, id_col="id", text_col="text").collect()}
    assert one[1].text == "承诺明天交付。" == "完成。承诺明天交付。"[one[1].start : one[1].end] and one[2].output_state == "UNKNOWN"
    assert extract.find(df, "promise", e, id_col="id", text_col="text").count() == 1
    assert [s["text"] for s in S.sentence_spans("abc\n")] == ["abc"] and [s["text"] for s in S.sentence_spans("abc\ndef")] == ["def"]


def test_dates_by_locale():
    day = dt.date(2026, 9, 22)
    assert {d["value"] for d in S.date_spans("昨天是2026年9月21日", day, "zh-CN")} == {dt.date(2026, 9, 21)}
    assert S.date_spans("01/02/2026", day, "zh-CN")[0]["value"] is None
    assert S.date_spans("01/02/2026", day, "en-US")[0]["value"] == dt.date(2026, 1, 2)
    assert S.date_spans("01/02/2026", day, "en-GB")[0]["value"] == dt.date(2026, 2, 1)
    assert S.date_spans("last Monday", day, "en-US")[0]["value"] == dt.date(2026, 9, 21)
    assert S.date_spans("last Tuesday", day, "en-US")[0]["value"] == dt.date(2026, 9, 15)


@pytest.mark.parametrize("text, want", [("1,234.50", "1234.50"), ("($12)", "-12"), ("-€3", "-3"), ("2 million", "2000000"), ("3万", "30000"), ("12%", "12"), ("1,23", None), ("x", None), ("1" * 29, None), ("0.12345678901", None)])
def test_numbers(text, want):
    got = S.to_number(text)
    assert got == (None if want is None else Decimal(want))


def test_literals():
    got = S.literals("top three of 'A b' over 1,200 in March 2024 since 2024-01-05, 二十五")
    assert got["strings"] == ["A b"] and set(got["numbers"]) >= {Decimal(3), Decimal(1200), Decimal(25)} and got["months"] == [(dt.date(2024, 3, 1), dt.date(2024, 3, 31))]
    assert S.convert("12", "integer") == 12 and S.convert("12.5", "integer") is None and S.convert("2024-02-30", "date") is None
    assert [p["text"] for p in S.passage_spans("a b\n\nc d e", "auto", 2)] == ["a b", "c d", "e"]


def test_stage_checks(spark):
    dag = StageDag()
    a = dag.source(spark.createDataFrame([(1, 2.0, "x")], "id int, v double, s string"), grain="a", keys=[["id"]], identifiers=["id"], name="a")
    b = dag.source(spark.createDataFrame([(1, 3.0)], "k int, w double"), grain="b", name="b")
    with pytest.raises(TermError, match="unique"):
        dag.join(a, b, [("id", "k")], {"w": ("right", "w")})
    with pytest.raises(TermError):
        dag.project(a, {"x": ["add", ["col", "id"], ["lit", 1]]})
    with pytest.raises(TermError):
        dag.filter(a, ["col", "v"])
    with pytest.raises(TermError):
        dag.window(a, "r", ("rank",))
    f = dag.filter(a, ["gt", ["col", "v"], ["lit", 1]])
    assert dag.filter(a, ["gt", ["col", "v"], ["lit", 1]]).name == f.name
    assert dag.stage_guard(dag.aggregate(a, [], {"n": ["count"]}), "n") == 1
    with pytest.raises(TermError, match="reach"):
        run_plan({"target": "x", "stages": [{"name": "x", "operator": "source", "table": "t"}, {"name": "y", "operator": "source", "table": "t"}]}, {"t": a.frame})


def test_programs(spark):
    rows = spark.createDataFrame([(1, "A", 1), (2, "A", 0), (3, "A", 0), (4, "A", 0), (5, "B", 1)], "id int, segment string, success int")
    assert P.conditional_ratio(rows, F.col("success") == 1, F.col("segment") == "A").first().ratio == 25.0
    links = [P.Link("a", "b", (("x", "y"),)), P.Link("b", "c", (("y", "z"),))]
    assert len(P.join_path(links, "a", "c")) == 2
    with pytest.raises(ValueError):
        P.join_path(links, "a", "q")
    q = spark.createDataFrame([(i, float(i)) for i in range(1, 6)] + [(6, None)], "id int, v double").select("id", P.quartile(F.col("v")).alias("q"))
    assert [r.q for r in q.orderBy("id").collect()] == [1, 1, 2, 3, 4, None]
    with pytest.raises(ValueError):
        P.rule("__import__('os')", ["a"])
    assert spark.createDataFrame([(4.0,)], "a double").select(P.rule("sqrt(a) if 1 < a <= 4 else -1", ["a"]).alias("r")).first().r == 2.0


def test_inference_and_coercion(spark):
    assert [C.infer(v) for v in ([True], [1], [1, 2.5], ["2026-09-21"], ["2026-09-21T14:00:00Z"], ["a"], [{"a": 1}], [None])] == ["boolean", "integer", "number", "date", "datetime", "text", "json", "text"]
    with pytest.raises(TypeError):
        C.infer([1, "a"])
    for bad, kind in ((True, "integer"), (1.5, "integer"), (float("nan"), "number"), ("2026-09-21T14:00:00", "datetime"), (1, "text")):
        with pytest.raises((TypeError, ValueError)):
            C.coerce(bad, kind)
    df = C.create(spark, "实验结果", [dict(样本=s, 温度=t) for s, t in (("甲", 20), ("乙", 30))])
    assert df.dtypes == [("样本", "string"), ("温度", "bigint")]


def test_catalog(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    cat = C.Catalog(spark)
    cat.attach("tt", f"{tmp_path}/t")
    assert cat.validate("tt") and spark.sql("select count(*) from tt").first()[0] == 5
    spark.range(5).selectExpr("id", "1 as x").write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert not cat.validate("tt")
    cat.detach("tt")
    with pytest.raises(Exception):
        cat.apply([{"name": "ok", "path": f"{tmp_path}/t"}, {"name": "no", "path": f"{tmp_path}/none"}])
    assert not cat.sources


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;amount;when;ok\n1;2,5;2024-01-01;true\n2;x;2024-02-30;false\n", encoding="utf-8")
    df = csvfile.read(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "amount", "when", "ok"]
    kinds = csvfile.inferred(df)
    assert kinds == {"id": "integer", "amount": "text", "when": "date", "ok": "boolean"}
    assert [tuple(r) for r in csvfile.cell_errors(df, {"amount": "number", "when": "date"}).collect()] == [("amount", "2,5"), ("amount", "x"), ("when", "2024-02-30")]


@pytest.mark.parametrize("text", ["DROP TABLE x", "SELECT 1; SELECT 2", "SELECT reflect('a','b')", "SELECT * FROM a.b", "SELECT x.y('a')", "SELECT ? FROM t", "INSERT INTO t VALUES (1)", "SELECT explode(a) FROM t", "SELECT * FROM t FOR UPDATE"])
def test_guard_refuses(text):
    with pytest.raises(SqlError):
        guard(text)


HIDDEN = [
    r"SELECT '\'', java_method('java.lang.Runtime','getRuntime') AS x, '\''",
    r"SELECT '\\', reflect('java.util.UUID','randomUUID') AS x, '\\'",
    r"SELECT r'\', reflect('java.util.UUID','randomUUID') AS x, r'\'",
    "SELECT 1 /* /* */ ' */, reflect('java.util.UUID','randomUUID') -- '",
    "SELECT 1 -- \\\n, 'x\n, reflect('java.util.UUID','randomUUID')",
    "SELECT /*+ BROADCAST(t) */ 1 FROM t", "SELECT 'open", "SELECT 1 /* open", "SELECT `reflect`('java.util.UUID','randomUUID')",
]


@pytest.mark.parametrize("text", HIDDEN)
def test_nothing_hides_in_quotes_or_comments(spark, text):
    with pytest.raises(SqlError):
        run_sql(spark, text)


def test_quoted_texts_stay_readable(spark):
    got = run_sql(spark, r"SELECT 'it\'s (fine)' AS a, 'two''quotes' AS b, r'\d(' AS c -- reflect('x')").first()
    assert tuple(got) == ("it's (fine)", "twoquotes", "\\d(") or got[0] == "it's (fine)"


def test_partial_results_stop_the_statement(spark):
    from quorvia.evaluators import PythonEvaluator, TableEvaluator

    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, None)], "id int, s string")
    known = Semantics({"d": "CASE WHEN {col} = 'yes' THEN 0.9 ELSE 0.1 END"})
    open_ = Semantics({"d": "CASE WHEN {col} = 'yes' THEN 0.9 ELSE 0.5 END"})
    nested = "SELECT id FROM t WHERE id IN (SELECT id FROM t WHERE SEMANTIC(s, 'd'))"
    assert [r.id for r in run_sql(spark, nested, known, {"t": df}).collect()] == [1]
    with pytest.raises(Exception, match="unresolved semantic"):
        run_sql(spark, nested, open_, {"t": df}).collect()
    plain = "WITH x AS (SELECT id, s FROM t) SELECT id FROM x WHERE SEMANTIC(s, 'd')"
    assert [r.id for r in run_sql(spark, plain, open_, {"t": df}).collect()] == [1]
    # evaluators of other kinds answer before the statement runs
    answers = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id int, p double")
    for e in (TableEvaluator(answers, ["id"], {"d": "p"}), PythonEvaluator(lambda q, cs: [{"p": 0.9 if c["s"] == "yes" else 0.5} for c in cs])):
        by = Semantics(evaluators={"d": e})
        got = run_sql(spark, "SELECT x.*, SEMANTIC(x.s, 'd') AS v FROM t x", by, {"t": df})
        assert got.columns == ["id", "s", "v"] and {r.id: r.v for r in got.collect()} == {1: True, 2: None, 3: None}
        with pytest.raises(Exception, match="unresolved semantic"):
            run_sql(spark, nested, by, {"t": df}).collect()


def test_bundles_fill_in_order(spark):
    sizes = [31_968] * 10 + [8] * 200 + [40_000]
    rows = spark.createDataFrame([("g", i, "x" * n) for i, n in enumerate(sizes)] + [(None, 0, None)], "g string, context_key int, payload string")
    got = bundled(rows, ["g"], Limits(), F.col("payload")).collect()
    by = {}
    for r in got:
        if r.g and r.bundle is not None:
            by.setdefault(r.bundle, []).append((r.context_key, len(r.payload) + 32))
    assert all(len(b) <= 32 and sum(n for _, n in b) <= 64_000 for b in by.values()) and sum(map(len, by.values())) == 210
    order = [k for _, b in sorted(by.items()) for k, _ in sorted(b)]
    assert order == sorted(order) and [r.too_large for r in got if r.context_key == 210] == [True]


def test_verify_refuses_too_large_a_bundle(spark):
    claims = spark.createDataFrame([(1,), (2,), (3,)], "c int")
    evidence = spark.createDataFrame([(1, f"e{i}") for i in range(5)] + [(2, "yes")], "k int, t string")
    e = ColumnEvaluator({"supports": lambda q: F.when(F.array_contains("evidence", "yes"), 0.9).otherwise(0.1), "opposes": lambda q: F.lit(0.1)})
    got = {r.c: r for r in check.verify(claims, evidence, "supports", "opposes", e, claim_id="c", evidence_claim="k", text_col="t", max_evidence=4).collect()}
    assert got[1].n_evidence == 5 and got[1].support.operation_state == got[1].opposition.operation_state == "BLOCKED_BY_POLICY"
    assert got[1].stance.output_state == "NOT_EVALUATED" and got[2].stance.value_text == "support" and got[3].n_evidence == 0


def test_verify_judges_bundles_of_any_size(spark):
    claims = spark.createDataFrame([(1,), (2,)], "c int")
    evidence = spark.createDataFrame([(1, f"e{i:03}") for i in range(99)] + [(1, "yes")], "k int, t string")
    e = ColumnEvaluator({"supports": lambda q: F.when(F.array_contains("evidence", "yes"), 0.9).otherwise(0.1), "opposes": lambda q: F.lit(0.1)})
    got = {r.c: r for r in check.verify(claims, evidence, "supports", "opposes", e, claim_id="c", evidence_claim="k", text_col="t", max_evidence=None).collect()}
    assert got[1].n_evidence == 100 and got[1].evidence == [f"e{i:03}" for i in range(99)] + ["yes"] and got[1].stance.value_text == "support"
    assert got[2].n_evidence == 0 and got[2].stance.value_text == "insufficient"


@pytest.mark.parametrize("bucket_rows", (100_000, 7))
def test_budgets_are_reserved_in_order(spark, bucket_rows):
    rows = spark.createDataFrame([(i, i % 3 or None, 1) for i in range(40)], "id int, g int, cost int")
    got = control.budget_states(rows, cost="cost", limit=5, order_by=["id"], bucket_rows=bucket_rows)
    assert sorted(r.id for r in got.where("operation_state = 'SUCCEEDED'").collect()) == [0, 1, 2, 3, 4]
    got = control.budget_states(rows, cost="cost", limit=15, order_by=["g", "id"], bucket_rows=bucket_rows)
    assert sorted(r.id for r in got.where("operation_state = 'SUCCEEDED'").collect()) == [0, 1, *range(3, 40, 3)]


@pytest.mark.parametrize(
    "text, want",
    [("-5 units", [-5]), ("5 million", [5_000_000]), ("(7)", [-7]), ("共3万人", [30_000]), ("3.5e4 and -1.20e3", [35_000, -1200]), ("2.5万", [25_000]), ("range 3-5", [3, 5]), ("A5 v1.2.3", []), ("USD 20 or €3.5k", [20, 3500]), ("(5 units) +7", [5, 7])],
)
def test_literal_numbers_whole(text, want):
    assert [S.to_number(s["text"]) for s in S.scalar_spans(text)] == want
    assert all(text[s["start"] : s["end"]] == s["text"] for s in S.scalar_spans(text))


def test_long_numbers_are_exact():
    from decimal import Decimal

    assert S.to_number("1234567890123456789012345678.5") is None or S.to_number("1234567890123456789012345678.5") == Decimal("1234567890123456789012345678.5")
    assert S.to_number("123456789012345678901.0123456789") == Decimal("123456789012345678901.0123456789") and S.to_number("1e400") is None


def test_sql_rules(spark):
    guard("SELECT count(*) FROM t WHERE a IN ('drop table', ';')")
    with pytest.raises(SqlError):
        check_partial("SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b) AND SEMANTIC(x, 'y')", complete=False)
    with pytest.raises(SqlError, match="outer join"):
        prepare("SELECT 1 FROM a x LEFT JOIN b y ON x.i = y.i WHERE SEMANTIC(y.t, 'd')", Semantics({"d": "0.5"}))
    assert translate_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    df = spark.createDataFrame([(1, "a-b"), (2, None)], "id int, s string")
    got = run_sql(spark, "SELECT id, concat(s, 'x') AS c, SEMANTIC(s, 'd') AS v FROM t WHERE id = ANY (SELECT id FROM t)", Semantics({"d": "CASE WHEN {col} = 'a-b' THEN 0.9 ELSE 0.1 END"}), {"t": df}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a-bx", True), (2, "x", None)]


def test_changes_are_reviewed(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id int, v int")
    seen = preview_change(df, ["id"], F.col("id") == 1, {"v": F.lit(9)})
    new = commit_change(df, ["id"], seen, f"{tmp_path}/a")
    assert sorted(map(tuple, new.collect())) == [(1, 9), (2, 6)]
    with pytest.raises(SqlError, match="changed"):
        commit_change(new, ["id"], seen, f"{tmp_path}/b")
    gone = commit_change(df, ["id"], preview_change(df, ["id"], F.col("id") == 2, None), f"{tmp_path}/c")
    assert [tuple(r) for r in gone.collect()] == [(1, 5)]
    with pytest.raises(SqlError):
        insert_rows(df, df, ["id"], f"{tmp_path}/d")


def test_manage(spark, tmp_path):
    df = spark.createDataFrame([(1, "yes"), (2, "no")], "id int, t string")
    out = manage.materialize(df, "yes", TEXT, f"{tmp_path}/m")
    assert out["status"] == "PUBLISHED" and out["rows"] == 2
    assert manage.materialize(df.union(spark.createDataFrame([(3, "maybe")], df.schema)), "yes", TEXT, f"{tmp_path}/m")["status"] == "PARTIAL"
    with pytest.raises(ValueError):
        manage.promote(spark.createDataFrame([("d", "PROVISIONAL", "x")], "definition_id string, status string, owner string"), "d", owner="o", holdout_accuracy=0.1)
    near = manage.nearest_by_tokens(spark.createDataFrame([(1, "red apple")], "id int, text string"), spark.createDataFrame([("f1", "red apple pie"), ("f2", "blue")], "fingerprint string, text string"), id_col="id", text_col="text")
    assert near.first().fingerprint == "f1"
    assert control.estimate(20_000, 100, tokens_limit=10)["warnings"] == ["W02", "W03"] and control.admit_expansion(10_000) == "BLOCKED_BY_REVIEW"


def test_streams(spark, tmp_path):
    from quorvia.streaming import judge_batches, judge_stream, on_change

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "yes"), (2, "no")], "id int, t string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, t string").parquet(f"{tmp_path}/in")
    q = judge_stream(stream, {"x": proposition("yes")}, TEXT).writeStream.format("memory").queryName("judged").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from judged where x.value_bool").first()[0] == 1
    e = PythonEvaluator(_counting())
    for n in range(2):
        w = judge_batches(stream, proposition("q"), e, context=["t"], observations=f"{tmp_path}/obs", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp").trigger(availableNow=True).start()
        w.awaitTermination(120)
        if n == 0:
            spark.createDataFrame([(3, "yes")], "id int, t string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/obs").count() == 2  # the third row reused an answer
    assert spark.read.parquet(f"{tmp_path}/out").where("decision.value_bool").count() == 2
    calls = []
    seen = on_change(lambda: spark.range(3), lambda: calls.append(1), None)
    assert on_change(lambda: spark.range(3), lambda: calls.append(1), seen) == seen and len(calls) == 1


def test_trace_stream(spark, tmp_path):
    from quorvia.streaming import trace_stream

    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at, "go"), (1, at + dt.timedelta(seconds=5), "stop"), (2, at, "go")], "e int, ts timestamp, ev string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("e int, ts timestamp, ev string").parquet(f"{tmp_path}/in")
    q = trace_stream(stream, {("idle", "go"): "run", ("run", "stop"): "idle"}, "idle", entity="e", time_col="ts", event_col="ev").writeStream.outputMode("update").format("memory").queryName("traced").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r.e: (r.state, r.n_events) for r in spark.sql("select * from traced").collect()} == {1: ("idle", 2), 2: ("run", 1)}


def test_jobs(spark):
    import time

    from quorvia.jobs import Approvals, Jobs

    jobs = Jobs(spark)
    one = jobs.submit("a", lambda s: s.range(10).count())
    assert jobs.submit("a", lambda s: 1) == one and jobs.result("a", 60) == 10
    jobs.submit("b", lambda s: s.range(1 << 40).selectExpr("sum(hash(id))").collect())
    time.sleep(2)
    jobs.cancel("b")
    with pytest.raises(RuntimeError, match="CANCELLED"):
        jobs.result("b", 60)
    began = time.time()
    assert spark.range(1000).selectExpr("sum(id)").first()[0] == 499500 and time.time() - began < 30  # the cores are free again
    a, plan = Approvals(), Approvals.plan_hash("JOIN", {"x": 1})
    assert not a.valid(plan)
    a.grant(plan)
    assert a.valid(plan) and not a.valid(Approvals.plan_hash("JOIN", {"x": 2}))
    a.grant(plan, -1)
    assert not a.valid(plan)


def test_assignment_and_beams():
    import itertools
    import random

    from quorvia.plans.search import assignment, best_sequences

    r = random.Random(0)
    for _ in range(30):
        m, n = sorted((r.randint(1, 5), r.randint(1, 6)))
        s = [[r.random() for _ in range(n)] for _ in range(m)]
        best = max(sum(s[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(n), m))
        got = assignment(s)
        assert len(set(got)) == m and abs(sum(s[i][c] for i, c in enumerate(got)) - best) < 1e-9
    assert best_sequences([[("a", 1.0), ("b", 0.9)], [("a", 1.0), ("b", 0.5)]], 2) == [(1.9, ("b", "a")), (1.5, ("a", "b"))]


def test_rate_gate(monkeypatch):
    import time

    slept = []
    monkeypatch.setattr(time, "sleep", slept.append)
    e = PythonEvaluator(_counting(), batch=1, per_minute=2)
    assert len(e.answer({}, ['{"t": "yes"}'] * 3)) == 3 and len(slept) == 1 and 50 < slept[0] <= 60


def test_discover_walks_past_a_large_copy_group(spark):
    import hashlib
    import re

    made = [f"topic{i} of record{i * 7} at place{i % 50}" for i in range(300)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = min(made, key=sha)
    near = [f"{' '.join(f'word{k}' for k in range(30))} end{i}" for i in range(400)]
    texts = [first] * 500 + near + made + [None, ""]
    rows = list(enumerate(texts))
    for exemplars in (10, 400):
        want = []
        for i, t in sorted(((i, t) for i, t in rows if t), key=lambda x: (sha(x[1]), x[0])):
            mine = set(re.findall(r"\w+", t.lower()))
            if mine and all(len(mine & o) <= 0.8 * len(mine | o) for _, o in want):
                want.append((i, mine))
        got = manage.discover(spark.createDataFrame(rows, "id int, text string"), [], "topic", None, id_col="id", text_col="text", exemplars=exemplars)
        assert [r.id for r in got.collect()] == [i for i, _ in want[:exemplars]] and len(want) == 301


def test_extract_table_keeps_long_records_whole_and_tells_of_truncation(spark):
    e = ColumnEvaluator({"record": F.lit(0.9), "field:n": F.lit(0.9)})
    long = " ".join(f"word{'x' * (i % 3)}" for i in range(500)) + " costs 17"
    docs = spark.createDataFrame([(1, long), (2, "\n".join(f"costs {i}" for i in range(5))), (3, "costs 1\ncosts 2")], "id int, text string")
    got = extract.extract_table(docs.where("id = 1"), {"n": {"type": "integer"}}, e, id_col="id", text_col="text", record_mode="document").collect()
    assert [(r.n, r.passage) for r in got] == [(17, long)]
    rows = extract.extract_table(docs.where("id > 1"), {"n": {"type": "integer"}}, e, id_col="id", text_col="text", max_rows=3)
    assert sorted((r.id, r.n, r.truncated) for r in rows.collect()) == [(2, 0, True), (2, 1, True), (2, 2, True), (3, 1, False), (3, 2, False)]
    assert not extract.table_is_complete(rows).first().complete and extract.table_is_complete(rows.where("id = 3")).first().complete
