"""Every registered query of the core against its SQL twin in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quorvia import queries as Q

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.7g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in Q.SQL:
        assert df.columns
        return
    got = duck.execute(Q.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted("|".join(norm(r[c]) for c in sorted(names)) for r in rows)
    theirs = sorted("|".join(norm(x) for _, x in sorted(zip(names, r), key=lambda p: p[0])) for r in got.fetchall())
    assert mine == theirs


def test_every_query_has_a_twin_but_a_few():
    assert set(Q.QUERIES) - set(Q.SQL) <= {"align_whole", "verify_whole", "extract_table_whole", "embedding_distance_any_basis_whole"}
    assert set(Q.SQL) <= set(Q.QUERIES)


def test_whole_table_queries_reach_the_last_rows(spark):
    t = Q.Tables(spark, FOLDER)
    last = t.orders.agg({"o_orderkey": "max"}).first()[0]
    keys = {r[0] for r in Q.QUERIES["extract_table_whole"](spark, FOLDER).select("o_orderkey").collect()}
    assert len(keys) == t.orders.count() and last in keys and last >= 500
    assert Q.QUERIES["align_whole"](spark, FOLDER).select("c_custkey").distinct().count() == t.customer.where(Q.col("c_nationkey").isin([r[0] for r in t.supplier.select("s_nationkey").collect()])).count()
    assert Q.QUERIES["verify_whole"](spark, FOLDER).agg({"n_evidence": "sum"}).first()[0] == t.customer.count()
    assert Q.QUERIES["embedding_distance_any_basis_whole"](spark, FOLDER).agg({"o_orderkey": "max"}).first()[0] == last - 1


def test_verify_whole_judges_large_bundles(spark, tmp_path):
    sizes = {1: 0, 2: 9, 3: 10, 4: 64, 5: 65, 6: 700, 7: 1}
    rows = [(k, f"c{k}_{i:03}" if k != 7 else None) for k, n in sizes.items() for i in range(n)]
    spark.createDataFrame([(k,) for k in sizes], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "c_custkey int, c_nationkey int, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = Q.QUERIES["verify_whole"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(Q.SQL["verify_whole"]).fetchall())
    assert "collect_list" not in got.where("n_evidence > 64")._jdf.queryExecution().executedPlan().toString()


def test_preview_update_takes_any_number_of_rows(spark, tmp_path):
    spark.range(5000).selectExpr("id as s_suppkey", "cast(id % 2000 as double) as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got = Q.QUERIES["preview_update"](spark, str(tmp_path)).collect()
    assert sorted((r.s_suppkey, r.was, r.will) for r in got) == [(i, float(i % 2000), 2.0 * (i % 2000)) for i in range(5000) if i % 2000 < 1000]
    with pytest.raises(Exception, match="more than 1000 rows"):
        Q.preview_change(Q.Tables(spark, str(tmp_path)).supplier, ["s_suppkey"], Q.col("s_acctbal") < 1000, None)


@pytest.mark.parametrize("name", ["join_exact_keys", "align_whole"])
def test_keyed_pairs_are_spread_over_tasks(spark, tmp_path, monkeypatch, name):
    """One key with most of the pairs, null keys, keys of one side only, equal balances."""
    monkeypatch.setattr(Q.connect.candidate_pairs, "__kwdefaults__", Q.connect.candidate_pairs.__kwdefaults__ | {"task_pairs": 1000})
    nation = lambda i, n: None if i % 50 == 0 else 1 if i % 3 else i % n
    spark.createDataFrame([(i, f"c{i}", nation(i, 7), i * 37 % 11000 - 1000.0) for i in range(400)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, nation(i, 9), None if i == 5 else i * 111 % 11000 - 1000.0) for i in range(90)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = Q.QUERIES[name](spark, str(tmp_path))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.SQL[name]} AND s_acctbal IS NOT NULL)").fetchall()
    assert order(r for r in got.where("right_id <> 5" if name == "join_exact_keys" else "s_suppkey <> 5").collect()) == order(want)
    assert "_l_cell" in got._jdf.queryExecution().optimizedPlan().toString()


def test_request_packing_goes_on_across_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q.bundled, "__kwdefaults__", {"range_rows": 60})
    spark.range(3000).selectExpr("id * 7 % 3001 as o_orderkey", "if(id < 20, 'few' || id % 4, if(id < 900, 'b', 'a')) as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = Q.QUERIES["request_packing"](spark, str(tmp_path))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.SQL['request_packing']})").fetchall())
    assert got.rdd.getNumPartitions() > 8


def test_distances_of_any_basis_in_many_tasks(spark):
    rows = Q.M.embed(Q.Tables(spark, FOLDER).orders, Q.BASIS, Q.BOTH).select("o_orderkey", Q.M.compact(Q.col("matrix"), Q.col("matrix_basis")).alias("m"))
    nxt = rows.select((Q.col("o_orderkey") - 1).alias("o_orderkey"), "m")
    few, many = (Q.M.keyed_distances(rows, nxt, "o_orderkey", "m", task_rows=n) for n in (10**9, 100))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.rdd.getNumPartitions() > 8
    assert "answers" not in many._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    other = nxt.withColumn("m", Q.col("m").withField("basis", Q.lit(b"x")))
    gap = nxt.withColumn("m", Q.col("m").withField("cells", Q.lit(None).cast("array<double>")))
    for wrong, text in ((other, "different bases"), (gap, "isn't complete")):
        with pytest.raises(Exception, match=text):
            Q.M.keyed_distances(rows, wrong, "o_orderkey", "m").collect()


def test_extract_table_cuts_out_passages_once(spark):
    got = Q.QUERIES["extract_table_whole"](spark, FOLDER)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1
