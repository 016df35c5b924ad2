"""Cases that a shortened job would get wrong."""

import datetime as dt

import duckdb

import __spark_entry__ as entry
from nightjar.operators import match, taste
from nightjar.plans import queries
from tests.test_recommend import INDEX, event, run

D = "/root/testdata/sf0.001"


def test_misspelt_similar_name(spark):
    index = [("communions", [], [("Iceage", 0.5), ("Trentemollerr", 0.9)])]
    picks, _ = run(spark, ["Trentemoller"], [event(0, "Communions", dt.date(2026, 9, 1))], index)
    assert [(p["title"], p["kind"], p["via"]) for p in picks] == [("Communions", "similar", "Trentemoller")]


def test_one_hop_order(spark):
    """The exact key of a listener goes before the one-edit fallback; of equal strengths the first place wins."""
    plays = [("a", "Trentemoller", 9.0, 0), ("b", "Trentemollerr", 9.0, 0), ("b", "Trentemoller", 4.0, 1), ("c", "Iceages", 9.0, 0), ("d", "Trentemoller", 9.0, 0), ("d", "Choir of Young", 9.0, 1)]
    keys = taste.taste_keys(taste.weights(spark.createDataFrame(plays, "user_id string, name string, plays double, rank int")))
    index = spark.createDataFrame([("lower", [], [("Trentemollerr", 0.9), ("Choir of Young", 0.9), ("Iceage", 1.0)])], INDEX)
    got = match.one_hop(spark.createDataFrame([("Lower",)], "artist string"), index, keys, "artist")
    assert {r["user_id"]: (r["via"], r["similarity"], round(r["strength"], 6)) for r in got.collect()} == {"a": ("Trentemoller", 0.9, 0.558), "b": ("Trentemollerr", 0.9, 0.558), "d": ("Trentemoller", 0.9, 0.558)}


def test_similar_scores_over_all_rows(spark):
    """The largest quantity counts wherever it lies; the first 60 rows are kept."""
    rows = duckdb.sql(f"SELECT l_suppkey, list(l_quantity ORDER BY l_orderkey, l_linenumber) FROM '{D}/lineitem.parquet' GROUP BY 1").fetchall()
    want = {k: (len(q[:60]), round(sum(min(1, max(0.25, x / max(1, *q))) for x in q[:60]), 6)) for k, q in rows}
    got = {r["l_suppkey"]: (r["n"], r["total"]) for r in entry.queries()["similar_scores"](spark, D).collect()}
    assert got == want


def test_similar_scores_null_places(spark, tmp_path):
    """As in the SQL, line items without an order or a line go last; no two of a supplier tie."""
    rows = """SELECT 1 AS l_suppkey, CASE WHEN i > 20 THEN i END AS l_orderkey, i AS l_linenumber, i AS l_partkey, 1e0 + i % 50 AS l_quantity FROM range(140) t(i)
        UNION ALL SELECT 2, i // 2, CASE WHEN i % 2 = 1 THEN 1 END, i, 1e0 + i % 50 FROM range(21, 140) t(i)"""
    con = duckdb.connect()
    con.sql(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = {k: (n, total) for k, n, total in con.sql(entry.oracle_sql()["similar_scores"]).fetchall()}
    got = {r["l_suppkey"]: (r["n"], r["total"]) for r in entry.queries()["similar_scores"](spark, str(tmp_path)).collect()}
    assert got == want


def test_similar_one_hop_all_nations(spark):
    """All nations of a brand are its similar artists (at this size every listener holds all of them, so no name needs the fallback)."""
    d = D.replace("sf0.001", "sf0.1")
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sold = con.sql("SELECT p_brand, s_nationkey, sum(l_quantity) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2").fetchall()
    held = {(u, n): plays for u, n, plays in con.sql("SELECT c_mktsegment, c_nationkey, sum(c_acctbal) FROM customer GROUP BY 1, 2 HAVING sum(c_acctbal) > 0").fetchall()}
    users = {u for u, _ in held}
    assert len(held) == 25 * len(users)
    top = {u: max(p for (x, _), p in held.items() if x == u) for u in users}
    want = {}
    for brand, n, q in sold:
        for u in users:
            strength = max(0.05, (held[u, n] / top[u]) ** 0.5) * min(1, q / 10_000) * 0.62
            want[u, brand] = max(want.get((u, brand), 0), strength)
    got = {(r["user_id"], r["brand"]): r["strength"] for r in entry.queries()["similar_one_hop"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items())


def test_flagship_all_pairs(spark):
    """Every supplier that sells an artist is a room with a show of it."""
    _, events, _ = queries._flagship_tables(spark, D)
    ((want,),) = duckdb.sql(f"SELECT count(DISTINCT (p_name || ' ' || p_brand, l_suppkey)) FROM '{D}/lineitem.parquet' JOIN '{D}/part.parquet' ON l_partkey = p_partkey").fetchall()
    got = events.select("title", "venue_id").collect()
    assert len(got) == len(set(got)) == want
