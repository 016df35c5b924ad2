"""Steps whose cost must not grow beyond their input: what is computed once, and where rows meet."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from nightjar.functions import text
from nightjar.operators import corpus, rules, vectors
from nightjar.plans import build, queries, recommend as rec
from nightjar.sources import structured
from tests.test_recommend import EVENT, event, run

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["hydration_roundtrip", "jsonld_repair_roundtrip", "jsonld_roundtrip"])
def test_pages_of_a_small_file_are_made_on_all_cores(spark, name):
    """Narrow rows are dealt before pages are made of them, and no filter brings the making back before that."""
    told = plan(queries.QUERIES[name](spark, D))
    assert "RepartitionByExpression" in told
    before = told[told.index("RepartitionByExpression") :]
    assert "script" not in before and "to_json" not in before


def test_payload_members_are_parsed_once(spark):
    told = plan(queries.QUERIES["hydration_roundtrip"](spark, D))
    assert told.count("get_json_object(node") + told.count("from_json(") < 60


def test_folding_is_the_plain_rule(spark):
    """Letters that are left out before the lower case fold as by the plain rule; lower() sees ASCII only, which is fast."""
    texts = ["a  b", " x&y+z ", "`q\u00b4 r", "Åse Ærø ßtraße", "e\u0301\u0308", "ǻǽ ệ Ǿ", "tab\t\n. . end..", "naïve — Ünï 漢", "İI \u212a \u212bx", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(text.fold_name(F.col("t"))).collect()]

    def rule(x):
        x = "".join(text._PLAIN[text._ACCENTED.index(c)] if c in text._ACCENTED else c for c in x or "")
        x = "".join(c for c in x if not 0x300 <= ord(c) <= 0x36F)
        for a, b in zip("øØæÆß`\u00b4", ("o", "o", "ae", "ae", "ss", "'", "'"), strict=True):
            x = x.replace(a, b)
        x = x.lower().replace("&", " and ").replace("+", " and ")
        return re.sub(" +", " ", re.sub("[^a-z0-9' ]+", " ", x)).strip(" ")

    assert got == [rule(x) for x in texts]
    told = plan(spark.range(1).select(text.fold_name(F.col("id").cast("string"))))
    assert "ELSE regexp_replace" in told and "[^\\x00-\\x7f]+" in told


def test_robots_lines_in_blocks(spark):
    """Groups are the same whatever the blocks, and equal rules of a host are one."""
    file = "User-agent: a\nUser-agent: *\nDisallow: /x\nUser-agent: nightjar\n\nUser-agent: b\nDisallow: /y\nAllow: /y\nUser-agent: *\nDisallow: /z"
    lines = spark.createDataFrame([(h, i, raw) for h in "pq" for i, raw in enumerate(file.split("\n")) if h == "p" or i < 4], "host string, line int, raw string")
    found = lambda n: sorted(tuple(r) for r in rules.robots_rules(lines, block_lines=n).collect())
    want = found(1000)
    assert [r[0] + r[3] for r in want] == ["p/y", "p/y"] and found(1) == want == found(2) == found(3)
    paths = spark.createDataFrame([(1, "p", "/y1"), (2, "p", "/z")], "k int, host string, path string")
    many = spark.createDataFrame([("p", i, i % 2 == 1, "/y*1") for i in range(50)], "host string, line int, allow boolean, path string")
    assert {r["k"]: r["allowed"] for r in rules.robots_allowed(paths, many, "k").collect()} == {1: False, 2: True}


def test_equal_lists_are_compared_once(spark):
    """Users with one list are a class: their number doesn't grow what is compared."""
    rows = [(u, i) for u in range(60) for i in ("abcd" if u % 3 else "abce")]
    out = rec.similar_lists(spark.createDataFrame(rows, "user_id int, event_id string"), 0.75)
    got = {(r["a"], r["b"]): r["overlap"] for r in out.collect()}
    assert len(got) == 60 * 59 // 2 and all(got[a, b] == (1.0 if (a % 3 == 0) == (b % 3 == 0) else 0.75) for a, b in got)


@pytest.mark.parametrize("block", [7, 40, 8192])
@pytest.mark.parametrize("items", [20, 150])
def test_lists_of_few_items_are_compared_as_bits(spark, monkeypatch, items, block):
    """Lists of few items meet nearly all of each other by any head: no pair is brought together by a join, and blocks of any size give the same pairs."""
    monkeypatch.setattr(rec, "LIST_BLOCK", block)
    monkeypatch.setattr(rec, "JUDGED", 100)
    monkeypatch.setattr(rec, "LEAVE", 30)
    rng = random.Random(items)
    lists = {f"u{u}": set(rng.sample(range(items), rng.randint(1, 12) if u % 3 else items // 2)) for u in range(50)}
    rows = spark.createDataFrame([(u, i) for u, s in lists.items() for i in s], "user_id string, event_id int")
    out = rec.similar_lists(rows, 0.6)
    told = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in told and "array_intersect" not in told
    want = {(a, b): v for a in lists for b in lists if a < b and (v := len(lists[a] & lists[b]) / min(len(lists[a]), len(lists[b]))) >= 0.6}
    assert {(r["a"], r["b"]): r["overlap"] for r in out.collect()} == want and len(want) > 50
    monkeypatch.setattr(rec, "MOST_WORDS", 0)
    assert {(r["a"], r["b"]): r["overlap"] for r in rec.similar_lists(rows, 0.6).collect()} == want


def test_pairs_meet_without_a_shuffle(spark):
    """Blocks of vectors meet by reading them, whatever partitions their rows come from, and vectors that are dealt by their ids aren't dealt anew."""
    rng = random.Random(3)
    rows = [(f"v{i}", t, float(rng.random()), i % 3) for i in range(40) for t in rng.sample(range(30), 8)] + [("big", t, 1.0, 0) for t in range(30)]
    rng.shuffle(rows)
    left = vectors.unit(spark.createDataFrame(rows, "a string, tag int, w double, k int").repartition("a"), ["a", "k"])
    right = left.withColumnsRenamed({"a": "b", "k": "m"}).repartition(7)
    found = lambda **k: {(r["a"], r["b"]): round(r["cosine"], 9) for r in vectors.pairs_above(left, right, ["a", "k"], ["b", "m"], 0.4, **k).collect()}
    weight = {}
    for r in left.collect():
        weight.setdefault(r["a"], {})[r["tag"]] = r["w"]
    want = {(a, b): v for a in weight for b in weight if (v := round(sum(w * weight[b].get(t, 0) for t, w in weight[a].items()), 9)) > 0.4}
    assert found() == want == found(block_rows=1) == found(block_rows=50, at_once=60) and 41 < len(want) < 41 * 41
    told = vectors.pairs_above(left, right, ["a", "k"], ["b", "m"], 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in told and "CoGroup" not in told


@pytest.mark.parametrize("made", [lambda p: structured.json_ld_events(p, "k"), lambda p: structured.hydration_events(p, "k")])
def test_events_of_a_page_are_told_apart_without_a_shuffle(spark, made):
    """Of equal events the first in the page stays, also over blocks and batches; equal events of two pages are two."""
    node = lambda n, **x: {"@type": "Event", "name": n, "startDate": "2026-01-01", **x}
    show = lambda n, **x: {"title": n, "date": "2026-01-01", "venue": "V", "price": 2, **x}
    ld = lambda *b: "".join(f'<script type="application/ld+json">{json.dumps(x)}</script>' for x in b)
    payload = lambda *b: f'<script id="__NEXT_DATA__">{json.dumps({"shows": b})}</script>'
    pages = []
    for k in range(30):
        pages.append((k, ld([node("Act A", image="1"), node("Act B")], node("Act A"), [node("Act C"), node("Act B", image="2")]) + payload(show("Act A", slug="1"), show("Act B"), show("Act A"), show("Act C"), show("Act B", slug="2"))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        out = made(spark.createDataFrame(pages, "k int, html string").repartition(3))
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    title = "name" if "name" in out.columns else "title"
    assert sorted((r["k"], r[title]) for r in rows) == [(k, x) for k in range(30) for x in ("Act A", "Act B", "Act C")]
    first = {r[title]: (r["seq"], '"1"' in r["node"] if title == "name" else r["slug"]) for r in rows}
    assert first["Act A"][1] in (True, "1") and first["Act B"][1] in (False, None) and first["Act A"][0] < first["Act B"][0] < first["Act C"][0]


def test_pages_are_dealt_to_folders_unsorted_and_meet_small_sources(spark, monkeypatch):
    """Bodies are neither sorted for their folders nor shuffled to meet the table of sources; rows that go are written without their event."""
    told, sizes, real = [], [], corpus.cut

    def seen(df, *by, **k):
        told.append((by, df._jdf.queryExecution().optimizedPlan().toString()))
        out = real(df, *by, **k)
        sizes.append((out.columns, out))
        return out

    monkeypatch.setattr(corpus, "cut", seen)
    pages, registry = queries._build_tables(spark, D)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    events, meta = build.build_corpus(pages, registry, queries.TODAY)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    (plan_of_pages,) = (p for by, p in told if by)
    joins = [x for x in plan_of_pages.split("\n") if "Join" in x and "source_id" in x]
    assert joins and all("rightHint=(strategy=broadcast)" in x for x in joins)
    (ruled,) = (df for columns, df in sizes if "dropped" in columns)
    assert ruled.filter("reason IS NOT NULL OR dropped IS NOT NULL").count() > ruled.filter("event IS NOT NULL").count() > 0
    assert ruled.filter("(reason IS NULL AND dropped IS NULL) != (event IS NOT NULL)").count() == 0
    total = meta.agg(F.sum("kept"), F.sum(F.col("raw") + F.col("rejected"))).first()
    assert (events.count(), ruled.count()) == tuple(total)


def test_folders_are_written_without_a_sort(spark, monkeypatch):
    """Folders are written side by side, with the session's setting as it was before and after."""
    key, held = "spark.sql.maxConcurrentOutputFileWriters", []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (held.append(spark.conf.get(key)), real(self, *a, **k))[1])
    rows = spark.range(1000).selectExpr("id", "CAST(id % 3 AS string) AS k").repartition(2)
    before = spark.conf.get(key)
    files = corpus.cut(rows, "k")
    corpus.cut(rows)
    assert int(held[0]) > 3 and held[1] == before == spark.conf.get(key)
    assert {r["k"]: r["n"] for r in files.groupBy("k").agg(F.countDistinct("id").alias("n")).collect()} == {"0": 334, "1": 333, "2": 333}
    assert all(p.endswith(".zstd.parquet") for p in files.inputFiles())


def test_posts_that_are_not_looked_up_meet_no_page_and_no_task(spark):
    """A post without a link to look up is dealt by its own key."""
    posts = spark.createDataFrame([(i, json.dumps({"title": f"Act {i}", "event_date": "2026-09-01", "ticket_url": "https://t/1", "link": f"https://p/{i}"})) for i in range(40)], "k int, j string")
    linked = spark.createDataFrame([("https://p/1", "<p>x</p>")], "link string, page string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = structured.wordpress_events(posts, "k", "j", dt.date(2026, 1, 1), linked)
        assert "alone" in [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in x][-1]
        assert {r["k"] for r in out.filter("reason IS NULL AND ticket_url = 'https://t/1'").collect()} == set(range(40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_table_of_all_events_is_written(spark, monkeypatch):
    """Events leave their one pass as groups: dates of a bill in rooms of one size, and a row for each reason."""
    sizes, real = [], rec.cut

    def counted(df, *by, **k):
        out = real(df, *by, **k)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(rec, "cut", counted)
    events = [event(i, "Iceage", dt.date(2026, 9, 1) + dt.timedelta(days=i % 50)) for i in range(300)] + [event(i, "Iceage", dt.date(2025, 9, 1)) for i in range(300, 400)]
    picks, (d,) = run(spark, ["Iceage"], events)
    assert [p["event_id"] for p in picks] == ["e0"] and (d["corpus_size"], d["events_considered"], d["filtered_past"], d["events_scored"]) == (400, 300, 100, 300)
    assert max(sizes) < 10


@pytest.mark.parametrize("tributes", [False, True])
def test_groups_are_those_of_each_event(spark, tributes):
    """Groups of titles give what judging each event gives, also without artists, title or room, and where titles of one bill are judged apart."""
    day, rows = dt.date(2026, 9, 1), []
    acts = [(["A"], "A"), (["A"], "A Tribute"), (["A"], "B"), (None, "A"), ([], "A"), ([], None), (None, None), ([None], None), (["A", "B"], "A"), (["A"], None), ([], "A Tribute")]
    for i in range(220):
        artists, title = acts[i % len(acts)]
        when = None if i % 13 == 0 else day if i % 7 else dt.date(2025, 1, 1)
        rows.append((f"e{i}", title, artists, when, "cancelled" if i % 17 == 0 else None, f"v{i}", "V", "DK", "X", ("club", None)[i % 2], (None, False, True)[i % 3], f"{i * 37 % 220:04d}"))
    want = {}
    for r in rows:
        reason = "past" if r[3] is None or r[3] < day else "cancelled" if r[4] else "tribute" if not tributes and (r[10] or "Tribute" in (r[1] or "")) else None
        key = (reason, *((None,) * 3 if reason else (tuple(r[2] or ()), None if r[2] else r[1], r[9])))
        want.setdefault(key, []).append((r[11], r[0], r[1]))
    out = rec.grouped_events(spark.createDataFrame(rows, EVENT), rec.RecommendOptions(from_date="2026-09-01", include_tributes=tributes)).collect()
    got = {(g["reason"], None if g["artists"] is None else tuple(g["artists"]), g["alone"], g["size_class"]): (g["n"], None if g["reason"] else (g["first"]["ord"], g["first"]["event_id"], g["first"]["title"])) for g in out}
    assert len(out) == len(want) > 10 and got == {k: (len(v), None if k[0] else min(v)) for k, v in want.items()}
