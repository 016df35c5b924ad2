"""Batch logs, running sums, sitemap walks, polite schedules and robots rules against plain versions."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from nightjar.operators import log, rules, taste
from nightjar.sources import schedule, sitemaps
from nightjar.streaming import decay


def day(text="2024-02-01"):
    return F.lit(text).cast("timestamp")


def keyed(spark, path):
    return log.BatchLog(spark, str(path), "k long, v long, t string", log.latest(["k"], "v"))


def test_log_reads_what_was_committed(spark, tmp_path):
    c = keyed(spark, tmp_path / "c")
    assert c.read().collect() == [] and not c.committed("a")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long, t string")
    assert c.add(rows((1, 1, "a"), (None, 5, "n"), (2, 1, None)), "a")
    assert not c.add(rows((1, 9, "again")), "a")
    c.write(rows((1, 10, "lost")))  # cut before its commit
    c.add(rows((1, 1, "b"), (2, 0, "older")))
    want = {(1, 1, "b"), (None, 5, "n"), (2, 1, None)}  # of equal versions the later batch
    assert {tuple(r) for r in c.read().collect()} == want
    c.compact()
    again = keyed(spark, tmp_path / "c")
    assert {tuple(r) for r in again.read().collect()} == want and len(again._live()) == 1 and again.committed("a")
    again.add(rows())
    assert {tuple(r) for r in again.read().collect()} == want


def test_enrichment_takes_the_most_billed_first_and_resumes(spark, tmp_path):
    bills = spark.createDataFrame([("Ann", 5), ("ANN", 7), ("Bo", 9), ("Cy", 1), ("Di", 1), ("--", 50)], "name string, n long")
    asked = []

    def look_up(todo):
        asked.append([r["name"] for r in todo.collect()])
        return todo.filter("key <> 'cy'").select("key", F.upper("name").alias("mbid"), F.lit("DK").alias("country"), F.lit(None).cast("array<struct<name:string,count:int>>").alias("tags"), F.lit(None).cast("array<struct<name:string,score:double>>").alias("similar"))

    cache = log.artist_cache(spark, str(tmp_path / "cache"))
    assert log.enrich(cache, bills, look_up, day(), 2, budget=3, most_batches=1) == 2
    assert log.enrich(cache, bills, look_up, day(), 2, every=1) == 2
    assert log.enrich(cache, bills, look_up, day(), 2) == 0
    assert [sorted(a) for a in asked] == [["ANN", "Bo"], ["Cy", "Di"]]
    assert {(r["key"], r["mbid"], r["not_found"]) for r in cache.read().collect()} == {("ann", "ANN", False), ("bo", "BO", False), ("cy", None, True), ("di", "DI", False)}
    late = day("2024-05-02")
    assert log.enrichment_todo(bills, cache.read(), late).count() == 4


def test_running_sums_equal_a_recount_in_a_stream_that_repeats(spark, tmp_path):
    pick = random.Random(3)
    rows = [(u, pick.choice("abc"), pick.choice([0.0, None, 60_000.0, 10_000.0, 240_000.0]), pick.choice([None, dt.datetime(2023, 5, 1), dt.datetime(2024, 1, 31, 5), dt.datetime(2024, 3, 1)]), pick.choice([None, 3.0]), pick.choice(["csv", "library-artist", None])) for u in range(6) for _ in range(30)]
    kind = "user_id long, artist string, ms double, at timestamp, plays double, from string"
    for n in range(3):
        spark.createDataFrame(rows[n::3], kind).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    sums = taste.sums_log(spark, str(tmp_path / "sums"))
    plays = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    early = day("2024-01-01")
    decay.keep_listening(plays, sums, str(tmp_path / "cp"), early, every=2).awaitTermination()
    decay.keep_listening(plays, sums, str(tmp_path / "cp2"), early).awaitTermination()  # all batches once more: known by their numbers
    want = taste.listening(taste.valid_plays(spark.createDataFrame(rows, kind)), day())
    tell = lambda df: sorted((r["user_id"], r["name"], round(r["plays"], 6), int(r["raw_plays"]), int(r["minutes"]), str(r["last_at"]), r["rank"]) for r in df.collect())
    assert tell(taste.settle_sums(sums.read(), day())) == tell(want)
    assert tell(taste.settle_sums(taste.ripen_sums(sums.read(), day()), day())) == tell(want)


def plain_walk(files, root, children):
    """Pages in the order of a walk in depth, by recursion."""
    seen, pages = [], []

    def visit(at, depth):
        if at in seen or len(seen) >= children + 5:
            return
        seen.append(at)
        text = files.get(at) or ""
        locs = re.findall(r"<loc>\s*([^<]+?)\s*</loc>", text)
        if "<sitemapindex" in text.lower() and depth < 2:
            for child in sorted(locs, key=lambda u: re.search(sitemaps.CHILD_HINT, u.lower()) is None)[:children]:
                visit(child, depth + 1)
        else:
            pages.extend(u for u in locs if u not in pages)

    visit(root, 0)
    return pages


def test_walk_of_random_and_circular_maps(spark):
    pick = random.Random(11)
    files, roots = {}, []
    for s in range(40):
        names = [f"{s}/{'event' if pick.random() < 0.3 else 'map'}{i}" for i in range(9)]
        for n in names[: pick.randint(0, 9)]:
            index = pick.random() < 0.5
            locs = [pick.choice(names) if index or pick.random() < 0.1 else f"{s}/p{pick.randint(0, 99)}" for _ in range(pick.randint(2, 9))]
            files[n] = ("<SitemapIndex>" if index else "<urlset>") + "".join(f"<loc> {u} </loc>" for u in locs)
        roots.append((s, names[0], pick.choice([1, 2, 3, 25])))
    got = sitemaps.sitemap_pages(spark.createDataFrame(list(files.items()), "url string, xml string"), spark.createDataFrame([*roots, (99, None, 1)], "source_id long, sitemap string, children int"))
    have = {}
    for r in sorted(got.collect(), key=lambda r: r["place"]):
        have.setdefault(r["source_id"], []).append(r["page"])
    want = {s: p for s, root, n in roots if (p := plain_walk(files, root, n))}
    assert have == want and any(len(p) > 6 for p in want.values())


def test_pages_are_distinct_before_patterns_and_capped(spark):
    files = spark.createDataFrame([("r", "<urlset><loc>x/1</loc><loc>y/2</loc><loc>x/1</loc><loc>x/3?a=1&amp;b</loc><loc>x/4</loc></urlset>"), ("r", None), ("e", "")], "url string, xml string")
    roots = spark.createDataFrame([("a", "r", ["x/"], 2), ("b", "r", None, None), ("c", "e", [], 1), ("d", "gone", [], 1)], "source_id string, sitemap string, patterns array<string>, most int")
    got = sitemaps.sitemap_pages(files.filter("xml IS NOT NULL"), roots).orderBy("source_id", "place").collect()
    assert [(r["source_id"], r["page"]) for r in got] == [("a", "x/1"), ("a", "x/3?a=1&b"), ("b", "x/1"), ("b", "y/2"), ("b", "x/3?a=1&b"), ("b", "x/4")]


def test_schedule_against_a_loop_with_a_hot_host(spark):
    pick = random.Random(5)
    rows = [(i, pick.choice(["hot"] * 6 + ["b", "c", None]), pick.choice([None, 0, pick.randint(0, 400_000)]), pick.choice([None, pick.randint(0, 3000)]), pick.choice([None, 100, 2500])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, host string, arrives long, takes long, gap long").withColumn("ends", F.lit("clash")).drop("ends")
    got = {r["id"]: (r["starts"], r["ends"]) for r in schedule.polite_schedule(df, ["id"]).collect()}
    last, want = {}, {}
    for i, host, arrives, takes, gap in sorted(rows, key=lambda r: (r[2] or 0, r[0])):
        start = max(arrives or 0, last[host] + max(gap or 0, 700)) if host in last else arrives or 0
        last[host] = start + (takes or 0)
        want[i] = (start, last[host])
    assert got == want
    assert schedule.polite_schedule(df.filter("false"), ["id"]).count() == 0


def test_request_time_with_retries(spark):
    kind = "a array<struct<status:int,ms:bigint>>"
    cases = [([(200, 5)], 5), ([(503, 5), (200, 7)], 2012), ([(429, 1), (None, 1), (500, 1), (200, 9)], 2003 + 3000), ([(404, 3), (200, 9)], 3), ([], 0), (None, 0)]
    got = [r["t"] for r in spark.createDataFrame([(c,) for c, _ in cases], kind).select(schedule.request_ms(F.col("a")).alias("t")).collect()]
    assert got == [w for _, w in cases]


def test_robots_by_literal_starts(spark):
    pick = random.Random(7)
    part = lambda: "".join(pick.choice("/ab.") for _ in range(pick.randint(0, 4)))
    made = [(h, line, pick.random() < 0.5, "/" + part() + pick.choice(["", "", "*" + part(), "*", "*" + part() + "*b", "$"]) + pick.choice(["", "", "$"])) for h in "xyz" for line in range(25)]
    made = [(h, n, a, p.replace("$$", "$")) for h, n, a, p in made] + [("x", 99, False, "*b")]
    paths = [(i, pick.choice(["x", "y", "z", "none", None]), pick.choice([None, "/" + part() + part(), ""])) for i in range(400)]
    got = {r["id"]: r["allowed"] for r in rules.robots_allowed(spark.createDataFrame(paths, "id long, host string, path string"), spark.createDataFrame(made, "host string, line int, allow boolean, path string"), "id").collect()}

    def plain(host, path):
        fit = []
        for h, line, allow, rule in made:
            rx = "^" + re.escape(rule.removesuffix("$")).replace(r"\*", ".*") + ("$" if rule.endswith("$") else "")
            if h == host and path is not None and re.search(rx, path):
                fit.append((-len(rule), line, allow))
        return min(fit)[2] if fit else True

    assert got == {i: plain(h, p) for i, h, p in paths}
