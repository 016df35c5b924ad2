"""The engine: evidence, caps, one date per act, controls."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightjar.operators import taste, vectors
from nightjar.plans import evaluate, recommend as rec

EVENT = "event_id string, title string, artists array<string>, start_date date, status string, venue_id string, venue_name string, country string, city string, size_class string, is_tribute boolean, ord string"
INDEX = "key string, tags array<struct<name:string,count:int>>, similar array<struct<name:string,score:double>>"


def event(i, name, day, venue="v", room="club", **more):
    return (f"e{i}", more.get("title", name), [name], day, more.get("status", "scheduled"), venue, venue.upper(), "DK", "X", room, False, f"{i:04d}")


def run(spark, names, events, index=(), **options):
    plays = spark.createDataFrame([("u", n, float(100 - i), i) for i, n in enumerate(names)], "user_id string, name string, plays double, rank int")
    picks, diag = rec.recommend(taste.weights(plays), spark.createDataFrame(events, EVENT), spark.createDataFrame(list(index), INDEX), rec.RecommendOptions(from_date="2026-08-12", **options))
    return picks.orderBy("start_date").collect(), diag.collect()


def test_controls(spark):
    day = dt.date(2026, 9, 1)
    events = [event(i, "Iceage", day + dt.timedelta(days=i), room=r) for i, r in enumerate(("arena", "club", "mid"))]
    events += [event(3, "Iceage", day, title="Iceage Tribute"), event(4, "Iceage", dt.date(2026, 1, 1)), event(5, "Other", day)]
    picks, diag = run(spark, ["Iceage"], events)
    assert [p["event_id"] for p in picks] == ["e1"] and picks[0]["why"] == "You listen to Iceage."
    d = diag[0]
    assert (d["filtered_tribute"], d["filtered_past"], d["short"], d["short_reason"], d["capped_at"]) == (1, 1, True, "thin-evidence", 5)


def test_evidence_kinds(spark):
    day = dt.date(2026, 9, 1)
    index = [("lower", [], [("Iceage", 0.9)]), ("communions", [("post-punk", 10)], []), ("iceage", [("post-punk", 5)], [])]
    picks, _ = run(spark, ["Iceage", "Trentemoller"], [event(0, "Iceage", day), event(1, "Lower", day), event(2, "Communions", day, "w"), event(3, "Trentemollerr", day, "w")], index)
    kinds = {p["title"]: (p["kind"], p["via"]) for p in picks}
    assert kinds == {"Iceage": ("direct", "Iceage"), "Lower": ("similar", "Iceage"), "Communions": ("tag", None), "Trentemollerr": ("direct", "Trentemoller")}


@pytest.mark.parametrize(("asked", "most"), [(5, 5), (12, 12), (999, 20)])
def test_caps(spark, asked, most):
    names = [f"Band number {i}" for i in range(60)]
    events = [event(i, n, dt.date(2026, 9, 1) + dt.timedelta(days=5 * i), f"v{i % 9}") for i, n in enumerate(names)]
    picks, _ = run(spark, names, events, count=asked)
    assert len(picks) <= most
    assert max(pd.Series([p["venue_name"] for p in picks]).value_counts()) <= 3
    assert len({p["title"] for p in picks}) == len(picks)


def test_empty(spark):
    picks, diag = run(spark, ["A"], [])
    assert picks == [] and diag[0]["returned"] == 0


def slow(frame, k, quota, o):
    """Plain greedy selection, similarities from scratch each round."""
    rows, chosen = frame.to_dict("records"), []

    def sim(a, b):
        fa, fb = set(a["folds"]), set(b["folds"])
        va, vb = dict(zip(a["tags"], a["ws"])), dict(zip(b["tags"], b["ws"]))
        return 0.55 * len(fa & fb) / max(1, min(len(fa), len(fb))) + 0.25 * sum(w * vb.get(t, 0) for t, w in va.items()) + 0.12 * (bool(a["venue_id"]) and a["venue_id"] == b["venue_id"]) + 0.08 * (a["month"] == b["month"])

    while len(chosen) < k:
        only = max(0, quota - sum(rows[i]["kind"] != "direct" for i in chosen)) >= k - len(chosen)
        best = None
        for i, r in enumerate(rows):
            if i in chosen or (only and r["kind"] == "direct") or any(set(r["folds"]) & set(rows[c]["folds"]) for c in chosen):
                continue
            if r["venue_id"] and sum(rows[c]["venue_id"] == r["venue_id"] for c in chosen) >= o.max_per_venue:
                continue
            v = o.lam * r["rank"] - (1 - o.lam) * max([0.0] + [sim(r, rows[c]) for c in chosen])
            if best is None or v > best[0] + 1e-12:
                best = (v, i)
        if best is None:
            if only and quota:
                quota = 0
                continue
            return chosen
        chosen.append(best[1])
    return chosen


def test_greedy_matches_plain():
    import numpy as np

    rng = np.random.default_rng(3)
    o = rec.RecommendOptions(from_date="2026-01-01")
    for _ in range(20):
        n = 40
        folds = [[f"a{rng.integers(30)}"] for _ in range(n)]
        frame = pd.DataFrame({"rank": np.sort(rng.random(n))[::-1], "kind": rng.choice(["direct", "similar", "tag"], n), "venue_id": rng.choice(["v1", "v2", "v3", ""], n), "month": rng.choice(["2026-01", "2026-02", "2026-03"], n)})
        frame["folds"], frame["bill"] = folds, folds
        frame["tags"] = [["x", "y"] if rng.random() < 0.5 else ["x"] for _ in range(n)]
        frame["ws"] = [[0.6, 0.8][: len(t)] if len(t) > 1 else [1.0] for t in frame["tags"]]
        assert rec.greedy(frame, 12, 2, o) == slow(frame, 12, 2, o)


def test_first_candidates_suffice_or_say_so():
    """With the best rank beyond them, the first candidates give the whole list's picks or none."""
    rng = np.random.default_rng(8)
    o, proven = rec.RecommendOptions(from_date="2026-01-01"), 0
    for _ in range(60):
        n = 60
        folds = [[f"a{rng.integers(40)}"] for _ in range(n)]
        frame = pd.DataFrame({"rank": np.sort(rng.random(n).round(2) * rng.choice([0.2, 1, 3]))[::-1], "kind": rng.choice(["direct", "tag"], n, p=[0.8, 0.2]), "venue_id": rng.choice(["v1", "v2", "v3", "v4", ""], n), "month": rng.choice(["2026-01", "2026-02"], n)})
        frame["folds"], frame["bill"], frame["tags"], frame["ws"] = folds, folds, [["x"]] * n, [[1.0]] * n
        got = rec.greedy(frame.iloc[:35], 8, 2, o, frame["rank"].iloc[35])
        assert got is None or got == rec.greedy(frame, 8, 2, o)
        proven += got is not None
    assert 10 < proven < 60


def test_selection_is_the_same_from_any_start(spark):
    n, rng = 90, np.random.default_rng(4)
    rows = [(u, f"e{i}", float(rng.random()), i, f"v{rng.integers(9)}", dt.date(2026, 1 + i % 9, 1), [f"Act {rng.integers(25)}"], str(rng.choice(["direct", "tag"]))) for u in range(5) for i in range(n - 20 * u)]
    c = spark.createDataFrame(rows, "user_id int, event_id string, rank double, ord int, venue_id string, start_date date, artists array<string>, kind string").withColumns({"bill": F.col("artists")[0], "best": F.struct("kind")}).drop("kind")
    sizes = spark.createDataFrame([(u, 12, 2) for u in range(5)], "user_id int, k int, quota int")
    index = spark.createDataFrame([(f"act {i}", [(f"t{i % 4}", 3)]) for i in range(25)], "key string, tags array<struct<name:string,count:int>>")
    o = rec.RecommendOptions(from_date="2026-01-01")
    tell = lambda first: sorted(tuple(r) for r in rec.select(c, sizes, index, o, first).collect())
    want = tell(10_000)
    assert len(want) > 40 and tell(2) == want and tell(30) == want


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75, 1.0])
def test_similar_lists_are_all_pairs_above(spark, least):
    rng = np.random.default_rng(int(least * 100))
    lists = {u: {f"i{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 20)) if x < 50} | ({"hot"} if u % 2 else set()) for u in range(60)}
    rows = [(u, i) for u, s in lists.items() for i in s] * 2 + [(1, None), (None, "hot")]
    got = {(r["a"], r["b"]): r["overlap"] for r in rec.similar_lists(spark.createDataFrame(rows, "user_id int, event_id string"), least).collect()}
    want = {(a, b): v for a in lists for b in lists if a < b and lists[a] and lists[b] and (v := len(lists[a] & lists[b]) / min(len(lists[a]), len(lists[b]))) >= least}
    assert got == want


def test_labels_and_promises(spark):
    pick = "user_id string, title string, artists array<string>, venue_id string, start_date date, why string, is_tribute boolean"
    months = [dt.date(2026, m, 1) for m in (1, 2, 3, 3)]
    rows = [("good", f"t{i}", [f"Act {i}"], f"v{i}", d, "You listen", None) for i, d in enumerate([*months[:3], dt.date(2026, 4, 1)])]
    rows += [("bad", "x tribute", ["Same"], "v", d, None, False) for d in months] + [("bad", "old", None, None, dt.date(2025, 1, 1), "abc", True)]
    labels = [("good", ["ACT 1", "Act 1", "Not playing"], ["Same"], 4, 4, True), ("bad", ["Act 1"], ["SAME", None], 6, 4, False), ("none", ["Act 1"], ["Same"], 1, None, True), ("quiet", None, None, None, None, None)]
    kind = "user_id string, must_appear array<string>, must_not_appear array<string>, min_picks int, max_picks int, should_be_short boolean"
    playing = spark.createDataFrame([("act 1",), (None,), ("same",)], "artist string")
    out = evaluate.judge(spark.createDataFrame(rows, pick), spark.createDataFrame(labels, kind), playing, F.to_date(F.lit("2026-01-01"))).collect()
    assert all(r["passed"] for r in out if r["user_id"] in ("good", "quiet"))
    assert {(r["check"], r["name"]) for r in out if r["user_id"] == "none" and not r["passed"]} == {("at-least", None), ("must-appear", "Act 1")}
    assert {(r["check"], r["name"]) for r in out if r["user_id"] == "bad" and not r["passed"]} == {(c, None) for c in ("artist-twice", "venue", "says-why", "no-tributes", "not-past", "at-least", "at-most")} | {("must-appear", "Act 1"), ("must-not-appear", "SAME")}


def test_regions_name_countries():
    of = lambda **k: rec.RecommendOptions(from_date="2026-01-01", **k).wanted_countries
    assert of() == () and of(region="all") == () and of(region="DE") == ("DE",) and of(region="nordic", countries=("DK",)) == ("DK",)
    assert len(of(region="nordic")) == 5 and set(of(region="nordic")) < set(of(region="europe"))


def test_decay_and_skips(spark):
    rows = [("u", "New", 200000.0, "2026-08-01"), ("u", "Old", 200000.0, "2022-08-01"), ("u", "Skip", 5000.0, "2026-08-01"), ("u", " ", 90000.0, None), ("u", None, 1.0, None)]
    p = spark.createDataFrame(rows, "user_id string, artist string, ms double, at string").withColumns({"at": F.col("at").cast("timestamp"), "plays": F.lit(None).cast("double"), "from": F.lit("csv")})
    got = {r["name"]: r["plays"] for r in taste.listening(taste.valid_plays(p), F.lit("2026-08-12").cast("timestamp")).collect()}
    assert set(got) == {"New", "Old"} and got["New"] > got["Old"]


@pytest.mark.parametrize(("seed", "gate", "salt_rows"), [(0, 0.12, 10_000), (1, 0.3, 5), (2, 0.6, 7), (3, 0.0, 3)])
def test_pairs_above(spark, seed, gate, salt_rows, monkeypatch):
    """All pairs above the gate, and no more, with hot tags, one-tag vectors and zero weights; the index leaves fewer pairs than share a tag."""
    monkeypatch.setattr(vectors, "SALT_ROWS", salt_rows)
    rng = np.random.default_rng(seed)

    def made(n):
        rows = []
        for i in range(n):
            own = {"hot": float(rng.random() * 0.3)} if rng.random() < 0.9 else {}
            own |= {f"t{int(x)}": float(rng.random()) for x in rng.zipf(1.3, rng.integers(0, 7)) if x < 60}
            rows += [(i, k, w) for k, w in own.items()]
        return [*rows, (n, "alone", 1.0), (n + 1, "hot", 0.0), (n + 2, None, 1.0)]

    x, y = made(70), made(50)
    norm = lambda rows: {i: sum(w * w for j, _, w in rows if j == i) ** 0.5 or 1.0 for i, _, _ in rows}
    nx, ny, want, shared = norm(x), norm(y), {}, set()
    for i, t, w in x:
        for j, u, v in y:
            if t == u and t is not None and w * v > 0:
                want[i, j] = want.get((i, j), 0.0) + w / nx[i] * v / ny[j]
                shared.add((i, j))
    want = {k: c for k, c in want.items() if c > gate}
    left, right = (vectors.unit(spark.createDataFrame(r, f"{c} int, tag string, w double"), [c]) for r, c in ((x, "a"), (y, "b")))
    got = {(r["a"], r["b"]): r["cosine"] for r in vectors.pairs_above(left, right, ["a"], ["b"], gate).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    positive = [v.filter("w > 0 AND tag IS NOT NULL") for v in (left, right)]
    tried = {tuple(r) for r in vectors.candidate_pairs(*positive, ["a"], ["b"], gate, salt_rows).collect()}
    assert want.keys() <= tried <= shared and (gate < 0.3 or len(tried) < 0.8 * len(shared))


def test_pairs_above_meets_by_blocks(spark):
    """Blocks and parts of any size give the same pairs, and no pair of blocks without a passing pair leaves a row behind."""
    rng = np.random.default_rng(5)
    rows = lambda n: [(i, int(t), float(w)) for i in range(n) for t, w in zip(rng.choice(40, 9, replace=False), rng.random(9), strict=True)]
    left, right = (vectors.unit(spark.createDataFrame(rows(n), f"{c} long, tag long, w double"), [c]) for n, c in ((60, "a"), (45, "b")))
    found = lambda **k: {(r["a"], r["b"]): round(r["cosine"], 9) for r in vectors.pairs_above(left, right, ["a"], ["b"], 0.35, **k).collect()}
    plain = left.alias("x").join(right.alias("y"), F.col("x.tag") == F.col("y.tag")).groupBy("a", "b").agg(F.sum(F.col("x.w") * F.col("y.w")).alias("c")).filter("c > 0.35")
    want = {(r["a"], r["b"]): round(r["c"], 9) for r in plain.collect()}
    assert want and found() == want == found(block_rows=70, at_once=1) == found(block_rows=200, at_once=50)
