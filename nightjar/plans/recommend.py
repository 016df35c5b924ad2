"""The flagship plan: listening and a corpus in, a short varied list of picks per user out."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nightjar.functions.scalars import discovery_quota, effective_count, noisy_or, rank_score, tag_weight, usable_tag
from nightjar.functions.text import fold_name, looks_like_tribute
from nightjar.operators import corpus, match, rules, vectors
from nightjar.operators.corpus import cut
from nightjar.operators.taste import taste_keys

# fixed values: weights of the kinds of evidence, the tag gate, the pair similarity
DIRECT, SIMILAR, TAG, TAG_GATE = 1.0, 0.62, 0.34, 0.12
OVERLAP, TAGS, SAME_VENUE, SAME_MONTH = 0.55, 0.25, 0.12, 0.08
ROOM_ORDER = {"club": 0, "mid": 1, "large": 2, "arena": 3}
UNKNOWN_ROOM, CLOSE_ENOUGH, BILLED = 9, 0.9, 8
# fixed values: countries of the regions
NORDIC = ("DK", "SE", "NO", "FI", "IS")
REGIONS = {"nordic": NORDIC, "europe": (*NORDIC, "DE", "NL", "BE", "FR", "GB", "PL", "ES", "IT", "AT", "CH", "CZ", "IE", "PT")}
#: candidates of a user that selection looks at first
FIRST = 256


@dataclass(frozen=True)
class RecommendOptions:
    from_date: str
    count: int = 12
    min_count: int = 5
    max_count: int = 20
    min_score: float = 0.18
    discovery_slots: int = 2
    max_per_venue: int = 3
    max_per_artist: int = 1
    lam: float = 0.72
    horizon_days: int = 365
    to_date: str | None = None
    countries: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    include_tributes: bool = False
    room_preference: str | None = None
    region: str | None = None
    lang: str = "en"

    @property
    def wanted_countries(self) -> tuple[str, ...]:
        """``countries``, else those of the region: a name of REGIONS, "all", or a country of its own."""
        if self.countries or self.region in (None, "all"):
            return self.countries
        return REGIONS.get(self.region, (self.region,))

    @property
    def asked(self) -> int:
        return max(self.min_count, min(self.max_count, self.count))


def filtered_events(events: DataFrame, o: RecommendOptions) -> DataFrame:
    """Events with ``reason`` (null for those that pass)."""
    low = F.to_date(F.lit(o.from_date))
    high = F.to_date(F.lit(o.to_date)) if o.to_date else F.date_add(low, o.horizon_days)
    tribute = None if o.include_tributes else F.coalesce("is_tribute", F.lit(False)) | looks_like_tribute(F.col("title"))
    return rules.cascade(events, rules.engine_rules(low, high, list(o.wanted_countries), list(o.cities), tribute))


def grouped_events(events: DataFrame, o: RecommendOptions) -> DataFrame:
    """(reason, artists, alone, size_class, n, first): events by why they are left out (null for those that pass) and, of these, by who plays and in what room.

    One pass that nothing but groups leaves, with the least event of each by ``ord``.  The tribute rule, the last of the cascade,
    reads the title only, so it is judged once a title and not once an event.  Events are sorted by their keys here: a hash before
    them tells most groups apart, and the array stays out where it says what the title says.
    """
    ruled = filtered_events(events, replace(o, include_tributes=True))
    passes = F.col("reason").isNull()
    artists, titled = F.coalesce("artists", F.array().cast("array<string>")), F.array("title")
    who = {"artists": F.when(artists != titled, artists), "title": F.col("title"), "is_tribute": F.col("is_tribute"), "size_class": F.col("size_class")}
    rows = ruled.select("reason", *(F.when(passes, c).alias(name) for name, c in who.items()), *(F.when(passes, F.col(c)).alias(c) for c in ("ord", "event_id", "venue_id", "venue_name", "start_date")))
    first = F.min(F.struct("ord", "event_id", "venue_id", "venue_name", "start_date")).alias("first")
    titles = rows.groupBy(F.xxhash64("reason", *who).alias("hash"), "reason", *who).agg(first, F.count(F.lit(1)).alias("n"))
    if not o.include_tributes:
        tribute = F.coalesce("is_tribute", F.lit(False)) | looks_like_tribute(F.col("title"))
        titles = titles.withColumn("reason", F.when(passes & tribute, "tribute").otherwise(F.col("reason")))
    alone = F.when(F.size("artists") == 0, F.col("title"))  # a title stands for the act it doesn't name
    titles = titles.withColumn("artists", F.coalesce("artists", titled))
    first = F.min(F.struct("first.ord", "first.event_id", "title", "first.venue_id", "first.venue_name", "first.start_date")).alias("first")
    return titles.groupBy("reason", *(F.when(passes, c).alias(name) for name, c in (("artists", F.col("artists")), ("alone", alone), ("size_class", F.col("size_class"))))).agg(first, F.sum("n").alias("n"))


def bills(grouped: DataFrame) -> DataFrame:
    """(bill, artists, size_class, n, ord, event_id, title, venue_id, venue_name, start_date): events that pass, by who plays and in what room.

    Events with one bill get the same evidence, so it is gathered once for all of a bill's
    dates.  Rank depends on the bill and the room's size only; of equal ranks the corpus order
    decides, and a room of the same size never replaces an earlier one.  So the first
    event of each bill and room size stands for the ``n`` that there are.
    """
    return grouped.filter(F.col("reason").isNull()).select(F.sha2(F.to_json(F.struct("artists", "alone")), 256).alias("bill"), "artists", "size_class", "n", "first.*")


def evidence(events: DataFrame, taste: DataFrame, index: DataFrame) -> DataFrame:
    """(user_id, event_id, pos, kind, artist, via, tags, similarity, strength): one row per billed artist that matters.

    Tiers are joins: direct keys and one edit, similar artists, tag vectors.  What a stronger tier has found is taken
    away from the weaker ones, from tag vectors before their products are taken.
    """
    billed = events.select("event_id", F.posexplode(F.slice(F.when(F.size("artists") > 0, F.col("artists")).otherwise(F.array("title")), 1, BILLED)).alias("pos", "artist"))
    keys, billed = cut(taste_keys(taste)), cut(billed)
    none = F.lit(None)
    place = ["user_id", "event_id", "pos"]
    direct = billed.join(match.taste_hits(billed.select("artist").distinct(), keys, "artist"), "artist")
    direct = direct.select(*place, F.lit("direct").alias("kind"), "artist", "via", none.cast("array<string>").alias("tags"), none.cast("double").alias("similarity"), (F.col("weight") * DIRECT).alias("strength"))

    hop = match.one_hop(billed, index, keys, "artist", weight=SIMILAR).join(direct.select(*place), place, "left_anti")
    similar = hop.select(*place, F.lit("similar").alias("kind"), "artist", "via", none.cast("array<string>").alias("tags"), "similarity", "strength")

    direct, similar = cut(direct), cut(similar)  # read by the tiers below, too
    done = direct.select(*place).unionByName(similar.select(*place))
    user_tags = user_vectors(taste, index)
    tagged = match.probe(billed, index.select("key", "tags"), "artist").select("event_id", "pos", "artist", F.posexplode("tags").alias("at", "t"))
    tagged = tagged.select("event_id", "pos", "artist", "at", usable_tag(F.col("t.name")).alias("tag"), tag_weight(F.col("t.count")).alias("w")).filter("tag IS NOT NULL AND w > 0")
    # a tag repeated within an artist: the last weight at the first place
    tagged = tagged.groupBy("event_id", "pos", "artist", "tag").agg(F.min("at").alias("at"), F.max_by("w", "at").alias("w"))
    tagged, user_tags = cut(vectors.unit(tagged, ["event_id", "pos"])), cut(user_tags)
    # a prefix index leaves only pairs that can pass the gate; those with stronger evidence go before any product is taken
    likely = vectors.candidate_pairs(tagged, user_tags, ["event_id", "pos"], ["user_id"], TAG_GATE).join(done, place, "left_anti")
    shared = likely.join(tagged, ["event_id", "pos"]).join(user_tags.select("user_id", "tag", F.col("w").alias("uw")), ["user_id", "tag"])
    cos = shared.groupBy("user_id", "event_id", "pos", "artist").agg(F.sum(F.col("w") * F.col("uw")).alias("similarity"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]), 1, 3).alias("tags"))
    tag = cos.filter(F.col("similarity") > TAG_GATE).select(*place, F.lit("tag").alias("kind"), "artist", none.cast("string").alias("via"), "tags", "similarity", (F.col("similarity") * TAG).alias("strength"))
    return direct.unionByName(similar).unionByName(tag)


def user_vectors(taste: DataFrame, index: DataFrame) -> DataFrame:
    """(user_id, tag, w): taste weights times positive votes over all indexed artists, unit length."""
    known = match.probe(taste.select("user_id", "name", "rank", "weight"), index.select("key", "tags"), "name")
    votes = known.select("user_id", "weight", F.explode("tags").alias("t")).select("user_id", usable_tag(F.col("t.name")).alias("tag"), (F.col("weight") * tag_weight(F.col("t.count"))).alias("w"))
    return vectors.tag_vector(votes.filter("tag IS NOT NULL AND w > 0"), ["user_id"])


def score(found: DataFrame, o: RecommendOptions) -> DataFrame:
    """(user_id, event_id, evidence, score, depth, best) of what is above the threshold; here events are bills."""
    # strongest first; the sort is stable over the bill
    item = F.struct((-F.col("strength")).alias("less"), "pos", "kind", "artist", "via", "tags", "similarity", "strength")
    agg = found.groupBy("user_id", "event_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))  # at most BILLED items
    strengths = F.transform("evidence", lambda e: e["strength"])
    scored = agg.withColumn("score", noisy_or(strengths)).withColumn("depth", F.aggregate(strengths, F.lit(0.0), lambda a, s: a + s))
    return scored.filter(F.col("score") >= o.min_score).withColumn("best", F.get("evidence", 0))


def dated(scored: DataFrame, dates: DataFrame, o: RecommendOptions) -> DataFrame:
    """Scored bills with their dates (see ``bills``) and ``rank``."""
    room = F.col("size_class") if o.room_preference == "intimate" else None
    rows = scored.select("user_id", F.col("event_id").alias("bill"), "score", "depth", "best").join(dates, "bill")
    return rows.withColumn("rank", rank_score(F.col("score"), F.col("depth"), room))


def one_date_per_artist(scored: DataFrame) -> DataFrame:
    """Per user and act one event: in rank order, a later one replaces the holder if nearly as good and in a smaller room.

    The replacement is judged against the holder of the moment, so it chains: a fold over the ordered array.
    """
    room = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROOM_ORDER.items() for x in kv]), F.col("size_class")), F.lit(UNKNOWN_ROOM))
    item = F.struct((-F.col("rank")).alias("less"), "ord", "event_id", room.alias("room"))
    acts = scored.groupBy("user_id", fold_name(F.col("best.artist")).alias("act")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    hold = F.aggregate(
        F.slice("items", 2, F.size("items")), F.get("items", 0), lambda h, x: F.when((x["less"] < h["less"]) | ((-x["less"] >= CLOSE_ENOUGH * -h["less"]) & (x["room"] < h["room"])), x).otherwise(h)
    )
    return scored.join(acts.select("user_id", hold["event_id"].alias("event_id")), ["user_id", "event_id"])


def list_sizes(scored: DataFrame, o: RecommendOptions) -> DataFrame:
    """(user_id, matched, k, quota) from the direct evidence of all scored events."""
    via = scored.select("user_id", F.explode("evidence").alias("e")).filter("e.kind = 'direct'").groupBy("user_id").agg(F.countDistinct("e.via").alias("matched"))
    out = scored.select("user_id").distinct().join(via, "user_id", "left").fillna(0, ["matched"])
    out = out.withColumn("k", effective_count(F.lit(o.asked), F.col("matched").cast("int"), o.min_count, o.max_count))
    return out.withColumn("quota", discovery_quota(F.col("k"), o.discovery_slots))


def greedy(frame: pd.DataFrame, k: int, quota: int, o: RecommendOptions, beyond: float | None = None) -> list[int] | None:
    """Row numbers of the picks, in the order they were made.

    Every candidate carries its largest similarity to a pick so far, so a round costs one pass.  ``beyond`` is the best rank
    among candidates that the frame leaves out, all of which come later in order: as similarity only lowers a value, none of them wins a round
    whose winner has the value of that rank or more.  The result is None if a round has no such winner.
    """
    floor = None if beyond is None else o.lam * beyond
    n = len(frame)
    acts: dict[str, list[int]] = {}  # candidates that bill an act
    rooms: dict[str, list[int]] = {}
    size, month = np.ones(n), frame["month"].fillna("").to_numpy(str)
    for i, (folds, venue) in enumerate(zip(frame["folds"], frame["venue_id"], strict=True)):
        size[i] = max(1, len(folds))
        for a in folds:
            acts.setdefault(a, []).append(i)
        if isinstance(venue, str) and venue:
            rooms.setdefault(venue, []).append(i)
    names = {t: k for k, t in enumerate(sorted({t for x in frame["tags"] for t in x}))}
    vec = np.zeros((n, len(names)))
    for i, (t, w) in enumerate(zip(frame["tags"], frame["ws"], strict=True)):
        vec[i, [names[x] for x in t]] = w
    discovery = (frame["kind"] != "direct").to_numpy()
    rank = frame["rank"].to_numpy(float)
    near, open_, fit = np.zeros(n), np.ones(n, bool), np.ones(n, bool)
    used: dict[tuple[str, str], int] = {}
    picks: list[int] = []

    def spend(kind: str, name: str, most: int, who: list[int]) -> None:
        used[kind, name] = used.get((kind, name), 0) + 1
        if used[kind, name] >= most:
            fit[who] = False

    while len(picks) < k and open_.any():
        owed = max(0, quota - int(discovery[picks].sum()))
        only = owed >= k - len(picks)
        able = np.flatnonzero(open_ & fit & (discovery if only else True))
        if not len(able):
            if only and quota:
                if floor is not None:
                    return None
                quota = 0
                continue
            break
        value = o.lam * rank[able] - (1 - o.lam) * near[able]
        if floor is not None and value.max() < floor:
            return None
        p = int(able[value.argmax()])  # the first of equals
        picks.append(p)
        open_[p] = False
        shared = np.zeros(n)
        for a in frame["folds"].iloc[p]:
            shared[acts[a]] += 1
        venue = frame["venue_id"].iloc[p]
        same = np.zeros(n)
        same[rooms.get(venue, [])] = 1
        near = np.maximum(near, OVERLAP * shared / np.minimum(size, size[p]) + TAGS * (vec @ vec[p]) + SAME_VENUE * same + SAME_MONTH * (month == month[p]))
        for a in frame["bill"].iloc[p]:
            spend("act", a, o.max_per_artist, acts[a])
        if venue in rooms:
            spend("room", venue, o.max_per_venue, rooms[venue])
    return picks if floor is None or len(picks) >= k else None


def select(candidates: DataFrame, sizes: DataFrame, index: DataFrame, o: RecommendOptions, first: int = FIRST) -> DataFrame:
    """(user_id, event_id, pick_order) by constrained greedy selection, one group per user.

    A group holds a user's ``first`` candidates by rank, and what is left out can be proven not to be picked by its best rank. Users for
    whom the proof fails come again with eight times as many, so only a user whose picks need it has a large group.
    """
    billed = candidates.select("bill", "artists").dropDuplicates(["bill"]).select("bill", F.explode("artists").alias("artist"))
    tags = match.probe(billed, index.select("key", "tags"), "artist").select("bill", F.explode("tags").alias("t")).select("bill", usable_tag(F.col("t.name")).alias("tag")).filter("tag IS NOT NULL")
    vec = vectors.unit(tags.groupBy("bill", "tag").agg(F.count(F.lit(1)).cast("double").alias("w")), ["bill"]).groupBy("bill").agg(F.collect_list(F.struct("tag", "w")).alias("vec"))
    bill = F.transform("artists", lambda a: fold_name(a))
    rows = candidates.join(vec, "bill", "left").join(sizes, "user_id").select(
        "user_id", "event_id", "rank", "ord", "k", "quota", "venue_id", F.date_format("start_date", "yyyy-MM").alias("month"), F.col("best.kind").alias("kind"), bill.alias("bill"), F.array_distinct(bill).alias("folds"),
        F.coalesce(F.transform("vec", lambda v: v["tag"]), F.array().cast("array<string>")).alias("tags"), F.coalesce(F.transform("vec", lambda v: v["w"]), F.array().cast("array<double>")).alias("ws"),
    )

    schema = f"user_id {candidates.schema['user_id'].dataType.simpleString()}, event_id {candidates.schema['event_id'].dataType.simpleString()}, pick_order int"
    with corpus.cuts():
        left, most, picks = cut(rows), first, []
        while True:
            top = corpus.top_k(left, ["user_id"], [F.desc("rank"), F.col("ord"), F.col("event_id")], most + 1, "place")
            out = cut(top.groupBy("user_id").applyInPandas(_picker(most, o), schema), keep=True)
            picks.append(out.filter("pick_order >= 0"))
            unproven = out.filter("pick_order < 0").select("user_id")
            if unproven.isEmpty():
                return reduce(DataFrame.unionByName, picks)
            left, most = left.join(unproven, "user_id", "left_semi"), 8 * most


def _picker(most: int, o: RecommendOptions) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A group's picks from its first ``most`` candidates, or one row with ``pick_order`` -1 if they don't suffice."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "ord", "event_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        beyond = float(frame["rank"].iloc[most]) if len(frame) > most else None
        picks = greedy(frame.iloc[:most], int(frame["k"].iloc[0]), int(frame["quota"].iloc[0]), o, beyond)
        out = frame.iloc[[0] if picks is None else picks][["user_id", "event_id"]].copy()
        out["pick_order"] = np.int32(-1) if picks is None else np.arange(len(picks), dtype=np.int32)
        return out

    return run


def explain(best: Column, lang: str = "en") -> Column:
    """One sentence for the strongest evidence."""
    direct, similar, tag, both = ("Du lytter til ", "Fordi du lytter til ", "Rammer din smag for ", " og ") if lang == "da" else ("You listen to ", "Because you listen to ", "Matches your taste for ", " and ")
    two = F.array_join(F.slice(F.coalesce(best["tags"], F.array().cast("array<string>")), 1, 2), both)
    said = F.when(best["kind"] == "direct", F.concat(F.lit(direct), best["via"])).when(best["kind"] == "similar", F.concat(F.lit(similar), best["via"])).when(best["kind"] == "tag", F.concat(F.lit(tag), two))
    return F.coalesce(F.concat(said, F.lit(".")), F.lit(""))


def recommend(taste: DataFrame, events: DataFrame, index: DataFrame, o: RecommendOptions) -> tuple[DataFrame, DataFrame]:
    """Picks (one row each; ``start_date`` orders them) and diagnostics (one row per user).

    ``taste``: user_id, name, rank, weight.  ``events``: event_id, title, artists,
    start_date, status, venue_id, venue_name, country, city, size_class, is_tribute, ord
    (corpus order).  ``index``: key, tags, similar.
    """
    # read by several branches below: written once to the shared folder, which also keeps the plans short
    taste, index = cut(taste), cut(index)
    grouped = cut(grouped_events(events, o))
    dates = cut(bills(grouped))
    shown = dates.groupBy(F.col("bill").alias("event_id")).agg(F.any_value("artists").alias("artists"), F.any_value("title").alias("title"))
    with corpus.cuts():  # the tiers' own tables
        scored = cut(score(evidence(shown, taste, index), o), keep=True)
    sizes = list_sizes(scored, o)
    rows = cut(dated(scored, dates, o))
    chosen = select(one_date_per_artist(rows), sizes, index, o)
    picks = rows.join(chosen, ["user_id", "event_id"]).select(
        "user_id", "event_id", "title", "start_date", "venue_name", "score", "rank", F.col("best.kind").alias("kind"), F.col("best.via").alias("via"), "pick_order",
        explain(F.col("best"), o.lang).alias("why"), explain(F.col("best"), "da").alias("why_da"), (F.col("best.kind") != "direct").alias("discovery"),
    )
    return picks, diagnostics(taste, grouped, scored, rows, sizes, picks, o)


def diagnostics(taste: DataFrame, grouped: DataFrame, scored: DataFrame, rows: DataFrame, sizes: DataFrame, picks: DataFrame, o: RecommendOptions) -> DataFrame:
    per_user = taste.groupBy("user_id").agg(F.countDistinct("name").alias("taste_size"))
    matched = scored.select("user_id", F.explode("evidence").alias("e")).filter("e.via IS NOT NULL").groupBy("user_id").agg(F.countDistinct("e.via").alias("taste_artists_matched"))
    best = rows.groupBy("user_id").agg(F.sum("n").alias("events_scored"), F.min_by("score", F.struct((-F.col("rank")).alias("less"), "ord")).alias("top_score"))
    got = picks.groupBy("user_id").agg(F.count(F.lit(1)).alias("returned"), F.count_if("discovery").alias("discovery_picks"))
    number = lambda which, name: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0).cast("long")).alias(name)
    reasons = grouped.agg(number(F.lit(True), "corpus_size"), number(F.col("reason").isNull(), "events_considered"), *(number(F.col("reason") == r, f"filtered_{r}") for r in ("past", "beyond_window", "cancelled", "country", "city", "tribute")))
    out = per_user.join(matched, "user_id", "left").join(best, "user_id", "left").join(got, "user_id", "left").join(sizes, "user_id", "left").crossJoin(F.broadcast(reasons))  # one row
    out = out.fillna(0, ["taste_artists_matched", "events_scored", "returned", "discovery_picks", "matched"]).withColumn("k", F.coalesce("k", F.lit(o.min_count)))
    capped = F.col("k") < o.asked
    short = F.col("returned") < o.asked
    return out.select(
        "user_id", F.lit(o.asked).alias("asked_for"), F.when(capped, F.col("k")).alias("capped_at"), F.col("matched").alias("matched_artist_count"), "returned", short.alias("short"),
        F.when(short, F.when(capped | (F.col("events_scored") < o.asked), "thin-evidence").otherwise("variety-limit")).alias("short_reason"),
        "events_considered", "events_scored", "corpus_size", "taste_size", "taste_artists_matched", "discovery_picks", F.lit(o.from_date).alias("window_from"), "top_score", F.lit(o.min_score).alias("score_floor"),
        *(c for c in out.columns if c.startswith("filtered_")),
    )


def pair_overlap(picks: DataFrame, user: str = "user_id", item: str = "event_id") -> DataFrame:
    """(a, b, overlap): common items of two users' lists over the shorter list, for pairs that share one."""
    n = picks.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    x = picks.select(F.col(user).alias("a"), F.col(item).alias("i"))
    y = picks.select(F.col(user).alias("b"), F.col(item).alias("i"))
    common = x.join(y, "i").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    return common.join(n.select(F.col(user).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(user).alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("c") / F.least("na", "nb")).alias("overlap"))


#: lists of a block, pairs that a task judges at once, rows that leave it at once
LIST_BLOCK, JUDGED, LEAVE = 8192, 1 << 17, 1 << 17
#: 64-bit words that lists' items may fill to be compared as bits, and how many such comparisons cost as much as bringing a pair together by a join
MOST_WORDS, BITS_A_PAIR = 16, 300


def _alike(least: float, kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs (x, y, overlap) of two blocks of lists, by the bits of their items; of a block with itself each pair once."""

    def side(lists: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        n, bits = lists.field("n").to_numpy(zero_copy_only=False), lists.field("bits").flatten().to_numpy().view(np.uint64)
        return lists.field("u"), n, np.ceil((least - 1e-9) * n).astype(np.uint16), bits.reshape(len(n), -1)

    def hits(nx, lx, bx, ny, ly, by, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at_once, even = max(1, JUDGED // max(1, len(ny))), len(np.unique(np.append(lx, ly))) == 1
        for i in range(0, len(nx), at_once):
            some = slice(i, i + at_once)
            common = np.bitwise_count(bx[some, 0, None] & by[None, :, 0])
            for w in range(1, bx.shape[1]):
                common = common + np.bitwise_count(bx[some, w, None] & by[None, :, w]).astype(np.uint16)
            near = common >= (lx[0].astype(common.dtype) if even else np.minimum(lx[some, None], ly))
            if same:
                near &= np.arange(len(ny)) > np.arange(len(nx))[some, None]
            x, y = np.divmod(np.flatnonzero(near), len(ny))
            yield x + i, y, common[x, y] / np.minimum(nx[x + i], ny[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ux, *x), (uy, *y) = side(batch.column("lx")[k].values), side(batch.column("ly")[k].values)
                held, size = [], 0
                for found in itertools.chain(hits(*x, *y, batch.column("bx")[k] == batch.column("by")[k]), [None]):
                    if found is not None:
                        held, size = [*held, found], size + len(found[0])
                    if size >= LEAVE or found is None and size:
                        i, j, overlap = (np.concatenate(c) for c in zip(*held, strict=True))
                        yield pa.RecordBatch.from_arrays([ux.take(pa.array(i)), uy.take(pa.array(j)), pa.array(overlap)], schema=kind)
                        held, size = [], 0

    return run


def _lists_by_bits(lists: DataFrame, items: DataFrame, words: int, n: int, least: float) -> DataFrame:
    """All pairs (a, b, overlap) of the ``n`` lists (u, i): each list is a row of bits, blocks of lists are rows that meet each other once."""
    blocks = -(-n // LIST_BLOCK)
    coded = lists.join(corpus.small(items.withColumn("code", F.row_number().over(W.orderBy("i")) - 1)), "i")  # items fill a few words
    bit = F.expr("shiftleft(1L, cast(code % 64 AS int))")
    word = lambda w: F.coalesce(F.bit_or(F.when(F.floor(F.col("code") / 64) == w, bit)), F.lit(0).cast("long"))
    rows = coded.groupBy("u").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array(*(word(w) for w in range(words))).alias("bits"))
    block = F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")
    held = cut(rows.groupBy(block.alias("b")).agg(F.collect_list(F.struct("u", "n", "bits")).alias("l")))
    x = held.select(F.col("b").alias("bx"), F.col("l").alias("lx"), F.explode(F.sequence("b", F.lit(blocks - 1))).alias("by"))
    met = x.join(held.select(F.col("b").alias("by"), F.col("l").alias("ly")), "by").select("bx", "by", "lx", "ly").repartitionByRange(blocks * (blocks + 1) // 2, "bx", "by")
    kind = T.StructType([T.StructField("x", lists.schema["u"].dataType), T.StructField("y", lists.schema["u"].dataType), T.StructField("overlap", T.DoubleType())])
    return met.mapInArrow(_alike(least, to_arrow_schema(kind)), kind).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def similar_lists(picks: DataFrame, least: float, user: str = "user_id", item: str = "event_id") -> DataFrame:
    """(a, b, overlap): all pairs of users with an ``overlap`` (see ``pair_overlap``) of ``least`` or more; 0 < ``least`` <= 1.

    Items stand in one order, rarest first.  A list of n needs c = ceil(least * n) items in common with a longer one, so one of them
    is among the first n - c + 1 of both orders' heads: the shorter list offers that head, the longer one a head for each power of two that
    a shorter list may begin at.  They meet by size class and item, so items that all lists share, last in the order,
    rarely bring a pair together; pairs are then counted on whole lists.  Users with one and the same list are a class that is compared once,
    under its least user.  Where items are so few that most heads meet, all lists are compared as bits instead, block by block; the
    pairs that would meet are counted to tell.  Repeated and null items count once and never.
    """
    lists = cut(picks.select(F.col(user).alias("u"), F.col(item).alias("i")).filter("u IS NOT NULL AND i IS NOT NULL").distinct())
    often = lists.groupBy("i").agg(F.count(F.lit(1)).alias("often"))
    whole = lists.join(often, "i").groupBy("u").agg(F.array_sort(F.collect_list(F.struct("often", "i"))).alias("s"))  # one list each
    members = cut(whole.select(F.col("u").alias("user"), F.transform("s", lambda x: x["i"]).alias("s")).withColumn("u", F.min("user").over(W.partitionBy("s"))))
    ordered = cut(members.filter("user = u").select("u", "s", F.size("s").alias("n"), F.floor(F.log2(F.size("s"))).cast("int").alias("c")))
    needed = lambda n: F.ceil(F.lit(least) * n - 1e-9).cast("int")
    short = ordered.select("u", "n", "c", F.explode(F.slice("s", 1, F.col("n") - needed(F.col("n")) + 1)).alias("i"))
    each = ordered.select("u", "n", "s", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("c"))
    long = each.select("u", "n", "c", F.explode(F.slice("s", 1, F.col("n") - needed(F.pow(F.lit(2.0), F.col("c"))) + 1)).alias("i"))
    x, y = short.select("c", "i", F.col("u").alias("x"), F.col("n").alias("nx")), long.select("c", "i", F.col("u").alias("y"), F.col("n").alias("ny"))
    words, n = -(-often.count() // 64), members.count()
    if 0 < words <= MOST_WORDS:
        heads = [h.groupBy("c", "i").agg(F.count(F.lit(1)).cast("double").alias(k)) for h, k in ((short, "h"), (long, "k"))]
        meet = heads[0].join(heads[1], ["c", "i"]).agg(F.sum(F.col("h") * F.col("k"))).first()[0] or 0.0
        if float(n) * n * words <= BITS_A_PAIR * meet:
            return _lists_by_bits(lists, often.select("i"), words, n, least)
    met = x.join(y, ["c", "i"]).filter("nx < ny OR (nx = ny AND x < y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sets = [ordered.select(F.col("u").alias(c), F.col("s").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab"]
    counted = met.join(sets[0], "a").join(sets[1], "b").select("a", "b", (F.size(F.array_intersect("sa", "sb")) / F.least("na", "nb")).alias("overlap"))
    near = cut(counted.filter(F.col("overlap") >= least - 1e-9))  # of classes; their members are paired from here on
    of = lambda c: members.select(F.col("u").alias(f"u{c}"), F.col("user").alias(c))
    across = near.select(F.col("a").alias("ux"), F.col("b").alias("uy"), "overlap").join(of("x"), "ux").join(of("y"), "uy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")
    within = of("x").join(of("y"), F.col("ux") == F.col("uy")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("overlap"))
    return across.unionByName(within)


def calendar(picks: DataFrame, low: Column, high: Column, spark, most: int = 36) -> DataFrame:
    """Months of the window with their number of picks, empty ones too."""
    months = spark.range(1).select(F.explode(F.slice(F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr("interval 1 month")), 1, most)).alias("month"))
    counts = picks.groupBy(F.trunc("start_date", "month").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(counts, "month", "left").fillna(0, ["n"])
