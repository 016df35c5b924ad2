"""Name lookups: multi-key probes, fuzzy fallback, one hop over similar artists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nightjar.functions.text import fold_name, keys_for, nearly_equal, tribute_stem

# fixed values: shortest probe and key of the fuzzy fallback
FUZZY_PROBE, FUZZY_KEY = 8, 7


def probe(names: DataFrame, index: DataFrame, name: str, on: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Inner join of ``names`` to ``index.key``: each row takes the first of its keys that the index has.

    ``on`` are further equality columns (a user, say).  An equi-join on exploded keys and
    one aggregate with map-side minima.
    """
    on, own = on or [], names.columns
    carry = carry or [c for c in index.columns if c not in [*on, "key"]]
    row = F.monotonically_increasing_id()
    keyed = names.withColumn("__row", row).select(*own, "__row", F.posexplode(keys_for(F.col(name))).alias("__pos", "key"))
    hit = keyed.join(index.select(*on, "key", F.struct(*carry).alias("__hit")), [*on, "key"])
    best = hit.groupBy("__row", *own).agg(F.min_by("__hit", "__pos").alias("__hit"))
    return best.select(*own, "__hit.*")


def deletions(key: Column) -> Column:
    """The key and all its variants with one letter less: keys one edit apart share one."""
    places = F.sequence(F.lit(1), F.length(key))
    cut = F.transform(places, lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))
    return F.array_distinct(F.concat(F.array(key), cut))


def fuzzy(names: DataFrame, index: DataFrame, name: str, on: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """As ``probe`` for names no key of which is known: the first index key one edit away.

    Candidates come from an equi-join on deletion variants, so no pair of unlike names is built.
    """
    on, own = on or [], names.columns
    carry = carry or [c for c in index.columns if c not in [*on, "key", "ord"]]
    folded = names.withColumn("__row", F.monotonically_increasing_id()).withColumn("__fold", fold_name(F.col(name))).filter(F.length("__fold") >= FUZZY_PROBE)
    left = folded.withColumn("__d", F.explode(deletions(F.col("__fold"))))
    right = index.filter(F.length("key") >= FUZZY_KEY).select(*on, F.col("key").alias("__key"), "ord", F.struct(*carry).alias("__hit")).withColumn("__d", F.explode(deletions(F.col("__key"))))
    near = left.join(right, [*on, "__d"]).filter(nearly_equal(F.col("__fold"), F.col("__key")))
    return near.groupBy("__row", *own).agg(F.min_by("__hit", "ord").alias("__hit")).select(*own, "__hit.*")


def taste_hits(names: DataFrame, taste: DataFrame, name: str) -> DataFrame:
    """(user_id, name, via, weight): per user and distinct name the first of its keys that the taste holds, else the first taste key one edit away."""
    held = F.struct(F.col("name").alias("via"), "weight").alias("__held")
    keyed = names.select(name, F.posexplode(keys_for(F.col(name))).alias("__pos", "key")).join(taste.select("user_id", "key", held), "key")
    exact = keyed.groupBy("user_id", name).agg(F.min_by("__held", "__pos").alias("h"))
    # which names are one edit apart is found once for all users
    near = names.withColumn("__fold", fold_name(F.col(name))).filter(F.length("__fold") >= FUZZY_PROBE).select(name, "__fold", F.explode(deletions(F.col("__fold"))).alias("__d"))
    known = taste.filter(F.length("key") >= FUZZY_KEY).select("key").distinct().select("key", F.explode(deletions(F.col("key"))).alias("__d"))
    pairs = near.join(known, "__d").filter(nearly_equal(F.col("__fold"), F.col("key"))).select(name, "key").distinct()
    close = pairs.join(taste.select("user_id", "key", "ord", held), "key").groupBy("user_id", name).agg(F.min_by("__held", "ord").alias("h"))
    return exact.unionByName(close.join(exact, ["user_id", name], "left_anti")).select("user_id", name, "h.via", "h.weight")


def one_hop(names: DataFrame, index: DataFrame, taste: DataFrame, name: str, default: float = 0.6, weight: float = 0.62) -> DataFrame:
    """Per user and name the strongest similar artist of the index that the taste holds, the first of equals."""
    own = names.columns
    known = probe(names, index.select("key", "similar"), name)
    sims = known.select(*own, F.posexplode("similar").alias("__place", "s")).select(*own, "__place", F.col("s.name").alias("sim_name"), F.least(F.lit(1.0), F.coalesce("s.score", F.lit(default))).alias("similarity"))
    hit = sims.join(taste_hits(sims.select("sim_name").distinct(), taste, "sim_name"), "sim_name")
    first = hit.withColumn("strength", F.col("weight") * F.col("similarity") * weight)
    best = first.groupBy("user_id", *own).agg(F.max_by(F.struct("via", "weight", "similarity", "strength"), F.struct("strength", (-F.col("__place")).alias("p"))).alias("b"))
    return best.select("user_id", *own, "b.via", "b.weight", "b.similarity", "b.strength")


def known_tributes(rows: DataFrame, names: DataFrame, title: str, name: str) -> DataFrame:
    """``rows`` with ``of_known``: whether the title is a known name and a tribute suffix. Equal titles are looked up once."""
    stems = rows.select(title).distinct().select(title, F.explode(keys_for(tribute_stem(F.col(title)))).alias("__key"))
    known = names.select(F.explode(keys_for(F.col(name))).alias("__key")).distinct()
    hits = stems.join(known, "__key", "left_semi").select(title).distinct().withColumn("__hit", F.lit(True))
    return rows.join(hits, title, "left").withColumn("of_known", F.coalesce("__hit", F.lit(False))).drop("__hit")
