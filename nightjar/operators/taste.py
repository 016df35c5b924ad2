"""From play records to weighted taste, per user."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from nightjar.functions.scalars import HALF_LIFE_DAYS, UNDATED_WEIGHT, decay_weight
from nightjar.functions.text import keys_for
from nightjar.operators.corpus import scratch_root
from nightjar.operators.log import BatchLog

# fixed values: shortest play, default length of an untimed play, artists kept, weight floor
MIN_MS, DEFAULT_MS, KEEP, FLOOR = 30_000, 180_000, 600, 0.05


def valid_plays(plays: DataFrame) -> DataFrame:
    """Named plays of half a minute or more; zero lengths stay, as library rows of any length do."""
    name = F.btrim("artist")
    short = (F.col("ms") > 0) & (F.col("ms") < MIN_MS) & (F.coalesce("from", F.lit("")) != "library-artist")
    return plays.filter(name.isNotNull() & (name != "") & (F.length(name) <= 120) & ~F.coalesce(short, F.lit(False))).withColumn("artist", name)


def listening(plays: DataFrame, now: Column, keep: int = KEEP) -> DataFrame:
    """(user_id, name, plays, raw_plays, minutes, last_at, rank): decayed minutes, the heaviest artists first."""
    ms = F.when(F.coalesce("ms", F.lit(0)) == 0, DEFAULT_MS).otherwise(F.col("ms"))
    agg = plays.groupBy("user_id", F.col("artist").alias("name")).agg(
        (F.sum(ms * decay_weight(F.col("at"), now)) / 60_000).alias("plays"),
        F.sum(F.coalesce("plays", F.lit(1))).alias("raw_plays"),
        F.floor(F.sum(F.coalesce("ms", F.lit(0))) / 60_000 + 0.5).alias("minutes"),
        F.max("at").alias("last_at"),
    )
    w = W.partitionBy("user_id").orderBy(F.desc("plays"), "name")
    return agg.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < keep)


def weights(artists: DataFrame) -> DataFrame:
    """Adds ``weight``: root of the share of the top count, or by rank where no artist has a count."""
    top = F.max("plays").over(W.partitionBy("user_id"))
    by_plays = F.greatest(F.lit(FLOOR), F.sqrt(F.coalesce("plays", F.lit(0)) / top))
    return artists.withColumn("weight", F.when(top > 0, by_plays).otherwise(1 / F.log2(F.col("rank") + 2)))


def taste_keys(taste: DataFrame) -> DataFrame:
    """(user_id, key, name, weight, ord): per key the heaviest artist, the first of equals; ``ord`` is the key's first place."""
    keyed = taste.select("user_id", "name", "weight", F.col("rank").alias("place"), F.posexplode(keys_for(F.col("name"))).alias("pos", "key"))
    at = F.struct("place", "pos")
    best = F.min_by(F.struct("name", "weight"), F.struct((-F.col("weight")).alias("w"), at.alias("at")))
    return keyed.groupBy("user_id", "key").agg(best.alias("b"), F.min(at).alias("ord")).select("user_id", "key", "b.name", "b.weight", "ord")


# Running sums: a play's weight falls by the same share for all as time goes by, so sums taken at one fixed time are
# scaled to any other.  Plays after that other time weigh 1 and wait under their own time.
LANDMARK = "2020-01-01 00:00:00"
SUMS = "user_id {user}, name string, waits_at timestamp, decayed double, flat double, raw_plays double, ms double, last_at timestamp"
KEYS = ["user_id", "name", "waits_at"]


def listening_sums(plays: DataFrame, now: Column) -> DataFrame:
    """Sums of valid plays per user and artist that ``merge_sums`` adds up and ``settle_sums`` turns into listening.

    Plays dated after ``now`` stay apart under ``waits_at``; undated ones go to ``flat``.
    """
    ms = F.when(F.coalesce("ms", F.lit(0)) == 0, DEFAULT_MS).otherwise(F.col("ms")).cast("double")
    waits = F.when(F.col("at") > now, F.col("at"))
    told = F.col("at").isNotNull() & waits.isNull()
    return plays.groupBy("user_id", F.col("artist").alias("name"), waits.cast("timestamp").alias("waits_at")).agg(
        F.sum(F.when(told, ms * _since_landmark(F.col("at"))).otherwise(0.0)).alias("decayed"),
        F.sum(F.when(told, 0.0).otherwise(ms)).alias("flat"),
        F.sum(F.coalesce("plays", F.lit(1))).cast("double").alias("raw_plays"),
        F.sum(F.coalesce("ms", F.lit(0))).cast("double").alias("ms"),
        F.max("at").cast("timestamp").alias("last_at"),
    )


def _since_landmark(at: Column) -> Column:
    days = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.lit(LANDMARK).cast("timestamp"))) / 86_400e6
    return F.pow(F.lit(2.0), days / HALF_LIFE_DAYS)


def merge_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("decayed", "flat", "raw_plays", "ms")), F.max("last_at").alias("last_at"))


def ripen_sums(rows: DataFrame, now: Column) -> DataFrame:
    """Sums in which plays that waited for a time up to ``now`` have joined the decayed ones."""
    ripe = F.coalesce(F.col("waits_at") <= now, F.lit(False))
    moved = rows.withColumns({"decayed": F.when(ripe, F.col("decayed") + F.col("flat") * _since_landmark(F.col("waits_at"))).otherwise(F.col("decayed")), "flat": F.when(ripe, 0.0).otherwise(F.col("flat")), "waits_at": F.when(~ripe, F.col("waits_at"))})
    return merge_sums(moved)


def settle_sums(rows: DataFrame, now: Column, keep: int = KEEP) -> DataFrame:
    """The rows of ``listening`` at ``now``, from sums of any batches whose own ``now`` was no later."""
    flat = F.col("flat") * F.when(F.col("waits_at").isNull(), UNDATED_WEIGHT).otherwise(decay_weight(F.col("waits_at"), now))
    agg = rows.groupBy("user_id", "name").agg(
        (F.sum(F.col("decayed") / _since_landmark(now) + flat) / 60_000).alias("plays"), F.sum("raw_plays").alias("raw_plays"), F.floor(F.sum("ms") / 60_000 + 0.5).alias("minutes"), F.max("last_at").alias("last_at")
    )
    w = W.partitionBy("user_id").orderBy(F.desc("plays"), "name")
    return agg.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < keep)


def sums_log(spark: SparkSession, path: str | None = None, user: str = "long") -> BatchLog:
    """A log of sums: each batch of plays adds its own, ``compact`` folds them."""
    return BatchLog(spark, path or f"{scratch_root(spark)}/nightjar-sums-{uuid.uuid4().hex}", SUMS.format(user=user), merge_sums)
