"""Whether lists of picks keep their promises: labels, caps and variety, one row for each check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nightjar.functions.text import fold_name, looks_like_tribute

# fixed values: picks shown, picks at one venue, least explanation, and picks from which that many months are asked for
CAP, PER_VENUE, SAID, MONTHS = 12, 3, 3, 4


def judge(picks: DataFrame, labels: DataFrame, playing: DataFrame, today: Column) -> DataFrame:
    """(user_id, check, name, passed) for each labelled user; ``name`` is the artist of a label, else null.

    ``picks``: user_id, title, artists, venue_id, start_date, why, is_tribute.  ``labels``: user_id (unique), must_appear, must_not_appear (arrays of
    names), min_picks, max_picks, should_be_short; null asks for nothing.  ``playing``: artist names of the corpus (``artist``); a name
    that must appear but isn't playing passes.  A user without picks keeps all promises but ``at-least`` and names that must appear.
    Names are compared folded; names repeated in a label are checked once.
    """
    acts = picks.select("user_id", F.explode("artists").alias("artist")).select("user_id", fold_name(F.col("artist")).alias("act")).distinct()
    tribute = F.coalesce("is_tribute", F.lit(False)) | F.coalesce(looks_like_tribute(F.col("title")), F.lit(False))
    said = F.coalesce(F.length("why") > SAID, F.lit(False))
    past = F.coalesce(F.col("start_date") < today, F.lit(False))
    whole = picks.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~said).alias("silent"), F.count_if(tribute).alias("tributes"), F.count_if(past).alias("past"), F.countDistinct(F.date_format("start_date", "yyyy-MM")).alias("months"))
    venues = picks.filter("venue_id IS NOT NULL").groupBy("user_id", "venue_id").agg(F.count(F.lit(1)).alias("v")).groupBy("user_id").agg(F.max("v").alias("at_venue"))
    apart = acts.groupBy("user_id").agg(F.count(F.lit(1)).alias("acts"))
    counted = ["n", "silent", "tributes", "past", "months", "at_venue", "acts"]
    of = labels.join(whole, "user_id", "left").join(venues, "user_id", "left").join(apart, "user_id", "left").fillna(0, counted)
    n = F.col("n")
    checks = {
        "cap": n <= CAP, "artist-twice": F.col("acts") >= n, "venue": F.col("at_venue") <= PER_VENUE, "says-why": F.col("silent") == 0, "no-tributes": F.col("tributes") == 0, "not-past": F.col("past") == 0,
        "at-least": n >= F.col("min_picks"), "at-most": n <= F.col("max_picks"), "short": F.when(F.col("should_be_short"), n < CAP), "months": F.when(n >= MONTHS, F.col("months") >= MONTHS),
    }
    rows = of.select("user_id", F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(None).cast("string").alias("name"), c.alias("passed")) for k, c in checks.items()))).alias("c")).select("user_id", "c.*").filter("passed IS NOT NULL")

    def named(column: str) -> DataFrame:
        return labels.select("user_id", F.explode(F.array_distinct(column)).alias("name")).filter("name IS NOT NULL").withColumn("act", fold_name(F.col("name")))

    heard = acts.withColumn("picked", F.lit(True))
    known = playing.select(fold_name(F.col("artist")).alias("act")).distinct().withColumn("plays", F.lit(True))
    must = named("must_appear").join(heard, ["user_id", "act"], "left").join(known, "act", "left").select("user_id", F.lit("must-appear").alias("check"), "name", (F.col("plays").isNull() | F.col("picked").isNotNull()).alias("passed"))
    never = named("must_not_appear").join(heard, ["user_id", "act"], "left").select("user_id", F.lit("must-not-appear").alias("check"), "name", F.col("picked").isNull().alias("passed"))
    return rows.unionByName(must).unionByName(never)
