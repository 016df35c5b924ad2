"""Benchmark decontamination by a broadcast hash set of n-grams (operator 7).

Items become windows of ``n`` normalised words.  One pass over the documents hashes
each word once, and at every word position the words from there on, for each length
that a window has.  The hashes are probed against the set of the windows' hashes, which
is broadcast if its counted size is at most ``BROADCAST_ROWS``; beyond that
only (document, place, hash) is shuffled to meet it.  What is left is verified
by a SHA-256 of the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .linededup import LOWER, UPPER
from .shared import Scratch

BROADCAST_ROWS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; an empty array for null or wordless text."""
    split = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.filter(split, lambda w: w != "")


def _hash(hashes: Column, start: Column, n: int) -> Column:
    """Hash of ``n`` words from the 0-based ``start``, given the words' hashes."""
    return F.xxhash64(F.lit(n), *[F.get(hashes, start + i) for i in range(n)])


def _gram(array: Column, start: Column, n: Column | int) -> Column:
    """Words hold no blanks, so the joined words name a window.

    It is never null by its form, else a test for nulls would be pushed below the probe and
    take the digest of every place.
    """
    return F.coalesce(F.sha2(F.array_join(F.slice(array, start + 1, n), " "), 256), F.lit(""))


def item_windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item_id, len, hash, gram_id): all windows of ``n`` words; a shorter item is one window."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.select("item_id", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"), F.least(F.size("w"), F.lit(n)).alias("len"))
    at = w.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("at"))
    hashes = F.coalesce(*[F.when(F.col("len") == k, _hash(F.col("wh"), F.col("at"), k)) for k in range(1, n + 1)])
    return at.select("item_id", "len", hashes.alias("hash"), _gram(F.col("w"), F.col("at"), F.col("len")).alias("gram_id")).distinct()


def hits(scratch: Scratch, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Verified occurrences (id, text_hash, at, len, gram_id), and whose the windows are (gram_id, item_id)."""
    owners = scratch.write(item_windows(items, item_id_col, item_text_col, n), "windows")
    hashes, known = owners.select("hash").distinct(), owners.select(F.col("gram_id").alias("known")).distinct()
    lengths = sorted(r["len"] for r in owners.select("len").distinct().collect())  # n values at most
    small = hashes.count() <= BROADCAST_ROWS
    base = docs.select(F.struct(F.col(id_col).alias("v")).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), words(F.col(text_col)).alias("w"))
    if not lengths:
        return base.select("id", "text_hash", F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit("").alias("gram_id")).limit(0), owners.select("gram_id", "item_id")
    spots = base.select("id", "text_hash", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    # no filter on the number of words: it would split every text once more
    spots = spots.select("*", F.explode(F.when(F.size("w") >= lengths[0], F.sequence(F.lit(0), F.size("w") - lengths[0]))).alias("at"))
    tries = [F.struct(F.lit(k).alias("len"), _hash(F.col("wh"), F.col("at"), k).alias("hash")) for k in lengths]
    if len(tries) == 1:
        spots = spots.select("id", "text_hash", "w", "at", F.lit(lengths[0]).alias("len"), tries[0]["hash"].alias("hash"))
    else:
        spots = spots.select("id", "text_hash", "w", "at", F.inline(F.array(*tries)))
    if small:
        likely = spots.join(F.broadcast(hashes), "hash").select("id", "text_hash", "w", "at", "len")
    else:
        narrow = spots.select("id", "text_hash", "at", "len", "hash").join(hashes, "hash", "left_semi")
        places = narrow.groupBy("id", "text_hash").agg(F.collect_set(F.struct("at", "len")).alias("places"))  # within one document
        likely = base.join(places, ["id", "text_hash"]).select("id", "text_hash", "w", F.inline("places"))
    # a window that runs over the document's end is cut short, and its hash is of nulls
    likely = likely.filter(F.col("at") + F.col("len") <= F.size("w")).select("id", "text_hash", "at", "len", _gram(F.col("w"), F.col("at"), F.col("len")).alias("gram_id"))
    found = likely.join(F.broadcast(known) if small else known, F.col("gram_id") == F.col("known"), "left_semi").distinct()
    return found, owners.select("gram_id", "item_id").distinct()


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids), ``spans``, ``contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window; ``spans`` are
    the maximal runs of such words as (start, length), 0-based.  Null, empty or
    wordless texts have no words and no hits; wordless items have no windows.
    Repeated rows get equal reports.  An empty benchmark hits nothing.
    """
    with Scratch(docs.sparkSession, "windows") as scratch:
        found, owners = hits(scratch, docs, items, id_col, text_col, item_id_col, item_text_col, n)
        found, owners = scratch.write(found, "hits", keep=True), scratch.write(owners, "owners", keep=True)
    key = ["id", "text_hash"]
    end = F.col("at") + F.col("len")
    order = W.partitionBy(*key).orderBy("at", "len")
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = (
        found.select(*key, "at", "len")
        .distinct()
        .withColumn("upto", before)
        .withColumn("run", F.sum(F.when(F.col("upto") >= F.col("at"), 0).otherwise(1)).over(order))
        .groupBy(*key, "run")
        .agg(F.min("at").alias("at"), F.max(end).alias("end"))
        .groupBy(*key)
        .agg(F.sum(F.col("end") - F.col("at")).alias("n_hit"), F.array_sort(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("end") - F.col("at")).alias("length")))).alias("spans"))
    )
    named = (
        found.select(*key, "gram_id").distinct().join(owners, "gram_id").select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    both = runs.join(named, key)
    base = docs.select(F.struct(F.col(id_col).alias("v")).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    return base.join(both, key, "left").select(
        F.col("id.v").alias(id_col),
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay as they are."""
    with Scratch(docs.sparkSession, "windows") as scratch:
        found, _ = hits(scratch, docs, items, id_col, text_col, **named)
        bad = scratch.write(found.select(F.col("id").alias("__nj_id"), F.col("text_hash").alias("__nj_hash")).distinct(), "bad", keep=True)
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, (F.struct(F.col(id_col).alias("v")) == F.col("__nj_id")) & (own == F.col("__nj_hash")), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """Documents with the hit words cut out: id, ``clean`` (kept normalised words, joined by blanks), ``n_hit``."""
    spans = report(docs, items, id_col, text_col, **named).select(F.struct(F.col(id_col).alias("v")).alias("id"), F.col("text_hash").alias("hash"), "spans", "n_hit").distinct()
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = docs.select(F.col(id_col).alias("__nj_id"), own.alias("__nj_hash"), words(F.col(text_col)).alias("w"))
    both = base.join(spans, (F.struct(F.col("__nj_id").alias("v")) == F.col("id")) & (F.col("__nj_hash") == F.col("hash")))
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    kept = F.array_except(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>")), hit)
    return both.select(F.col("__nj_id").alias(id_col), F.array_join(F.transform(kept, lambda i: F.get(F.col("w"), i)), " ").alias("clean"), "n_hit")
