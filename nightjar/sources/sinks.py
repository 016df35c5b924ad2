"""Writing corpora, served projections and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from nightjar.operators.corpus import require_rows

PAGE_LIMIT = 6_000_000
KEEP_BODIES, BODY_CHARS = 3, 120_000


def write_corpus(events: DataFrame, path: str, allow_empty: bool = False) -> None:
    """Sorted by day and, in the Unicode collation, title; an empty corpus is refused."""
    require_rows(events, allow_empty).orderBy("start_date", F.collate("title", "UNICODE")).write.mode("overwrite").json(path)


def slim(events: DataFrame) -> DataFrame:
    """The served columns as one JSON text per event, safe inside a script tag."""
    keep = [c for c in ("id", "title", "artists", "start_date", "start_time", "venue_id", "venue_name", "city", "country", "size_class", "url", "ticket_url", "price", "tags", "is_tribute") if c in events.columns]
    return events.select(F.replace(F.to_json(F.struct(*keep)), F.lit("<"), F.lit("\\u003c")).alias("json"))


def guarded_size(rows: DataFrame, limit: int = PAGE_LIMIT) -> int:
    """Bytes of a served projection; more than ``limit`` is an error."""
    size = rows.agg(F.sum(F.octet_length("json") + 1)).first()[0] or 0
    if size > limit:
        raise ValueError(f"served page would take {size} bytes; the limit is {limit}")
    return size


def prune_bodies(bodies: DataFrame) -> DataFrame:
    """The three richest bodies of each host, cut to 120,000 characters."""
    w = W.partitionBy("host").orderBy(F.desc("events"), F.desc("is_json"), F.desc("bytes"), "url")
    return bodies.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= KEEP_BODIES).withColumn("body", F.substring("body", 1, BODY_CHARS)).drop("r")
