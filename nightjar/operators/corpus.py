"""Merging, deduplicating and decorating event rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

BROADCAST_BYTES = 32 << 20
#: folders that a task of ``cut`` writes at once; beyond them it sorts its rows
WRITERS = 64
_MADE: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("made", default=None)


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint only if the optimizer's size estimate is below the bound."""
    return F.broadcast(df) if estimate(df) <= BROADCAST_BYTES else df


def estimate(df: DataFrame) -> int:
    """Bytes as the optimizer has it: of a table that was written its files, of a join the product of both sides."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a session in one process that names none gets one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nightjar-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row: a generator stands between them and later filters, which would copy them into each of their terms."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


@contextmanager
def cuts() -> Iterator[None]:
    """Removes the tables that ``cut`` writes within the block when it ends, also by an error.

    What is read after the block must not read them: write it with ``keep`` within the block.
    """
    made: list[tuple[SparkSession, str]] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for spark, path in made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _set(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """A setting of the session within the block; none if ``value`` is None."""
    before = spark.conf.get(key)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None:
            spark.conf.set(key, before)


def cut(df: DataFrame, *by: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the folder that driver and executors share, and read back.

    In folders by the columns ``by``, so that a filter on them reads its own files only; their rows aren't sorted for that, which would spill wide rows.
    Cuts the plan's lineage, and readers take only the columns they need.
    Within ``cuts`` the table goes when that ends, unless ``keep``.
    """
    path, made = f"{scratch_root(df.sparkSession)}/nightjar-cut-{uuid.uuid4().hex}", _MADE.get()
    if made is not None and not keep:
        made.append((df.sparkSession, path))
    with _set(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(WRITERS) if by else None):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def merge_key(venue: str = "venue_id", day: str = "start_date", title: str = "title") -> Column:
    """Same room, same night, same bill."""
    return F.concat_ws("|", venue, F.col(day).cast("string"), F.regexp_replace(F.lower(title), r"\s+", " "))


def first_wins(df: DataFrame, keys: list[str], order: list[Column], late: list[str]) -> DataFrame:
    """The first row of each key; its null or empty ``late`` columns come from the first later row that has them.

    One aggregate with map-side minima instead of a window, so hot keys don't meet in a task.
    """
    rest = [c for c in df.columns if c not in keys and c not in late]
    at = F.struct(*order)
    first = F.min_by(F.struct(*rest), at) if rest else None
    has = {c: F.nullif(F.col(c), F.lit("")) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in late}
    fills = [F.min_by(v, F.when(v.isNotNull(), at)).alias(c) for c, v in has.items()]
    out = df.groupBy(*keys).agg(*([first.alias("__first")] if first is not None else []), *fills, F.count(F.lit(1)).alias("__n"))
    return out.select(*keys, *(["__first.*"] if first is not None else []), *late, (F.col("__n") - 1).alias("duplicates"))


def drop_recurring(df: DataFrame, keys: list[Column], most: int = 5) -> DataFrame:
    """Without all rows of keys that occur ``most`` times or more.

    The counts are pre-aggregated; only recurring keys go into the anti join.
    """
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    keyed = df.withColumns(named)
    often = keyed.groupBy(*named).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= most).drop("__n")
    return keyed.join(often, list(named), "left_anti").drop(*named)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key; of equal versions the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in [*keys, "__new"]]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("__row")).select(*keys, "__row.*")


def stale(names: DataFrame, cache: DataFrame, key: str, checked: str, now: Column, days: int = 90) -> DataFrame:
    """Names without a cache row younger than ``days``."""
    fresh = cache.filter(F.col(checked) > now - F.expr(f"interval {days} days")).select(key)
    return names.join(fresh, key, "left_anti")


def billing_counts(events: DataFrame) -> DataFrame:
    """How often each artist is billed, without tributes and one-letter names."""
    names = events.filter(~F.coalesce("is_tribute", F.lit(False))).select(F.explode("artists").alias("name"))
    return names.filter(F.length("name") >= 2).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def artist_index(artists: DataFrame, position: str) -> DataFrame:
    """One row per folded key; of artists that share a key the last in ``position`` wins."""
    from nightjar.functions.text import keys_for

    rest = [c for c in artists.columns if c != position]
    keyed = artists.select(F.explode(keys_for(F.col("name"))).alias("key"), F.struct(*rest).alias("row"), position)
    return keyed.groupBy("key").agg(F.max_by("row", position).alias("row")).select("key", "row.*")


def require_rows(df: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Fail on an empty output."""
    if not allow_empty and df.isEmpty():
        raise ValueError("no rows: refusing to write an empty output")
    return df
