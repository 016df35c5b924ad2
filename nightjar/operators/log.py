"""Tables kept as a log of committed batches, for caches and running sums that outlive a run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightjar.operators.corpus import cut, scratch_root

COMMIT = "number long, batch string, folder string, base boolean"


class BatchLog:
    """Rows of committed batches below ``path``, merged by ``merge`` when they are read.

    A batch is first written to a folder of its own, then named in the log by one small file that
    appears at once, so a run that is cut leaves either the whole batch or none of it; folders
    that the log doesn't name are never read.  A batch whose id has been committed is left out, so
    that a stream may send it again.  ``compact`` commits the merged rows as a new base, and later
    reads start there.  One writer at a time; readers may be many.

    An empty log reads as no rows; empty batches are committed like others; null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge

    def commits(self) -> DataFrame:
        """(number, batch, folder, base) of all commits."""
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.path}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT)

    def _live(self) -> list:
        """The last base and what follows it: as many rows as batches since the last compaction."""
        all_ = self.commits()
        since = all_.filter("base").agg(F.coalesce(F.max("number"), F.lit(-1)).alias("since"))
        return all_.join(F.broadcast(since), F.col("number") >= F.col("since")).orderBy("number").collect()  # one row is broadcast

    def committed(self, batch: str) -> bool:
        return not self.commits().filter(F.col("batch") == batch).isEmpty()

    def write(self, rows: DataFrame) -> str:
        """Write a batch's rows without committing them; the folder's name."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, folder: str, batch: str, base: bool = False) -> None:
        last = self.commits().agg(F.coalesce(F.max("number"), F.lit(-1)).alias("n")).first()["n"]
        self.spark.createDataFrame([(last + 1, batch, folder, base)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def add(self, rows: DataFrame, batch: str | int | None = None) -> bool:
        """Write and commit a batch; false, with nothing done, if a batch of that id has been committed."""
        name = uuid.uuid4().hex if batch is None else str(batch)
        if batch is not None and self.committed(name):
            return False
        self.commit(self.write(rows), name)
        return True

    def read(self) -> DataFrame:
        live = self._live()
        if not live:
            return self.merge(self.spark.createDataFrame([], self.schema).withColumn("__n", F.lit(0).cast("long")))
        batches = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{c['folder']}").withColumn("__n", F.lit(c["number"])) for c in live]
        rows = batches[0]
        for b in batches[1:]:
            rows = rows.unionByName(b)
        return self.merge(rows)

    def compact(self, settle: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Commit the merged rows, changed by ``settle`` if given, as the base of later reads."""
        rows = self.read()
        self.commit(self.write(settle(rows) if settle else rows), f"base-{uuid.uuid4().hex}", base=True)


def latest(keys: list[str], version: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps the row of the highest version of each key; of equal versions the later batch's."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "__n")]
        best = F.max_by(F.struct(*rest), F.struct(version, "__n", *(c for c in rest if c != version))) if rest else None
        return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")

    return merge


CACHE = "key string, name string, checked_at timestamp, not_found boolean, mbid string, country string, tags array<struct<name:string,count:int>>, similar array<struct<name:string,score:double>>"


def artist_cache(spark: SparkSession, path: str | None = None) -> BatchLog:
    """The lookups' cache: one row per folded name.  Without a path it lies in a new scratch folder."""
    return BatchLog(spark, path or f"{scratch_root(spark)}/nightjar-cache-{uuid.uuid4().hex}", CACHE, latest(["key"], "checked_at"))


def enrichment_todo(billings: DataFrame, cache: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """(key, name, n): names (``name``, ``n``) without a fresh cache row, one per folded key: the most billed spelling, the first of equals.

    Names that fold to nothing are left out: there is nothing to look up.
    """
    from nightjar.functions.text import fold_name

    named = billings.select(fold_name(F.col("name")).alias("key"), "name", "n").filter("key != ''")
    one = named.groupBy("key").agg(F.min_by(F.struct("name", "n"), F.struct((-F.col("n")).alias("less"), "name")).alias("b")).select("key", "b.name", "b.n")
    fresh = cache.filter(F.col("checked_at") > now - F.expr(f"interval {days} days")).select("key")
    return one.join(fresh, "key", "left_anti")


def enrich(log: BatchLog, billings: DataFrame, look_up: Callable[[DataFrame], DataFrame], now: Column, batch_rows: int, budget: int | None = None, most_batches: int | None = None, every: int = 8) -> int:
    """Look names up, the most billed first, and commit each batch of ``batch_rows``; how many were looked up.

    What has been committed is fresh, so a run that was cut is resumed by calling this again.  ``look_up`` takes (key, name)
    and returns rows of the cache without ``checked_at``; a name without an answer becomes ``not_found``.
    ``budget`` names at most, ``most_batches`` batches at most; the log is compacted after each ``every`` batches.
    """
    done, batches = 0, 0
    while (budget is None or done < budget) and (most_batches is None or batches < most_batches):
        take = batch_rows if budget is None else min(batch_rows, budget - done)
        todo = enrichment_todo(billings, log.read(), now).orderBy(F.desc("n"), "name").limit(take)
        todo = cut(todo.select("key", "name"))  # the answers' join reads the very names that were chosen
        n = todo.count()
        if n == 0:
            break
        found = look_up(todo).drop("name", "checked_at", "not_found")
        rows = todo.join(found.withColumn("__hit", F.lit(True)), "key", "left").withColumns({"checked_at": now, "not_found": F.col("__hit").isNull()})
        log.add(rows.select("key", "name", F.col("checked_at").cast("timestamp"), "not_found", "mbid", "country", "tags", "similar"))
        done, batches = done + n, batches + 1
        if batches % every == 0:
            log.compact()
    return done
