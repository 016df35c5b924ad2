"""When a polite client may send each of its requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nightjar.operators.corpus import cut

# fixed values: least gap between requests of a host in ms, retries, waits before them after a busy answer and after none
GAP_MS, RETRIES, BUSY_MS, LOST_MS = 700, 2, 2000, 1500


def request_ms(answers: Column) -> Column:
    """Time that a request takes with its retries: ``answers`` is an array of (status, ms) of its attempts, status null where none came.

    Tried again, twice at most, after 429, 5xx or no answer; an attempt's wait grows with its number. Attempts after a final answer don't count.
    """
    lost = lambda a: a["status"].isNull()
    again = lambda a: lost(a) | (a["status"] == 429) | (a["status"] >= 500)
    start = F.struct(F.lit(0).cast("long").alias("ms"), F.lit(0).alias("n"), F.lit(True).alias("more"))

    def step(acc: Column, a: Column) -> Column:
        n = acc["n"] + 1
        more = again(a) & (n <= RETRIES)
        wait = F.when(more, n * F.when(lost(a), LOST_MS).otherwise(BUSY_MS)).otherwise(0)
        return F.when(acc["more"], F.struct((acc["ms"] + a["ms"] + wait).cast("long").alias("ms"), n.alias("n"), more.alias("more"))).otherwise(acc)

    return F.aggregate(F.coalesce(answers, F.array().cast("array<struct<status:int,ms:bigint>>")), start, step)["ms"]


def polite_schedule(requests: DataFrame, order: list[str], host: str = "host", arrives: str = "arrives", takes: str = "takes", gap: str = "gap") -> DataFrame:
    """``requests`` with ``starts`` and ``ends`` in ms: one at a time for each host, in the order of ``arrives`` and ``order``.

    A request starts when it has arrived and ``gap`` ms (700 at least, also for null) have passed since the one before it ended; a host's first starts as it arrives.
    Null ``arrives`` and ``takes`` count as 0; a null host is a host.  ``order`` must make rows unique, or equal ones stand in any order.

    ends(k) = max(arrives(k) + takes(k), ends(k-1) + gap(k) + takes(k)) is a prefix scan in (max, +).  Rows are dealt to
    blocks by ranges of host, time and order, so a hot host is many blocks; each block is scanned by itself, hosts are
    scanned over one row a block, and a block's rows take over what its predecessors end at.
    """
    c = [F.coalesce(F.col(x).cast("long"), F.lit(0).cast("long")) for x in (arrives, takes)]
    r = requests.withColumns({"__a": c[0], "__d": c[1], "__g": F.greatest(F.coalesce(F.col(gap).cast("long"), F.lit(GAP_MS)), F.lit(GAP_MS).cast("long"))})
    r = cut(r.repartitionByRange(host, "__a", *order).withColumn("__block", F.spark_partition_id()))  # written, so that blocks stay what they are if tasks run again
    at = [F.col("__a"), *map(F.col, order)]
    w = W.partitionBy(host, "__block").orderBy(*at).rowsBetween(W.unboundedPreceding, 0)
    local = r.withColumn("__sum", F.sum(F.col("__g") + F.col("__d")).over(w)).withColumn("__best", F.max(F.col("__a") + F.col("__d") - F.col("__sum")).over(w))
    blocks = block_starts(local, host)
    out = local.join(blocks, local[host].eqNullSafe(blocks["__host"]) & (local["__block"] == blocks["__b"]), "left")
    ends = F.col("__sum") + F.greatest("__best", "__before")
    return out.withColumn("ends", ends).withColumn("starts", F.col("ends") - F.col("__d")).select(*requests.columns, "starts", "ends")


def block_starts(local: DataFrame, host: str) -> DataFrame:
    """(__host, __b, __before): where the blocks before a block end; null for a host's first."""
    s = local.groupBy(F.col(host).alias("__host"), F.col("__block").alias("__b")).agg(F.max("__sum").alias("__total"), F.max("__best").alias("__peak"))
    w = W.partitionBy("__host").orderBy("__b")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("__t", F.sum("__total").over(upto)).withColumn("__e", F.col("__t") + F.max(F.col("__peak") - (F.col("__t") - F.col("__total"))).over(upto))
    return s.select("__host", "__b", F.lag("__e").over(w).alias("__before"))
