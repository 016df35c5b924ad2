"""Uniform shuffle into shards of exact size (operator 10).

Every chunk of the input gets a row of a communication matrix: how many of its rows
go to each shard.  The matrix is drawn from the multivariate hypergeometric law, so
that permuting each chunk locally, sending the drawn counts and permuting every shard
again is a uniform random permutation whose shard sizes are exact.  A chunk is the
runs of RUN_ROWS rows of input partitions that hash to it; there are at most
MAX_CHUNKS chunks and MAX_CELLS cells however many partitions and shards there are,
and nothing else reaches the driver.  Rows move once to their chunk and once to their
shard, as narrow digests.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import Scratch

MAX_CHUNKS, MAX_CELLS = 20_000, 2_000_000
CHUNK_ROWS, RUN_ROWS, BUCKET_ROWS = 2_048, 256, 2_048
_NUMPY_LIMIT = 10**9 - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Draws of the first kind among ``n`` from ``good + bad``, exact at any size.

    Beyond numpy's limit the law is inverted, walking outwards from its mode.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad <= _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    peak = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u = rng.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up, u = up + 1, u - p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down, u = down - 1, u - p_down
            if u <= 0:
                return down
    return mode


def chunk_count(rows: int, n_shards: int) -> int:
    """Chunks of about CHUNK_ROWS rows, but never more than MAX_CHUNKS or a matrix of MAX_CELLS."""
    return max(1, min(MAX_CHUNKS, MAX_CELLS // n_shards, -(-rows // CHUNK_ROWS)))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """A random matrix with row sums ``rows`` and column sums ``shards``."""
    if sum(rows) != sum(shards):
        raise ValueError("row and shard sizes differ in total")
    rng = np.random.Generator(np.random.PCG64(seed))
    left = [int(s) for s in shards]
    out = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for i, need in enumerate(rows):
        rest = sum(left)
        for j, room in enumerate(left):
            take = hypergeometric(rng, room, rest - room, need)
            out[i, j] = take
            rest -= room
            left[j] -= take
            need -= take
    return out


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, seed: int = 20_240) -> DataFrame:
    """Deal every row of ``docs`` into shards whose counts differ by one at most.

    Returns id, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``law`` ('rows'),
    ``shard``, ``slot`` (gapless from 0 in a shard) and ``grown_shard`` (null).

    Null text counts as empty: size 1, crc 0.  A null id is a value like any
    other.  Repeated rows are separate rows with slots of their own.  An empty
    table gives an empty result.  Columns other than the two named are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("spot"))
    with Scratch(spark, "sharding") as scratch:
        # kept, as the result is read from it: spots must not be numbered anew
        base = scratch.write(rows, "rows", keep=True)
    total = base.count()
    chunks = chunk_count(total, n_shards)
    run = F.struct(F.shiftright("spot", 33), F.floor(F.col("spot").bitwiseAND(F.lit((1 << 33) - 1)) / RUN_ROWS))
    base = base.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), run), F.lit(chunks)))

    counts = dict(base.groupBy("chunk").count().collect())  # one row for each chunk: MAX_CHUNKS at most
    sizes = [total // n_shards + (i < total % n_shards) for i in range(n_shards)]
    order = sorted(counts)
    matrix = communication_matrix([counts[c] for c in order], sizes, seed)
    bounds = spark.createDataFrame([(c, [int(x) for x in np.cumsum(m)]) for c, m in zip(order, matrix, strict=True)], "chunk long, upto array<long>")

    # first permutation, within a chunk; the matrix row turns ranks into shards
    local = W.partitionBy("chunk").orderBy(F.xxhash64(F.lit(seed), "spot"), "spot")
    dealt = (
        base.withColumn("rank", F.row_number().over(local).cast("long"))
        .join(F.broadcast(bounds), "chunk")  # at most MAX_CELLS numbers
        .withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("rank"))))
    )
    # second permutation: a random bucket of the shard, then a random order in it
    buckets = max(1, -(-total // (n_shards * BUCKET_ROWS)))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "spot"), F.lit(buckets))).select("id", "size", "crc", "spot", "shard", "bucket")
    ahead = (
        dealt.groupBy("shard", "bucket")
        .count()
        .withColumn("ahead", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("shard", "bucket", "ahead")
    )
    order = W.partitionBy("shard", "bucket").orderBy(F.xxhash64(F.lit(seed + 2), "spot"), "spot")
    return (
        dealt.withColumn("rank", F.row_number().over(order))
        .join(ahead, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("rows").alias("law"),
            "shard",
            (F.col("ahead") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
