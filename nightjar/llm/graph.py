"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Scratch


def _to_minimum(pairs: DataFrame, low: DataFrame) -> DataFrame:
    return pairs.join(low, "u").filter(F.col("v") != F.col("m")).select("v", "m").distinct()


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, m): every node that isn't the least of its component, with that least node.

    ``edges`` has long columns u and v in either order; loops are ignored.  Only
    minima are gathered per node, in a map-side combined aggregate, so a hub costs a
    task no more than its share of rows.
    """
    e = scratch.write(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("m")).filter("v != m").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(e.select(F.col("m").alias("u"), "v"))
        low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = _to_minimum(both.filter("v > u"), low)  # larger neighbours go to the minimum
        down = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = scratch.write(down, "large")
        least = scratch.write(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _to_minimum(down, least).unionByName(least.select(F.col("u").alias("v"), "m")).filter("v != m").distinct()
        e = scratch.write(small.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")).distinct(), "edges")
        state = tuple(e.agg(F.count("v"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if state == before:
            return e
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
