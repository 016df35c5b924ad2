"""Sparse tag vectors and cosines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nightjar.operators.corpus import cut


def unit(rows: DataFrame, entity: list[str], weight: str = "w") -> DataFrame:
    """Rows scaled to unit length per entity; an all-zero entity keeps its rows."""
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(W.partitionBy(*entity)))
    return rows.withColumn(weight, F.col(weight) / F.when(norm == 0, 1.0).otherwise(norm))


def tag_vector(rows: DataFrame, entity: list[str], tag: str = "tag", weight: str = "w") -> DataFrame:
    return unit(rows.groupBy(*entity, tag).agg(F.sum(weight).alias(weight)), entity, weight)


def cosine_pairs(a: DataFrame, b: DataFrame, left: str, right: str, tag: str = "tag", extra: Column | None = None) -> DataFrame:
    """(left, right, cosine) of unit vectors that share a tag."""
    x = a.select(F.col(left).alias("l"), F.col(tag).alias("t"), F.col("w").alias("wl"))
    y = b.select(F.col(right).alias("r"), F.col(tag).alias("t"), F.col("w").alias("wr"))
    both = x.join(y, "t")
    both = both if extra is None else both.filter(extra)
    return both.groupBy("l", "r").agg(F.sum(F.col("wl") * F.col("wr")).alias("cosine"))


#: rows of a tag on the right side that one task should meet
SALT_ROWS = 10_000


def _prefix(rows: DataFrame, ids: list[str], tags: DataFrame, top: str, gate: float) -> DataFrame:
    """(ids, tag, heat, salts): each vector's tags but its hottest ones that can't make a pair pass the gate alone.

    The product over a set of tags is at most the sum of weights times the largest weight on the other side, and at
    most the length of what the vector has on them, as the other side's vectors have length 1.
    """
    hottest_first = W.partitionBy(*ids).orderBy(F.desc("heat"), F.desc("tag")).rowsBetween(W.unboundedPreceding, 0)
    bound = F.least(F.sum(F.col("w") * F.col(top)).over(hottest_first), F.sqrt(F.sum(F.col("w") * F.col("w")).over(hottest_first)))
    return rows.join(tags, "tag").withColumn("bound", bound).filter(F.col("bound") > gate * (1 - 1e-9)).select(*ids, "tag", "salts")


def candidate_pairs(left: DataFrame, right: DataFrame, left_ids: list[str], right_ids: list[str], gate: float, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(left_ids, right_ids), distinct: a superset of the pairs of unit vectors (ids, tag, w > 0) whose product passes ``gate``.

    Tags are put in one order for both sides, the one with the fewest possible pairs first.  The first tag that a
    passing pair shares is in the prefix of both, so only prefixes are indexed and meet.  A tag with
    many rows on the right is split by salt; its left rows go to each part.
    """
    a = left.groupBy("tag").agg(F.count(F.lit(1)).alias("na"), F.max("w").alias("top_left"))
    b = right.groupBy("tag").agg(F.count(F.lit(1)).alias("nb"), F.max("w").alias("top_right"))
    tags = a.join(b, "tag").select("tag", (F.col("na") * F.col("nb")).alias("heat"), "top_left", "top_right", F.ceil(F.col("nb") / salt_rows).cast("int").alias("salts"))
    x = _prefix(left, left_ids, tags, "top_right", gate).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    y = _prefix(right, right_ids, tags, "top_left", gate).withColumn("salt", F.pmod(F.xxhash64(*right_ids), F.col("salts")).cast("int"))
    return x.drop("salts").join(y.drop("salts"), ["tag", "salt"]).select(*left_ids, *right_ids).distinct()


#: rows of one side that a block holds, and products that a task makes at once
BLOCK_ROWS, AT_ONCE = 1 << 21, 4_000_000


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _read(held: pa.Scalar, kind: type | None = None) -> np.ndarray | pa.Table:
    return pa.ipc.open_stream(held.as_buffer()).read_all() if kind is None else np.frombuffer(held.as_buffer(), kind)


def _packed(ids: list[str], by_tag: bool, block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of whole vectors, one row each: ``ids`` and ``tags`` once each, and the block's rows in the order of vectors, or of tags, as
    ``begins`` (where each vector, or tag, has its rows), ``other`` (their tags, or vectors, by number) and ``w``."""

    def block(rows: pa.Table, vector: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(vector, prepend=-1))
        coded = pc.dictionary_encode(rows["tag"].combine_chunks())
        code, w = coded.indices.to_numpy(), rows["w"].to_numpy()
        begins, other = np.append(first, len(vector)), code
        vector = np.repeat(np.arange(len(first)), np.diff(begins))
        if by_tag:
            order = np.argsort(code, kind="stable")
            begins, other, w = np.append(0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))), vector[order], w[order]
        held = [_written(rows.select(ids).take(pa.array(first))), _written(pa.table([coded.dictionary], ["tag"])), *(x.astype(k).tobytes() for x, k in ((begins, "<i4"), (other, "<i4"), (w, "<f8")))]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in held], PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = pa.Table.from_batches(held)
            keys = rows.select(ids).to_pandas()
            begins = (keys != keys.shift()).any(axis=1).to_numpy()
            begins[:1] = True
            vector, starts = np.cumsum(begins) - 1, np.append(np.flatnonzero(begins), size if last else [])
            i = 0  # a block ends before the first vector that would make it too large; the last vector may go on in the next batch
            while i < starts[-1] and (last or starts[-1] - i >= block_rows):
                j = int(starts[max(np.searchsorted(starts, i, "right"), np.searchsorted(starts, i + block_rows, "right") - 1)])
                yield block(rows.slice(i, j - i), vector[i:j])
                i = j
            held, size = rows.slice(i).to_batches(), size - i

        asked = block_rows
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
            if size > asked:
                yield from blocks(False)
                asked = max(block_rows, 2 * size)  # one vector that is larger isn't looked at anew with each batch
        if size:
            yield from blocks(True)

    return run


#: columns of a block
PACKED = ["ids", "tags", "begins", "other", "w"]


def _blocks(rows: DataFrame, ids: list[str], by_tag: bool, block_rows: int) -> DataFrame:
    """``rows`` as blocks (see ``_packed``).  The window brings a vector's rows together; vectors that come together already aren't dealt or sorted anew."""
    whole = rows.withColumn("__whole", F.count(F.lit(1)).over(W.partitionBy(*ids)))  # stays in the rows, or Spark drops the window
    return cut(whole.mapInArrow(_packed(ids, by_tag, block_rows), ", ".join(f"{c} binary" for c in PACKED)))


def _product(gate: float, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of two blocks of vectors whose product is above ``gate``, by numpy."""

    def pair(held: dict[str, pa.Scalar]) -> Iterator[pa.RecordBatch]:
        where = pc.fill_null(pc.index_in(_read(held["xtags"])["tag"].combine_chunks(), value_set=_read(held["ytags"])["tag"].combine_chunks()), -1).to_numpy()
        if where.max(initial=-1) < 0:
            return
        begins, lt, lw = (_read(held[f"x{c}"], k) for c, k in (("begins", "<i4"), ("other", "<i4"), ("w", "<f8")))
        tags, rv, rw = (_read(held[f"y{c}"], k) for c, k in (("begins", "<i4"), ("other", "<i4"), ("w", "<f8")))
        left, right = _read(held["xids"]), _read(held["yids"])
        low, fan = tags[where][lt], np.where(where < 0, 0, np.diff(tags)[where])[lt]
        sums = np.append(0, np.cumsum(fan, dtype=np.int64))
        made, width, i = sums[begins], len(right), 0
        vector, most = np.repeat(np.arange(len(left)), np.diff(begins)), float(rw.max(initial=0.0))
        while i < len(left):  # some whole vectors at a time; one has no more products than the right side has rows
            j = max(i + 1, int(np.searchsorted(made, made[i] + at_once, "right")) - 1)
            at = slice(begins[i], begins[j])
            one = np.repeat(np.arange(at.start, at.stop), fan[at])
            other = low[one] + np.arange(len(one)) - np.repeat(sums[at] - sums[at.start], fan[at])
            pairs = (vector[one] - i) * width + rv[other]
            if (j - i) * width <= 4 * len(pairs):
                total = np.bincount(pairs, lw[one] * rw[other], (j - i) * width)
                pairs = np.arange(len(total))
            else:
                # so many tags must a pair share at least, as no product of two weights is larger
                least = int(gate * (1 - 1e-9) / (float(lw[at].max()) * most)) + 1 if len(pairs) else 1
                if least > 1:
                    ordered = np.sort(pairs)
                    likely = ordered[least - 1 :]
                    likely = likely[likely == ordered[: len(likely)]]
                    at_last = np.minimum(np.searchsorted(likely, pairs), max(0, len(likely) - 1)) if len(likely) else None
                    some = np.flatnonzero(likely[at_last] == pairs) if len(likely) else np.zeros(0, int)
                    one, other, pairs = one[some], other[some], pairs[some]
                pairs, which = np.unique(pairs, return_inverse=True)
                total = np.bincount(which, lw[one] * rw[other], len(pairs))
            keep = total > gate
            if keep.any():
                x, y = np.divmod(pairs[keep], width)
                found = [c.combine_chunks() for t, n in ((left, x + i), (right, y)) for c in t.take(pa.array(n)).columns]
                yield pa.RecordBatch.from_arrays([*found, pa.array(total[keep])], [*left.column_names, *right.column_names, "cosine"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from pair({c: batch.column(c)[k] for c in batch.schema.names})

    return run


def pairs_above(left: DataFrame, right: DataFrame, left_ids: list[str], right_ids: list[str], gate: float, block_rows: int = BLOCK_ROWS, at_once: int = AT_ONCE) -> DataFrame:
    """(left_ids, right_ids, cosine): all pairs of unit vectors (ids, tag, w) whose product is above ``gate``, which is 0 or more.

    Each side is written once as blocks of whole vectors, one row each.  A cross join brings two blocks together by reading them,
    without a shuffle, and products are summed there: only pairs that pass leave it.  So what is written grows with the rows, not with the blocks.
    Zero weights count as absent; negative ones aren't allowed; a vector names a tag once.  Null ids and tags match nothing.
    """
    x, y = (v.select(*ids, "tag", "w").filter("w > 0").dropna(subset=[*ids, "tag"]) for v, ids in ((left, left_ids), (right, right_ids)))
    kind = ", ".join(f"`{c}` {v.schema[c].dataType.simpleString()}" for v, ids in ((x, left_ids), (y, right_ids)) for c in ids)
    x, y = (_blocks(v, ids, by_tag, block_rows).select(*(F.col(c).alias(f"{k}{c}") for c in PACKED)) for v, ids, by_tag, k in ((x, left_ids, False, "x"), (y, right_ids, True, "y")))
    return x.crossJoin(y).mapInArrow(_product(gate, at_once), f"{kind}, cosine double")


def dense_cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
