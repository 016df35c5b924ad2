"""Packing documents into sequences of bounded length (operator 5).

Documents are encoded once; only piece lengths matter afterwards.  Longer ones
are cut so that all pieces but the first are full, and a full piece is a sequence
by itself.  The rest is bin packing over a histogram of at most ``capacity - 1``
lengths, solved on the driver: large lengths are rounded up within groups of equal
cardinality (linear grouping), the rounded problem is solved over configurations
by column generation, actual lengths are put in for the rounded ones, and what is
left, small lengths and the odd large one, goes best-fit, longest first.  This is planned with
several bounds of what is large, until a plan is proven to be near the least there can be; the
one with the fewest sequences is taken.  Plain best fit only serves as a check.  The plan is runs of equal
sequences, and each piece finds its place by the rank it has among the pieces of its length.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from . import tokens
from .shared import Scratch

#: shares of the capacity over which a length is large, with the number of groups: the more pieces a sequence
#: may hold, the fewer groups, as their configurations are many
BOUNDS = ((0.48, 640), (0.32, 400), (0.19, 240), (0.09, 115))
#: how near to the proven bound ends the search
GAP = 5e-4


class Plan(NamedTuple):
    """Runs (how many, lengths) of equal sequences, how many hold a configuration's pieces, and how few sequences there must be."""

    runs: list[tuple[int, list[int]]]
    grouped: int
    least: int

    @property
    def made(self) -> int:
        return sum(n for n, _ in self.runs)


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(part, uid, id, piece, start, length, crc, rank): rank counts a part's pieces of that length."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, seen = pyspark.TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows, ids, at in tokens.encoded(batch, "text", path, end_id):
                n = np.diff(at)
                k = -(-n // capacity)
                first = n - (k - 1) * capacity
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                low = at[:-1][doc] + start
                crc = np.fromiter((zlib.crc32(ids[s:e]) for s, e in zip(low, low + length, strict=True)), np.int64, len(doc))
                order = np.argsort(length, kind="stable")
                sizes = length[order]
                new = np.flatnonzero(np.diff(sizes, prepend=-1))
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc)))) + seen[sizes]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), pa.array((np.int64(part) << 36) + made + np.arange(len(doc))), rows.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(rank)],
                    ["part", "uid", "id", "piece", "start", "length", "crc", "rank"],
                )
                made += len(doc)

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("uid", T.LongType()), T.StructField("id", kind), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "crc", "rank")])
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the largest value: a knapsack in which pieces may repeat."""
    best = np.zeros(capacity + 1)
    for s, v in zip(sizes.tolist(), value.tolist(), strict=True):
        if v > 0:
            for at in range(s, capacity + 1, s):  # a stretch of ``s`` builds on the one before
                stretch = best[at : at + s]
                np.maximum(stretch, best[at - s : at - s + len(stretch)] + v, out=stretch)
    column, c = np.zeros(len(sizes)), capacity
    while best[c] > 1e-12:
        j = int(np.where(sizes <= c, best[np.maximum(c - sizes, 0)] + value, -1).argmax())
        column[j] += 1
        c -= int(sizes[j])
    return float(best[capacity]), column


def configurations(sizes: list[int], needs: list[int], capacity: int, gap: float = 5e-4, rounds: int | None = None) -> list[tuple[float, np.ndarray]]:
    """``solve`` without its bound."""
    return solve(sizes, needs, capacity, gap, rounds)[0]


def solve(sizes: list[int], needs: list[int], capacity: int, gap: float = 5e-4, rounds: int | None = None) -> tuple[list[tuple[float, np.ndarray]], float]:
    """A basic solution of the fractional cutting-stock problem, by column generation, and a lower bound of all solutions.

    It ends at the optimum, or when the bound that the duals give shows that it is within ``gap``
    of it or can't save a whole sequence; if it has to end after ``rounds`` (by default 16 for each
    size, and 400), it warns.
    """
    size = np.array(sizes)
    need = np.array(needs, float) + 1e-5 * np.arange(1, len(sizes) + 1) / len(sizes)  # equal ratios would let it go in circles
    basis = np.diag((capacity // size).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x, bound = inverse @ need, 0.0
    rounds = 16 * len(sizes) + 400 if rounds is None else rounds
    for turn in range(rounds):
        value, column = best_configuration(size, inverse.sum(0), capacity)
        bound = max(bound, x.sum() / value)  # the duals over ``value`` are feasible
        if x.sum() <= (1 + gap) * bound or np.ceil(x.sum() - 1e-3) <= np.ceil(bound - 1e-3):
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if turn % 64 == 63:  # one Newton step, so that errors don't add up
            inverse = inverse @ (2 * np.eye(len(size)) - basis @ inverse)
        x = np.maximum(inverse @ need, 0)
    else:
        warnings.warn(f"column generation ended after {rounds} rounds, {x.sum() / bound - 1:.2%} from its bound", stacklevel=2)
    return [(float(v), basis[:, j].astype(int)) for j, v in enumerate(x)], float(bound)


def pack_histogram(counts: dict[int, int], capacity: int, bounds: tuple[tuple[float, int], ...] = BOUNDS) -> list[tuple[int, list[int]]]:
    """Runs (how many, lengths) of equal sequences that hold every piece of the histogram once."""
    return best_plan(counts, capacity, bounds).runs


def best_plan(counts: dict[int, int], capacity: int, bounds: tuple[tuple[float, int], ...] = BOUNDS) -> Plan:
    """The plan with the fewest sequences over ``bounds``, by linear grouping each.

    A plan within ``GAP`` of what the configurations and the sum of lengths prove to be needed ends the
    search.  Plain best fit is planned too, as a check: it is taken only if it needs fewer than all of them.
    """
    least, best = -(-sum(s * n for s, n in counts.items()) // capacity), None
    for small, groups in bounds:
        plan = grouped_plan(counts, capacity, groups, small)
        least = max(least, plan.least)
        if best is None or plan.made < best.made:
            best = plan
        if best.made <= (1 + GAP) * least:
            break
    plain = grouped_plan(counts, capacity, 1, 1.0)
    return (plain if best is None or plain.made < best.made else best)._replace(least=least)


def plan_histogram(counts: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[int, list[int]]]:
    """Runs of ``grouped_plan``."""
    return grouped_plan(counts, capacity, groups, small).runs


def grouped_plan(counts: dict[int, int], capacity: int, groups: int, small: float) -> Plan:
    """A plan with lengths over ``small`` of the capacity in the grouping; with 1 all is best fit.

    Rounding up costs no more than one group's pieces, so all plans need the configurations' bound less one group.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted((s for s in left if s > capacity * small), reverse=True)
    total = sum(left[s] for s in large)
    runs: list[tuple[int, list[int]]] = []
    least = 0
    if total:
        # groups of equal cardinality, longest first; the longest length of each stands for it
        step, pools, at = max(1, -(-total // groups)), [], 0
        if len(large) <= groups:  # few lengths need no rounding
            pools, large, step = [[[s, left[s]]] for s in large], [], 0
        for s in large:
            n = left[s]
            while n:
                if at % step == 0:
                    pools.append([])
                take = min(n, step - at % step)
                pools[-1].append([s, take])
                at, n = at + take, n - take
        sizes, needs = [p[0][0] for p in pools], [sum(n for _, n in p) for p in pools]
        merged: dict[int, list[int]] = {}  # groups that round to one length are one
        for i, s in enumerate(sizes):
            merged.setdefault(s, []).append(i)
        pools = [[x for i in g for x in pools[i]] for g in merged.values()]
        needs = [sum(needs[i] for i in g) for g in merged.values()]
        found, bound = solve(list(merged), needs, capacity)
        least = max(0, int(np.ceil(bound - step - 0.01)))  # the needs are a little larger than they are
        for amount, column in found:
            todo = int(amount + 1e-9)
            slots = [g for g, c in enumerate(column) for _ in range(c)]
            while todo and slots:
                heads, m, used = [], todo, {}
                for g in slots:  # actual lengths for the rounded ones
                    skip = used.get(g, 0)
                    if skip < len(pools[g]):
                        used[g] = skip + 1
                        heads.append(pools[g][skip])
                        m = min(m, pools[g][skip][1])
                if not heads:
                    break
                if len(heads) < len(slots):  # a pool with one length left may serve several slots of a sequence
                    heads = []
                    per: dict[int, int] = {}
                    for g in slots:
                        if pools[g]:
                            per[g] = per.get(g, 0) + 1
                    m = todo
                    for g, k in per.items():
                        if pools[g][0][1] >= k:
                            m = min(m, pools[g][0][1] // k)
                            heads += [pools[g][0]] * k
                        else:
                            m = 1
                            heads += [pools[g][0]] * pools[g][0][1]
                runs.append((m, [h[0] for h in heads]))
                for h in heads:
                    h[1] -= m
                    left[h[0]] -= m
                for g in set(slots):
                    pools[g] = [h for h in pools[g] if h[1]]
                todo -= m
    # best fit of what is left, longest first, over runs of equal room
    room: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    mask = 0

    def put(n: int, held: list[int], free: int) -> None:
        nonlocal mask
        if n:
            room[free].append((n, held))
            mask |= 1 << free

    grouped = sum(n for n, _ in runs)
    for n, held in runs:
        put(n, held, capacity - sum(held))
    for s in sorted((s for s in left if left[s]), reverse=True):
        n = left[s]
        while n:
            above = mask >> s
            free = s + (above & -above).bit_length() - 1 if above else capacity
            if above:
                m, held = room[free].pop()
                if not room[free]:
                    mask &= ~(1 << free)
            else:
                m, held = n, []
            each = min(free // s, n)
            full = min(m, n // each)
            put(m - full, held, free) if above else None
            put(full, [*held, *[s] * each], free - each * s)
            n -= full * each
    return Plan([r for free in room for r in free], grouped, least)


def plan_intervals(runs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for n, held in runs:
        offset = 0
        for s in held:
            out.append((s, rank.get(s, 0), base, offset))
            rank[s] = rank.get(s, 0) + n
            offset += s
        base += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID) -> DataFrame:
    """Place every document: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text counts as empty: one piece with the end id.  A document with more
    than ``capacity`` ids is cut, its first piece may be shorter.  Repeated rows are
    packed each; an empty table packs to nothing.  Other columns are ignored.
    Sequences of one full piece have negative ids, the others count from 0.
    """
    with Scratch(docs.sparkSession, "packing") as scratch:
        cut = scratch.write(pieces(docs, path, capacity, id_col, text_col, end_id), "pieces", keep=True)
    rest = cut.filter(F.col("length") < capacity)
    by_part = rest.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # below capacity rows
    plan = plan_intervals(best_plan(histogram, capacity).runs)
    keys = (plan[:, 0] << 44) + plan[:, 1]
    ahead = by_part.select(
        F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            i = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(plan[i, 2] + rank - plan[i, 1]), pa.array(plan[i, 3])], ["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    columns = ["id", "piece", "start", "length", "crc"]
    schema = T.StructType([*(cut.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = rest.join(ahead, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select(*columns, (F.col("ahead") + F.col("rank")).alias("rank")).mapInArrow(place, schema)
    full = cut.filter(F.col("length") == capacity).select(*columns, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})
