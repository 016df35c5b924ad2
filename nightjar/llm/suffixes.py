"""Removal of repeated byte strings by distributed suffix sorting (operator 1).

A 50-byte window and its copies share their minimiser: the least-hashed 24-byte
string in the window, leftmost on ties.  So it is enough to sort the suffixes that
begin at minimisers, with the few bytes to their left that their windows need.

1. Blocks of documents tell which minimisers they hold; only those held by two
   documents or more go on.
2. Each block sorts its suffixes and sends them, one sorted and front-coded run for
   each part: common-prefix lengths and the rest of each suffix.  Equal suffix and left
   bytes within a block travel once, for the least document that has them.
3. A part merges its runs with a loser tree that holds each player's common prefix with
   the last winner, so known prefixes are never compared again.  The merged
   common-prefix lengths bound, for every window offset, the entries with equal
   right sides; equal left sides among them are copies of a window, and all but
   the least document's are marked.
4. Blocks turn the marks into byte ranges of all their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernels as K
from .shared import Scratch, require_integral

WINDOW, SEED = 50, 24
REACH = WINDOW - SEED  # largest offset of a minimiser in its window
BLOCK_BYTES = 8 << 20
PART_BYTES = 4 << 20
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 16
_LARGEST = np.iinfo(np.int64).max


def minimisers(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one minimiser: anchor, lo and hi (offsets), document, hashes."""
    n = len(data)
    none = {c: np.zeros(0, np.int64) for c in ("anchor", "lo", "hi", "doc")} | {c: np.zeros(0, K.U64) for c in ("seed", "whole")}
    if n < WINDOW:
        return none
    hasher = K.Hasher(data)
    seed = hasher.windows(SEED)
    value, off = seed.copy(), np.zeros(len(seed), np.int8)
    span = 1
    while span <= REACH:  # sliding minimum over REACH + 1 seeds by doubling
        step = min(span, REACH + 1 - span)
        right = value[step:]
        less = right < value[:-step]
        off = np.where(less, off[step:] + np.int8(step), off[:-step])
        value = np.minimum(value[:-step], right)
        span += step
    starts = len(value)  # windows that fit the data
    end = np.repeat(offsets[1:], np.diff(offsets))[:starts]
    place = np.arange(starts)
    ok = place + WINDOW <= end
    anchor = np.where(ok, place + off, -1)
    new = np.ones(starts, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new & ok)
    last = np.flatnonzero(ok & np.append(new[1:], True))
    if not len(first):
        return none
    a = anchor[first]
    return {"anchor": a, "lo": a - last, "hi": a - first, "doc": np.searchsorted(offsets, first, "right") - 1, "seed": seed[a], "whole": hasher.spans(first, last + WINDOW)}


def _block(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in order of id and text, with ids, bytes and offsets."""
    table = table.combine_chunks()
    ids = table.column("low").to_numpy()
    table = table.take(pa.array(np.lexsort((table.column("tie").to_numpy(), ids))))
    data, offsets = K.buffers(table.column("text"))
    return table, table.column("low").to_numpy(), data, offsets


def _entries(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Minimisers of a block, found a megabyte at a time; a longer document is cut into slices that share WINDOW - 1 bytes."""
    found, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[to])
        step = SLICE_BYTES if to == at + 1 else high - low
        for s in range(low, max(high - WINDOW + 1, low + 1), max(1, step)):
            e = min(high, s + step + WINDOW - 1)
            part = minimisers(data[s:e], np.clip(offsets[at : to + 1], s, e) - s)
            part["anchor"] = part["anchor"] + s
            part["doc"] = part["doc"] + at
            found.append(part)
        at = to
    return {c: np.concatenate([f[c] for f in found]) for c in found[0]} if found else minimisers(data, offsets)


def _code(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of a seed, and 32 further bits of it; minimisers have small hashes, so they are mixed anew."""
    seed = K.mix(seed ^ K.U64(0xA0761D6478BD642F))
    return (seed >> K.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(seed), np.int64), ((seed >> K.U64(32 - bits)) & K.U64(0xFFFFFFFF)).astype(np.uint32)


def _first(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least value of each, and each row's key number."""
    order = np.lexsort((values, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return k[new], values[order][new], number


def _held_twice(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, part, codes): the seeds of a block that two documents or more hold anywhere."""

    def tell(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, ids, data, offsets = _block(table)
        e = _entries(data, offsets)
        part, code = _code(e["seed"], bits)
        both = (part.astype(K.U64) << K.U64(32)) | code.astype(K.U64)
        keys, least, number = _first(both, ids[e["doc"]])
        twice = np.zeros(len(keys), bool)
        twice[number[ids[e["doc"]] > least[number]]] = True
        parts = (keys >> K.U64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(parts, prepend=-1))
        codes = keys.astype(np.uint32)
        rows = [(int(parts[s]), codes[s:t].tobytes(), np.packbits(twice[s:t]).tobytes()) for s, t in zip(cuts, np.append(cuts[1:], len(keys)), strict=True)] if len(keys) else []
        return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int64()), "codes": pa.array([r[1] for r in rows], pa.binary()), "twice": pa.array([r[2] for r in rows], pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        codes = [np.frombuffer(c, np.uint32) for c in table.column("codes").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(c)].astype(bool) for t, c in zip(table.column("twice").to_pylist(), codes, strict=True)]
        keys, number, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        more = count > 1
        more[number[np.concatenate(twice)]] = True
        stay = more[number]
        ends = np.cumsum([len(c) for c in codes])
        out = [c[stay[e - len(c) : e]].tobytes() for c, e in zip(codes, ends, strict=True)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "codes": pa.array(out, pa.binary())})

    told = blocks.groupBy("block").applyInArrow(tell, "block long, part long, codes binary, twice binary")
    return told.groupBy("part").applyInArrow(join, "block long, part long, codes binary").filter(F.octet_length("codes") > 0)


def _sides(data: np.ndarray, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right sides (WINDOW bytes, cut at WINDOW - lo) and reversed left sides (REACH bytes, cut at hi), zero-padded."""
    right, left = np.zeros((len(anchor), WINDOW), np.uint8), np.zeros((len(anchor), REACH), np.uint8)
    after, before = np.arange(WINDOW), np.arange(1, REACH + 1)
    for k in range(0, len(anchor), SLICE_ROWS):
        own = slice(k, k + SLICE_ROWS)
        a = anchor[own, None]
        right[own] = np.where(after < (WINDOW - lo[own])[:, None], data[np.minimum(a + after, len(data) - 1)], 0)
        left[own] = np.where(before <= hi[own, None], data[np.maximum(a - before, 0)], 0)
    return right, left


def _runs(blocks: DataFrame, twice: DataFrame, bits: int) -> DataFrame:
    """One front-coded sorted run for each block and part."""

    def sort(key: tuple, docs: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and held.num_rows:
            _, ids, data, offsets = _block(docs)
            e = _entries(data, offsets)
            part, code = _code(e["seed"], bits)
            both = (part.astype(K.U64) << K.U64(32)) | code.astype(K.U64)
            known = np.sort(np.concatenate([(np.frombuffer(c, np.uint32).astype(K.U64)) | K.U64(p << 32) for p, c in zip(held.column("part").to_pylist(), held.column("codes").to_pylist(), strict=True)]))
            spot = np.searchsorted(known, both)
            spot[spot == len(known)] = 0
            go = np.flatnonzero(known[spot] == both)
            whole, least, number = _first(e["whole"][go], ids[e["doc"][go]])
            some = np.empty(len(whole), np.int64)
            some[number] = go
            a, lo, hi, part = e["anchor"][some], e["lo"][some], e["hi"][some], part[some]
            right, left = _sides(data, a, lo, hi)
            padded = np.zeros((len(a), 56), np.uint8)
            padded[:, :WINDOW] = right
            words = padded.view(">u8").astype(K.U64)
            order = np.lexsort((WINDOW - lo, *(words[:, j] for j in range(6, -1, -1)), part))
            right, left, lo, hi, part, whole, least = right[order], left[order], lo[order], hi[order], part[order], whole[order], least[order]
            size = WINDOW - lo
            common = np.zeros(len(order), np.int64)
            if len(order) > 1:
                differ = right[1:] != right[:-1]
                common[1:] = np.where(differ.any(1), differ.argmax(1), WINDOW)
                common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            common[cuts] = 0
            columns = np.arange(WINDOW)
            rest = (columns >= common[:, None]) & (columns < size[:, None])
            before = np.arange(1, REACH + 1) <= hi[:, None]
            for s, t in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
                rows.append((int(part[s]), common[s:t].astype(np.uint8).tobytes(), lo[s:t].astype(np.uint8).tobytes(), hi[s:t].astype(np.uint8).tobytes(), right[s:t][rest[s:t]].tobytes(), left[s:t][before[s:t]].tobytes(), least[s:t].tobytes(), whole[s:t].tobytes()))
        names = ("part", "common", "lo", "hi", "rest", "left", "least", "whole")
        kinds = (pa.int64(), *[pa.binary()] * 7)
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int64())} | {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return blocks.groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(sort, "block long, part long, common binary, lo binary, hi binary, rest binary, left binary, least binary, whole binary")


def merge_runs(runs: list[tuple[bytes, list[int], bytes]]) -> tuple[list[int], list[int], list[int]]:
    """Merge front-coded runs (common, sizes, rest): run, place in it, and common prefix with the one before.

    A loser tree: each player keeps the length it shares with the last winner.
    The longer shared prefix wins without a look at the strings; only on equal lengths
    are bytes compared, from that length on.
    """
    k = len(runs)
    width = 1 << max(0, (k - 1).bit_length())
    text: list[bytes | None] = [None] * width  # a player's suffix, None when its run is over
    share = [0] * width
    place, spot = [-1] * width, [0] * width

    def advance(i: int) -> None:
        common, sizes, rest = runs[i]
        p = place[i] + 1
        place[i] = p
        if p == len(sizes):
            text[i] = None
            return
        c = common[p]
        n = sizes[p] - c
        text[i] = (text[i][:c] if c else b"") + rest[spot[i] : spot[i] + n]
        spot[i] += n
        share[i] = c

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes its common prefix with the winner."""
        x, y = text[a], text[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = share[a], share[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        m = min(len(x), len(y))
        if x[p:m] == y[p:m]:
            p = m
            first = len(x) < len(y) or (len(x) == len(y) and a < b)
        else:
            low, high = p, m
            while high - low > 1:  # first byte that differs
                mid = (low + high) // 2
                if x[low:mid] == y[low:mid]:
                    low = mid
                else:
                    high = mid
            p = low
            first = x[p] < y[p]
        if first:
            share[b] = p
            return a, b
        share[a] = p
        return b, a

    for i in range(k):
        advance(i)
    losers = [0] * width
    winners = list(range(width, 2 * width))
    level = list(range(width))
    at = width
    while len(level) > 1:
        up = []
        at //= 2
        for j in range(0, len(level), 2):
            w, loser = play(level[j], level[j + 1])
            losers[at + j // 2] = loser
            up.append(w)
        level = up
    del winners
    win = level[0]
    from_run, from_place, common = [], [], []
    while text[win] is not None:
        from_run.append(win)
        from_place.append(place[win])
        common.append(share[win])
        advance(win)
        node = (win + width) >> 1
        while node:
            win, losers[node] = play(win, losers[node])
            node >>= 1
    return from_run, from_place, common


def mark_copies(common: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Bit ``o`` of an entry: a smaller document has the window that begins ``o`` bytes before its anchor."""
    marks = np.zeros(len(common), np.uint32)
    side = np.zeros(len(common), K.U64)
    for o in range(REACH + 1):
        if o:
            side = K.mix(side * K.U64(0x9E3779B97F4A7C15) + K.CODES[left[:, o - 1]])
        group = np.cumsum(common < WINDOW - o).astype(K.U64)
        own = np.flatnonzero((lo <= o) & (o <= hi))
        if len(own) < 2:
            continue
        _, first, number = _first(K.mix(side[own] + group[own] * K.U64(0xD6E8FEB86659FD93)), least[own])
        marks[own[least[own] > first[number]]] |= np.uint32(1 << o)
    return marks


def _marks(runs: DataFrame) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("common", "lo", "hi", "rest", "left", "least", "whole")}
        lo, hi = ([np.frombuffer(x, np.uint8) for x in cols[c]] for c in ("lo", "hi"))
        merged = merge_runs([(c, (WINDOW - x.astype(np.int64)).tolist(), r) for c, x, r in zip(cols["common"], lo, cols["rest"], strict=True)])
        run, place, common = (np.array(x, np.int64) for x in merged)
        first = np.concatenate(([0], np.cumsum([len(x) for x in lo])))
        at = first[run] + place
        lo, hi = np.concatenate(lo)[at].astype(np.int64), np.concatenate(hi)
        left = np.zeros((len(hi), REACH), np.uint8)
        left[np.arange(1, REACH + 1) <= hi[:, None]] = np.frombuffer(b"".join(cols["left"]), np.uint8)
        least = np.frombuffer(b"".join(cols["least"]), np.int64)[at]
        whole = np.frombuffer(b"".join(cols["whole"]), K.U64)[at]
        marks = mark_copies(common, lo, hi[at].astype(np.int64), left[at], least)
        hit = np.flatnonzero(marks)
        hit = hit[np.argsort(run[hit], kind="stable")]
        cuts = np.flatnonzero(np.diff(run[hit], prepend=-1))
        blocks = table.column("block").to_pylist()
        rows = [(blocks[run[hit[s]]], whole[hit[s:t]].tobytes(), marks[hit[s:t]].tobytes()) for s, t in zip(cuts, np.append(cuts[1:], len(hit)), strict=True)] if len(hit) else []
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "whole": pa.array([r[1] for r in rows], pa.binary()), "marks": pa.array([r[2] for r in rows], pa.binary())})

    return runs.groupBy("part").applyInArrow(merge, "block long, whole binary, marks binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, binary).

    Removed is each byte covered by a WINDOW-byte string that also starts in a
    row with a smaller id, judged on the input.  Null text counts as empty; texts under
    WINDOW bytes are never touched; a null id counts as larger than any other.
    Rows that share an id don't take from each other.  Repeated rows get equal results; an
    empty table gives none; other columns are ignored.  Ids must be integers (``TypeError``
    otherwise).  A text is worked on in one task, which takes about ten times its size.
    """
    require_integral(docs, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LARGEST)).alias("low"), F.xxhash64(text).alias("tie"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    bits = max(0, min(28, (-(-total // PART_BYTES) - 1).bit_length())) if total else 0
    with Scratch(docs.sparkSession, "suffixes") as scratch:
        # the texts are dealt to their blocks once; all steps read them where they are
        _, blocks = scratch.buckets(rows.withColumn("block", F.pmod(F.xxhash64("low", "tie"), F.lit(n_blocks)).cast("long")), "blocks", ["block"])
        twice = scratch.write(_held_twice(blocks, bits), "seeds")
        marks = scratch.write(_marks(_runs(blocks, twice, bits)), "marks")
        return scratch.write(_cut(blocks, marks, id_col, docs.schema[id_col].dataType, with_text), "result", keep=True)


def _cut(blocks: DataFrame, marks: DataFrame, id_col: str, kind: T.DataType, with_text: bool) -> DataFrame:
    """The rows of all blocks without the marked bytes."""

    def apply(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([], out_arrow)
        table, ids, data, offsets = _block(table)
        e = _entries(data, offsets)
        whole, least, number = _first(e["whole"], ids[e["doc"]])
        mask = np.zeros(len(whole), np.uint32)
        if told.num_rows:
            own = np.frombuffer(b"".join(told.column("whole").to_pylist()), K.U64)
            mask[np.searchsorted(whole, own)] = np.frombuffer(b"".join(told.column("marks").to_pylist()), np.uint32)
        every = ids[e["doc"]] > least[number]  # this block has the whole run in a smaller document
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, e["anchor"][every] - e["hi"][every], 1)
        np.add.at(cover, e["anchor"][every] - e["lo"][every] + WINDOW, -1)
        bits_of = np.where(every, 0, mask[number])
        for o in range(REACH + 1):
            hit = e["anchor"][(bits_of >> o) & 1 == 1] - o
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
        gone = np.cumsum(cover[:-1]) > 0
        fresh = gone.copy()
        fresh[1:] &= ~gone[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        fresh[edges] = gone[edges]
        removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, fresh))
        kept = [data[s:t][~gone[s:t]].tobytes() for s, t in zip(offsets[:-1], offsets[1:], strict=True)]
        out = {"id": table.column("id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed[offsets[1:]] - removed[offsets[:-1]]), "n_spans": pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), "sha": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {})).rename_columns(out_names).cast(out_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if with_text else [])])
    out_arrow, out_names = to_arrow_schema(schema), schema.names
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(apply, schema)
