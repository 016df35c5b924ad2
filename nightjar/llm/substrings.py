"""Removal of repeated word windows by Rabin-Karp hashes (operator 12).

1. Texts are dealt once to a table bucketed by block.  A block rolls a Rabin-Karp hash
   over all its windows, keeps each hash once with the least id that has it, and sends
   (hash, id) to buckets, packed: a window costs about eight bytes on the way, and one
   that every document holds costs a block no more than any other.
2. A bucket counts: a window with an id above the least one of its hash repeats.  It answers each
   block with one bit for each entry.
3. Blocks roll the same hashes again, mark repeated windows and those that a smaller
   document of the block has, and merge them into maximal intervals of words.

Windows are equal if 56 bits of one rolling hash and the bucket's bits of another are: among n distinct
windows a false repeat is expected n * n / 2 / 2^(56 + bits) times, which is 0.03 for 50 GB of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import kernels as K
from .shared import Scratch, require_integral
from .suffixes import _block, _first

WINDOW = 13
#: bytes of text in a block and behind a bucket; from 2^21 blocks or 2^19 buckets on both grow, so that what a block sends to a bucket isn't a few bytes
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
MOST_BLOCKS, MOST_BITS = 21, 19
SLICE_BYTES, HASH_BYTES = 1 << 20, 7
_LARGEST = np.iinfo(np.int64).max
_OTHER = K.U64(0xA0761D6478BD642F)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every word, about a megabyte at a time."""
    out = np.empty(len(start), K.U64)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(data) + SLICE_BYTES, SLICE_BYTES)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        low = start[i]
        out[i:j] = K.Hasher(data[low : end[j - 1]]).spans(start[i:j] - low, end[i:j] - low)
    return out


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of every ``k`` neighbours: sums of hashes times powers of an odd base."""
    up, down = K.powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, K.U64)
    np.cumsum(h * down[: len(h)], out=sums[1:])
    return K.mix((sums[k:] - sums[: len(h) - k + 1]) * up[: len(h) - k + 1])


def windows(data: np.ndarray, offsets: np.ndarray, k: int, bits: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Words (start, end, document), and of every window in one document its first word, hash and bucket."""
    start, end, doc = K.words(data, offsets)
    if len(start) < k:
        return (start, end, doc), np.zeros(0, np.int64), np.zeros(0, K.U64), np.zeros(0, np.int64)
    h = word_hashes(data, start, end)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    code = (roll(K.mix(h ^ _OTHER), k)[at] >> K.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
    return (start, end, doc), at, roll(h, k)[at], code


def _entries(table: pa.Table, k: int, bits: int) -> dict:
    """A block's windows, and its distinct hashes in order of bucket and least id."""
    table, ids, data, offsets = _block(table)
    (start, end, doc), at, whole, code = windows(data, offsets, k, bits)
    keys, least, number = _first(whole, ids[doc[at]])
    some = np.empty(len(keys), np.int64)
    some[number] = np.arange(len(number))
    order = np.lexsort((least, code[some]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    code = code[some][order]
    cuts = np.flatnonzero(np.diff(code, prepend=-1))
    return {
        "table": table, "ids": ids, "data": data, "words": (start, end, doc), "at": at, "entry": place[number], "keys": keys[order], "least": least[order],
        "runs": list(zip(code[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True)) if len(keys) else [],
    }


def _pack(ids: np.ndarray) -> bytes:
    """Ascending ids as steps, byte plane by byte plane: all but the low planes are zeros, which compress away."""
    return np.diff(ids, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _pack_hashes(hashes: np.ndarray) -> bytes:
    return hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpack_hashes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.view(K.U64).ravel()


def _repeated(blocks: DataFrame, k: int, bits: int) -> DataFrame:
    """(block, bucket, bits): for each hash that a block sent to a bucket, whether a smaller id has it."""

    def tell(table: pa.Table) -> pa.Table:
        block, e = table.column("block")[0].as_py(), _entries(table, k, bits)
        return pa.table(
            {
                "block": pa.array([block] * len(e["runs"]), pa.int64()), "bucket": pa.array([b for b, _, _ in e["runs"]], pa.int64()),
                "hashes": pa.array([_pack_hashes(e["keys"][s:t]) for _, s, t in e["runs"]], pa.binary()), "ids": pa.array([_pack(e["least"][s:t]) for _, s, t in e["runs"]], pa.binary()),
            }
        )

    def count(table: pa.Table) -> pa.Table:
        hashes = [_unpack_hashes(h) for h in table.column("hashes").to_pylist()]
        ids = np.concatenate([_unpack(i) for i in table.column("ids").to_pylist()])
        _, first, number = _first(np.concatenate(hashes), ids)
        gone, ends = ids > first[number], np.cumsum([len(h) for h in hashes])
        own = [gone[e - len(h) : e] for h, e in zip(hashes, ends, strict=True)]
        some = [i for i, g in enumerate(own) if g.any()]
        picked = table.select(["block", "bucket"]).take(pa.array(some, pa.int64()))
        return picked.append_column("bits", pa.array([np.packbits(own[i]).tobytes() for i in some], pa.binary()))

    told = blocks.groupBy("block").applyInArrow(tell, "block long, bucket long, hashes binary, ids binary")
    return told.groupBy("bucket").applyInArrow(count, "block long, bucket long, bits binary")


def _kept(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int) -> list[bytes]:
    """The words of each of ``n`` documents, joined by one blank."""
    size = end - start + 1
    ends = np.cumsum(size)
    if len(ends):
        out = np.append(data, np.uint8(0x20))[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        out[ends - 1] = 0x20
    cuts = np.searchsorted(doc, np.arange(n + 1))
    return [out[ends[i] - size[i] : ends[j - 1] - 1].tobytes() if i < j else b"" for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _cut(blocks: DataFrame, repeated: DataFrame, k: int, bits: int, schema: T.StructType, with_text: bool) -> DataFrame:
    """The rows of all blocks without the words of repeated windows."""
    kinds = to_arrow_schema(schema)

    def apply(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([], kinds)
        e = _entries(table, k, bits)
        start, end, doc = e["words"]
        n, again = len(e["ids"]), np.zeros(len(e["keys"]), bool)
        spans = {b: (s, t) for b, s, t in e["runs"]}
        for bucket, raw in zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist(), strict=True):
            s, t = spans[bucket]
            again[s:t] = np.unpackbits(np.frombuffer(raw, np.uint8))[: t - s]
        hit = e["at"][again[e["entry"]] | (e["ids"][doc[e["at"]]] > e["least"][e["entry"]])]
        cover = np.zeros(len(start) + 1, np.int64)
        cover[hit] += 1  # windows start at distinct words
        cover[hit + k] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.diff(doc, prepend=-1) > 0
        first = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
        last = np.flatnonzero(gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False)))
        words, removed, runs = (np.bincount(x, minlength=n) for x in (doc, doc[gone], doc[first]))
        base = np.cumsum(words) - words
        intervals = pa.StructArray.from_arrays([pa.array(first - base[doc[first]]), pa.array(last - first + 1)], ["start", "length"])
        kept = _kept(e["data"], start[~gone], end[~gone], doc[~gone], n)
        columns = [e["table"].column("id"), pa.array(words), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in kept]), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs)), pa.int32()), intervals)]
        return pa.table([*columns, *([pa.array(kept, pa.binary()).cast(pa.string())] if with_text else [])], names=kinds.names).cast(kinds)

    return blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(apply, schema)


def remove_windows(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``spans`` (and ``kept``, a string).

    Removed is each word covered by a window of ``k`` words whose words also stand in a row with a
    smaller id, judged on the input; ``spans`` are the maximal runs of removed words as
    (start, length), 0-based.  ``kept`` has the other words joined by one blank.  Null, empty
    and blank texts have no words; texts of fewer than ``k`` words are never touched; a null
    id counts as larger than any other.  Rows that share an id don't take from each
    other.  Repeated rows get equal results; an empty table gives none; other columns are ignored.
    Ids must be integers (``TypeError`` otherwise).  A text is worked on in one task, which
    takes about twenty times its size.
    """
    require_integral(docs, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LARGEST)).alias("low"), F.xxhash64(text).alias("tie"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // max(BLOCK_BYTES, total >> MOST_BLOCKS)))
    bits = max(0, min(MOST_BITS, (-(-total // BUCKET_BYTES) - 1).bit_length()))
    interval = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(interval))]
    schema = T.StructType([*fields, *([T.StructField("kept", T.StringType())] if with_text else [])])
    with Scratch(docs.sparkSession, "windows") as scratch:
        _, blocks = scratch.buckets(rows.withColumn("block", F.pmod(F.xxhash64("low", "tie"), F.lit(n_blocks)).cast("long")), "blocks", ["block"])
        repeated = scratch.write(_repeated(blocks, k, bits), "repeated")
        return scratch.write(_cut(blocks, repeated, k, bits, schema, with_text), "result", keep=True)
