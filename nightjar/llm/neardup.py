"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures (operator 4).

A signature has ``3 * PARTS * groups`` symbols of 16 bits.  Three symbols make a
part, ``PARTS`` parts a chunk.  By pigeonhole, two signatures with at least
``groups + 1`` equal parts agree in two parts of some chunk, so the choice of the
two error-free parts is enumerated: ``PARTS * (PARTS - 1) / 2`` keys for each
chunk.  All pairs that differ in at most ``radius`` symbols share a key, and a pair
at the similarity threshold fails to with a probability below ``MISS``.

Equal sets are one node.  In each bucket of a key every node is first compared
with the bucket's least node only, on full shingle sets.  After the components
of these links, buckets whose other nodes still lie in several components are
compared block by block on odd sketches, bitmaps that hold the parity of the
shingles hashed to each bit.  Two sketches differ in no more bits than the sets in
shingles, so a pair that is too far apart is dismissed for certain, and the few that
are left are confirmed on full sets.  So no link between different components is
lost, and no bucket is ever expanded into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernels as K
from .graph import components
from .shared import Scratch

PARTS, WIDTH = 6, 3
MISS = 2e-6
BLOCK = 512
SKETCH_BITS, SKETCHED = 2048, 1024
SALT_ROWS = 256


def n_chunks(percent: int) -> int:
    """Chunks so that a pair at the threshold shares no key with a probability below MISS."""
    p = (percent / 100) ** WIDTH
    alone = (1 - p) ** PARTS + PARTS * p * (1 - p) ** (PARTS - 1)
    return max(1, math.ceil(math.log(MISS) / math.log(alone))) if alone > 0 else 1


def radius(chunks: int) -> int:
    """Symbol errors up to which two signatures share a key for certain."""
    return chunks * PARTS - (chunks + 1)


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents in order, and their offsets."""
    doc, h = K.distinct(*K.shingles(data, offsets, words))
    return h, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1)))).astype(np.int64)


def _fingerprints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set: 128 bits that equal sets share."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A63):
        sums = np.concatenate((np.zeros(1, K.U64), np.cumsum(K.mix(h ^ K.U64(salt)), dtype=K.U64)))
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _signatures(h: np.ndarray, at: np.ndarray, symbols: int) -> np.ndarray:
    """(documents with shingles, symbols) of uint16."""
    rng = np.random.Generator(np.random.PCG64(7919))
    factor = rng.integers(1, 2**63, symbols, dtype=K.U64) * K.U64(2) + K.U64(1)
    flip = rng.integers(0, 2**64, symbols, dtype=K.U64)
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), symbols), np.uint16)
    if len(starts):
        for j in range(symbols):
            out[:, j] = (K.mix(np.minimum.reduceat((h ^ flip[j]) * factor[j], starts)) & K.U64(0xFFFF)).astype(np.uint16)
    return out


def _level(n: np.ndarray) -> np.ndarray:
    """How often a set is halved before it is sketched: until SKETCHED shingles or fewer are expected."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / SKETCHED))).astype(np.int64)


def _sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, bytes): parity of the sampled shingles at each bit."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    stay = (h >> K.U64(40)) & ((K.U64(1) << _level(n).astype(K.U64))[doc] - K.U64(1)) == 0
    spot = doc[stay] * SKETCH_BITS + (h[stay] & K.U64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=len(n) * SKETCH_BITS) & 1).astype(np.uint8).reshape(len(n), SKETCH_BITS), axis=1)


def _most_apart(n: np.ndarray, m: int, level: int, percent: int) -> np.ndarray:
    """Sketch bits in which linked sets of ``n`` and ``m`` shingles may differ; six deviations for sampled ones."""
    apart = (n + m) * (100 - percent) / (100 + percent)
    share = 0.5**level
    return np.floor(apart + 1e-9) if level == 0 else apart * share + 6 * np.sqrt(apart * share) + 1


def _keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """(rows, keys): one key for each chunk and choice of two of its parts."""
    parts = sig.reshape(len(sig), chunks * PARTS, WIDTH).astype(K.U64)
    part = (parts[:, :, 0] << K.U64(32)) | (parts[:, :, 1] << K.U64(16)) | parts[:, :, 2]
    out = []
    for c in range(chunks):
        for i, j in combinations(range(PARTS), 2):
            tag = K.U64((c * 64 + i * 8 + j) * 0x9E3779B97F4A7C15 % 2**64)
            out.append(K.mix(K.mix(part[:, c * PARTS + i] + tag) * K.U64(0xD6E8FEB86659FD93) + part[:, c * PARTS + j]))
    return np.stack(out, 1).view(np.int64) if len(sig) else np.zeros((0, len(out)), np.int64)


def _describe(docs: DataFrame, words: int, chunks: int) -> DataFrame:
    """(uid, id, text_hash, n, s1, s2, sig, sketch) of every row."""
    symbols = chunks * PARTS * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = pyspark.TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in K.slices(batch, "text"):
                h, at = _sets(*K.buffers(rows.column(1)), words)
                n = np.diff(at)
                s1, s2 = _fingerprints(h, at)
                sig = np.zeros((len(n), symbols), np.uint16)
                sig[n > 0] = _signatures(h, at, symbols)
                fixed = lambda x: pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * (x.shape[1] * x.itemsize)).astype(np.int32)), pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(part) << 36) + made + np.arange(len(n))), rows.column(0), rows.column(2), pa.array(n), pa.array(s1), pa.array(s2), fixed(sig), fixed(_sketches(h, at))], ["uid", "id", "text_hash", "n", "s1", "s2", "sig", "sketch"])
                made += len(n)

    schema = T.StructType([T.StructField("uid", T.LongType()), docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("text_hash", "n", "s1", "s2")), T.StructField("sig", T.BinaryType()), T.StructField("sketch", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _unpack(column: pa.Array, symbols: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), symbols)


def _buckets(nodes: DataFrame, chunks: int) -> DataFrame:
    """(key, uid) of every node with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                keys = _keys(_unpack(part.column(1), chunks * PARTS * WIDTH), chunks)
                uid = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(uid, keys.shape[1]))], ["key", "uid"])

    return nodes.select("uid", "sig").mapInArrow(run, "key long, uid long")


def _confirm(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough.

    ``v`` is the centre: its set goes to every salt of its pairs, ``u``'s set to one.
    """
    uses = pairs.groupBy(F.col("v").alias("c")).agg(F.ceil(F.count("u") / SALT_ROWS).cast("int").alias("salts"))
    uses = scratch.write(uses, "centres")
    jobs = (
        pairs.join(uses, F.col("v") == F.col("c"))
        .select(F.col("u").alias("uid"), "c", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
        .unionByName(uses.select(F.col("c").alias("uid"), "c", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role")))
    )
    wanted = jobs.groupBy("uid").agg(F.collect_list(F.struct("c", "salt", "role")).alias("jobs"))
    named = wanted.join(nodes.select("uid", "id", "s1", "s2"), "uid").select(F.struct("id").alias("key"), "uid", "s1", "s2", "jobs")
    named = scratch.write(named, "jobs")
    # the wanted nodes grow with the input: never broadcast
    texts = docs.select(F.struct("id").alias("key"), "text").join(named.hint("merge"), "key").select("text", "uid", "s1", "s2", "jobs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.slices(batch, "text"):
                h, at = _sets(*K.buffers(rows.column(0)), words)
                s1, s2 = _fingerprints(h, at)
                own = (s1 == rows.column(2).to_numpy()) & (s2 == rows.column(3).to_numpy())  # else another row of this id
                raw = [h[at[i] : at[i + 1]].tobytes() if own[i] else None for i in range(len(own))]
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(raw, pa.binary()), rows.column(4)], ["uid", "shingles", "jobs"])

    kind = T.StructType([T.StructField("uid", T.LongType()), T.StructField("shingles", T.BinaryType()), named.schema["jobs"]])
    made = texts.mapInArrow(sets, kind).filter(F.col("shingles").isNotNull())
    dealt = made.select("uid", "shingles", F.explode("jobs").alias("j")).select("j.c", "j.salt", "j.role", "uid", "shingles")
    dealt = dealt.repartition("c", "salt").sortWithinPartitions("c", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.zeros(0, K.U64)
        for b in batches:
            u, v = [], []
            parts = (b.slice(at, 500) for at in range(0, b.num_rows, 500))
            for c, salt, role, uid, raw in (row for part in parts for row in zip(*(x.to_pylist() for x in part.columns), strict=True)):
                own = np.frombuffer(raw, K.U64)
                if role == 0:
                    centre, held = (c, salt), own
                elif centre == (c, salt):
                    spot = np.searchsorted(held, own)
                    spot[spot == len(held)] = 0
                    inter = int((held[spot] == own).sum())
                    if 100 * inter >= percent * (len(held) + len(own) - inter):
                        u.append(uid)
                        v.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def _near_in_blocks(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components whose sketches are near, by blocks of the bucket."""
    ones = np.array([bin(x).count("1") for x in range(256)], np.uint8)
    sizes = rest.groupBy("key").agg(F.ceil(F.count("uid") / BLOCK).cast("int").alias("blocks"))
    rows = rest.join(sizes, "key").join(nodes.select("uid", "n", "sketch"), "uid").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    # block pair (i, j), i <= j: a row goes to all pairs with its block
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid", "label", "n", "sketch")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        uid, label, own, n = (table.column(c).to_numpy() for c in ("uid", "label", "own", "n"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(uid), SKETCH_BITS // 8)
        level = _level(n)
        u, v = [], []
        i, j = key[1].as_py(), key[2].as_py()
        a = np.flatnonzero(own == i)
        b = np.flatnonzero(own == j)
        for x in a.tolist():
            y = b[(label[b] != label[x]) & ((uid[b] < uid[x]) | (i != j))]
            y = y[(100 * n[y] >= percent * n[x]) & (100 * n[x] >= percent * n[y])]  # sizes alone rule a link out
            apart = ones[sketch[y] ^ sketch[x]].sum(1, dtype=np.int64)
            y = y[(level[y] != level[x]) | (apart <= _most_apart(n[y], int(n[x]), int(level[x]), percent))]
            u += uid[y].tolist()
            v += [int(uid[x])] * len(y)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    near = spread.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")
    return near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, ``uid``, ``n_shingles``, ``component_id`` (the group's least id), ``first`` and ``text_hash``.

    Sets are distinct ``words``-word shingles of the text with A-Z in lower case; rows
    with ``100 * intersection >= percent * union`` are linked.  Null, empty and wordless
    texts have no shingles and form groups of their own; fewer words than a shingle
    are one shingle.  Repeated rows are one group; ``first`` is true for exactly one
    row of each group (the least id, nulls last).  A null id yields a null
    component only if all ids of its group are null.  An empty table gives an
    empty result; other columns are ignored.
    """
    with Scratch(docs.sparkSession, "neardup") as scratch:
        found = scratch.write(_groups(scratch, docs, id_col, text_col, words, percent), "groups", keep=True)
    return found.withColumnRenamed("id", id_col)


def _groups(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    chunks = n_chunks(percent)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scratch.write(_describe(narrow.withColumn("text_hash", F.xxhash64("text")), words, chunks), "signatures")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    equal = scratch.write(rows.filter("n > 0").groupBy("s1", "s2").agg(F.min(order)["uid"].alias("rep")), "sets")
    member = scratch.write(rows.drop("sig", "sketch").join(equal, ["s1", "s2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("uid"))), "members")
    nodes = rows.join(equal.select(F.col("rep").alias("uid")), "uid", "left_semi")

    # sort-merge joins on keys: both sides grow with the input, and skewed partitions of such joins are split at run time
    keyed = _buckets(nodes, chunks)
    shared = keyed.groupBy("key").agg(F.min("uid").alias("centre"), F.max("uid").alias("last")).filter("centre != last").select("key", "centre")
    active = scratch.write(keyed.join(scratch.write(shared, "shared").hint("merge"), "key").filter("uid != centre"), "buckets")
    links = scratch.write(_confirm(scratch, active.select(F.col("uid").alias("u"), F.col("centre").alias("v")).distinct(), nodes, narrow, words, percent), "links")
    roots = components(scratch, links)

    # other nodes of a bucket in several components
    labelled = active.join(roots.select(F.col("v").alias("uid"), F.col("m")), "uid", "left").select("key", "uid", F.coalesce("m", "uid").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("key")
    rest = scratch.write(labelled.join(scratch.write(mixed, "mixed").hint("merge"), "key", "left_semi"), "rest")
    if not rest.isEmpty():
        near = scratch.write(_near_in_blocks(rest, nodes, percent), "near")
        done = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        more = scratch.write(_confirm(scratch, near.join(done, ["u", "v"], "left_anti"), nodes, narrow, words, percent), "more")
        if not more.isEmpty():
            roots = components(scratch, links.unionByName(more))

    top = scratch.write(member.join(roots.select(F.col("v").alias("rep"), "m"), "rep", "left").withColumn("root", F.coalesce("m", "rep")).drop("m"), "roots")
    least = scratch.write(top.groupBy("root").agg(F.min(order).alias("least")), "least")
    return top.join(least, "root").select("id", "uid", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("uid") == F.col("least.uid")).alias("first"), "text_hash")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns as they are.

    That is the row with the least id (nulls last); rows without shingles all stay,
    as they are linked with nothing.  Of rows equal in id and text one stays.
    """
    found = groups(docs, id_col, text_col, words, percent).select(F.struct(F.col(id_col).alias("v")).alias("__nj_key"), F.col("text_hash").alias("__nj_hash"), "n_shingles", "first")
    stay = found.filter("first OR n_shingles = 0").select("__nj_key", "__nj_hash").distinct()
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumns({"__nj_key": F.struct(F.col(id_col).alias("v")), "__nj_hash": F.xxhash64(body)}).join(stay, ["__nj_key", "__nj_hash"], "left_semi")
    repeats = found.filter("n_shingles > 0").groupBy("__nj_key", "__nj_hash").count().filter("count > 1")
    if not repeats.isEmpty():  # of rows equal in id and text one stays
        worded = body.rlike(r"[^\x20\x09-\x0D]")
        rows = rows.filter(worded).dropDuplicates(["__nj_key", "__nj_hash"]).unionByName(rows.filter(~worded))
    return rows.select(*docs.columns)
