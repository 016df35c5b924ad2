"""Language identification by string kernels (operator 6).

A text is the set of its byte n-grams (lengths 1 to 3, A-Z in lower case), hashed
into ``DIMS`` presence bits.  The blended spectrum kernel of two texts is the
number of common bits over the geometric mean of their counts.  Landmark texts
approximate the kernel (Nyström), and one-versus-rest kernel ridge regression
learns a weight per landmark and language, so a batch is scored by two matrix
products: presence times landmarks, times weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from . import kernels as K
from .shared import Scratch

DIMS = 1 << 14
ROWS = 256
SPARE = 4
_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str) -> Column:
    """True for documents whose crc32 of the id's text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, DIMS) float32 of 0 and 1."""
    n_docs = len(offsets) - 1
    out = np.zeros(n_docs * DIMS + 1, np.float32)  # the last cell takes n-grams across documents
    low = K.LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(n_docs, dtype=np.int64) * DIMS, np.diff(offsets))
    code = np.zeros(len(low), np.uint32)
    for n in (1, 2, 3):
        m = len(low) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + low[n - 1 :] + np.uint32(1)
        spot = row[:m] + ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
        for k in range(1, n):
            edge = offsets[1:-1] - k
            spot[edge[(edge >= 0) & (edge < m)]] = n_docs * DIMS
        # documents shorter than n end before their own edge
        short = np.flatnonzero(np.diff(offsets) < n)
        for d in short.tolist():
            spot[offsets[d] : min(offsets[d + 1], m)] = n_docs * DIMS
        out[spot] = 1
    return out[:-1].reshape(n_docs, DIMS)


@dataclass
class KernelModel:
    languages: list[str]
    landmarks: np.ndarray  # (DIMS, landmarks), columns scaled to unit length
    weights: np.ndarray  # (landmarks, languages)

    def scores(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1))
        return ((x @ self.landmarks) / size[:, None]) @ self.weights


def fit(bits: np.ndarray, y: list[str], landmarks: int = 256, ridge: float = 1e-2) -> KernelModel | None:
    """Kernel ridge regression on packed presence rows; landmarks are dealt evenly over the languages.

    Rows are unpacked ROWS at a time, so the driver holds the packed sample and the landmarks.
    """
    languages = sorted(set(y))
    if not languages:
        return None

    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    names = np.array(y)
    chosen = np.concatenate([np.flatnonzero(names == lang)[: max(1, landmarks // len(languages))] for lang in languages])
    z = unit(bits[chosen])
    value, vector = np.linalg.eigh((z @ z.T).astype(float))
    good = value > 1e-6 * max(value.max(), 1e-12)
    white = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([(unit(bits[k : k + ROWS]) @ z.T) @ white for k in range(0, len(bits), ROWS)])
    target = (names[:, None] == np.array(languages)[None, :]).astype(float)
    balance = (1 / np.maximum(target.sum(0), 1))[target.argmax(1)] * len(names) / len(languages)
    gram = phi.T @ (phi * balance[:, None]) + ridge * len(names) / 100 * np.eye(phi.shape[1])
    weights = white @ np.linalg.solve(gram, phi.T @ (target * balance[:, None]))
    return KernelModel(languages, np.ascontiguousarray(z.T), weights.astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_language: int = 1_000, max_rows: int = 20_000) -> KernelModel | None:
    """Fit on training documents (see ``held_out``), at most ``max_per_language`` and ``max_rows`` of them.

    Only text and language are learned from; the sample is the documents with the
    smallest hashes of their ids.  Languages are counted first, and of a large one only
    ids that hash into its ``SPARE``-fold share of the bound are ranked, so that the
    window reads no more than about ``SPARE * max_per_language`` rows of a language at
    any size of the input.
    """
    order = F.xxhash64(F.col("key"))
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("lang"))
    with Scratch(docs.sparkSession, "languages") as scratch:
        return _train(scratch, docs, known, order, id_col, text_col, max_per_language, max_rows)


def _train(scratch: Scratch, docs: DataFrame, known: DataFrame, order: Column, id_col: str, text_col: str, max_per_language: int, max_rows: int) -> KernelModel | None:
    sizes = scratch.write(known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    if sizes.count() <= max_rows:  # else joined by a shuffle
        sizes = F.broadcast(sizes)
    share = F.least(F.lit(1.0), F.lit(float(SPARE * max_per_language)) / F.col("size"))
    # a hash is below -2^63 + share * 2^64 with probability ``share``
    known = known.join(sizes, "lang").filter((share >= 1) | (order.cast("double") < share * 2.0**64 - 2.0**63)).select("key", "lang")
    sample = (
        known.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(order, "key")))
        .filter(F.col("r") <= max_per_language)
        .orderBy("r", "lang")
        .limit(max_rows)
        .select("key", F.col("lang").alias("own"))
        .dropDuplicates(["key"])
    )
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "key").select("text", "own", F.xxhash64("key").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                bits = np.packbits(presence(*K.buffers(part.column(0))).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bits], pa.binary()), part.column(1), part.column(2)], ["bits", "own", "h"])

    rows = texts.mapInArrow(run, "bits binary, own string, h long").limit(max_rows).toPandas().sort_values(["h", "own", "bits"])
    return fit(np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), DIMS // 8), rows["own"].tolist())


def predict(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``held_out``, ``lang_pred`` and ``score`` (they replace columns of these names).

    Null text and text without a letter are ``und`` with score 0, as is all text if
    the model has no language.  The score is the best language's ridge output, held
    between 0 and 1.  Repeated rows get equal predictions.
    """
    added = ("held_out", "lang_pred", "score")
    base = docs.select(*[c for c in docs.columns if c not in added]).withColumn("__nj_held", held_out(id_col))
    names = [*base.columns[:-1], *added]
    spot = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.slices(batch, text_col):
                for at in range(0, rows.num_rows, ROWS):
                    part = rows.slice(at, ROWS)
                    worded = np.array([t is not None and _LETTER.search(t) is not None for t in part.column(spot).to_pylist()])
                    if model is None:
                        best, lang = np.zeros(len(worded)), np.full(len(worded), "und", object)
                    else:
                        s = model.scores(presence(*K.buffers(part.column(spot))))
                        best = np.where(worded, np.clip(s.max(1), 0, 1), 0).astype(float)
                        lang = np.where(worded, np.array(model.languages, object)[s.argmax(1)], "und")
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], part.columns[-1], pa.array(lang.tolist(), pa.string()), pa.array(best)], names)

    schema = T.StructType([*base.schema.fields[:-1], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, schema)
