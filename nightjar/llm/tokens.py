"""Token ids of whole texts, and their Parquet files (operator 8).

Documents are dealt by id ranges, encoded, and written as Parquet with one row
per document: ``part`` and ``part_start`` (ids before it in its file), ``doc_id``,
``n_tokens`` and a list column ``ids``.  Row groups, pages and the encoding of the ids
are set by the caller; page indexes and column pruning let readers fetch lengths
without ids, or the ids of a few documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from . import kernels as K
from .shared import Scratch

END_ID = 2
SLICE_BYTES = 4 << 20
_encoders: dict[str, K.CachedEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> K.CachedEncoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = K.CachedEncoder(path)
    return _encoders[path]


def encoded(batch: pa.RecordBatch, text: str, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their ids (each document's end id included) and offsets."""
    enc = encoder(path)
    for part in K.slices(batch, text, SLICE_BYTES):
        ids, at = enc.encode(*K.buffers(part.column(part.schema.get_field_index(text))))
        n = np.diff(at)
        whole = np.empty(len(ids) + len(n), np.uint32)
        ends = np.cumsum(n + 1)
        own = np.ones(len(whole), bool)
        own[ends - 1] = False
        whole[own] = ids
        whole[ends - 1] = end_id
        yield part, whole, np.concatenate(([0], ends))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, part_start, id, n_tokens, ids) in ascending order of id within and across parts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ranged = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = pyspark.TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, ids, at in encoded(batch, "text", path, end_id):
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(before + at[:-1]), rows.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))],
                    ["part", "part_start", "id", "n_tokens", "ids"],
                )
                before += int(at[-1])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return ranged.mapInArrow(run, schema)


def write_tokens(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000) -> None:
    """Encode ``docs`` with the ``tokenizers`` file at ``path`` and write them to ``out``.

    ``encoding`` is 'dictionary' or 'delta' (binary packed).  Null text counts as
    empty and has the end id only.  Null ids come first.  Equal ids keep a fixed
    order by their text; repeated rows are rows of their own.  An empty table
    makes files without rows.  Other columns are ignored.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    (
        encode_documents(docs, path, id_col, text_col, end_id)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.enable.dictionary", "true" if encoding == "dictionary" else "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.dictionary.page.size", str(1 << 20))
        .parquet(out)
    )


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "n_tokens", "ids"), low: int | None = None, high: int | None = None) -> DataFrame:
    """Chosen columns of the documents with ``low <= id < high``; both reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows if low is None else rows.filter(F.col("id") >= low)
    rows = rows if high is None else rows.filter(F.col("id") < high)
    return rows.select(*columns)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) read back from token files; only sums per file are gathered."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = sums.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    kind = rows.schema["id"].dataType

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = np.fromiter((zlib.crc32(ids[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums)], ["part", "part_start", "id", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    read = rows.select("part", "part_start", "id", "n_tokens", "ids").mapInArrow(crc, schema)
    return read.join(ahead, F.col("part") == F.col("of")).select("id", (F.col("ahead") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, path: str, **named) -> DataFrame:
    """Write token files to a scratch folder and read their digests back."""
    out = Scratch(docs.sparkSession, "tokens").path("ids", keep=True)
    write_tokens(docs, out, path, **named)
    return digests(docs.sparkSession, out)
