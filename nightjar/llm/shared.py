"""Shared helpers of the training-data operators: scratch tables and input access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session in one process (``local[...]``) that names none gets a folder of our
    own; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nightjar-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The tables of one run of an operator, in the shared folder.

    A written table cuts lineage: a lost executor re-reads it rather than recomputing
    what led to it.  Leaving the ``with`` block removes all tables but the kept ones,
    which the operator's lazy result reads; those go with the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_root(spark)}/nightjar-{name}-{uuid.uuid4().hex}"
        self.made, self.tables = 0, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.tables)

    def path(self, name: str, keep: bool = False) -> str:
        self.made += 1
        path = f"{self.root}{'-kept' if keep else ''}/{self.made:03d}-{name}"
        if not keep:
            self.tables[path] = None
        return path

    def write(self, df: DataFrame, name: str, keep: bool = False, partition: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = self.path(name, keep)
        df.write.option("compression", "zstd").partitionBy(*partition).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        return out.select(*df.columns)

    def buckets(self, df: DataFrame, name: str, keys: list[str], dealt: bool = False) -> tuple[str, DataFrame]:
        """Write ``df`` in buckets of ``keys``, sorted by them: joins and groups on them need no shuffle.

        There are as many buckets as shuffle partitions, each one file; ``dealt`` says that
        each bucket's rows are in one partition already.
        """
        n, path, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.path(name), f"nightjar_{uuid.uuid4().hex}"
        rows = df if dealt else df.repartition(n, *keys)
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
        self.tables[path] = name
        return path, self.spark.table(name)

    def drop(self, *paths: str) -> None:
        """Remove tables before the block ends."""
        for path in paths:
            name = self.tables.pop(path)
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)


def require_integral(df: DataFrame, column: str) -> None:
    """Ids are compared as 64-bit integers: other types are refused before any job runs."""
    kind = dict(df.dtypes)[column]
    if kind not in INTEGRAL:
        raise TypeError(f"{column} must be an integer column, not {kind}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
