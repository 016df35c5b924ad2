"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir).  All
but the last return the columns of ``documents``; ``run`` writes each stage's rows
as Parquet in the shared folder and gives the next stage what it reads back.

Rows with null ids or texts, repeated rows, empty tables and extra columns are
handled as the operators' docstrings say; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightjar.llm import decontaminate, langid, linededup, neardup, packing, tokens
from nightjar.llm.shared import Scratch

#: near-duplicates: words in a shingle, and the similarity in percent
SHINGLE_WORDS, SIMILARITY = 5, 80
CAPACITY = 1024


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (null text, no letter; all if no language is learned) go.

    Otherwise the predicted language and its score decide nothing: op6 defines ``und`` by
    letters alone, so the kernel model has no effect on the rows that stay.
    """
    tagged = docs.withColumnsRenamed({c: f"__nj_own_{c}" for c in ("held_out", "lang_pred", "score") if c in docs.columns})
    kept = langid.predict(tagged, langid.train(docs)).filter("lang_pred != 'und'").drop("held_out", "lang_pred", "score")
    return kept.withColumnsRenamed({c: c[9:] for c in kept.columns if c.startswith("__nj_own_")}).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents that lose all their text stay, with what is left."""
    tagged = docs.withColumnsRenamed({c: f"__nj_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns})
    kept = linededup.dedup_lines(tagged).drop("n_lines", "n_dropped")
    kept = kept.withColumnsRenamed({c: c[9:] for c in kept.columns if c.startswith("__nj_own_")})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    return neardup.keep_first(docs, words=SHINGLE_WORDS, percent=SIMILARITY).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json"), CAPACITY)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

#: tokenizers and signatures aren't SQL; tests hold the rows against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:  # packing reads its documents at once
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
