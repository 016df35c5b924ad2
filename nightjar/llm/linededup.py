"""Line dedup over levelled sorted runs (operator 9).

Every text is split and hashed once, into a narrow table of lines.  Batches of documents
come in descending order of id.  A run is a table of 128-bit line keys with one file for each bucket
of keys, sorted by them.  A batch's distinct keys are combined and written like a run first, so that a frequent line
is one row from then on.  They are merge-anti-joined with the runs, bucket by bucket in the order the files
have: no shuffle and no sort of what came before.  What is left are lines that no larger batch has, and it
becomes a run of level 0 together with the largest id of the batch that holds it.  Once a level
holds ``fanout`` runs they are merged bucket by bucket into one run of the next level, as in a log-structured
merge tree; runs never share a key.

Because larger ids come first, a new key's holder is the largest document that has the
line.  All its other lines are repeats, found by an anti join on key and id, which no
frequent line can skew.  Only repeats are counted at the end: they go if enough
documents hold the line.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import Scratch, require_integral

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
HOT_SHARE = 1_024  # a key with more than this part of all repeats is hot: there can be no more than HOT_SHARE of them
LEAST_ID = -(2**63)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_table(docs: DataFrame, min_chars: int, batch: Column) -> DataFrame:
    """(batch, id, tid, at, h1, h2): the lines of ``min_chars`` code points or more of (id, text)."""
    keys = F.transform(F.split("text", "\n"), line_key)
    lines = docs.select(batch.alias("batch"), "id", F.xxhash64("text").alias("tid"), F.posexplode(keys).alias("at", "k"))
    return lines.filter(F.char_length("k") >= min_chars).select("batch", "id", "tid", "at", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"))


@contextmanager
def files_in_order(spark: SparkSession) -> Iterator[None]:
    """Inside, scans of a bucket that is one file know that it is sorted; what is planned here is run here."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class LineRuns:
    """Levelled runs of (h1, h2, id): each key once, with the id that held it first."""

    scratch: Scratch
    fanout: int = 4
    levels: list[list[tuple[str, DataFrame]]] = field(default_factory=list)

    def _keep(self, run: tuple[str, DataFrame], level: int) -> DataFrame:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run[1]

    def live(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge-anti-join a batch's keys with all runs and add the rest as a run; returns that run."""
        # written before the joins, else the optimiser would join each line first and combine equal ones after;
        # the aggregate has dealt the rows by key, so a bucket is one file
        path, new = self.scratch.buckets(lines.groupBy(*KEY).agg(F.max("id").alias("id")), "lines-new", KEY, dealt=True)
        runs = self.live()
        if not runs:
            return self._keep((path, new), 0)
        with files_in_order(self.scratch.spark):
            for run in runs:  # few: at most ``fanout`` - 1 of each level
                new = new.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
            fresh = self.scratch.buckets(new, "lines-l0", KEY, dealt=True)
        self.scratch.drop(path)
        return self._keep(fresh, 0)

    def compact(self) -> None:
        """Merge the runs of full levels; no run of them may be in use."""
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fanout:
                merged = full[0]
                for k, other in enumerate(full[1:]):
                    both = self._merge(merged[1], other[1], level + 1)
                    self.scratch.drop(other[0], *([merged[0]] if k else []))
                    merged = both
                self.scratch.drop(full[0][0])
                self.levels[level] = []
                self._keep(merged, level + 1)
            level += 1

    def _merge(self, left: DataFrame, right: DataFrame, level: int) -> tuple[str, DataFrame]:
        """A run of both: as they share no key, a full outer merge join walks through each pair of buckets once."""
        a, b = left.select(*KEY, "id"), right.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("id").alias("other"))
        with files_in_order(self.scratch.spark):
            both = a.hint("merge").join(b, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "full")
            rows = both.select(F.coalesce("h1", "g1").alias("h1"), F.coalesce("h2", "g2").alias("h2"), F.coalesce("id", "other").alias("id"))
            return self.scratch.buckets(rows, f"lines-l{level}", KEY, dealt=True)


def repeated_lines(scratch: Scratch, docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(id, tid, gone): the places of the lines to drop from each (id, text hash)."""
    cuts = docs.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = sum((F.when(F.col("id") <= c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))  # 0 has the largest ids
    lines = scratch.write(line_table(docs, min_chars, batch), "lines", partition=("batch",))
    runs, repeats = LineRuns(scratch, fanout), None
    for b in range(batches):
        own = lines.filter(F.col("batch") == b).drop("batch")
        fresh = runs.add(own)
        again = scratch.write(own.join(fresh.hint("merge"), [*KEY, "id"], "left_anti"), "repeats")
        runs.compact()
        repeats = again if repeats is None else repeats.unionByName(again)
    # the holder is one document more
    often = repeats.select(*KEY, "id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs - 1)
    often = scratch.write(often, "often")
    bound = repeats.count() / HOT_SHARE
    hot, cold = F.broadcast(often.filter(F.col("n") > bound).select(*KEY)), often.filter(F.col("n") <= bound).select(*KEY)
    lost = repeats.join(hot, KEY, "left_semi").unionByName(repeats.join(hot, KEY, "left_anti").join(cold.hint("merge"), KEY, "left_semi"))
    return scratch.write(lost.groupBy("id", "tid").agg(F.collect_set("at").alias("gone")), "lost", keep=True)  # at most the lines of one document


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """Drop lines that ``min_docs`` documents or more hold, but in the largest id.

    All columns of ``docs`` come back with ``text_col`` rewritten, plus
    ``n_lines`` and ``n_dropped`` (they replace columns of these names).

    Null or empty text is one empty line and stays as an empty string.  Lines
    with fewer than ``min_chars`` code points stay.  Rows that share an id count
    as one document and keep or lose their lines alike; a null id is one
    document, below all others.  Ids must be integers (``TypeError`` otherwise).
    An empty table gives an empty result.
    """
    require_integral(docs, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    with Scratch(docs.sparkSession, "lines") as scratch:
        lost = repeated_lines(scratch, docs.select(low.alias("id"), text.alias("text")), min_chars, min_docs, batches, fanout)
    # a row's id and a hash of its text name it: equal rows share their verdict
    lost = lost.select(F.col("id").alias("__nj_id"), F.col("tid").alias("__nj_text"), F.col("gone").alias("__nj_gone"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    split = F.split(F.col("__nj_body"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("__nj_gone"))
    # the lines are bound once, so that picking them by place doesn't split the text again
    left = F.get(F.transform(F.array(split), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")), 0)
    out = (
        docs.withColumns({"__nj_body": text, "__nj_id": low, "__nj_text": F.xxhash64(text)})
        .join(lost.hint("merge"), ["__nj_id", "__nj_text"], "left")  # grows with the input: never broadcast
        .withColumn("n_lines", (F.regexp_count("__nj_body", F.lit("\n")) + 1).cast("long"))
        .withColumn("n_dropped", F.when(F.col("__nj_gone").isNull(), 0).otherwise(F.size("__nj_gone")).cast("long"))
    )
    return out.withColumn(text_col, F.when(F.col("__nj_gone").isNull(), F.col("__nj_body")).otherwise(left)).select(*keep, "n_lines", "n_dropped")
