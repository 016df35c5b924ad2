"""Which sources of a language use words differently: exact divergences of term shares (operator 13).

An inverted index holds, for each kept term of a language, its sources with their counts.  A pair of
sources starts at ``V * f`` of two zero counts, as if neither had any term.  The postings then
correct it, where a term does occur: what one source's count changes against a zero is
summed over the source's histogram of counts, and what is left where both have the term comes
from the term's posting.  Zero corrections aren't emitted, and all are summed before
the shuffle.  So the work grows with the postings, not with terms times pairs; a term's
group holds one row for each of its sources, as the result holds one for each pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import kernels as K
from .shared import Scratch
from .substrings import word_hashes

#: bytes between terms: those of ASCII that are no letters
_GAP = np.zeros(256, bool)
_GAP[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
SLICE_BYTES = 8 << 20
SCALE, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 10, 10
BROADCAST_GROUPS = 100_000


def share(count: str, total: str, terms: str) -> str:
    """SQL of the smoothed share of a count, in parts of ``SCALE`` and 1 at least; exact for any long count. Null without terms."""
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return f"CASE WHEN {terms} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({wide(count)} + 2BD)) DIV ({wide(total)} + 2BD * {wide(terms)}) END"


def gap(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)) of two shares."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q})))"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, held): occurrences of each term and how many documents of the source hold it.

    Tasks count some megabytes of text at a time by hashes of the terms, so that the aggregate and the shuffle get a row for each
    distinct term of these only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                data, offsets = K.buffers(part.column(0))
                data = K.LOWER[data]
                start, end, doc = K.words(data, offsets, _GAP)
                pairs = pa.StructArray.from_arrays(part.columns[1:3], ["lang", "source"])
                named = [c.dictionary_encode() for c in part.columns[1:3]]
                own = named[0].indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(named[1].dictionary) + named[1].indices.to_numpy(zero_copy_only=False)
                key = K.mix(word_hashes(data, start, end) ^ K.mix(own[doc].astype(K.U64) + K.U64(1)))
                order = np.argsort(key, kind="stable")  # documents stay in their order
                key, at = key[order], doc[order]
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                first = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))[: len(key)]
                n = np.diff(np.append(new, len(key)))
                held = np.add.reduceat(first.astype(np.int64), new) if len(new) else n
                some = order[new]
                rows = pairs.take(pa.array(at[new]))
                yield pa.RecordBatch.from_arrays([*rows.flatten(), _strings(data, start[some], end[some]), pa.array(n), pa.array(held)], ["lang", "source", "term", "n", "held"])

    counted = docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, held long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow column."""
    ends = np.append(0, np.cumsum(end - start))
    body = data[np.repeat(start - ends[:-1], end - start) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)]).cast(pa.string())


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from the others of its language, and by which terms.

    Terms are runs of letters (A-Z in lower case; all other characters beyond ASCII count as
    letters).  A language keeps the terms that ``least_docs`` of its documents or more hold.  Part ``pair``: ``item`` is another
    source of the language, ``value`` the divergence of the two over all kept terms, of which there
    may be none (0).  Part ``term``: the ``top`` terms that the source has more of than its language.
    Ranks go by value, then by item.

    Null text, language and source count as empty strings.  A source without terms still has
    its pairs; a lone source has none.  Every row is a document of its own, repeated or not; an empty table gives no
    rows; other columns are ignored.  The result has a row for each ordered pair of a language's sources.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    with Scratch(docs.sparkSession, "divergence") as scratch:
        word = W.partitionBy("lang", "term")
        held = term_counts(plain).withColumns({"docs": F.sum("held").over(word), "all": F.sum("n").over(word)})
        index = scratch.write(held.filter(F.col("docs") >= least_docs).select("lang", "term", "source", "n", "all"), "index")
        kept = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        terms = index.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        groups = plain.select("lang", "source").distinct().join(kept, ["lang", "source"], "left").join(terms, "lang", "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
        groups = scratch.write(groups.withColumn("p0", F.expr(share("0L", "total", "v"))), "groups")
        known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups

        placed = index.join(known, ["lang", "source"]).withColumn("p", F.expr(share("n", "total", "v")))
        placed = scratch.write(placed.withColumn("q", F.expr(share("`all`", "lang_total", "v"))).select("lang", "term", "source", "n", "p", "p0", "q"), "shares")
        best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        more = placed.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
        more = more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

        other = known.select("lang", F.col("source").alias("item"), "v", F.col("p0").alias("o0"))
        pairs = groups.select("lang", "source", "p0").join(other, "lang").filter("source != item")
        base = pairs.select("lang", "source", "item", F.expr(f"coalesce(v * {gap('p0', 'o0')}, 0L)").alias("value"))
        counts = placed.groupBy("lang", "source", "n", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
        alone = counts.join(other, "lang").filter("source != item").withColumn("value", F.expr(f"m * ({gap('p', 'o0')} - {gap('p0', 'o0')})"))
        one = placed.select("lang", "term", "source", "p", "p0")
        two = placed.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
        both = one.join(two.hint("merge"), ["lang", "term"]).filter("source < item").withColumn("value", F.expr(f"{gap('p', 'o')} - {gap('p', 'o0')} - {gap('p0', 'o')} + {gap('p0', 'o0')}"))
        fixes = alone.select("lang", "source", "item", "value").unionByName(both.select("lang", "source", "item", "value")).filter("value != 0")
        fixes = fixes.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        back = fixes.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        summed = base.unionByName(fixes).unionByName(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pair = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
        return scratch.write(pair.unionByName(more), "result", keep=True)
