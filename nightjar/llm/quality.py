"""Quality rules: boosted trees over document statistics (operator 2).

Statistics come from vectorised passes over whole texts.  A gradient-boosted
ensemble of shallow trees is fitted on at most ``max_rows`` labelled documents,
those with the smallest hash of their id, and flattened into numpy node arrays; all
documents of a batch walk all trees level by level.  Chosen features are held
monotonic: a split that would break the direction is not taken and each child's
values stay on its side of the middle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernels as K

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_ratio", "symbol_words", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "stop_ratio", "words_per_line", "pipe_ratio", "top_word_ratio"]
FEATURES = ["n_words", *RATIOS]
#: -1: the quality must not rise with the feature
MONOTONE = {"symbol_ratio": -1, "symbol_words": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "pipe_ratio": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?,;:"]] = True
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per-document counts and ratios."""
    n_docs = len(offsets) - 1

    def per_doc(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def count(doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=n_docs).astype(np.int64)

    start, end, doc = K.words(data, offsets)
    hasher = K.Hasher(data)
    n_words = count(doc)
    inside = ~K.BLANK[data]
    out = {"n_words": n_words, "word_chars": per_doc(inside & ((data & 0xC0) != 0x80)), "n_symbols": per_doc(_SYMBOL[data])}

    # lines that hold a word and equal an earlier line
    cut = ~_NEWLINE
    l_start, l_end, l_doc = K.words(data, offsets, cut)
    worded = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    has = worded[l_end] > worded[l_start]
    l_start, l_end, l_doc = l_start[has], l_end[has], l_doc[has]
    n_lines = count(l_doc)
    out["n_dup_lines"] = n_lines - count(K.distinct(l_doc, hasher.spans(l_start, l_end))[0])

    # words in five-word windows that the document has twice or more
    h = hasher.spans(start, end) if len(start) else np.zeros(0, K.U64)
    out["n_repeat_words"] = np.zeros(n_docs, np.int64)
    if len(h) >= 5:
        up, _ = K.powers(6)
        gram = np.zeros(len(h) - 4, K.U64)
        for i in range(5):
            gram += h[i : len(h) - 4 + i] * up[5 - i]
        same = np.flatnonzero(doc[:-4] == doc[4:])
        key = K.mix(K.mix(gram[same]) + doc[same].astype(K.U64) * K.U64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        k = key[order]
        twice = np.zeros(len(k), bool)
        twice[1:] = k[1:] == k[:-1]
        twice[:-1] |= k[1:] == k[:-1]
        mark = np.zeros(len(h) + 1, np.int64)
        at = same[order[twice]]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + 5, -1)
        out["n_repeat_words"] = count(doc[np.cumsum(mark)[:-1] > 0])

    words, chars, nbytes = np.maximum(n_words, 1), np.maximum(out["word_chars"], 1), np.maximum(np.diff(offsets), 1)
    u_doc, _ = K.distinct(doc, h)
    d, v = (doc[o := np.lexsort((h, doc))], h[o]) if len(h) else (doc, h)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    top = np.zeros(n_docs, np.int64)
    if len(d):
        firsts = np.flatnonzero(new)
        np.maximum.at(top, d[firsts], np.diff(np.append(firsts, len(d))))
    symbol_end = _SYMBOL[data[end - 1]] if len(end) else np.zeros(0, bool)
    out |= {
        "mean_word": out["word_chars"] / words,
        "symbol_ratio": out["n_symbols"] / chars,
        "symbol_words": count(doc[symbol_end]) / words,
        "dup_line_ratio": out["n_dup_lines"] / np.maximum(n_lines, 1),
        "repeat_ratio": out["n_repeat_words"] / words,
        "distinct_ratio": count(u_doc) / words,
        "upper_ratio": per_doc(_UPPER[data]) / nbytes,
        "digit_ratio": per_doc(_DIGIT[data]) / nbytes,
        "stop_ratio": per_doc(_STOP[data]) / words,
        "words_per_line": n_words / np.maximum(n_lines, 1),
        "pipe_ratio": per_doc(data == ord("|")) / words,
        "top_word_ratio": top / words,
    }
    return out


@dataclass
class Trees:
    """Flattened ensemble: node arrays of shape (trees, nodes); a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                go = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(go, self.left[t, node], self.right[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Histogram-based boosting of the logistic loss, with monotonic features."""
    n, m = x.shape
    nodes = 2 ** (depth + 1) - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)] if n else [np.zeros(0)] * m
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, m), int)
    p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    f = np.full(n, base)
    shape = (trees, nodes)
    out = Trees(np.zeros(shape, np.int32), np.full(shape, np.inf), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.zeros(shape), depth, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = q - y, q * (1 - q)
        where = np.zeros(n, np.int32)
        open_nodes = [(0, -np.inf, np.inf)]
        for _ in range(depth):
            following = []
            for node, low, high in open_nodes:
                own = np.flatnonzero(where == node)
                total_g, total_h = g[own].sum(), h[own].sum()
                best = (1e-6, None)
                for j in range(m):
                    k = len(cuts[j])
                    if not k or not len(own):
                        continue
                    gs = np.bincount(binned[own, j], g[own], k + 1).cumsum()[:-1]
                    hs = np.bincount(binned[own, j], h[own], k + 1).cumsum()[:-1]
                    gr, hr = total_g - gs, total_h - hs
                    vl, vr = np.clip(-gs / (hs + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                    ok = (hs >= least) & (hr >= least)
                    if monotone[j]:
                        ok &= (vr - vl) * monotone[j] >= 0
                    gain = gs**2 / (hs + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
                    gain = np.where(ok, gain, -1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (j, i, vl[i], vr[i]))
                if best[1] is None:
                    continue
                j, i, vl, vr = best[1]
                a, b = 2 * node + 1, 2 * node + 2
                out.feature[t, node], out.threshold[t, node], out.left[t, node], out.right[t, node] = j, cuts[j][i], a, b
                go = binned[own, j] <= i
                where[own[go]], where[own[~go]] = a, b
                middle = (vl + vr) / 2
                sides = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
                following += [(a, *sides[0]), (b, *sides[1])]
                out.value[t, a], out.value[t, b] = rate * vl, rate * vr
            open_nodes = following
        f += out.value[t, where]
    return out


def _columns(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([stats[c].astype(float) for c in FEATURES], 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Trees:
    """Fit on at most ``max_rows`` labelled documents (the smallest hashes of their ids)."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    picked = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "k").select("text", F.col("y").cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                x = _columns(statistics(*K.buffers(part.column(0))))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(x.shape[1])), part.column(1)], [*FEATURES, "y"])

    # repeated rows of one id could pass the bound: cut again
    rows = picked.mapInArrow(run, T.StructType([T.StructField(c, T.DoubleType()) for c in [*FEATURES, "y"]])).limit(max_rows).toPandas().sort_values([*FEATURES, "y"])
    return fit(rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float), [MONOTONE.get(c, 0) for c in FEATURES])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: id, the base counts, the statistics, ``base_failed``, ``score`` and ``kept``.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in
    five-word windows that the text repeats.  ``kept``: not ``base_failed`` and a
    score of ``threshold`` or more.  Null and empty texts have zero counts and fail.
    Repeated rows are scored alike; other columns are ignored.  Without labels all
    documents that pass the base rules score 0.5 and are kept.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                stats = statistics(*K.buffers(part.column(1)))
                p = model.scores(_columns(stats))
                failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(stats[c]) for c in [*BASE, *RATIOS]), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], [id_col, *BASE, *RATIOS, "base_failed", "score", "kept"]
                )

    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in BASE), *(T.StructField(c, T.DoubleType()) for c in RATIOS), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)
