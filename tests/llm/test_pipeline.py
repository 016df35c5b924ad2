"""The pipeline's stages against a plain version."""

import re

import duckdb

import corpus_pipeline as cp
from nightjar.llm.shared import Scratch

from .test_operators import ASCII, D, EDGE, components_of, edge


def plain_lines(docs):
    holders = {}
    for i, text in docs.items():
        for line in text.split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    out = {}
    for i, text in docs.items():
        stay = []
        for line in text.split("\n"):
            own = holders.get(line.strip(" \t\n\x0b\x0c\r").translate(ASCII), ())
            if len(own) < 3 or i == max(own):
                stay.append(line)
        out[i] = "\n".join(stay)
    return out


def test_stages(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall())
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{D}/benchmark.parquet'").fetchall()]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(ASCII))
    windows = {tuple(w[k : k + 10]) for w in map(word, items) for k in range(max(1, len(w) - 9)) if w}
    want = plain_lines({i: t for i, t in docs.items() if any(c.isalpha() for c in t)})
    comp = components_of(want, cp.SHINGLE_WORDS, cp.SIMILARITY)
    want = {i: t for i, t in want.items() if comp[i][1] == i}

    def hit(t):
        w = word(t)
        return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    want = {i: t for i, t in want.items() if not hit(t)}
    df = spark.read.parquet(f"{D}/documents.parquet")
    columns = df.columns
    for name, stage in cp.STAGES[:-1]:
        df = Scratch(spark, "test").write(stage(spark, df, D), name, keep=True)
        assert df.columns == columns
    assert {r["doc_id"]: r["text"] for r in df.collect()} == want
    packed = cp.STAGES[-1][1](spark, df, D)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(want)


def test_stage_edges(spark):
    for rows in (EDGE, []):
        for name, stage in cp.STAGES[:-1]:
            df = edge(spark, rows)
            out = stage(spark, df, D)
            assert out.columns == df.columns and out.count() <= df.count(), name
