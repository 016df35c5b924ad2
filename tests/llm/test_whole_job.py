"""Cases that a shortened job would get wrong."""

import hashlib
import io
from collections import Counter

import pytest

import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from nightjar.llm import decontaminate, kernels, langid, linededup, packing, quality, shared, tokens, warc

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("segment", [50_000, 1 << 20])
def test_warc_long_url(spark, tmp_path, segment):
    """A header of any length is read to its end, and no record after it is lost."""
    body = "<p>" + "x" * 300
    rows = [(i, "data:," + "u" * (200_000 if i == 3 else 70_000 if i == 7 else 40), body + str(i % 5)) for i in range(10)]
    out = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), out)
    records = warc.read_warc(spark, out, segment_bytes=segment)
    assert sorted(len(r["uri"]) for r in records.collect()) == sorted(len(u) for _, u, _ in rows)
    got = {r["page"]: (r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in warc.resolved(records).collect()}
    assert got == {str(i): ("response" if i < 5 else "revisit", len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows}


@pytest.mark.parametrize("cut", [10, 1_500])
def test_warc_broken_file(spark, tmp_path, cut):
    warc.write_warc(spark.createDataFrame([(i, "u", f"{i}" * 900) for i in range(4)], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    (whole,) = (tmp_path / "w").glob("part-*")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.txt").write_bytes(whole.read_bytes()[:-cut])
    with pytest.raises(Exception, match="no record at byte|is cut off"):
        warc.read_warc(spark, f"file://{tmp_path}/broken").collect()


class _File(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_warc_magic_in_lines():
    """Magic bytes within a header's lines count as places of their own, as far as the fields follow them."""
    head = b"WARC/1.1\r\nWARC-Type: response\r\nX: WARC/1.1\r\nWARC-Type: a\r\nY: WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    text = b"WARC/1.1\r\nno\nrecord" + head + b"WARC/1.1\r\nWARC-Type: x"
    data = warc._Bytes(_File(text), 0, 20, len(text))
    assert data.buffer == text[:20]
    data = warc._Bytes(_File(text), 0, len(text), len(text))
    first = text.index(b"record") + 6
    inner = text.index(b"WARC/1.1", first + 1)
    assert list(data.records(len(text))) == [(first, first + len(head)), (inner, first + len(head))]


def test_pack_dominant_lengths():
    """One of 500 and two of 262 fill a sequence; pairs of 500 would cost a sixth more."""
    counts = {500: 3_000, 262: 6_000}
    held = Counter()
    runs = packing.pack_histogram(counts, 1024)
    for n, own in runs:
        assert sum(own) <= 1024
        for s in own:
            held[s] += n
    assert held == counts
    assert sum(n for n, _ in runs) <= 1.01 * 3_000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens(name):
    """Strings of added tokens become those tokens, as a fresh model does it; nothing is cut inside them."""
    path = tokens.tokenizer_path(name)
    model, enc = Tokenizer.from_file(path), kernels.CachedEncoder(path)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "", "a<|endoftext|><|startoftext|>b.", "<|ENDOFTEXT|> <|endoftext", "|> x", "plain text, no token", "<|endoftext|>don't<|endoftext|>"]
    for some in (texts, texts[::-1], texts[:1]):
        ids, at = enc.encode(*kernels.buffers(pa.array(some)))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(some))] == [model.encode(t, add_special_tokens=False).ids for t in some]


def test_unknown_tokenizer(tmp_path):
    model = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    model.pre_tokenizer = None
    model.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="isn't known"):
        kernels.CachedEncoder(str(tmp_path / "t.json"))


def test_tokens_query(spark):
    model, at, want = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json")), 0, {}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet' ORDER BY doc_id").fetchall():
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in entry.queries()["op8_tokens"](spark, D).collect()} == want


def test_sharding_query(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall())
    rows = entry.queries()["op10_sharding"](spark, D).toPandas()
    assert sorted(rows["doc_id"]) == sorted(docs)
    sizes = rows.groupby("shard").size()
    assert sorted(sizes.index) == list(range(8)) and sizes.max() - sizes.min() <= 1
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    for r in rows.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "rows")


@pytest.mark.parametrize(("low", "high", "most"), [(1, 1024, None), (300, 400, 7_237), (205, 480, None), (100, 201, None)])
def test_never_above_best_fit(low, high, most):
    x = np.random.default_rng(0).integers(low, high, 20_000)
    counts = dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True))))
    made = sum(n for n, _ in packing.pack_histogram(counts, 1024))
    assert made <= sum(n for n, _ in packing.plan_histogram(counts, 1024, 256, 1.0)) and (most is None or made <= most)


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² 3"), (2, "①Ⅷ"), (3, "a"), (4, "漢")], "doc_id long, text string")
    model = langid.fit(np.packbits(langid.presence(*kernels.buffers(pa.array(["some words", "des mots"]))).astype(bool), axis=1), ["en", "fr"])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got[1] == got[2] == "und" and "und" not in (got[3], got[4])


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="must be an integer"):
        linededup.dedup_lines(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_many_lines(spark):
    """A text of many lines is split once."""
    line = "the same line in each of them"
    rows = [(i, "\n".join(f"line number {i} {k} of this text" for k in range(40_000 if i == 9 else 2)) + f"\n{line}") for i in range(10)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ((40_001, 0) if i == 9 else (3, 1)) for i in range(10)}


def test_windows_beyond_the_broadcast_bound(spark, monkeypatch):
    """The shuffled probe finds what the broadcast one finds."""
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "one two"), (3, None), (4, "k l m n o p q r s t u v")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two three"), (2, "l m n o p q r s t u v"), (3, "")], "item_id long, text string")
    want = sorted(map(str, decontaminate.report(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontaminate.report(docs, items).collect())) == want and "n_hit=11" in want[-1]


def test_quality_on_held_out_labels(spark):
    """Labels that the model hasn't seen: the verdict tells good from bad."""
    d = D.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = F.col("doc_id") % 3 != 0
    got = quality.score(docs, quality.train(docs, labels.filter(seen))).join(labels.filter(~seen), "doc_id").select("quality", "kept").toPandas()
    assert len(got) > 100 and (got["kept"] == (got["quality"] == 1)).mean() > 0.9


def test_scratch_is_removed(spark, tmp_path):
    with shared.Scratch(spark, "test") as scratch:
        scratch.root = f"file://{tmp_path}/s"
        scratch.write(spark.range(3), "gone")
        scratch.buckets(spark.range(3), "gone", ["id"])
        kept = scratch.write(spark.range(3), "kept", keep=True)
    assert kept.count() == 3 and not any((tmp_path / "s").iterdir())
