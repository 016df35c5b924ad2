"""Training-data operators against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nightjar.llm import decontaminate, kernels, langid, linededup, neardup, packing, quality, sharding, shared, suffixes, tokens, warc

D = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid int, id string, key string, block int, n_lines string, score string, w string, hash int"
LONG = " ".join(f"word{i % 977} item{i}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, "   \n\n "), (4, "one"), (5, "same text " * 30), (6, "same text " * 30), (6, "same text " * 30), (7, LONG), (8, LONG), (None, "null id but words"), (None, None), (9, "é ß 漢字   x"), (10, "A\n" * 50)]


def edge(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", "k", 2, "n", "s", "w", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet' ORDER BY doc_id").fetchall()
    return dict(rows)


def result(spark, name):
    return {r["doc_id"]: r for r in entry.queries()[name](spark, D).collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_suffixes(spark, docs):
    got, seen = result(spark, "op1_suffix_dedup"), set()
    for i, text in sorted(docs.items()):
        raw = text.encode()
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = bytearray(len(raw))
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())


def test_loser_tree():
    rng = np.random.default_rng(5)
    runs, plain = [], []
    for r in range(7):
        strings = sorted(bytes(rng.integers(97, 99, rng.integers(1, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 30)))
        plain += [(s, r, p) for p, s in enumerate(strings)]
        common, rest = [], b""
        for p, s in enumerate(strings):
            c = next((k for k in range(min(len(s), len(strings[p - 1]))) if s[k] != strings[p - 1][k]), min(len(s), len(strings[p - 1]))) if p else 0
            common.append(c)
            rest += s[c:]
        runs.append((bytes(common), [len(s) for s in strings], rest))
    run, place, common = suffixes.merge_runs(runs)
    plain.sort()
    assert list(zip(run, place)) == [(r, p) for _, r, p in plain]
    for k in range(1, len(plain)):
        a, b = plain[k - 1][0], plain[k][0]
        assert common[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_suffix_edges(spark):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(edge(spark)).collect()]
    assert len(got) == len(EDGE)
    by = Counter(got)
    n = len(LONG.encode())
    assert by[(7, n, 0)] == 1 and by[(8, n, n)] == 1 and by[(6, 300, 300)] == 2 and by[(1, 0, 0)] == 1 and by[(10, 100, 0)] == 1
    assert suffixes.remove_repeats(edge(spark, [])).count() == 0


def test_quality(spark, docs):
    for i, r in result(spark, "op2_quality").items():
        w = words(docs[i])
        count, hit = Counter(zip(w, w[1:], w[2:], w[3:], w[4:])), set()
        for k in range(len(w) - 4):
            if count[tuple(w[k : k + 5])] > 1:
                hit.update(range(k, k + 5))
        seen, dup = set(), 0
        for line in docs[i].split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in docs[i]), dup, len(hit))
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_quality_model():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(2000) < 0.1)).astype(float)
    model = quality.fit(x, y, [-1, 0, 0])
    assert ((model.scores(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    line = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5), np.full(200, 0.5)], 1)
    assert (np.diff(model.scores(line)) <= 1e-12).all()  # monotone
    assert quality.fit(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_edges(spark):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(edge(spark), quality.train(edge(spark), labels)).collect()
    assert len(got) == len(EDGE) and all(r["base_failed"] for r in got if r["n_words"] < 10)
    assert quality.score(edge(spark, []), quality.train(edge(spark, []), labels.limit(0))).count() == 0


PAGES = [(1, "http://a/\r\nx", "p" * 200), (2, None, "p" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (None, "u", "p" * 200), (8, "u", "é" * 5000)]


@pytest.mark.parametrize("segment", [64, 1000, 1 << 20])
def test_warc(spark, tmp_path, segment):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    out = f"file://{tmp_path}/w"
    warc.write_warc(pages, out)
    records = warc.read_warc(spark, out, segment_bytes=segment)
    payloads = sorted(bytes(r["payload"]).decode() for r in records.filter("type = 'response'").collect())
    assert payloads == sorted([h or "" for i, _, h in PAGES if i not in (2, None)])
    got = {r["page"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.resolved(records).collect()}
    for i, _, h in PAGES:
        raw = (h or "").encode()
        again = i in (2, None)
        assert got[None if i is None else str(i)] == ("revisit" if again else "response", "1" if again else None, len(raw), hashlib.sha256(raw).hexdigest())


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def components_of(texts, n, percent):
    sets = {}
    for i, text in texts.items():
        w = words((text or "").translate(ASCII))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_neardup(spark, docs):
    want = components_of(docs, 3, 85)
    for i, r in result(spark, "op4_neardup").items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[i], want[i][1] == i)


def test_neardup_chains(spark):
    """Copies of copies, edited a little each time, and two families with one passage."""
    rng = np.random.default_rng(2)
    texts, base = {}, [f"w{x}" for x in rng.integers(0, 10_000, 200)]
    for i in range(120):
        base = list(base)
        for k in rng.integers(0, 200, 4):
            base[k] = f"n{i}x{k}"
        texts[int(rng.integers(10**9))] = " ".join(base)
    want = components_of(texts, 5, 80)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in neardup.groups(df).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    kept = neardup.keep_first(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_neardup_edges(spark):
    got = neardup.groups(edge(spark)).collect()
    assert len(got) == len(EDGE) and all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (1, 2, 3))
    assert {r["component_id"] for r in got if r["doc_id"] in (7, 8)} == {7}
    kept = neardup.keep_first(edge(spark))
    assert kept.columns == edge(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 7, None, None, 9, 10])
    assert neardup.keep_first(edge(spark, [])).count() == 0


def test_odd_sketch_bound():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64)) for _ in range(2)]
    mixed = [np.sort(np.concatenate((sets[0][:-k], sets[1][:k]))) if k else sets[0] for k in (0, 5, 40)]
    at = np.cumsum([0] + [len(m) for m in mixed])
    s = neardup._sketches(np.concatenate(mixed), at)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert np.unpackbits(s[a] ^ s[b]).sum() <= len(np.setxor1d(mixed[a], mixed[b]))


def test_packing(spark, docs):
    model = kernels.CachedEncoder(tokens.tokenizer_path("byte_bpe_50k.json")).model
    rows = entry.queries()["op5_packing"](spark, D).toPandas().sort_values(["doc_id", "piece"])
    for i, own in rows.groupby("doc_id"):
        ids, at = [*model.encode(docs[i], add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(own.itertuples()):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 1024
    assert rows["sequence_id"].nunique() <= 1.02 * -(-rows["length"].sum() // 1024)


def test_pack_histogram():
    rng = np.random.default_rng(1)
    for x in (rng.integers(1, 1024, 5000), rng.integers(300, 700, 2000), np.array([1023]), np.array([512, 512, 513])):
        counts = dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True))))
        held = Counter()
        runs = packing.pack_histogram(counts, 1024)
        for n, own in runs:
            assert sum(own) <= 1024
            for s in own:
                held[s] += n
        assert held == counts
    assert packing.pack_histogram({}, 1024) == []


def test_pack_edges(spark):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(edge(spark), path).toPandas()
    assert rows["sequence_id"].nunique() >= 1 and (rows.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert len(rows[rows["doc_id"] == 1]) == 1 and rows[rows["doc_id"] == 1]["length"].iloc[0] == 1
    assert packing.pack(edge(spark, []), path).count() == 0


def test_langid(spark, docs):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{D}/documents.parquet'").fetchall())
    got = result(spark, "op6_langid")
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    unseen = [r["lang_pred"] == lang[i] for i, r in got.items() if r["held_out"]]
    assert np.mean(unseen) > 0.95


def test_langid_edges(spark):
    rows = edge(spark).withColumn("lang", F.when(F.col("doc_id") > 4, "en"))
    got = {r["doc_id"]: r for r in langid.predict(rows, langid.train(rows)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3)) and got[7]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.predict(edge(spark), langid.train(edge(spark))).collect()} == {"und"}
    assert langid.predict(edge(spark, []), None).count() == 0


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "one"), (2, "SAME text same text same text same text same text same"), (3, None), (4, "!!"), (5, "漢字")], "item_id long, text string")
    got = decontaminate.report(edge(spark), items).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[4]["items"] == ["1"] and by[5]["n_hit"] == 60 and by[9]["items"] == ["5"] and not by[7]["contaminated"]
    left = decontaminate.drop_contaminated(edge(spark), items)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, 2, 3, 7, 8, None, None, 10])
    assert decontaminate.report(edge(spark, []), items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(edge(spark), items.limit(0)).collect())
    cut = {r["doc_id"]: r["clean"] for r in decontaminate.remove_spans(edge(spark), items).collect() if r["doc_id"]}
    assert cut[5] == "" and cut[9] == "é ß   x".replace(" ", " ")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_tokens(spark, tmp_path, encoding):
    path, out = tokens.tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/t"
    tokens.write_tokens(edge(spark), out, path, encoding=encoding)
    model = kernels.CachedEncoder(path).model
    rows = tokens.read_tokens(spark, out, ("id", "n_tokens", "ids"), 7, 9).collect()
    assert [(r["id"], r["ids"]) for r in rows] == [(i, [*model.encode(LONG, add_special_tokens=False).ids, 2]) for i in (7, 8)]
    got = tokens.digests(spark, out).orderBy("start").collect()
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]] and [r["id"] for r in got][:3] == [None, None, 1]


def test_tokens_empty(spark):
    assert tokens.token_table(edge(spark, []), tokens.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_encoder_chunks():
    enc = kernels.CachedEncoder(tokens.tokenizer_path("byte_bpe_50k.json"), capacity=50)
    import pyarrow as pa

    texts = ["don't a.b,c  x  \n y's it's 'tis x.'s", "", "    foo  bar", "<|endoftext|> hi", "ÀÉ× ÷.é,ß!ŝ.x", "a\x1c b\x7f c", "a  b  c  ", LONG[:3000], "\t\tx\r\n"]
    ids, at = enc.encode(*kernels.buffers(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == enc.model.encode(text, add_special_tokens=False).ids


def test_lines(spark):
    line = "a line of twenty characters or more"
    rows = [(1, f"x\n{line}"), (2, f"  {line.upper()} \ny"), (3, line), (3, line), (4, f"{line}!\n{line}!\nshort"), (5, f"{line}!"), (None, line)]
    got = linededup.dedup_lines(edge(spark, rows)).collect()
    by = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in got), key=str)
    assert by == sorted([(1, "x", 1), (2, "y", 1), (3, line, 0), (3, line, 0), (4, f"{line}!\n{line}!\nshort", 0), (5, f"{line}!", 0), (None, "", 1)], key=str)
    assert linededup.dedup_lines(edge(spark, [])).count() == 0
    assert linededup.dedup_lines(edge(spark)).count() == len(EDGE)


def test_line_runs(spark):
    """A batch's keys are anti-joined with the runs; runs share no key and full levels are merged."""
    batches = [[(1, 1, 9), (1, 1, 8), (2, 2, 8)], [(1, 1, 7), (3, 3, 6)], [(3, 3, 5), (4, 4, 5)], [(2, 2, 1)]]
    with shared.Scratch(spark, "test") as scratch:
        runs = linededup.LineRuns(scratch, fanout=2)
        fresh = []
        for rows in batches:
            own = runs.add(spark.createDataFrame(rows, "h1 long, h2 long, id long"))
            fresh.append(sorted((r["h1"], r["id"]) for r in own.collect()))
            runs.compact()
        assert fresh == [[(1, 9), (2, 8)], [(3, 6)], [(4, 5)], []]
        assert [len(x) for x in runs.levels] == [0, 0, 1]
        assert sorted((r["h1"], r["id"]) for run in runs.live() for r in run.collect()) == [(1, 9), (2, 8), (3, 6), (4, 5)]


def test_sharding(spark):
    rows = sharding.shard_rows(edge(spark), n_shards=3).toPandas()
    assert sorted(rows.groupby("shard").size()) == [4, 4, 5]
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    by = rows[rows["doc_id"] == 1].iloc[0]
    assert (by["size"], by["text_crc32"], by["law"]) == (1, 0, "rows")
    assert rows[rows["doc_id"] == 9].iloc[0]["text_crc32"] == zlib.crc32(EDGE[11][1].encode())
    assert sharding.shard_rows(edge(spark, [])).count() == 0


def test_matrix_is_uniform():
    total = np.zeros((3, 2))
    for seed in range(400):
        m = sharding.communication_matrix([4, 6, 2], [7, 5], seed)
        assert m.sum(1).tolist() == [4, 6, 2] and m.sum(0).tolist() == [7, 5]
        total += m
    assert np.allclose(total / 400, np.outer([4, 6, 2], [7, 5]) / 12, atol=0.15)
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 300) < 5 and 10 < np.std(big) < 19
