"""Manifest, repeated word windows and divergence: against plain versions, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nightjar.llm import divergence, linededup, manifest, packing, shared, substrings, tokens

from .test_operators import ASCII, D, EDGE, SCHEMA, docs, edge, words  # noqa: F401

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Rows (doc_id, leaf, subroot, root, proof, folded, verified) of dicts, by recursion over lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*(field(r[c]) for c in FIELDS))

    def up(nodes, proofs):
        """Digest of a list of (digest, leaf keys); siblings are added to ``proofs``."""
        while len(nodes) > 1:
            above = []
            for k in range(0, len(nodes), 8):
                run = nodes[k : k + 8]
                for j, (_, keys) in enumerate(run):
                    for key in keys:
                        proofs[key].append(([h for h, _ in run[:j]], [h for h, _ in run[j + 1 :]]))
                above.append((sha(*(h for h, _ in run)), [key for _, keys in run for key in keys]))
            nodes = above
        return nodes[0]

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), i))
    proofs, tops = defaultdict(list), []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        tops.append(up([(h, [i]) for _, _, h, i in sorted(groups[lang])], proofs))
    subroot = {i: h for h, keys in tops for i in keys}
    root = up(tops, proofs)[0]
    out = []
    for i, r in enumerate(rows):
        other = r
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
            other = r | {"text": r["text"].translate(ASCII)}
        f = leaf(other)
        for left, right in proofs[i]:
            f = sha(*left, f, *right)
        out.append((r["doc_id"], leaf(r), subroot[i], root, sha(*(h for left, right in proofs[i] for h in left + right)), f, f == root))
    return out


def manifest_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_manifest(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert manifest_rows(entry.queries()["op11_manifest"](spark, D)) == Counter(plain_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 73])
def test_manifest_shapes(spark, n):
    """Lone leaves, full runs, runs of one; a null language and one that sorts beyond ASCII."""
    rows = [{"doc_id": i * 7 % 101, "text": None if i % 5 == 0 else f"Text {i}", "lang": (None, "z", "é", "")[0 if i == 3 else 1 + (i > 9) + (i == 70)], "source": "s" if i % 2 else None, "n_chars": i} for i in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(manifest.manifest(df)) == Counter(plain_manifest(rows) if rows else [])


def test_manifest_edges(spark):
    rows = [dict(zip(FIELDS, (i, None, None, None, t), strict=True)) for i, t in EDGE]
    got = manifest.manifest(edge(spark).withColumns({"tree": F.lit(1), "leaf": F.lit(2), "place": F.lit(3)}), with_proof=True)
    assert manifest_rows(got.drop("proof")) == Counter(plain_manifest(rows))
    assert all(sha(*r["proof"]) == r["proof_sha256"] for r in got.collect())


def test_manifest_missing_child(spark, tmp_path):
    """A vertex that doesn't get all its messages stops the job."""
    from nightjar.llm.shared import Scratch

    nodes = spark.sparkContext.parallelize([("=a", i, 9, sha(str(i))) for i in range(9) if i != 4], 2)
    with Scratch(spark, "test") as scratch, pytest.raises(Exception, match="has 7 of 8 children"):
        manifest.climb(scratch, nodes, 9, 9, 8)


def plain_windows(rows, k=13):
    """{row number: (n_words, removed flags, words)}."""
    own = [words(t) for _, t in rows]
    low = {}
    for (i, _), w in zip(rows, own, strict=True):
        key = float("inf") if i is None else i
        for a in range(len(w) - k + 1):
            g = tuple(w[a : a + k])
            low[g] = min(low.get(g, key), key)
    out = []
    for (i, _), w in zip(rows, own, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if low[tuple(w[a : a + k])] < (float("inf") if i is None else i):
                gone[a : a + k] = [True] * k
        out.append((i, w, gone))
    return out


def check_windows(df, rows, k=13):
    want = Counter()
    for i, w, gone in plain_windows(rows, k):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        spans = tuple((m.start(), m.end() - m.start()) for m in re.finditer("x+", "".join("x" if g else "." for g in gone)))
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), spans, kept] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], tuple(map(tuple, r["spans"])), r["kept"]) for r in df.collect())
    assert got == want


def test_windows_edges(spark):
    check_windows(substrings.remove_windows(edge(spark), with_text=True), EDGE)
    assert substrings.remove_windows(edge(spark, [])).count() == 0
    with pytest.raises(TypeError):
        substrings.remove_windows(edge(spark), id_col="key")


@pytest.mark.parametrize("seed", range(3))
def test_windows_random(spark, seed, monkeypatch):
    """Short alphabets, shared passages and repeated ids, over several blocks and buckets."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 900)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 500)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 64)
    rng = np.random.default_rng(seed)
    shared = [" ".join(f"w{x}" for x in rng.integers(0, 400, 20)) for _ in range(4)]
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(0, 6)):
            parts.append(shared[rng.integers(4)] if rng.random() < 0.4 else " ".join(f"é{x}" for x in rng.integers(0, 2, rng.integers(0, 25))))
        rows.append((None if rng.random() < 0.05 else int(rng.integers(-5, 40)), rng.choice(["\n", "  ", "\t"]).join(parts)))
    for k in (13, 3):
        check_windows(substrings.remove_windows(edge(spark, rows), k=k, with_text=True), rows, k)


def test_windows_planted(spark):
    """A passage in every third document goes from all but the first; clean documents stay whole."""
    rng = np.random.default_rng(9)
    fresh = lambda i, n: " ".join(f"u{i}v{x}" for x in range(n))
    passage = " ".join(f"p{x}" for x in range(60))
    rows = [(i, f"{fresh(i, 30)} {passage} {fresh(-i - 1, 9)}" if i % 3 == 0 else fresh(i, int(rng.integers(0, 80)))) for i in range(90)]
    got = {r["doc_id"]: r for r in substrings.remove_windows(edge(spark, rows)).collect()}
    assert all(got[i]["n_removed"] == (60 if i % 3 == 0 and i else 0) for i in range(90))
    assert [tuple(s) for s in got[3]["spans"]] == [(30, 60)]


def plain_divergence(rows, least, top):
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    held, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        own = split(text)
        held[lang].update(set(own))
        counts[lang, source].update(own)
        sources[lang].add(source)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, own in sources.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v, p = len(kept), {}
        whole = Counter({t: sum(counts[lang, s][t] for s in own) for t in kept})
        for s, c in [*((s, counts[lang, s]) for s in own), (None, whole)]:
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        for s in own:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(f(p[s][t], p[None][t]), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def sources(spark, rows):
    return spark.createDataFrame([(lang, s, t, "x", 1) for lang, s, t in rows], "lang string, source string, text string, term string, n int")


@pytest.mark.parametrize("least,bound", [(10, None), (2, 0), (1, 0)])
def test_divergence(spark, least, bound, monkeypatch):
    """Hot and rare terms, sources without terms, nulls and a lone source; both ways to join the groups."""
    if bound is not None:
        monkeypatch.setattr(divergence, "BROADCAST_GROUPS", bound)
    rng = np.random.default_rng(4)
    rows = [("en", f"s{min(int(rng.integers(0, 9)), 5)}", " ".join(rng.choice(["The", "the", "Éa", "éa", "x1y", "of", f"w{'abcdefgh'[i % 8]}"], rng.integers(0, 30)))) for i in range(120)]
    rows += [(None, None, "a b a"), (None, "q", None), ("de", "only", "ja " * 12), ("en", "none", "12 34"), ("fr", "a", ""), ("fr", "b", None), ("", "q", "a")] * 2
    got = divergence.divergence(sources(spark, rows), least_docs=least, top=3)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_divergence(rows, least, 3)


def test_divergence_empty(spark):
    assert divergence.divergence(sources(spark, [])).count() == 0
    assert divergence.divergence(edge(spark)).count() == 0  # one source
    assert divergence.divergence(edge(spark).withColumn("source", F.col("doc_id").cast("string"))).filter("part = 'pair' AND value = 0").count() == 110


def test_share_is_exact(spark):
    """Counts of a corpus of 100 TB, where products pass 64 bits."""
    n, total, v = 10**12 + 7, 9 * 10**13 + 1, 10**7
    got = spark.sql(f"SELECT {divergence.share(f'{n}L', f'{total}L', f'{v}L')} AS p").first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def rest_lengths(sf):
    """How many pieces under 1,024 tokens of each length the documents have."""
    counts = Counter()
    for (text,) in duckdb.sql(f"SELECT list(coalesce(text, '')) FROM '/root/testdata/{sf}/documents.parquet' GROUP BY doc_id // 500").fetchall():
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["text"])
        for _, _, at in tokens.encoded(batch, "text", tokens.tokenizer_path("byte_bpe_50k.json"), tokens.END_ID):
            n = np.diff(at)
            counts.update((n - (-(-n // 1024) - 1) * 1024).tolist())
    return {s: n for s, n in counts.items() if s < 1024}


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1", "uniform", "narrow", "long tail"])
def test_pack_by_grouping(name):
    """Configurations make the plan, which needs no more sequences than best fit and little more than the proven least."""
    rng = np.random.default_rng(1)
    made = {"uniform": lambda: rng.integers(1, 1024, 1_000_000), "narrow": lambda: rng.integers(300, 400, 20_000), "long tail": lambda: np.clip(rng.exponential(250, 200_000), 1, 1023).astype(int)}
    counts = dict(Counter(made[name]().tolist())) if name in made else rest_lengths(name)
    plan, plain = packing.best_plan(counts, 1024), packing.grouped_plan(counts, 1024, 1, 1.0)
    large = sum(n for s, n in counts.items() if s > 0.48 * 1024)
    held = Counter()
    for n, own in plan.runs:
        assert sum(own) <= 1024
        for s in own:
            held[s] += n
    assert held == counts and plan.made <= plain.made and plan.made <= plan.least + max(2, 1e-3 * plan.least)
    assert plan.grouped >= 0.9 * min(plan.made, large)  # configurations carry the large pieces


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_runs(spark, capsys):
    """Runs have one file a bucket, are joined without a shuffle or sort, and hold each key once with its largest id; hot keys too."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = lambda df: Counter(int(re.search(r"_(\d+)\.", r["f"].rsplit("/", 1)[1])[1]) for r in df.select(F.input_file_name().alias("f")).distinct().collect())
    with shared.Scratch(spark, "test") as scratch:
        runs, seen = linededup.LineRuns(scratch, fanout=2), {}
        for batch in range(5):
            # a key that half of all rows have, keys of this batch and of the one before
            rows = spark.range(2_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise((F.col("id") / 4).cast("long") + batch * 250).alias("h1"), F.lit(7).cast("long").alias("h2"), (100_000 - batch * 10_000 + F.col("id")).alias("id"))
            if runs.live():
                with linededup.files_in_order(spark):
                    one = runs.live()[0]
                    plan = explained(one.join(runs.live()[-1].select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"))
                    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
            for r in rows.groupBy("h1").agg(F.max("id").alias("id")).collect():
                seen.setdefault(r["h1"], r["id"])
            fresh = runs.add(rows)
            assert {r["h1"] for r in fresh.collect()} <= set(seen)
            runs.compact()
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        got = [(r["h1"], r["id"]) for run in runs.live() for r in run.collect()]
        assert sorted(got) == sorted(seen.items())
        for run in runs.live():
            assert max(files(run).values()) == 1 and len(files(run)) <= n
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_line_keys_are_combined_first(spark):
    """The plan that makes a batch's keys combines equal lines before the shuffle, and no join is below it."""
    lines = spark.range(1_000).select(F.lit(1).cast("long").alias("h1"), (F.col("id") % 3).alias("h2"), "id")
    made = []

    class Told(shared.Scratch):
        def buckets(self, df, name, keys, dealt=False):
            made.append((name, explained(df)))
            return super().buckets(df, name, keys, dealt)

    with Told(spark, "test") as scratch:
        runs = linededup.LineRuns(scratch, fanout=3)
        runs.add(lines), runs.add(lines)
    assert [name for name, _ in made] == ["lines-new", "lines-new", "lines-l0"]
    assert all("Join" not in plan and plan.count("HashAggregate") == 2 for name, plan in made if name == "lines-new")
    assert "Aggregate" not in made[2][1] and "Exchange" not in made[2][1]
