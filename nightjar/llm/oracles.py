"""DuckDB SQL for the training-data queries that SQL can express."""

OP7 = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
hit AS (
  SELECT p.doc_id, p.i, x.n, x.item_id
  FROM (SELECT p.doc_id, p.i, k.n, p.w[p.i : p.i + k.n - 1] AS g FROM pos p, (SELECT DISTINCT n FROM win) k) p
  JOIN win x ON x.n = p.n AND x.g = p.g),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_KEY = r"translate(trim(l, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, l, spot, {_KEY} AS k FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS spot FROM d)),
rep AS (SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT lines.*, rep.k IS NOT NULL AND doc_id < top AS gone FROM lines LEFT JOIN rep USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY spot) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS dig FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY dig) AS first FROM p)
SELECT page_id, n AS payload_bytes, dig AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT g, min(doc_id) AS low FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (g) WHERE doc_id > low),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_P = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
_GAP = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
ln AS (SELECT lang, count(DISTINCT term) AS v, sum(n) AS ln FROM c GROUP BY 1),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN ln USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", total="total")} AS p, {_P.format(n="sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term)", total="ln")} AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({_GAP.format(p="a.p", q="b.p")}) AS BIGINT) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST({_GAP.format(p="p", q="q")} AS BIGINT) FROM x WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""

#: levels of a tree that the SQL below works through: 8^9 leaves, 8^5 languages
_LEVELS, _TOP = 9, 5
_FIELD = "coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _climb(start: str, keys: str, levels: int, name: str) -> str:
    """CTEs ``name``0 to ``name`` + levels of (keys, i, n, h, l, r): a node's place, its level's size, digest, and its siblings' to the left and right."""
    side = "coalesce(string_agg(h, '') OVER (PARTITION BY {k}i // 8 ORDER BY i ROWS BETWEEN {w}), '')"
    own = f"SELECT *, {side.format(k=keys, w='UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side.format(k=keys, w='1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM"
    out = [f"{name}0 AS ({own} ({start}))"]
    for k in range(levels):
        up = f"SELECT {keys} i // 8 AS i, CAST((n + 7) // 8 AS BIGINT) AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY {keys} i // 8, n"
        out.append(f"{name}{k + 1} AS ({own} ({up}))")
    return ",\n".join(out)


def _fold(levels: int, name: str, key: str, place: str, into: str, source: str) -> str:
    """CTEs that carry (proof, f) of ``source`` up the tree, the last named ``into``."""
    out = []
    for k in range(levels):
        step = "CASE WHEN s.n = 1 THEN {a} ELSE {b} END"
        proof, f = step.format(a="proof", b="proof || s.l || s.r"), step.format(a="f", b="sha256(s.l || f || s.r)")
        out.append(f"{into if k == levels - 1 else f'{into}{k}'} AS (SELECT q.* REPLACE ({proof} AS proof, {f} AS f) FROM {source if k == 0 else f'{into}{k - 1}'} q JOIN {name}{k} s ON {key} s.i = q.{place} // {8**k})")
    return ",\n".join(out)


_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda y, j: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b)), 4294967295), 4294967295)"
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_leaf("text")} AS h, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_LOWERED)} END AS other FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_climb("SELECT g, i, n, h FROM o", "g,", _LEVELS, "a")},
b AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{_LEVELS}),
{_climb("SELECT i, n, h FROM b", "", _TOP, "t")},
w AS (SELECT o.doc_id, o.g, o.i, o.h AS leaf, b.h AS subroot, b.i AS top, (SELECT h FROM t{_TOP}) AS root, '' AS proof, coalesce(other, o.h) AS f FROM o JOIN b USING (g)),
{_fold(_LEVELS, "a", "s.g = q.g AND", "i", "x", "w")},
{_fold(_TOP, "t", "", "top", "y", "x")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM y
"""

ORACLES = {"op3_warc": OP3, "op7_decontaminate": OP7, "op9_line_dedup": OP9, "op11_manifest": OP11, "op12_substring_dedup": OP12, "op13_divergence": OP13}
