"""DuckDB SQL that states each query's result independently."""

from __future__ import annotations

_ORDERS = """
WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_date, CASE o_orderstatus WHEN 'F' THEN 'scheduled' WHEN 'P' THEN 'cancelled' END AS status,
  n_name AS country, n_regionkey, c_mktsegment AS city, o_orderpriority AS title
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""
_FOLD = r"trim(regexp_replace(regexp_replace(replace(replace(lower(replace(replace({x}, '`', ''''), '´', '''')), '&', ' and '), '+', ' and '), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _fold(x: str) -> str:
    x = f"strip_accents({x})"
    for a, b in (("ø", "o"), ("Ø", "o"), ("æ", "ae"), ("Æ", "ae"), ("ß", "ss")):
        x = f"replace({x}, '{a}', '{b}')"
    return _FOLD.format(x=x)


def _nordic(x: str) -> str:
    for a, b in (("ø", "oe"), ("Ø", "Oe"), ("æ", "ae"), ("Æ", "Ae"), ("å", "aa"), ("Å", "Aa")):
        x = f"replace({x}, '{a}', '{b}')"
    return _fold(x)


_BODY = "html"
for _tag in ("script", "style", "nav", "footer"):
    _BODY = f"regexp_replace({_BODY}, '<{_tag}.*?</{_tag}>', ' ', 'gis')"
_BODY = f"regexp_replace({_BODY}, '<[^>]+>', ' ', 'g')"


def _entities(x: str) -> str:
    x = f"replace(replace({x}, '&nbsp;', ' '), '&amp;', '&')"
    x = f"regexp_replace(regexp_replace({x}, '&(quot|apos|#39);', '''', 'gi'), '&[a-z]+;', ' ', 'gi')"
    return f"trim(regexp_replace(replace({x}, chr(160), ' '), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '')"
_ARTIST = "p_name || ' ' || p_brand"
_PLAYS = "SELECT user_id, event_type AS name, value * 10000 AS ms, CASE WHEN event_id % 7 <> 0 THEN ts END AS t FROM events WHERE NOT (value * 10000 > 0 AND value * 10000 < 30000)"
_BEST_LAST = "arg_max({c}, (CAST(l_shipdate AS DATE), l_orderkey, l_linenumber))"
_ROUND = "floor({x} * 100 + 0.5) / 100"

_BUILD = """
WITH r AS (SELECT s_suppkey AS s, s_name, n_name, s_acctbal, s_suppkey % 4 AS k, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS page, 'https://t/' || l_orderkey AS link, l_orderkey, l_linestatus = 'O' AS sold, l_returnflag AS flag, l_linenumber AS line,
    p_name || CASE WHEN p_size % 10 = 0 THEN ' quiz' ELSE '' END AS title, p_size, p_type, p_size % 10 AS z, CAST(date_trunc('week', l_shipdate) AS DATE) AS day
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 6),
-- what isn't music goes, silently from payloads; so does what has no date: prose beyond 8,000 characters, a node that says "soon", a post without one in field, excerpt or linked page
v AS (SELECT *, z = 0 OR CASE k WHEN 0 THEN line = 4 WHEN 1 THEN z = 1 WHEN 3 THEN z = 1 AND line NOT IN (1, 2) ELSE false END AS unfit FROM r WHERE NOT (k = 2 AND z = 0)),
-- on plain pages the first of a title and day stays; a later node vanishes, a later page counts as rejected
w AS (SELECT *, k = 0 AND NOT unfit AND row_number() OVER (PARTITION BY s, title, day, k = 0, unfit ORDER BY page) > 1 AS again FROM v),
q AS (SELECT *, unfit OR again AS bad, CASE WHEN k <> 0 AND flag = 'R' THEN 'cancelled' WHEN k <> 0 AND line = 7 THEN 'postponed' ELSE 'scheduled' END AS status, k = 3 AND line = 2 AND (z = 1 OR NOT sold) AS looked_up FROM w WHERE NOT (again AND line = 5)),
t AS (SELECT *, CASE WHEN bad THEN NULL WHEN day < DATE '1998-01-01' THEN 'past' WHEN day > DATE '1998-01-01' + 400 THEN 'beyond_horizon' WHEN status <> 'scheduled' THEN status ELSE 'fine' END AS fate,
    CASE WHEN k = 0 THEN NULL WHEN sold THEN link WHEN looked_up THEN link || '/t' END AS ticket, CASE WHEN k = 1 AND flag = 'N' THEN link WHEN looked_up THEN link || '/i' END AS image,
    {'link': link, 'url': CASE WHEN k = 2 AND line = 1 THEN 'https://t/event/show-' || l_orderkey WHEN k = 3 THEN link || '/p' || page ELSE link END, 'hour': CASE WHEN k = 1 THEN '20:30' WHEN k = 0 AND line = 5 THEN '19:00' WHEN k = 3 AND z = 1 AND line = 2 THEN '21:00' END,
      'price': CAST(CASE WHEN k = 1 AND line = 2 THEN p_size WHEN k = 2 AND line <> 2 THEN 1 END AS DOUBLE), 'tags': CASE WHEN k = 2 THEN p_type ELSE '' END} AS own FROM q),
o AS (SELECT s, day, title, any_value(s_name) AS s_name, any_value(n_name) AS n_name, any_value(s_acctbal) AS s_acctbal, any_value(k) AS k, count(*) - 1 AS again, arg_min(own, page) AS own,
    arg_min(ticket, page) FILTER (ticket IS NOT NULL) AS ticket, arg_min(image, page) FILTER (image IS NOT NULL) AS image FROM t WHERE fate = 'fine' GROUP BY 1, 2, 3),
e AS (SELECT *, count(*) OVER (PARTITION BY s, title) < 5 AS stays FROM o)
"""

ORACLES = {
    "corpus_build": _BUILD + """
SELECT sha256(s || '|' || day || '|' || title)[1:16] AS id, title, title AS artists, day AS start_date, own.hour AS start_time, 'scheduled' AS status, CAST(s AS VARCHAR) AS venue_id, s_name AS venue_name, n_name AS city, 'DK' AS country,
  CASE WHEN floor(s_acctbal) = 0 THEN NULL WHEN s_acctbal >= 8000 THEN 'arena' WHEN s_acctbal >= 2000 THEN 'large' WHEN s_acctbal >= 700 THEN 'mid' ELSE 'club' END AS size_class, own.url AS url, ticket AS ticket_url, image,
  own.price AS price, CASE WHEN own.price IS NOT NULL THEN 'DKK' END AS currency, own.tags AS tags, ['html-event', 'jsonld-page', 'next-data', 'wp-rest'][k + 1] AS adapter, own.link AS source_url FROM e WHERE stays""",
    "corpus_meta": _BUILD + """
, c AS (SELECT s, count(*) FILTER (NOT bad) AS raw, count(*) FILTER (bad) AS rejected, count(*) FILTER (fate = 'past') AS past, count(*) FILTER (fate = 'beyond_horizon') AS beyond_horizon, count(*) FILTER (fate = 'cancelled') AS cancelled,
    count(*) FILTER (fate = 'postponed') AS postponed FROM t GROUP BY 1),
m AS (SELECT s, CAST(sum(again) AS BIGINT) AS duplicate, count(*) FILTER (NOT stays) AS recurring, count(*) FILTER (stays) AS kept FROM e GROUP BY 1)
SELECT CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name, n_name AS city, ['html-event', 'jsonld-page', 'next-data', 'wp-rest'][s_suppkey % 4 + 1] AS adapter, coalesce(raw, 0) AS raw, coalesce(rejected, 0) AS rejected, coalesce(past, 0) AS past,
  coalesce(beyond_horizon, 0) AS beyond_horizon, coalesce(cancelled, 0) AS cancelled, coalesce(postponed, 0) AS postponed, coalesce(duplicate, 0) AS duplicate, coalesce(recurring, 0) AS recurring, coalesce(kept, 0) AS kept
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN c ON c.s = s_suppkey LEFT JOIN m ON m.s = s_suppkey WHERE s_suppkey % 7 <> 6""",
    "direct_evidence_score": """
WITH p AS (SELECT c_nationkey || '/' || c_mktsegment AS user_id, p_name || ' ' || p_brand AS name, l_quantity * 100000 * CASE WHEN l_shipdate > TIMESTAMP '2001-12-01' THEN 1 ELSE pow(0.5, (epoch_us(TIMESTAMP '2001-12-01') - epoch_us(l_shipdate)) / 86400e6 / 548) END AS ms
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
a AS (SELECT user_id, name, sum(ms) / 60000 AS plays FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, name) <= 600),
w AS (SELECT user_id, name, greatest(0.05, sqrt(plays / max(plays) OVER (PARTITION BY user_id))) AS s FROM a),
e AS (SELECT p_name || ' ' || p_brand AS name, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT user_id, CAST(sum(n) AS BIGINT) AS events, round(max(s), 6) AS best, round(1 - exp(sum(n * ln(1 - least(0.999, s)))), 6) AS "any" FROM w JOIN e USING (name) WHERE s >= 0.18 GROUP BY 1""",
    "page_surfaces": r"""
SELECT page_id, len(regexp_extract_all(html, '<script[^>]+type=["'']application/ld\+json["''][^>]*>', 0, 'i')) AS json_ld, contains(html, '__NEXT_DATA__') AS next_data,
  least(10, len(list_distinct(regexp_extract_all(html, '20\d\d-\d\d-\d\d')))) AS dates,
  array_to_string(list_filter([CASE WHEN regexp_matches(html, p.rx, 'i') THEN p.name END FOR p IN [
    {'name': 'wordpress', 'rx': 'wp-content|wp-json'}, {'name': 'drupal', 'rx': 'drupal-settings|/sites/default/'}, {'name': 'next', 'rx': '__NEXT_DATA__|/_next/'}, {'name': 'nuxt', 'rx': '__NUXT__|/_nuxt/'}, {'name': 'gatsby', 'rx': '___gatsby'},
    {'name': 'squarespace', 'rx': 'squarespace'}, {'name': 'wix', 'rx': 'wixstatic|wix\.com'}, {'name': 'shopify', 'rx': 'cdn\.shopify'}, {'name': 'umbraco', 'rx': 'umbraco'}, {'name': 'sitecore', 'rx': 'sitecore'}, {'name': 'json-ld', 'rx': 'application/ld\+json'},
    {'name': 'microdata', 'rx': 'schema\.org/[A-Za-z]*Event'}, {'name': 'ical', 'rx': '\.ics["''?]'}, {'name': 'rss', 'rx': 'application/rss\+xml'}, {'name': 'graphql', 'rx': 'graphql'}]], lambda x: x IS NOT NULL), ',') AS platforms FROM pages""",
    "filter_cascade_counts": _ORDERS + """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN start_date < DATE '1996-01-01' THEN 'past' WHEN start_date > DATE '1998-12-31' THEN 'beyond_window'
  WHEN status IS NOT NULL AND status <> 'scheduled' THEN 'cancelled' WHEN n_regionkey NOT IN (1, 2, 3) THEN 'country'
  WHEN city NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'city' WHEN starts_with(title, '5') THEN 'tribute' ELSE 'kept' END AS reason FROM e) GROUP BY 1""",
    "corpus_filter_counts": _ORDERS + """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN start_date < DATE '1996-01-01' THEN 'past' WHEN start_date > DATE '1998-12-31' THEN 'beyond_horizon'
  WHEN title = '1-URGENT' THEN 'postponed' WHEN status = 'cancelled' THEN 'cancelled' ELSE 'kept' END AS reason FROM e) GROUP BY 1""",
    "reason_samples": _ORDERS + """
, r AS (SELECT o_orderkey, CASE WHEN start_date < DATE '1996-01-01' THEN 'past' WHEN start_date > DATE '1998-12-31' THEN 'beyond_window' WHEN status <> 'scheduled' THEN 'cancelled' END AS reason FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY o_orderkey) AS p FROM r WHERE reason IS NOT NULL)
SELECT reason, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY p) FILTER (p <= 5) AS samples FROM k GROUP BY 1""",
    "listening_decay_agg": f"""
WITH p AS ({_PLAYS}), w AS (SELECT *, CASE WHEN t IS NULL THEN 0.55 WHEN t > TIMESTAMP '2024-02-01' THEN 1 ELSE pow(0.5, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(t)) / 86400e6 / 548) END AS d FROM p),
a AS (SELECT user_id, name, sum(CASE WHEN ms = 0 THEN 180000 ELSE ms END * d) / 60000 AS plays, count(*) AS raw_plays, CAST(floor(sum(ms) / 60000 + 0.5) AS BIGINT) AS minutes, max(t) AS last_at FROM w GROUP BY 1, 2)
SELECT user_id, name, round(plays, 6) AS plays, raw_plays, minutes, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, name) - 1 AS rank FROM a QUALIFY rank < 600""",
    "noisy_or_score": """
WITH s AS (SELECT user_id, 1 - product(1 - least(0.999, value / 2000)) AS score, sum(value / 2000) AS depth FROM events GROUP BY 1)
SELECT user_id, round(score, 6) AS score, round(depth, 6) AS depth, round(score * (1 + 0.12 * ln(1 + depth)), 6) AS rank FROM s""",
    "taste_weights": """
WITH p AS (SELECT l_suppkey AS user_id, CAST(l_partkey AS VARCHAR) AS name, sum(l_quantity) AS plays FROM lineitem GROUP BY 1, 2)
SELECT *, round(greatest(0.05, sqrt(plays / max(plays) OVER (PARTITION BY user_id))), 6) AS weight FROM p""",
    "dedupe_first_wins_coalesce": """
SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS l_linenumber,
  first(l_partkey ORDER BY l_orderkey, l_linenumber) FILTER (l_returnflag = 'R') AS ticket, first(l_orderkey ORDER BY l_orderkey, l_linenumber) FILTER (l_linestatus = 'O') AS image, count(*) - 1 AS duplicates
FROM lineitem GROUP BY 1, 2""",
    "recurring_filter": "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey, l_partkey) < 5",
    "size_class_join": """
SELECT o_orderkey, CAST(floor(c_acctbal) AS BIGINT) AS capacity, CASE WHEN coalesce(floor(c_acctbal), 0) = 0 THEN NULL WHEN floor(c_acctbal) >= 8000 THEN 'arena' WHEN floor(c_acctbal) >= 2000 THEN 'large'
  WHEN floor(c_acctbal) >= 700 THEN 'mid' ELSE 'club' END AS size_class FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "billing_frequency": """
SELECT name, count(*) AS n FROM (SELECT unnest([p_name || ' + ' || p_brand, p_name, p_brand]) AS name FROM part WHERE p_type <> 'ECONOMY') GROUP BY 1""",
    "source_summary": _ORDERS + """
SELECT country AS source, count(*) AS raw, count(*) FILTER (start_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND coalesce(status, '') <> 'cancelled') AS kept,
  count(DISTINCT city) AS venues, count(*) FILTER (start_date < DATE '1996-01-01') AS past FROM e GROUP BY 1""",
    "keyed_upsert": f"""
WITH o AS (SELECT l_partkey AS k, max(CAST(l_shipdate AS DATE)) AS v, {_BEST_LAST.format(c='l_orderkey')} AS a, {_BEST_LAST.format(c='l_linenumber')} AS b, 0 AS fresh FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
n AS (SELECT l_partkey AS k, max(CAST(l_shipdate AS DATE)) AS v, {_BEST_LAST.format(c='l_orderkey')} AS a, {_BEST_LAST.format(c='l_linenumber')} AS b, 1 AS fresh FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT k, v, a, b FROM (SELECT * FROM o UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC, fresh DESC) = 1""",
    "artist_index_last_wins": "SELECT lower(p_name) AS key, arg_max(p_name, p_partkey) AS name, arg_max(p_brand, p_partkey) AS country FROM part GROUP BY 1",
    "stale_names": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-02' - INTERVAL 90 DAY)",
    "top_k_per_group": "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 3",
    "corpus_sort": f"SELECT p_partkey, {_ARTIST} AS title, p_size, row_number() OVER (PARTITION BY p_size ORDER BY lower({_ARTIST}), p_partkey) AS place FROM part",
    "month_spine": """
SELECT CAST(m AS DATE) AS month, (SELECT count(*) FROM orders WHERE date_trunc('month', o_orderdate) = m) AS n FROM generate_series(TIMESTAMP '2000-06-01', TIMESTAMP '2002-06-01', INTERVAL 1 MONTH) g(m)""",
    "validate_rows": """
WITH e AS (SELECT o_orderkey - CASE WHEN o_orderkey % 97 = 1 THEN 1 ELSE 0 END AS id, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderpriority END AS title, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, c_mktsegment AS seg, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT unnest([CASE WHEN trim(title) = '' THEN 'missing title' END, CASE WHEN day < '1996-01-01' THEN 'starts in the past' END, CASE WHEN day > '2000-12-31' THEN 'starts beyond the horizon' END,
  CASE WHEN o_orderstatus = 'P' THEN 'status isn''t scheduled' END, CASE WHEN seg = 'MACHINERY' THEN 'unknown adapter' END, CASE WHEN seg = 'BUILDING' THEN 'host isn''t registered' END,
  CASE WHEN c_acctbal <= 0 THEN 'no link back' END, CASE WHEN row_number() OVER (PARTITION BY id) > 1 THEN 'duplicate id' END]) AS message FROM e)
SELECT message, count(*) AS n FROM b WHERE message IS NOT NULL GROUP BY 1""",
    "tag_vector_cosine": """
WITH u AS (SELECT user_id, event_type AS t, sum(value) AS w FROM events GROUP BY 1, 2), h AS (SELECT hour(ts) AS hour, event_type AS t, sum(value) AS w FROM events GROUP BY 1, 2),
un AS (SELECT user_id, sqrt(sum(w * w)) AS n FROM u GROUP BY 1), hn AS (SELECT hour, sqrt(sum(w * w)) AS n FROM h GROUP BY 1)
SELECT u.user_id, h.hour, round(sum(u.w * h.w) / any_value(un.n) / any_value(hn.n), 6) AS cosine FROM u JOIN h USING (t) JOIN un ON un.user_id = u.user_id JOIN hn ON hn.hour = h.hour GROUP BY 1, 2""",
    "tag_threshold_pairs": """
WITH b AS (SELECT o_custkey AS customer, l_partkey AS t, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), s AS (SELECT l_suppkey AS supplier, l_partkey AS t, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
bn AS (SELECT customer, sqrt(sum(w * w)) AS n FROM b GROUP BY 1), sn AS (SELECT supplier, sqrt(sum(w * w)) AS n FROM s GROUP BY 1),
c AS (SELECT customer, supplier, sum(b.w * s.w) AS dot FROM b JOIN s USING (t) GROUP BY 1, 2)
SELECT customer, supplier, round(dot / bn.n / sn.n, 6) AS cosine FROM c JOIN bn USING (customer) JOIN sn USING (supplier) WHERE dot / bn.n / sn.n > 0.12""",
    "dense_cosine_topk": """
WITH x AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
m AS (SELECT label, list(m ORDER BY i) AS mean FROM x GROUP BY 1),
c AS (SELECT vec_id, m.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean), 6) AS cosine FROM embeddings, m)
SELECT vec_id, label, cosine, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rank FROM c QUALIFY rank <= 3""",
    "priority_key_lookup": """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE '' END || p_name AS probe_name, (SELECT min(q.p_partkey) FROM part q WHERE lower(q.p_name) = lower(p.p_name)) AS hit FROM part p""",
    "fuzzy_name_join": f"""
WITH n AS (SELECT DISTINCT replace({_ARTIST}, '#', '') AS name FROM part), w AS (SELECT DISTINCT name[1:3] || 'q' || name[5:] AS wrong FROM n)
SELECT wrong, (SELECT first(name ORDER BY lower(name)) FROM n WHERE levenshtein(lower(name), trim(regexp_replace(lower(wrong), ' +', ' ', 'g'))) <= 1) AS hit FROM w
WHERE EXISTS (SELECT 1 FROM n WHERE levenshtein(lower(name), trim(regexp_replace(lower(wrong), ' +', ' ', 'g'))) <= 1)""",
    "similar_one_hop": """
WITH q AS (SELECT p_brand AS brand, s_nationkey AS nk, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY q DESC, nk) AS pos FROM q),
o AS (SELECT c_mktsegment AS user_id, c_nationkey AS nk, sum(c_acctbal) AS plays FROM customer GROUP BY 1, 2 HAVING sum(c_acctbal) > 0),
w AS (SELECT user_id, 'nation ' || nk AS name, plays, greatest(0.05, sqrt(plays / max(plays) OVER (PARTITION BY user_id))) AS weight FROM o),
n AS (SELECT DISTINCT 'nation ' || nk AS sim FROM q), u AS (SELECT DISTINCT user_id FROM w),
x AS (SELECT n.sim, w.user_id, w.name, w.weight FROM n JOIN w ON w.name = n.sim),
f AS (SELECT n.sim, w.user_id, first(w.name ORDER BY w.plays DESC, w.name) AS name, first(w.weight ORDER BY w.plays DESC, w.name) AS weight FROM n JOIN w ON length(n.sim) >= 8 AND length(w.name) >= 7 AND levenshtein(n.sim, w.name) <= 1
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.sim = n.sim AND x.user_id = w.user_id) GROUP BY 1, 2),
h AS (SELECT * FROM x UNION ALL SELECT * FROM f)
SELECT user_id, brand, replace(arg_max(h.name, (s, -pos)), 'n', 'N')[1:1] || arg_max(h.name, (s, -pos))[2:] AS via, round(max(s), 6) AS strength FROM (SELECT h.user_id, brand, h.name, pos, weight * least(1, t.q / 10000) * 0.62 AS s FROM t JOIN h ON h.sim = 'nation ' || t.nk) h GROUP BY 1, 2""",
    "artist_fold_sequential": """
WITH o AS (SELECT o_custkey AS user_id, o_orderkey AS event_id, o_totalprice / 1000 AS r, CAST(o_orderpriority[1] AS INT) AS c FROM orders),
l AS (SELECT user_id, list({'e': event_id, 'r': r, 'c': CASE WHEN c = 5 THEN 9 ELSE c - 1 END} ORDER BY r DESC, event_id) AS xs FROM o GROUP BY 1),
h AS (SELECT user_id, list_reduce(xs, lambda a, b: CASE WHEN b.r > a.r OR (b.r >= a.r * 0.9 AND b.c < a.c) THEN b ELSE a END) AS x FROM l)
SELECT user_id, x.e AS event_id, CASE x.c WHEN 0 THEN 'club' WHEN 1 THEN 'mid' WHEN 2 THEN 'large' WHEN 3 THEN 'arena' END AS size_class FROM h""",
    "eval_labels": """
WITH i AS (SELECT o_custkey AS u, p_name || ' ' || p_brand AS act, l_suppkey % 10 AS v, CAST(l_shipdate AS DATE) AS day, l_linenumber AS line, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey % 2 = 0 OR l_quantity <= 40
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 15),
w AS (SELECT u, count(*) AS n, count(DISTINCT act) AS acts, count(*) FILTER (line = 7) AS silent, count(*) FILTER (flag = 'R') AS tributes, count(*) FILTER (day < DATE '1995-03-01') AS past, count(DISTINCT strftime(day, '%Y-%m')) AS months FROM i GROUP BY 1),
v AS (SELECT u, max(n) AS most FROM (SELECT u, v, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT c_custkey AS u, coalesce(n, 0) AS n, coalesce(acts, 0) AS acts, coalesce(silent, 0) AS silent, coalesce(tributes, 0) AS tributes, coalesce(past, 0) AS past, coalesce(months, 0) AS months, coalesce(most, 0) AS most FROM customer LEFT JOIN w ON c_custkey = w.u LEFT JOIN v ON c_custkey = v.u),
l AS (SELECT c_custkey AS u, p_partkey - c_custkey AS k, p_name || ' ' || p_brand AS act FROM customer JOIN part ON p_partkey IN (c_custkey, c_custkey + 1)),
h AS (SELECT l.*, EXISTS (SELECT 1 FROM i WHERE i.u = l.u AND i.act = l.act) AS picked, act IN (SELECT p_name || ' ' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45) AS plays FROM l)
SELECT u AS user_id, unnest(['cap', 'artist-twice', 'venue', 'says-why', 'no-tributes', 'not-past', 'at-least']) AS check, NULL AS name, unnest([n <= 12, acts >= n, most <= 3, silent = 0, tributes = 0, past = 0, n >= 5]) AS passed FROM c
UNION ALL SELECT u, 'at-most', NULL, n <= 14 FROM c WHERE u % 2 = 0 UNION ALL SELECT u, 'short', NULL, n < 12 FROM c WHERE u % 3 = 0 UNION ALL SELECT u, 'months', NULL, months >= 4 FROM c WHERE n >= 4
UNION ALL SELECT u, CASE k WHEN 0 THEN 'must-appear' ELSE 'must-not-appear' END, unnest([upper(act), 'Nobody']), unnest([CASE k WHEN 0 THEN picked OR NOT plays ELSE NOT picked END, true]) FROM h""",
    "zip_source": """
WITH e AS (SELECT l_suppkey, year(l_shipdate) AS y, string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS line FROM lineitem) GROUP BY 1, 2)
SELECT l_suppkey, 'plays/' || y || '.csv' AS entry, strlen(text) AS size, sha256(text) AS sha FROM e WHERE y < 2000""",
    "similar_persona_lists": """
WITH q AS (SELECT l_suppkey AS u, p_brand AS i, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
t AS (SELECT u, i FROM q QUALIFY row_number() OVER (PARTITION BY u ORDER BY q DESC, i) <= 12), n AS (SELECT u, count(*) AS n FROM t GROUP BY 1)
SELECT x.u AS a, y.u AS b, round(count(*) / least(any_value(m.n), any_value(k.n)), 6) AS overlap FROM t x JOIN t y ON x.i = y.i AND x.u < y.u JOIN n m ON m.u = x.u JOIN n k ON k.u = y.u GROUP BY 1, 2 HAVING overlap >= 0.75""",
    "persona_overlap": """
WITH q AS (SELECT s_nationkey AS u, p_brand AS i, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
t AS (SELECT u, i FROM q QUALIFY row_number() OVER (PARTITION BY u ORDER BY q DESC, i) <= 12), n AS (SELECT u, count(*) AS n FROM t GROUP BY 1)
SELECT x.u AS a, y.u AS b, round(count(*) / least(any_value(m.n), any_value(k.n)), 6) AS overlap FROM t x JOIN t y ON x.i = y.i AND x.u < y.u JOIN n m ON m.u = x.u JOIN n k ON k.u = y.u GROUP BY 1, 2""",
    "fold_name_docs": f"SELECT doc_id, sha256({_fold('text')}) AS folded, length({_nordic('text')}) AS nordic FROM documents",
    "name_keys": f"SELECT p_partkey, 'the ' || {_fold(_ARTIST)} || '|' || {_fold(_ARTIST)} AS keys FROM part",
    "split_credits_bills": """
WITH s AS (SELECT p_partkey, p_name, p_brand, [' + ', ' feat. ', ' & ', ' x ', ' / ', ' med '][p_partkey % 6 + 1] AS sep FROM part)
SELECT p_partkey, p_name || sep || p_brand || '|' || p_name || '|' || p_brand AS names, p_name AS "primary" FROM s""",
    "tribute_flag": """
SELECT p_partkey, p_partkey % 7 IN (0, 2, 3, 5) AS is_tribute, CASE WHEN p_size > 25 THEN p_name END AS stem FROM part""",
    "tributes_of_known": """
SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN ' Mania' ELSE ' live' END AS title, p_size > 25 AND p_name IN (SELECT p_name FROM part WHERE p_size <= 3) AS of_known FROM part""",
    "served_events": r"""SELECT '{"id":"' || p_partkey || '","title":"\u003cb>' || p_name || '","venue_name":"' || p_brand || '"}' AS json FROM part""",
    "edit_distance": """
WITH n AS (SELECT lower(n_name) AS x FROM nation), s AS (SELECT DISTINCT lower(p_name) AS y FROM part)
SELECT x, y, least(levenshtein(x, y), 7) AS d, x = y OR (length(x) >= 7 AND length(y) >= 7 AND levenshtein(x, y) <= 1) AS near FROM n, s""",
    "html_links": f"""
WITH h AS (SELECT page_id, 'https://' || {_HOST} AS base, regexp_extract_all(html, 'href=["'']([^"''#]+)["'']', 1, 'i') AS hs FROM pages),
f AS (SELECT page_id, base, list_transform(hs, lambda u: CASE WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, '/') THEN base || u WHEN regexp_matches(u, '^https?:', 'i') THEN u END) AS us FROM h),
g AS (SELECT page_id, list_transform(list_filter(us, lambda u: u IS NOT NULL AND starts_with(u, base)), lambda u: split_part(u, '?', 1)) AS us FROM f),
k AS (SELECT page_id, list_filter(us, lambda u, i: list_position(us, u) = i) AS us FROM g)
SELECT page_id, len(us) AS n, sha256(coalesce(array_to_string(us, ','), '')) AS links FROM k""",
    "html_title": f"""
SELECT page_id, nullif({_entities("regexp_replace(regexp_extract(regexp_replace(html, '<h1.*?</h1>', '', 'gis'), '<title[^>]*>(.{1,200}?)</title>', 1, 'is'), '<[^>]+>', ' ', 'g')")}, '') AS title FROM pages""",
    "strip_tags": f"SELECT page_id, sha256({_entities(_BODY)}) AS body FROM pages",
    "url_host": f"SELECT page_id, {_HOST} AS host FROM pages",
    "meta_tags": "SELECT page_id, nullif(trim(url), '') AS title, 'img ' || page_id AS image FROM pages",
    "ticket_links": "SELECT page_id, 'https://www.BILLETTO.dk/e/' || page_id AS ticket FROM pages",
    "title_rules": """
SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN 'musikquiz' ELSE ' live' END AS title, CASE p_partkey % 5 WHEN 1 THEN 'cancelled' WHEN 2 THEN 'postponed' ELSE 'scheduled' END AS status, p_partkey % 3 = 0 AS non_musical FROM part""",
    "deep_key_roundtrip": "SELECT p_partkey, CAST(DATE '2026-01-01' + p_size AS DATE) AS date, CAST(NULL AS VARCHAR) AS time, 'https://t/' || p_brand AS ticket_url FROM part",
    "hydration_roundtrip": """
WITH p AS (SELECT *, p_partkey % 2 = 1 AS listed FROM part), d AS (SELECT *, unnest(CASE WHEN listed THEN [0, 1] ELSE [0] END) AS k FROM p)
SELECT p_partkey, p_name AS title, CASE k WHEN 0 THEN DATE '2026-03-01' + p_size % 28 ELSE DATE '2026-04-01' END AS start_date, CASE k WHEN 0 THEN '20:00' END AS start_time,
  CASE WHEN p_type = 'ECONOMY' THEN 'cancelled' WHEN p_partkey % 5 = 0 THEN 'postponed' ELSE 'scheduled' END AS status, p_brand AS venue_name, CASE WHEN listed AND k = 0 THEN 'https://t/' || p_partkey END AS ticket_url,
  round(p_retailprice, 6) AS price, p_type AS tags, p_name || '|Extra Act' AS artists FROM d""",
    "wordpress_roundtrip": "SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN DATE '2026-11-01' + p_size % 28 END AS start_date, CASE WHEN p_partkey % 2 = 1 THEN 'no-event-date' END AS reason FROM part",
    "html_event_reasons": """
WITH p AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'Program ' WHEN 1 THEN 'Musikquiz ' ELSE 'Band ' END || page_id AS title, page_id % 4 AS k, page_id % 9 AS m FROM pages)
SELECT page_id, title, CASE k WHEN 1 THEN DATE '2026-08-27' WHEN 2 THEN NULL ELSE DATE '2026-11-11' END AS start_date,
  CASE WHEN m = 0 THEN 'section-page' WHEN m = 1 THEN 'non-musical' WHEN k = 2 THEN 'no-date' WHEN k = 1 THEN 'date-not-confident' ELSE 'kept' END AS reason FROM p""",
    "danish_date_roundtrip": """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS found, CASE o_orderkey % 3 WHEN 0 THEN '20:30' WHEN 2 THEN '19:05' END AS time, CASE o_orderkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 1.0 END AS confidence
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND year(o_orderdate) < 2000 THEN o_orderdate + to_years(100) ELSE o_orderdate END AS o_orderdate FROM orders)""",
    "csv_roundtrip": """SELECT p_partkey AS user_id, p_name || ' "live", ' || p_brand AS artist, p_type AS track, CAST(p_size * 1000 AS DOUBLE) AS ms, '2024-01-02' AS "at" FROM part""",
    "json_shapes_roundtrip": """
SELECT p_partkey AS user_id, p_name AS artist, p_type AS track, CAST(p_size * 1000 AS DOUBLE) AS ms, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2020-01-09T15:15:00Z' END AS "at",
  CASE WHEN p_partkey % 2 = 0 THEN 'spotify-extended' ELSE 'spotify-classic' END AS "from" FROM part""",
    "typed_list_roundtrip": "SELECT s_nationkey AS user_id, s_name AS artist, round(3e6 / (1 + log2(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) + 1)), 6) AS ms FROM supplier",
    "zip_roundtrip": "SELECT s_nationkey AS nation, s_name AS artist, CASE WHEN s_suppkey > 0 THEN CAST(s_suppkey AS DOUBLE) END AS plays, CAST(greatest(s_suppkey, 1) * 210000 AS DOUBLE) AS ms FROM supplier",
    "robots_longest_match": """
WITH p AS (SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/en/1') THEN true WHEN path LIKE '/%7' THEN false WHEN starts_with(path, '/en') THEN false ELSE true END AS allowed, 10.0 AS delay FROM p""",
    "sitemap_roundtrip": "SELECT DISTINCT trim(url) AS page FROM pages WHERE url LIKE '%example%'",
    "month_partitions": """
SELECT n_name AS country, CAST(m AS DATE) AS from_date, CAST(m + INTERVAL 1 MONTH AS DATE) AS to_date FROM nation, generate_series(TIMESTAMP '2026-08-01', TIMESTAMP '2027-09-01', INTERVAL 1 MONTH) g(m)""",
    "discovery_roundtrip": """
SELECT p_partkey, p_name AS title, p_brand AS venue_name, 'DK' AS country, '20:30' AS start_time, CASE WHEN p_size > 1 THEN p_brand ELSE 'a' END AS image, DATE '2026-09-01' AS start_date FROM part WHERE p_size % 3 <> 1""",
    "tag_lookup_roundtrip": """
SELECT p_name, p_brand AS mbid, count(*) AS n, CAST(sum(CASE WHEN p_size > 0 THEN 2 ELSE 1 END) AS BIGINT) AS tags, count(*) FILTER (p_size < 20) AS rock_first FROM part GROUP BY 1, 2""",
    "similar_scores": """
WITH r AS (SELECT l_suppkey, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS p FROM lineitem),
m AS (SELECT *, greatest(max(q) OVER (PARTITION BY l_suppkey), 1) AS top FROM r)
SELECT l_suppkey, count(*) AS n, round(sum(least(1, greatest(0.25, q / top))), 6) AS total FROM m WHERE p <= 60 GROUP BY 1""",
    "explain_text": """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'You listen to ' || p_name WHEN 1 THEN 'Because you listen to ' || p_name ELSE 'Matches your taste for ' || p_type || ' and ' || p_brand END || '.' AS en,
  CASE p_partkey % 3 WHEN 0 THEN 'Du lytter til ' || p_name WHEN 1 THEN 'Fordi du lytter til ' || p_name ELSE 'Rammer din smag for ' || p_type || ' og ' || p_brand END || '.' AS da FROM part""",
    "event_labels": """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p, floor(o_totalprice / 100000) AS a, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-10') AS n FROM orders)
SELECT o_orderkey, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 14 THEN n || ' days ago' ELSE (n // 7) || ' weeks ago' END AS age, strftime(day, '%Y-%m') AS month, day + 45 AS later,
  CASE WHEN a = 0 THEN 'free' ELSE CAST(a AS BIGINT) || ' DKK' END AS price, regexp_replace(p, '[^A-Za-z0-9]+', '-', 'g') AS slug, '&lt;' || p || '&#39;s &amp; &quot;x&quot;&gt;' AS escaped, sha256('shop|' || day || '|' || lower(p))[1:16] AS id FROM o""",
    "list_size_rule": """
WITH k AS (SELECT p_partkey, p_retailprice, CAST(least(least(greatest(p_size, 5), 20), greatest(5, 2 * (p_partkey % 11))) AS INT) AS k FROM part)
SELECT p_partkey, k, CAST(least(2, k // 3) AS INT) AS quota, floor(p_retailprice / 7 * 100 + 0.5) / 100 AS rounded FROM k""",
    "windowed_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS from_ts, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "sitemap_source": """
WITH s AS (SELECT s_suppkey AS id, 'https://s' || s_suppkey || '/' AS site FROM supplier WHERE s_suppkey % 3 <> 0),
u AS (SELECT id, site || 'p?o=' || l_orderkey || '&l=' || l_linenumber || '&p=' || l_partkey AS page, CAST(l_shipdate AS DATE) AS day, l_linenumber AS l, l_returnflag AS f, p_name FROM lineitem JOIN s ON l_suppkey = id JOIN part ON l_partkey = p_partkey
  QUALIFY row_number() OVER (PARTITION BY id, page ORDER BY day, f = 'R') = 1),
-- the walk: root, 1996, below it the unopened map of 1998 and the months, then 2000 with its months, then 1995 as the thirtieth map
o AS (SELECT *, CASE year(day) WHEN 1996 THEN 100 + month(day) WHEN 2000 THEN 200 + month(day) ELSE 300 END AS walk FROM u WHERE year(day) IN (1995, 1996, 2000)
  UNION ALL SELECT id, site || '1998-0' || m, NULL, NULL, NULL, NULL, m FROM s, generate_series(1, 9) g(m)),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY walk, page) AS place FROM o QUALIFY place <= 250)
SELECT id AS source_id, place, page, CASE WHEN l NOT IN (3, 5, 6) THEN p_name END AS title, CASE WHEN l NOT IN (3, 5, 6) AND f <> 'R' THEN day END AS start_date,
  CASE WHEN l IS NULL OR l = 6 THEN 'robots-disallow' WHEN l = 5 THEN 'http-404' WHEN l = 3 THEN 'no-jsonld-event' WHEN f = 'R' THEN 'no-date' END AS reason FROM n
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, 'sitemap-empty' FROM supplier WHERE s_suppkey % 3 = 0""",
    "robots_by_host": f"""
WITH p AS (SELECT page_id, {_HOST} AS host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT host, page_id AS line, page_id % 4 AS k, path, CASE page_id % 4 WHEN 0 THEN path[1:5] WHEN 1 THEN path WHEN 2 THEN '/*' || right(path, 1) || '$' ELSE '/e*/9' END AS rule FROM p WHERE path IS NOT NULL),
m AS (SELECT page_id, arg_min(k = 1, (-length(rule), line)) AS allowed FROM p JOIN r USING (host)
  WHERE CASE k WHEN 2 THEN length(p.path) >= 2 AND ends_with(p.path, right(r.path, 1)) WHEN 3 THEN regexp_matches(p.path, '^/e.*/9') ELSE starts_with(p.path, rule) END GROUP BY 1)
SELECT page_id, host, coalesce(allowed, true) AS allowed FROM p LEFT JOIN m USING (page_id)""",
    "polite_schedule": f"""
WITH r AS (SELECT page_id, {_HOST} AS host, page_id // 3 AS a, CASE WHEN page_id % 10 = 0 THEN 2 * length(html) + 2000 WHEN page_id % 7 = 0 THEN 3 * length(html) + 4500 ELSE length(html) END AS d,
  greatest(700, CASE WHEN page_id % 2 = 0 THEN page_id % 1500 ELSE 0 END) AS g FROM pages),
c AS (SELECT *, sum(g + d) OVER (PARTITION BY host ORDER BY a, page_id) AS c FROM r),
e AS (SELECT *, c + max(a + d - c) OVER (PARTITION BY host ORDER BY a, page_id) AS e FROM c)
SELECT page_id, host, CAST(e - d AS BIGINT) AS starts, CAST(e AS BIGINT) AS ends FROM e""",
    "enrich_resume": f"""
WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand AS name, p_size, {_fold(_ARTIST)} AS key FROM part),
k AS (SELECT key, max(p_size) AS size, max(p_partkey) AS id, min(name) AS name FROM p GROUP BY 1),
b AS (SELECT key, arg_min(name, (-n, name)) AS billed FROM (SELECT key, name, count(*) AS n FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT *, billed IS NOT NULL AND (size < 10 OR size >= 20) AS looked FROM k LEFT JOIN b USING (key))
SELECT key, CASE WHEN looked THEN billed ELSE name END AS name, looked AND size % 5 = 0 AS not_found, CASE WHEN looked THEN '2024-02-01' WHEN size < 10 THEN '2023-01-01' ELSE '2024-01-01' END AS checked,
  CASE WHEN NOT looked THEN 'old' WHEN size % 5 <> 0 THEN CAST(id AS VARCHAR) END AS mbid, CASE WHEN NOT looked OR size % 5 <> 0 THEN size END AS votes FROM a WHERE looked OR size < 20""",
}
ORACLES["listening_incremental"] = ORACLES["listening_decay_agg"]
for _name in ("jsonld_roundtrip", "jsonld_repair_roundtrip"):
    ORACLES[_name] = "SELECT p_partkey, p_name AS name, '2026-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS start, p_brand AS url, p_type AS location FROM part"

#: dates come out as ISO text
_DATES = {
    "dedupe_first_wins_coalesce": ["day"], "sitemap_source": ["start_date"], "keyed_upsert": ["v"], "month_spine": ["month"], "deep_key_roundtrip": ["date"], "hydration_roundtrip": ["start_date"], "wordpress_roundtrip": ["start_date"],
    "html_event_reasons": ["start_date"], "danish_date_roundtrip": ["found"], "month_partitions": ["from_date", "to_date"], "discovery_roundtrip": ["start_date"], "event_labels": ["later"], "corpus_build": ["start_date"],
}
for _name, _columns in _DATES.items():
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _columns)}) FROM ({ORACLES[_name]})"
