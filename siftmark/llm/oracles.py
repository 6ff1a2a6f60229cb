r"""DuckDB SQL for the operators that SQL can express, each by a plainer method than the operator's.

``op6``: the whole deletion neighbourhood as text, without the operator's pigeonhole step.
``op9``: all pairs that share a shingle, and a recursive search for components.
``op10``: every document position against every window of the same length.
"""

from __future__ import annotations

from siftmark.llm.decontaminate import SIZE, SLOP
from siftmark.llm.line_dedup import EDIT_WORDS, EXACT_WORDS

_WHITE = r"[^\x20\x09-\x0D]+"
#: Fixed value: a word of ``op10`` once A-Z are lower-cased.
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH raw AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
worded AS MATERIALIZED (SELECT doc_id, line, raw, list_filter(regexp_split_to_array(lower(raw), '[ \t\x0b\f\r]+'), lambda w: w <> '') AS w FROM raw),
lines AS MATERIALIZED (SELECT doc_id, line, w, array_to_string(w, ' ') AS s FROM worded WHERE len(w) >= {EXACT_WORDS}),
firsts AS MATERIALIZED (SELECT s, any_value(w) AS w, min((doc_id, line)) AS f FROM lines GROUP BY s),
variants AS MATERIALIZED (SELECT s, f, gap, md5(CASE WHEN gap = 0 THEN s ELSE array_to_string(list_concat(w[1:gap - 1], w[gap + 1:]), ' ') END) AS v
  FROM (SELECT s, w, f, unnest(range(0, len(w) + 1)) AS gap FROM firsts WHERE len(w) >= {EDIT_WORDS})),
near AS MATERIALIZED (
  SELECT x.s FROM variants x JOIN (SELECT gap, v, min(f) AS f FROM variants WHERE gap > 0 GROUP BY ALL) y ON x.gap > 0 AND x.gap = y.gap AND x.v = y.v WHERE y.f < x.f
  UNION SELECT x.s FROM variants x JOIN variants y ON x.gap > 0 AND y.gap = 0 AND x.v = y.v WHERE y.f < x.f
  UNION SELECT x.s FROM variants x JOIN (SELECT v, min(f) AS f FROM variants WHERE gap > 0 GROUP BY ALL) y ON x.gap = 0 AND x.v = y.v WHERE y.f < x.f),
drops AS MATERIALIZED (SELECT doc_id, line FROM lines JOIN firsts USING (s) WHERE (doc_id, line) <> f OR s IN (SELECT s FROM near)),
marked AS (SELECT r.doc_id, r.line, r.raw, d.line IS NOT NULL AS gone FROM raw r LEFT JOIN drops d ON d.doc_id = r.doc_id AND d.line = r.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""

OP9 = rf"""
WITH RECURSIVE worded AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WHITE}') AS w FROM documents),
shingled AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM shingled),
postings AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM shingled),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM postings x JOIN postings y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, seen) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT b.b, r.seen FROM reach r JOIN both_ways b ON b.a = r.id),
component AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN component ON id = doc_id
"""

OP10 = rf"""
WITH worded AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
items AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '{_TERM}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {SIZE}) AS n, array_to_string(w[i:i + {SIZE - 1}], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM worded, sizes WHERE len(w) >= n),
hits AS MATERIALIZED (SELECT p.doc_id, p.i, p.n, x.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM places) p JOIN windows x ON x.n = p.n AND x.s = p.s),
words_hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
spelt AS MATERIALIZED (SELECT item_id, n, string_split(s, ' ') AS t FROM windows),
counts AS MATERIALIZED (SELECT word, count(*) AS k FROM (SELECT unnest(w) AS word FROM worded) GROUP BY word),
rare AS MATERIALIZED (SELECT item_id, n, t, min((k, off)) AS pick FROM (SELECT item_id, n, t, unnest(t) AS word, unnest(range(n)) AS off FROM spelt) LEFT JOIN counts USING (word) GROUP BY ALL HAVING count(k) = n),
spots AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS at FROM worded),
begun AS (SELECT DISTINCT doc_id, item_id, n, t, at - pick[2] - back AS b FROM rare JOIN spots ON word = t[pick[2] + 1], range({SLOP + 1}) x(back)),
near AS MATERIALIZED (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM begun JOIN worded USING (doc_id) WHERE b + n + {SLOP} > 0
  AND len(list_filter(range(n), lambda o: NOT coalesce(list_contains(w[greatest(b + o + 1, 1):greatest(b + o + 1 + {SLOP}, 0)], t[o + 1]), false))) = 0),
nearby AS (SELECT doc_id, count(*) AS n_near_items, sha256(string_agg(item, ',' ORDER BY item)) AS near_items_sha256 FROM near GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near_items, 0) AS n_near_items, coalesce(near_items_sha256, sha256('')) AS near_items_sha256
FROM worded LEFT JOIN words_hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": OP6, "op9_minhash": OP9, "op10_decontaminate": OP10}
