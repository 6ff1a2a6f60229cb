"""DuckDB SQL by query name: every query of the catalogue has one."""

from __future__ import annotations

from siftmark.functions.hashing import PRIME
from siftmark.functions.shingling import UNSEGMENTED_RANGES
from siftmark.operators.cluster import BANDS
from siftmark.operators.perturb import EVERY, SETTINGS
from siftmark.plans.catalog import SCRIPTS
from siftmark.plans.duck import bits, blake2b, blake2b4_doubles, blake2b8, components, normalized, runs, signatures, tokens
from siftmark.sources.loaders import LEXICAL_FAMILIES, SEMANTIC_FAMILIES

SPACE = r"[\s\x0b\x1c-\x1f]"
STRIPPED = rf"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"
_scripts = "(VALUES " + ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in SCRIPTS) + ") s(name, text)"
_dense = rf"regexp_replace(lower(text), '{SPACE}+', '', 'g')"
_ranges = "[" + "".join(f"{a}-{b}" for a, b in UNSEGMENTED_RANGES) + "]"
_norm = normalized("text")

_items = "(SELECT item_id AS id, text AS t FROM benchmark)"
_turns = "(SELECT conv_id * 1000 + turn AS id, text AS t FROM conversations)"
_forms = "(SELECT unnest([text, 'please ' || text, text || ' now thanks']) AS text FROM benchmark)"
_documents = f"""uniques AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t) - 1 AS id, t FROM (SELECT DISTINCT {_norm} AS t FROM documents WHERE {_norm} <> ''))"""
_unique = f"""uniques AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t) - 1 AS id, t FROM (SELECT DISTINCT {_norm} AS t FROM {_forms} WHERE {_norm} <> ''))"""
_bands = f"""banded AS MATERIALIZED (SELECT id, slot // {128 // BANDS} AS band, string_agg(value::VARCHAR, ':' ORDER BY slot) AS key FROM sig GROUP BY ALL)"""
_stars = """stars AS MATERIALIZED (SELECT DISTINCT b.id AS src, l.dst FROM banded b JOIN (SELECT band, key, min(id) AS dst FROM banded GROUP BY ALL HAVING count(*) > 1) l USING (band, key) WHERE b.id <> l.dst)"""
_sizes = "sizes AS (SELECT component, count(*) AS n FROM component GROUP BY component)"
_stats = "SELECT sum(n)::BIGINT AS n_unique, count(*) AS n_clusters, count(*) FILTER (WHERE n > 1) AS n_multi, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_in_multi, 100 * coalesce(sum(n) FILTER (WHERE n > 1), 0)::DOUBLE / sum(n) AS pct_in_multi FROM sizes"
_document_clusters = f"WITH RECURSIVE {_documents}, {signatures('uniques')}, {_bands}, {_stars}, {components('uniques', 'stars')}"
_clusters = f"WITH RECURSIVE {_unique}, {signatures('uniques')}, {_bands}, {_stars}, {components('uniques', 'stars')}"
_rate = "count(*) AS total, count(DISTINCT nullif(norm, '')) AS n_unique, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE 100 * (count(*) - count(DISTINCT nullif(norm, '')))::DOUBLE / count(*) END AS dup_pct"

_digest = "'plm1:128:' || string_agg(printf('%08x', value), ':' ORDER BY slot)"
_pair_sims = """matched AS MATERIALIZED (SELECT x.id AS a, y.id AS b, CASE WHEN max(x.value) = 0 OR max(y.value) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (WHERE x.value = y.value)::DOUBLE / 128 END AS sim
  FROM sig x JOIN sig y ON x.slot = y.slot AND x.id < y.id GROUP BY ALL)"""

_vectors = "vectors AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_mean = "means AS MATERIALIZED (SELECT axis, avg(x) AS m FROM (SELECT unnest(range(len(v))) AS axis, unnest(v) AS x FROM vectors) GROUP BY axis), mean AS MATERIALIZED (SELECT list(m ORDER BY axis) AS m FROM means)"
_centred = f"{_vectors}, {_mean}, centred AS MATERIALIZED (SELECT id, label, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS v FROM vectors, mean)"
_bit_pairs = f"""{_vectors}, {bits('vectors')}, rows_of AS MATERIALIZED (SELECT id, label, list(bit ORDER BY plane) AS w FROM bit JOIN vectors USING (id) GROUP BY ALL),
pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b, list_sum(list_transform(list_zip(x.w, y.w), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END))::DOUBLE / 256 AS sim, (x.label IS NOT DISTINCT FROM y.label) AS is_intra FROM rows_of x JOIN rows_of y ON x.id < y.id)"""
_lexical_pairs = f"""{signatures(_turns)}, {_pair_sims}, labelled AS (SELECT conv_id * 1000 + turn AS id, role AS label FROM conversations),
pairs AS MATERIALIZED (SELECT a, b, sim, (x.label IS NOT DISTINCT FROM y.label) AS is_intra FROM matched JOIN labelled x ON x.id = a JOIN labelled y ON y.id = b)"""
_summary = """SELECT ((1 + sqrt(1 + 8 * count(*))) / 2)::BIGINT AS n_items, count(*) FILTER (WHERE is_intra) AS n_pairs_intra, count(*) FILTER (WHERE NOT is_intra) AS n_pairs_inter,
coalesce(avg(sim) FILTER (WHERE is_intra), 0.0) AS mean_intra, coalesce(avg(sim) FILTER (WHERE NOT is_intra), 0.0) AS mean_inter,
coalesce(avg(sim) FILTER (WHERE is_intra), 0.0) - coalesce(avg(sim) FILTER (WHERE NOT is_intra), 0.0) AS separation FROM pairs"""


def _metrics(thresholds: str) -> str:
    """CTEs ending in ``rated``: metrics at each threshold."""
    return f"""hist AS MATERIALIZED (SELECT sim, count(*) FILTER (WHERE is_intra) AS x, count(*) FILTER (WHERE NOT is_intra) AS y FROM pairs GROUP BY sim),
counts AS (SELECT threshold, coalesce(sum(x) FILTER (WHERE sim >= threshold), 0)::BIGINT AS tp, coalesce(sum(y) FILTER (WHERE sim >= threshold), 0)::BIGINT AS fp,
  coalesce(sum(x) FILTER (WHERE sim < threshold), 0)::BIGINT AS fn, coalesce(sum(y) FILTER (WHERE sim < threshold), 0)::BIGINT AS tn FROM ({thresholds}) t CROSS JOIN hist GROUP BY threshold),
halves AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM counts),
rated AS MATERIALIZED (SELECT threshold, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1, tp, fp, fn, tn FROM halves)"""


_steps = "SELECT i::DOUBLE / 100 AS threshold FROM range(101) r(i)"
_unit = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"


def _cosine(source: str) -> str:
    return f"units AS MATERIALIZED (SELECT id, label, CASE WHEN list_dot_product(v, v) = 0 THEN v ELSE {_unit} END AS u FROM {source}), cosines AS MATERIALIZED (SELECT x.id AS a, y.id AS b, list_dot_product(x.u, y.u) AS sim, (x.label IS NOT DISTINCT FROM y.label) AS is_intra FROM units x JOIN units y ON x.id < y.id)"


_separation = "round(avg(sim) FILTER (WHERE is_intra), 6) AS mean_intra, round(avg(sim) FILTER (WHERE NOT is_intra), 6) AS mean_inter, round(avg(sim) FILTER (WHERE is_intra) - avg(sim) FILTER (WHERE NOT is_intra), 6) AS separation FROM cosines"
_scale = "list_max(list_transform(v, lambda x: abs(x))) / 127"

_next_bits = "SELECT x.id, count(*) FILTER (WHERE x.bit = y.bit)::DOUBLE / 256 AS sim FROM bit x JOIN bit y ON y.id = x.id + 1 AND x.plane = y.plane GROUP BY x.id"


def _fixture(name: str, rows: list[tuple[str, str]]) -> str:
    """SELECT of the summary and best threshold of a small labelled set."""
    quoted = ", ".join(f"({i}, '{t}', '{label}')" for i, (t, label) in enumerate(rows))
    pairs = f"items AS (SELECT * FROM (VALUES {quoted}) v(id, t, label)), {signatures('items')}, {_pair_sims}, pairs AS MATERIALIZED (SELECT a, b, sim, x.label = y.label AS is_intra FROM matched JOIN items x ON x.id = a JOIN items y ON y.id = b)"
    return f"SELECT '{name}' AS name, * FROM (WITH {pairs}, {_metrics(_steps)} SELECT * FROM ({_summary}), (SELECT * FROM rated ORDER BY f1 DESC, threshold LIMIT 1))"


def _sweep(slots: int, size: int) -> str:
    """SELECT of the mean similarity of benchmark texts and their edits, of one setting."""
    hit, new = f"i % {EVERY} = 0", "'zz' || reverse(w[i])"
    forms = {
        "plain": "w",
        "insert": f"flatten(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {hit} THEN [w[i], {new}] ELSE [w[i]] END))",
        "delete": f"list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT ({hit})), lambda i: w[i])",
        "substitute": f"list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {hit} THEN {new} ELSE w[i] END)",
        "reorder": "list_reverse(w)",
    }
    texts = " UNION ALL ".join(f"SELECT n * 5 + {k} AS id, array_to_string({form}, ' ') AS t FROM worded" for k, form in enumerate(forms.values()))
    names = " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(forms))
    sims = f"SELECT y.id, CASE WHEN max(x.value) = 0 OR max(y.value) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (WHERE x.value = y.value)::DOUBLE / {slots} END AS sim FROM sig x JOIN sig y ON x.slot = y.slot AND x.id = y.id // 5 * 5 AND y.id % 5 > 0 GROUP BY y.id"
    return f"SELECT CASE id % 5 {names} END AS edit, {slots} AS num_perm, {size} AS shingle_size, count(*) AS n, round(avg(sim), 9) AS mean_sim FROM (WITH worded AS MATERIALIZED (SELECT row_number() OVER () AS n, {tokens('text')} AS w FROM benchmark), forms AS MATERIALIZED ({texts}), {signatures('forms', 1, slots, size)} {sims}) GROUP BY 1"


def _crossed(sides: str) -> str:
    """Texts of the side ``k`` = 0, those that share a band with one of the side 1, and their share, for a relation of ``k, t``."""
    return (
        f"WITH uniques AS MATERIALIZED (SELECT row_number() OVER () AS id, k, t FROM ({sides}) WHERE t <> ''), {signatures('uniques')}, {_bands}, "
        "hits AS (SELECT DISTINCT x.id FROM banded x JOIN uniques u ON u.id = x.id AND u.k = 0 JOIN (SELECT DISTINCT b.band, b.key FROM banded b JOIN uniques USING (id) WHERE k = 1) y ON x.band = y.band AND x.key = y.key) "
        "SELECT (SELECT count(*) FROM uniques WHERE k = 0) AS n_unique, count(*) AS n_matched, CASE WHEN (SELECT count(*) FROM uniques WHERE k = 0) = 0 THEN 0.0::DOUBLE ELSE 100 * count(*)::DOUBLE / (SELECT count(*) FROM uniques WHERE k = 0) END AS matched_pct FROM hits"
    )


ORACLE_SQL: dict[str, str] = {
    "scan_parquet": "SELECT text FROM documents WHERE text IS NOT NULL",
    "scan_text": "SELECT unnest(string_split(text, chr(10))) AS text FROM documents",
    "scan_csv": "SELECT text FROM documents WHERE text <> ''",
    "load_labelled": "SELECT text, role AS label FROM conversations",
    "load_labelled_flexible": f"SELECT * FROM (SELECT {STRIPPED} AS text, regexp_replace(role, '^{SPACE}+|{SPACE}+$', '', 'g') AS label FROM conversations) WHERE text <> '' AND label <> ''",
    "clean_texts": f"SELECT * FROM (SELECT doc_id, {STRIPPED} AS text FROM documents) WHERE text <> ''",
    "limit_first_n": f"SELECT * FROM (SELECT doc_id, {STRIPPED} AS text FROM documents) WHERE text <> '' ORDER BY doc_id LIMIT 100",
    "normalize_tokens": f"SELECT doc_id, len(w) AS n_tokens, array_to_string(w, '|') AS tokens FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)",
    "normalized_text": f"SELECT doc_id, {_norm} AS normalized FROM documents",
    "script_route": f"SELECT name, regexp_matches(text, '{_ranges}')::INTEGER AS unsegmented FROM {_scripts}",
    "char_shingles": f"SELECT name, unnest(CASE WHEN length(d) = 0 THEN []::VARCHAR[] WHEN length(d) = 1 THEN [d] ELSE list_distinct(list_transform(range(1, length(d)), lambda i: substring(d, i, 2))) END) AS shingle FROM (SELECT name, {_dense} AS d FROM {_scripts})",
    "word_shingles": f"SELECT doc_id, unnest({runs('w')}) AS shingle FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)",
    "shingles": f"SELECT doc_id, unnest({runs('w')}) AS shingle FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)",
    "base_hash": f"WITH strings AS MATERIALIZED (SELECT DISTINCT unnest({runs('w')}) AS s FROM (SELECT {tokens('text')} AS w FROM benchmark)) SELECT s AS shingle, h::VARCHAR AS hash FROM ({blake2b8('strings')})",
    "perm_coefficients": f"WITH n AS MATERIALIZED (SELECT i, '1:a:' || i AS x, '1:b:' || i AS y FROM range(128) r(i)), strings AS MATERIALIZED (SELECT x AS s FROM n UNION ALL SELECT y FROM n), hashed AS MATERIALIZED ({blake2b8('strings')}) "
    f"SELECT i, (p.h::HUGEINT % {PRIME - 1} + 1)::VARCHAR AS a, (q.h::HUGEINT % {PRIME})::VARCHAR AS b FROM n JOIN hashed p ON p.s = x JOIN hashed q ON q.s = y",
    "minhash_signature": f"WITH {signatures(_items)} SELECT id AS item_id, slot, value FROM sig",
    "parse_lexical": f"WITH {signatures(_items)} SELECT id AS item_id, slot, value FROM sig",
    "lexical_digest": f"WITH {signatures(_items)} SELECT id AS item_id, {_digest} AS digest FROM sig GROUP BY id",
    "conversation_digest": f"WITH {signatures(_turns)} SELECT id // 1000 AS conv_id, id % 1000 AS turn, {_digest} AS digest FROM sig GROUP BY id",
    "stream_digest": f"WITH {signatures(_turns)} SELECT id // 1000 AS conv_id, id % 1000 AS turn, {_digest} AS digest FROM sig GROUP BY id",
    "hyperplane_values": f"WITH strings AS MATERIALIZED (SELECT p AS plane, d AS axis, '1:' || p || ':' || d AS s FROM range(256) x(p), range(64) y(d)), hashed AS MATERIALIZED ({blake2b('strings', 16)}) "
    "SELECT plane, axis, round(sqrt(-2.0::DOUBLE * ln((h0::DOUBLE + 1) / (18446744073709551616::DOUBLE + 1))) * cos(2.0::DOUBLE * pi() * (h1::DOUBLE / 18446744073709551616::DOUBLE)), 9) AS value FROM strings JOIN hashed USING (s)",
    "compare_semantic": f"SELECT 'plain' AS kind, * FROM (WITH {_vectors}, {bits('vectors')} {_next_bits}) UNION ALL SELECT 'centred', * FROM (WITH {_centred}, {bits('centred')} {_next_bits})",
    "lexical_similarity": f"WITH {signatures(_items)}, {_pair_sims} SELECT a, b, sim FROM matched",
    "compare_dispatch": f"WITH {signatures(_items)}, {_pair_sims} SELECT a, b, sim FROM matched",
    "similarity_text": f"WITH both_forms AS MATERIALIZED (SELECT item_id * 2 AS id, text AS t FROM benchmark UNION ALL SELECT item_id * 2 + 1, 'please ' || upper(text) FROM benchmark), {signatures('both_forms')} "
    "SELECT x.id // 2 AS item_id, CASE WHEN max(x.value) = 0 OR max(y.value) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (WHERE x.value = y.value)::DOUBLE / 128 END AS sim FROM sig x JOIN sig y ON x.slot = y.slot AND y.id = x.id + 1 AND x.id % 2 = 0 GROUP BY x.id",
    "lsh_bands": f"WITH {_unique}, {signatures('uniques')}, {_bands} SELECT id, band, key FROM banded",
    "lsh_band_collisions": f"WITH {_unique}, {signatures('uniques')}, {_bands}, {_stars} SELECT src, dst FROM stars",
    "lsh_bands_documents": f"WITH {_documents}, {signatures('uniques')}, {_bands} SELECT id, band, key FROM banded",
    "lsh_band_collisions_documents": f"WITH {_documents}, {signatures('uniques')}, {_bands}, {_stars} SELECT src, dst FROM stars",
    "lsh_clusters_variants": f"{_clusters} SELECT id, component AS cluster_id FROM component",
    "cluster_stats_variants": f"{_clusters}, {_sizes} {_stats}",
    "lsh_clusters": f"{_document_clusters} SELECT id, component AS cluster_id FROM component",
    "cluster_stats": f"{_document_clusters}, {_sizes} {_stats}",
    "top_clusters": f"{_document_clusters}, {_sizes}, largest AS (SELECT * FROM sizes WHERE n > 1 ORDER BY n DESC, component LIMIT 3), "
    "ranked AS (SELECT id, component, n, row_number() OVER (PARTITION BY component ORDER BY id) AS k FROM component JOIN largest USING (component)) SELECT component AS cluster_id, n AS size, id, substring(t, 1, 100) AS snippet FROM ranked JOIN uniques USING (id) WHERE k <= 3",
    "exact_dup_rate": f"SELECT {_rate} FROM (SELECT {_norm} AS norm FROM documents)",
    "exact_dup_by_group": f"SELECT source, {_rate} FROM (SELECT source, {_norm} AS norm FROM documents) GROUP BY source",
    "cross_corpus_exact": f"WITH n AS MATERIALIZED (SELECT DISTINCT doc_id % 2 AS k, {_norm} AS norm FROM documents WHERE {_norm} <> '') SELECT count(*) AS n_unique, count(y.norm) AS n_matched, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE 100 * count(y.norm)::DOUBLE / count(*) END AS matched_pct FROM (SELECT norm FROM n WHERE k = 0) x LEFT JOIN (SELECT norm FROM n WHERE k = 1) y USING (norm)",
    "cross_corpus_lsh": _crossed(f"SELECT DISTINCT 0 AS k, {_norm} AS t FROM benchmark UNION SELECT DISTINCT 1, {_norm} FROM (SELECT 'please ' || text AS text FROM benchmark)"),
    "cross_corpus_lsh_documents": _crossed(f"SELECT DISTINCT doc_id % 2 AS k, {_norm} AS t FROM documents"),
    "pair_similarities": f"WITH {_bit_pairs} SELECT a, b, sim, is_intra::INTEGER AS is_intra FROM pairs",
    "pair_similarities_lexical": f"WITH {_lexical_pairs} SELECT a, b, sim, is_intra::INTEGER AS is_intra FROM pairs",
    "family_count": "SELECT count(DISTINCT label) AS n_families FROM embeddings",
    "dim_check": "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1",
    "reference_mean": f"WITH {_vectors}, {_mean} SELECT axis, round(m, 12) AS mean FROM means",
    "reference_mean_id": f"WITH {_vectors}, {_mean}, rounded AS MATERIALIZED (SELECT list_transform(m, lambda x: round(x, 9)) AS v FROM mean) SELECT hex AS ref_id FROM ({blake2b4_doubles('rounded', 64)})",
    "center_embeddings": f"WITH {_centred} SELECT id, unnest(range(len(v))) AS axis, round(unnest(v), 9) AS x FROM centred",
    "simhash_bits": f"WITH {_vectors}, {bits('vectors')} SELECT id, plane, bit::INTEGER AS bit FROM bit",
    "simhash_hex": f"WITH {_vectors}, {bits('vectors')} SELECT id, hex FROM packed",
    "semantic_digest": f"WITH {_vectors}, {bits('vectors')} SELECT id, 'pls1:unit_test:256:' || hex AS digest FROM packed",
    "semantic_digest_centered": f"WITH {_centred}, {bits('centred')} SELECT id, 'pls1c' AS scheme, 256 AS n_bits, hex FROM packed",
    "parse_semantic": f"WITH {_vectors}, {bits('vectors')} SELECT id, 'pls1' AS scheme, 'unit_test' AS model_id, 'none' AS ref_id, 256 AS n_bits, hex FROM packed",
    "semantic_similarity": f"WITH {_vectors}, {bits('vectors')} SELECT x.id, count(*) FILTER (WHERE x.bit = y.bit)::DOUBLE / 256 AS sim FROM bit x JOIN bit y ON y.id = x.id + 1 AND x.plane = y.plane GROUP BY x.id",
    "cosine_pairs": f"WITH {_vectors}, {_cosine('vectors')} SELECT a, b, round(sim, 6) AS sim FROM cosines",
    "int8_cosine": f"WITH {_vectors}, whole AS MATERIALIZED (SELECT id, label, CASE WHEN {_scale} = 0 THEN v ELSE list_transform(v, lambda x: round_even(x / ({_scale}), 0)) END AS v FROM vectors), {_cosine('whole')} SELECT a, b, round(sim, 6) AS sim FROM cosines",
    "centered_separation": f"SELECT 'raw' AS kind, * FROM (WITH {_vectors}, {_cosine('vectors')} SELECT {_separation}) UNION ALL SELECT 'centred', * FROM (WITH {_centred}, {_cosine('centred')} SELECT {_separation})",
    "recall_at_1": f"WITH {_vectors}, units AS MATERIALIZED (SELECT id, label, {_unit} AS u FROM vectors), best AS (SELECT x.id, x.label, arg_max(y.label, (round(list_dot_product(x.u, y.u), 9), -y.id)) AS found FROM units x JOIN units y ON x.id <> y.id GROUP BY ALL) SELECT count(*) AS n_queries, count(*) FILTER (WHERE label = found) AS n_hits, count(*) FILTER (WHERE label = found)::DOUBLE / count(*) AS recall FROM best",
}
for _end, _pairs in (("", _bit_pairs), ("_lexical", _lexical_pairs)):
    ORACLE_SQL[f"family_summary{_end}"] = f"WITH {_pairs} {_summary}"
    ORACLE_SQL[f"threshold_metrics{_end}"] = f"WITH {_pairs}, {_metrics('SELECT 0.5::DOUBLE AS threshold')} SELECT * FROM rated"
    ORACLE_SQL[f"threshold_curve{_end}"] = f"WITH {_pairs}, {_metrics(_steps)} SELECT * FROM rated"
    ORACLE_SQL[f"best_threshold{_end}"] = f"WITH {_pairs}, {_metrics(_steps)} SELECT * FROM rated ORDER BY f1 DESC, threshold LIMIT 1"
ORACLE_SQL["fixture_summary"] = " UNION ALL ".join(_fixture(*x) for x in (("lexical", LEXICAL_FAMILIES), ("semantic", SEMANTIC_FAMILIES)))
ORACLE_SQL["perturbation_sweep"] = " UNION ALL ".join(_sweep(*x) for x in SETTINGS)
