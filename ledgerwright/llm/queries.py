"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import op1_licenses, op2_decontaminate, op3_repeats, op4_packing, op5_language, op6_toxicity, op7_media, op8_pii, op9_minhash, op10_planes, op11_ranking, op12_spellings, op13_outliers

QUERIES = {
    "op1_license_paragraphs": op1_licenses.query,
    "op2_contaminated_passages": op2_decontaminate.query,
    "op3_remove_repeats": op3_repeats.query,
    "op4_pack_sequences": op4_packing.query,
    "op5_word_languages": op5_language.query,
    "op6_toxicity_scores": op6_toxicity.query,
    "op7_media_boxes": op7_media.query,
    "op8_personal_data": op8_pii.query,
    "op9_near_duplicates": op9_minhash.query,
    "op10_plane_files": op10_planes.query,
    "op11_ranked_search": op11_ranking.query,
    "op12_spelling_variants": op12_spellings.query,
    "op13_quality_outliers": op13_outliers.query,
}
#: Distinct shingles of four words by document, links by counting common ones, and the least document reached over links.
_NEAR = """
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
e AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT links.y, r.c FROM r JOIN links ON links.x = r.doc_id WHERE r.c < links.y)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""

#: Every 50-byte string as hexadecimal, cut by way of pieces of 1,000 bytes; the smallest document of each; runs of covered bytes.
_REPEATS = """
WITH
d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, 1000 * k AS base, substr(h, 2000 * k + 1, 2098) AS h FROM (SELECT *, unnest(range(0, (n + 999) // 1000)) AS k FROM d)),
s AS MATERIALIZED (SELECT doc_id, base + i AS pos, md5(substr(h, 2 * i + 1, 100)) AS m FROM (SELECT *, unnest(range(0, least(1000, n - 49 - base))) AS i FROM p WHERE n - 49 > base)),
f AS (SELECT m, min(doc_id) AS first FROM s GROUP BY m),
c AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s JOIN f USING (m) WHERE first < doc_id),
i AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT *, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM c) GROUP BY doc_id, k),
kept AS (SELECT doc_id, a, lead(a, 1, NULL) OVER (PARTITION BY doc_id ORDER BY a) AS next, b FROM (SELECT doc_id, a, b FROM i UNION ALL SELECT doc_id, -1, 0 FROM d)),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * k.b + 1, 2 * (coalesce(k.next, n) - k.b)), '' ORDER BY k.b) AS h FROM kept k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(x.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(x.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(t.h)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM i GROUP BY doc_id) x USING (doc_id)"""
ORACLES: dict[str, str] = {"op3_remove_repeats": _REPEATS, "op9_near_duplicates": _NEAR, "op11_ranked_search": op11_ranking.SQL, "op12_spelling_variants": op12_spellings.SQL}
