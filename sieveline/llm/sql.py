"""Equivalent SQL of the llm queries that SQL can express."""

_P2 = """
WITH r AS (
  SELECT run_id, query_id, chunk_id, score, rank, method FROM retrieval_results
  WHERE run_id IS NOT NULL AND query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
), once AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, query_id, chunk_id ORDER BY score DESC, rank ASC NULLS LAST, method) AS copy FROM r
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, rank ASC NULLS LAST, chunk_id) AS position FROM once WHERE copy = 1
)
"""

_P6 = r"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
iw AS (SELECT DISTINCT item_id, array_to_string(w[a : a + least(13, len(w)) - 1], ' ') AS words, least(13, len(w)) AS n FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS a) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[a : a + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM iw))),
found AS (SELECT doc_id, item_id, count(DISTINCT words) AS leaked_windows FROM dw JOIN iw USING (words) GROUP BY 1, 2)
"""
_P1 = """
WITH r AS (
  SELECT DISTINCT 'document' AS record_type, document_id AS id, document_id AS owner, body AS text FROM enterprise_documents
  UNION SELECT DISTINCT 'chunk', chunk_id, regexp_extract(chunk_id, '^(.*)-C', 1), text FROM chunks
), part AS (
  SELECT record_type, id, owner, substring(text, b + 1, 1199) AS text FROM (SELECT *, unnest(range(0, length(text) - 199, 1000)) AS b FROM r WHERE length(text) >= 200)
), w AS (
  SELECT record_type, id, owner, hash(substring(text, a, 200))::VARCHAR || hash(reverse(substring(text, a, 200)) || 'x')::VARCHAR AS h FROM (SELECT *, unnest(range(1, length(text) - 198)) AS a FROM part)
), shared AS (
  SELECT record_type, h FROM w GROUP BY 1, 2 HAVING min(owner) <> max(owner)
), g AS (SELECT DISTINCT record_type, h, id, owner FROM w JOIN shared USING (record_type, h))
"""

_P7 = """
WITH t AS (SELECT source, sum(target_share)::DOUBLE AS share, max(max_repeats)::BIGINT AS cap FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY 1),
r AS (SELECT *, ('0x' || substring(md5('42|' || doc_id), 1, 15))::BIGINT AS key FROM (SELECT doc_id, translate(lower(trim(source)), '- ', '__') AS source, length(text) // 4 AS n FROM documents) WHERE doc_id IS NOT NULL AND n > 0 AND source IN (SELECT source FROM t)),
have AS (SELECT source, sum(n)::BIGINT AS have, count(*) AS n_records FROM r GROUP BY 1),
plan AS (SELECT floor(min(have * cap * (SELECT sum(share) FROM t) / share))::BIGINT // 512 AS slots FROM have JOIN t USING (source) WHERE cap > 0),
cum AS (SELECT source, cap, coalesce(sum(share) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(share) FROM t) AS a, CASE WHEN lead(source) OVER (ORDER BY source) IS NULL THEN 2 ELSE sum(share) OVER (ORDER BY source) / (SELECT sum(share) FROM t) END AS b FROM t),
slot AS (SELECT i, (i + 1) * 0.6180339887498949::DOUBLE AS p FROM (SELECT unnest(range(0, slots)) AS i FROM plan)),
dealt AS (SELECT cum.source, cap, row_number() OVER (PARTITION BY cum.source ORDER BY i) - 1 AS nth FROM slot JOIN cum ON p - floor(p) >= a AND p - floor(p) < b),
block AS (SELECT source, nth % ((have + 511) // 512) AS block, count(*) AS repeats FROM dealt JOIN have USING (source) WHERE nth < ((have + 511) // 512) * cap GROUP BY 1, 2),
placed AS (SELECT doc_id, source, n, (coalesce(sum(n) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT // 512 AS block FROM r),
uses AS (SELECT doc_id, placed.source, n AS n_tokens, repeats FROM placed JOIN block ON placed.source = block.source AND placed.block = block.block)
"""
_COVER = _P1.split(", part AS")[0] + """, part AS (
  SELECT record_type, id, owner, text AS whole, b, substring(text, b + 1, 1199) AS text FROM (SELECT *, unnest(range(0, length(text) - 199, 1000)) AS b FROM r WHERE length(text) >= 200)
), w AS (
  SELECT record_type, id, owner, whole, b + a - 1 AS p, hash(substring(text, a, 200))::VARCHAR || hash(reverse(substring(text, a, 200)) || 'x')::VARCHAR AS h FROM (SELECT *, unnest(range(1, length(text) - 198)) AS a FROM part)
), shared AS (
  SELECT record_type, h FROM w GROUP BY 1, 2 HAVING min(owner) <> max(owner)
), place AS (
  SELECT DISTINCT record_type, id, whole, p FROM w JOIN shared USING (record_type, h)
), edge AS (
  SELECT *, CASE WHEN p - lag(p) OVER v <= 200 THEN 0 ELSE 1 END AS new FROM place WINDOW v AS (PARTITION BY record_type, id, whole ORDER BY p)
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY record_type, id, whole ORDER BY p) AS span FROM edge
), spans AS (
  SELECT record_type, id, whole, min(p) AS span_start, max(p) + 200 AS span_end FROM numbered GROUP BY record_type, id, whole, span
)
"""

SQL = {
    "p1_found": _P1 + "SELECT DISTINCT a.record_type, a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.record_type = b.record_type AND a.h = b.h AND a.id < b.id AND a.owner <> b.owner",
    "p1_spans": _COVER + "SELECT DISTINCT record_type, id, span_start, span_end FROM spans",
    "p1_shared_chars": _COVER + """, sums AS (SELECT record_type, id, whole, sum(span_end - span_start) AS shared_chars, count(*) AS n_spans, max(span_end - span_start) AS longest_span FROM spans GROUP BY ALL),
 al AS (SELECT r.record_type, r.id, length(text) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(n_spans, 0) AS n_spans, coalesce(longest_span, 0) AS longest_span
   FROM r LEFT JOIN sums ON r.record_type = sums.record_type AND r.id = sums.id AND r.text = sums.whole WHERE r.id IS NOT NULL AND r.owner IS NOT NULL AND text IS NOT NULL)
 SELECT record_type, id, n_chars::BIGINT AS n_chars, shared_chars::BIGINT AS shared_chars, n_spans::BIGINT AS n_spans, longest_span::BIGINT AS longest_span
 FROM (SELECT *, row_number() OVER (PARTITION BY record_type, id ORDER BY shared_chars DESC, n_chars DESC, n_spans DESC, longest_span DESC) AS best FROM al) WHERE best = 1""",
    "p6_found": _P6 + "SELECT doc_id, item_id FROM found",
    "p6_leaks": _P6 + "SELECT * FROM found",
    "p6_items": _P6 + "SELECT item_id, count(*) AS n_docs, max(leaked_windows) AS most_windows FROM found GROUP BY 1",
    "p3_found": r"""
SELECT DISTINCT config_id, document_id,
  CASE WHEN list_max(list_transform(regexp_split_to_array(body, '\s+'), lambda w: length(w))) // 4 > max_tokens THEN 'forced' ELSE 'boundary' END AS cut_kind
FROM enterprise_documents, chunking_config WHERE length(body) // 4 > max_tokens""",
    "p7_uses_estimated": _P7 + "SELECT * FROM uses",
    "p7_mix_estimated": _P7 + """, given AS (SELECT source, count(*) AS n_used, max(repeats) AS most_repeats, sum(n_tokens * repeats)::BIGINT AS tokens_used FROM uses GROUP BY 1)
SELECT t.source, share AS target_share, cap AS max_repeats, coalesce(n_records, 0) AS n_records, coalesce(have, 0) AS tokens, coalesce(n_used, 0) AS n_used, coalesce(most_repeats, 0) AS most_repeats, coalesce(tokens_used, 0) AS tokens_used FROM t LEFT JOIN have USING (source) LEFT JOIN given USING (source)""",
    "p8_measures": r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')),
ln AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '')) AS x FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(x, '[.!?…。"”»’)]$')) AS ends, count(*) FILTER (regexp_matches(x, '^(?:[-*•‣◦–+]|\[[ xX]\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])(?:\s|$)')) AS bullets FROM ln GROUP BY 1),
w AS (SELECT doc_id, length(text) AS n_chars, length(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS solid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
f AS (SELECT list(DISTINCT lower(word)) AS f FROM common_words),
s AS (SELECT doc_id, n_chars, solid, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters, len(list_filter(w, lambda x: regexp_full_match(x, '\p{Nd}+'))) AS digits, len(list_filter(w, lambda x: list_contains(f, x))) AS common FROM w, f)
SELECT doc_id, n_chars, n AS n_words, n_lines, coalesce(round(letters / nullif(n, 0), 6), 0) AS mean_word_length, round((solid - letters) / solid, 6) AS symbol_ratio, coalesce(round((n - digits) / nullif(n, 0), 6), 0) AS alpha_word_ratio,
 round(ends / n_lines, 6) AS end_punct_ratio, round(bullets / n_lines, 6) AS bullet_ratio, coalesce(round(common / nullif(n, 0), 6), 0) AS common_ratio FROM s JOIN l USING (doc_id)""",
    "p3_soundness": """
SELECT config_id, count(*) AS n_texts, count(*) FILTER (length(body) // 4 > max_tokens) AS n_oversized, 0::BIGINT AS n_too_long, 0::BIGINT AS n_empty, 0::BIGINT AS n_gaps, 0::BIGINT AS n_bad_overlap
FROM (SELECT DISTINCT document_id, body FROM enterprise_documents WHERE document_id IS NOT NULL AND body IS NOT NULL), chunking_config GROUP BY 1""",
    "p2_found": _P2 + "SELECT run_id, query_id, chunk_id FROM placed WHERE position <= 3",
    "p2_top3": _P2 + "SELECT run_id, query_id, chunk_id, score, rank, method, CAST(position AS INTEGER) AS position FROM placed WHERE position <= 3",
}
