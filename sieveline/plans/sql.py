"""Equivalent SQL of the core queries."""

from ..functions.text import ID_PATTERNS, QUESTION_TYPES, STOP_WORDS



def _one(name: str, key: str, alias: str) -> str:
    return f"{alias} AS (SELECT * EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) AS copy FROM {name} WHERE {key} IS NOT NULL) WHERE copy = 1)"


_CH, _DOC, _Q = _one("chunks", "chunk_id", "ch"), _one("enterprise_documents", "document_id", "doc"), _one("queries", "query_id", "q")
_DEC, _EV = _one("pilot_decisions", "decision_id", "d"), _one("failure_analysis", "failure_id", "ev")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tokens(text: str, keep: bool) -> str:
    found, rest = [], f"coalesce({text}, '')"
    for pattern in ID_PATTERNS:
        found.append(f"list_transform(regexp_extract_all({rest}, {_quote(pattern)}, 1), lambda t: lower(t))")
        rest = f"regexp_replace({rest}, {_quote(pattern)}, ' ', 'g')"
    stop = "" if keep else " AND w NOT IN (" + ", ".join(map(_quote, STOP_WORDS)) + ")"
    words = f"list_filter(list_transform(string_split_regex(lower({rest}), '[^a-z0-9_/-]+'), lambda w: regexp_replace(w, '^[_-]+|[_-]+$', '', 'g')), lambda w: length(w) >= 2{stop})"
    return " || ".join(f"({x})" for x in (*found, words))


_CLEAN = "upper(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_POST = f"{_CH}, tk AS (SELECT chunk_id, {_tokens('array_to_string(section_path, chr(32)) || chr(32) || text', False)} AS t FROM (SELECT chunk_id, coalesce(section_path, []) AS section_path, coalesce(text, '') AS text FROM ch)), each AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tk), post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM each GROUP BY ALL)"
_IDF = _POST + """, df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), n AS (SELECT count(*) AS n FROM ch),
idf0 AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, n), idf AS (SELECT term, df, CASE WHEN i >= 0 THEN i ELSE 0.25 * (SELECT avg(i) FROM idf0) END AS idf FROM idf0)"""

# Ranked lists of the latest run of each method.
_RUNS = """last AS (SELECT method, arg_max(run_id, (run_at, run_id)) AS run_id FROM retrieval_results WHERE method IS NOT NULL GROUP BY 1),
rows0 AS (SELECT r.run_id, r.method, query_id, chunk_id, score, rank FROM retrieval_results r JOIN last ON r.method = last.method AND r.run_id = last.run_id WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
once AS (SELECT * EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, chunk_id ORDER BY score DESC, rank ASC NULLS LAST) AS copy FROM rows0) WHERE copy = 1),
list AS (SELECT run_id, method, query_id, chunk_id, score, row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, rank ASC NULLS LAST, chunk_id) AS rank FROM once)"""
_NEED = f"{_Q}, need AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, {_CLEAN.format('c')} AS chunk_id FROM (SELECT query_id, unnest(required_chunk_ids) AS c FROM q WHERE coalesce(answerable, true))) WHERE chunk_id <> '')"
_MET = _NEED + ", " + _RUNS + f""", base AS (SELECT method, query_id, count(*) AS n_relevant FROM need, (SELECT DISTINCT method FROM rows0) GROUP BY ALL),
hit AS (SELECT l.method, l.query_id, l.rank FROM list l JOIN need ON l.query_id = need.query_id AND {_CLEAN.format('l.chunk_id')} = need.chunk_id),
ks AS (SELECT unnest([1, 3, 5, 10])::BIGINT AS k),
ideal AS (SELECT m, (SELECT sum(1 / log2(i + 1)) FROM range(1, m + 1) t(i)) AS idcg FROM range(1, 11) r(m)),
met AS (SELECT b.method, b.query_id, k, n_relevant, count(*) FILTER (h.rank <= k) AS n_retrieved_relevant, round(count(*) FILTER (h.rank <= k) / n_relevant, 6) AS recall, round(count(*) FILTER (h.rank <= k) / k, 6) AS precision,
  round(coalesce(1 / min(h.rank), 0), 6) AS mrr, round(coalesce(sum(1 / log2(h.rank + 1)) FILTER (h.rank <= k), 0) / any_value(idcg), 6) AS ndcg, CASE WHEN count(*) FILTER (h.rank <= k) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit
  FROM base b CROSS JOIN ks LEFT JOIN hit h ON b.method = h.method AND b.query_id = h.query_id JOIN ideal ON m = least(n_relevant, k) GROUP BY b.method, b.query_id, k, n_relevant)"""
_MEANS = "count(*) AS n_queries, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(hit), 4) AS hit"


def _stack(source: str, attributes: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{a}' AS attribute, coalesce(nullif({a}, ''), 'unknown') AS value FROM {source}" for a in attributes)


def _fuse(k: str, by: str = "") -> str:
    return f"SELECT {by}query_id, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY {by}query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT {by}query_id, chunk_id, sum(1 / ({k} + rank)) AS s FROM c GROUP BY ALL)"


_RULES = _Q + """, kind AS (SELECT *, coalesce(reasoning_type, '') AS t, coalesce(retrieval_difficulty_factors, []) AS f FROM q),
fired AS (SELECT *, list_filter([CASE WHEN t = 'temporal' OR list_contains(f, 'temporal_reasoning') THEN 'R01' END, CASE WHEN t = 'exception' OR list_contains(f, 'exception_handling') THEN 'R02' END,
  CASE WHEN t = 'multi_hop' OR list_contains(f, 'multi_document_dependency') THEN 'R03' END, CASE WHEN list_contains(f, 'table_dependency') THEN 'R04' END, CASE WHEN t IN ('comparison', 'aggregation') THEN 'R05' END,
  CASE WHEN coalesce(category, '') IN ('System Design Documents', 'API Documentation') AND t = 'single_hop' THEN 'R06' END], lambda x: x IS NOT NULL) AS m FROM kind),
rules(rule_id, strategy, confidence) AS (VALUES ('R01', 'bm25', 0.8::DOUBLE), ('R02', 'dense', 0.85), ('R03', 'hybrid', 0.9), ('R04', 'hybrid', 0.75), ('R05', 'hybrid', 0.75), ('R06', 'dense', 0.7), ('R07', 'hybrid', 0.6)),
planned AS (SELECT query_id, strategy AS selected_strategy, CASE WHEN len(m) = 0 THEN 'R07' ELSE array_to_string(m, '|') END AS matched_rules, confidence AS planner_confidence, MAPPED AS oracle_strategy_mapped, coalesce(m[1], 'R07') AS first, reasoning_type
  FROM fired JOIN rules ON rule_id = coalesce(m[1], 'R07'))"""
_MAPPED = "CASE coalesce(nullif(planner_oracle_strategy, ''), 'hybrid') WHEN 'keyword' THEN 'bm25' WHEN 'dense' THEN 'dense' WHEN 'hierarchical' THEN 'dense' WHEN 'hybrid' THEN 'hybrid' WHEN 'table_aware' THEN 'hybrid' WHEN 'multi_hop' THEN 'hybrid' WHEN 'metadata_filtered' THEN 'hybrid' ELSE planner_oracle_strategy END"
_RULES = _RULES.replace("MAPPED AS", _MAPPED + " AS")
_COST = """count(*) AS n, round(avg(latency_s), 4) AS mean_latency_s, round(quantile_cont(latency_s, 0.5), 4) AS median_latency_s, round(coalesce(stddev_samp(latency_s), 0), 4) AS stdev_latency_s,
 sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(avg(prompt_tokens), 2) AS avg_prompt_tokens, round(sum(estimated_cost_usd), 4) AS cost_usd, round(1000 * sum(estimated_cost_usd) / count(*), 4) AS cost_per_1000_usd"""
_SCORED = _RUNS + """, s0 AS (SELECT *, max(score) OVER (PARTITION BY method, query_id) AS top FROM list WHERE rank <= 10 AND method IN ('bm25', 'dense', 'hybrid')),
s1 AS (SELECT method, query_id, chunk_id, score, rank::INTEGER AS rank, round(greatest(0, 1 - (rank - 1) * 0.1::DOUBLE), 4) AS rank_proxy, CASE WHEN top < 1e-9 THEN 0 ELSE floor(greatest(score, 0) / top * 10000 + 0.5) / 10000 END AS lexical, floor(greatest(0, least(1, score)) * 10000 + 0.5) / 10000 AS dense FROM s0),
scored AS (SELECT *, CASE method WHEN 'dense' THEN dense WHEN 'bm25' THEN lexical ELSE floor((round(lexical * 10000) + round(dense * 10000)) / 2 + 0.5) / 10000 END AS adaptive FROM s1)"""
_VERDICT = _Q + ", " + _SCORED + """, vb AS (SELECT query_id, coalesce(reasoning_type, 'unknown') AS reasoning_type, coalesce(reasoning_type = 'multi_hop' AND regexp_matches(query_text, '\\{\\w+\\}'), false) AS open_slot, method FROM q, (SELECT unnest(['bm25', 'dense', 'hybrid']) AS method)),
v0 AS (SELECT vb.method, vb.query_id, reasoning_type, open_slot, count(adaptive) AS n_chunks, count(*) FILTER (adaptive >= CASE reasoning_type WHEN 'temporal' THEN 0.20 WHEN 'exception' THEN 0.22 WHEN 'multi_hop' THEN 0.20 ELSE 0.30 END) AS n_passed, count(*) FILTER (adaptive < 0.05) AS n_zero,
  CASE reasoning_type WHEN 'temporal' THEN 'bm25' WHEN 'exception' THEN 'dense' ELSE 'hybrid' END AS suits FROM vb LEFT JOIN scored USING (method, query_id) GROUP BY ALL),
v1 AS (SELECT *, n_passed >= 3 AS passed, CASE WHEN n_passed >= 3 THEN NULL WHEN n_chunks = 0 THEN 'no_chunks' WHEN n_zero = n_chunks THEN CASE WHEN method = suits AND method = 'hybrid' THEN 'too_narrow' ELSE 'wrong_strategy' END
  WHEN open_slot THEN 'missing_entity' WHEN method <> suits AND n_zero > 0.6 * n_chunks THEN 'wrong_strategy' WHEN n_passed > 0 THEN 'insufficient_coverage' ELSE 'low_quality' END AS failure_reason FROM v0),
verdict AS (SELECT method, query_id, reasoning_type, n_chunks, n_passed, passed, failure_reason, CASE WHEN failure_reason = 'no_chunks' THEN 'hybrid' WHEN failure_reason = 'wrong_strategy' THEN CASE WHEN method <> suits THEN suits ELSE 'hybrid' END WHEN failure_reason = 'missing_entity' THEN method
  WHEN failure_reason IN ('insufficient_coverage', 'low_quality') AND method <> 'hybrid' THEN 'hybrid' END AS suggested_strategy FROM v1)"""
_LOOP = _RULES + ", " + _VERDICT.split("q AS (", 1)[1].split("WHERE copy = 1), ", 1)[1] + ", l0 AS (SELECT query_id, selected_strategy AS strategy, 0 AS loop_count FROM planned)" + "".join(
    f", l{i} AS (SELECT l.query_id, CASE WHEN coalesce(v.passed, false) THEN l.strategy ELSE coalesce(v.suggested_strategy, l.strategy) END AS strategy, l.loop_count + CASE WHEN coalesce(v.passed, false) THEN 0 ELSE 1 END AS loop_count FROM l{i - 1} l LEFT JOIN verdict v ON v.query_id = l.query_id AND v.method = l.strategy)"
    for i in (1, 2, 3)
) + ", outcome AS (SELECT l.query_id, l.strategy, l.loop_count, coalesce(v.passed, false) AS passed, CASE WHEN coalesce(v.passed, false) THEN NULL ELSE coalesce(v.failure_reason, 'no_chunks') END AS failure_reason FROM l3 l LEFT JOIN verdict v ON v.query_id = l.query_id AND v.method = l.strategy)"
_SHARES = """count(DISTINCT query_id) AS n_queries, count(*) AS n_required, count(*) FILTER (source = 'both') AS n_both, count(*) FILTER (source = 'bm25_only') AS n_bm25_only, count(*) FILTER (source = 'dense_only') AS n_dense_only,
 count(*) FILTER (source = 'hybrid_only') AS n_hybrid_only, count(*) FILTER (source = 'not_found') AS n_not_found, round(count(*) FILTER (source IN ('bm25_only', 'dense_only')) / greatest(count(*), 1), 4) AS complementarity, round(count(*) FILTER (source = 'hybrid_only') / greatest(count(*), 1), 4) AS hybrid_gain"""
_CONTRIB = _NEED + ", " + _RUNS + f""", t AS (SELECT DISTINCT query_id, {_CLEAN.format('chunk_id')} AS chunk_id, method FROM list WHERE rank <= 10 AND method IN ('bm25', 'dense', 'hybrid')),
found AS (SELECT need.query_id, need.chunk_id, coalesce(bool_or(method = 'bm25'), false) AS b, coalesce(bool_or(method = 'dense'), false) AS d, coalesce(bool_or(method = 'hybrid'), false) AS h FROM need LEFT JOIN t USING (query_id, chunk_id) GROUP BY ALL),
cls AS (SELECT query_id, chunk_id, CASE WHEN b AND d THEN 'both' WHEN b THEN 'bm25_only' WHEN d THEN 'dense_only' WHEN h THEN 'hybrid_only' ELSE 'not_found' END AS source FROM found)"""
_LEVEL = "CASE WHEN complementarity > 0.3 THEN 'high' WHEN complementarity > 0.15 THEN 'moderate' ELSE 'low' END AS complementarity_level"
_SECTIONS = _DOC + """, part AS (SELECT document_id, unnest(string_split(body, chr(10) || '#')) AS part, generate_subscripts(string_split(body, chr(10) || '#'), 1) - 1 AS section_no FROM doc WHERE body IS NOT NULL),
sized AS (SELECT *, length(part) + CASE WHEN section_no > 0 THEN 1 ELSE 0 END AS n FROM part),
sec AS (SELECT document_id, section_no, CASE WHEN section_no > 0 OR starts_with(part, '#') THEN trim(regexp_extract(part, '^#*[ \\t]*([^\\r\\n]*)', 1)) END AS heading, coalesce(sum(n + 1) OVER (PARTITION BY document_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, n FROM sized),
sect AS (SELECT document_id, section_no, heading, char_start, char_start + n AS char_end FROM sec)"""


def _percentiles(source: str, by: str, value: str, percents: str) -> str:
    return f"SELECT {by}, p AS percent, v[least((p * len(v)) // 100, len(v) - 1) + 1] AS value FROM (SELECT {by}, list({value} ORDER BY {value}) AS v FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}), (SELECT unnest({percents}) AS p)"


def _violations(name: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{r}' AS rule, count(*) AS n_rows, count(*) FILTER (NOT ({c})) AS n_violations FROM {name}" for r, c in rules.items())


def _samples(name: str, key: str, rules: dict[str, str]) -> str:
    broken = " UNION ".join(f"SELECT {key} AS record_id, '{r}' AS rule FROM {name} WHERE {key} IS NOT NULL AND NOT ({c})" for r, c in rules.items())
    return f"SELECT '{name}' AS table_name, * FROM (SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY record_id) AS place, record_id FROM ({broken})) WHERE place <= 20"


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_DENSE = f"e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), near AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.v, b.v), 6) AS score, a.label AS la, b.label AS lb FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near)"
_MERGE = _RUNS + ", c AS (SELECT * FROM list WHERE rank <= 20 AND method IN ('bm25', 'dense', 'hybrid'))"
_ERROR = """CASE WHEN prompt_version = 'zero_shot' THEN 'prompt_ambiguity' WHEN oracle_strategy_source = 'empirical_validation' THEN 'oracle_disagreement'
 WHEN reasoning_type IN ('temporal', 'exception') OR list_contains(difficulty_factors, 'temporal_reasoning') OR list_contains(difficulty_factors, 'exception_handling') THEN 'reasoning_confusion'
 WHEN list_contains(difficulty_factors, 'multi_document_dependency') OR reasoning_type = 'multi_hop' OR list_contains(difficulty_factors, 'table_dependency') THEN 'difficulty_factor_confusion'
 WHEN category IN ('System Design Documents', 'API Documentation') THEN 'category_confusion' ELSE 'oracle_disagreement' END"""
_ANSWER = _CH + ", " + _SCORED + """, ans AS (SELECT query_id, string_agg(CASE WHEN rank <= 3 THEN '[' || rank || '] ' || coalesce(substring(text, 1, 200), '') END, ' | ' ORDER BY rank) AS answer, round(avg(adaptive) FILTER (rank <= 3), 4) AS confidence, round(count(*) FILTER (rank <= 3) / count(*), 4) AS coverage
 FROM scored LEFT JOIN ch USING (chunk_id) WHERE method = 'hybrid' GROUP BY 1)"""
_MD5 = "md5(query_id || '|structured|mock_v1')"
_FOLD = "0"
for _i in range(4):
    _FOLD = f"(({_FOLD})::BIGINT * 67296 + ('0x' || substring({_MD5}, {8 * _i + 1}, 8))::BIGINT) % 100000"
_KINDS = "CASE WHEN query_text IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches(lower(query_text), {_quote(p)}) THEN '{n}'" for n, p in QUESTION_TYPES) + " ELSE 'single_hop' END"

_P4 = """
WITH refs AS (
  SELECT 'failure_analysis' AS table_name, 'required_chunk_ids' AS field_name, failure_id AS record_id, 'chunks' AS target, unnest(required_chunk_ids) AS raw, evaluated_at AS t0 FROM failure_analysis
  UNION ALL SELECT 'failure_analysis', 'retrieved_chunk_ids', failure_id, 'chunks', unnest(retrieved_chunk_ids), evaluated_at FROM failure_analysis
  UNION ALL SELECT 'enterprise_documents', 'reference_ids', document_id, 'enterprise_documents', unnest(reference_ids), updated_at FROM enterprise_documents
  UNION ALL SELECT 'chunks', 'document_id', chunk_id, 'enterprise_documents', document_id, indexed_at FROM chunks
), r AS (
  SELECT table_name, field_name, record_id, target, upper(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS key, t0, coalesce(strftime(t0 AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period
  FROM refs WHERE regexp_replace(raw, '\\s', '', 'g') <> ''
), parents AS (
  SELECT target, key, min(c) AS created_at, CASE WHEN count(d) = count(*) THEN max(d) END AS deleted_at FROM (
    SELECT 'chunks' AS target, upper(regexp_replace(chunk_id, '^\\s+|\\s+$', '', 'g')) AS key, indexed_at AS c, deleted_at AS d FROM chunks
    UNION ALL SELECT 'enterprise_documents', upper(regexp_replace(document_id, '^\\s+|\\s+$', '', 'g')), created_at, deleted_at FROM enterprise_documents
  ) WHERE key <> '' GROUP BY 1, 2
), judged AS (
  SELECT r.*, CASE WHEN p.key IS NULL THEN 'missing' WHEN p.created_at > r.t0 THEN 'late' WHEN p.deleted_at <= r.t0 THEN 'deleted' END AS reason
  FROM r LEFT JOIN parents p ON r.target = p.target AND r.key = p.key
), found AS (
  SELECT DISTINCT table_name, field_name, record_id, key AS missing_id, reason, period FROM judged WHERE reason IS NOT NULL
)
"""

_CHUNK_RULES = {
        "id_format": "regexp_matches(chunk_id, '^.+-C\\d{3}$')", "parent_is_prefix": "regexp_extract(chunk_id, '^(.*)-C', 1) = upper(trim(regexp_replace(document_id, '\\t', '', 'g')))", "offsets_ordered": "char_end > char_start",
        "text_present": "length(trim(coalesce(text, ''))) > 0", "length_matches_offsets": "length(text) = char_end - char_start", "path_present": "coalesce(len(section_path) > 0, false)"}
_DOC_RULES = {"updated_after_created": "updated_at >= created_at", "deleted_after_created": "deleted_at >= created_at", "body_present": "length(coalesce(body, '')) > 0", "title_present": "length(trim(coalesce(title, ''))) > 0"}
_QUERY_RULES = {
        "answerable_has_chunks": "NOT answerable OR len(coalesce(required_chunk_ids, [])) > 0", "unanswerable_has_none": "answerable OR (len(coalesce(required_chunk_ids, [])) = 0 AND len(coalesce(required_document_ids, [])) = 0)",
        "many_documents_flagged": "len(coalesce(required_document_ids, [])) < 2 OR coalesce(list_contains(retrieval_difficulty_factors, 'multi_document_dependency'), false)"}

SQL = {
    "token_counts": f"WITH {_POST} SELECT term, sum(tf)::BIGINT AS n_total, count(*) AS n_chunks FROM post GROUP BY 1",
    "term_stats_idf": f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_top10": f"""WITH {_IDF}, {_Q}, len AS (SELECT sum(dl) / (SELECT n FROM n) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM post)),
 asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('query_text', True)}) AS term FROM q WHERE regexp_extract(query_id, '([0-9]+)$', 1)::BIGINT % 100 = 0) GROUP BY ALL),
 s AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM post JOIN asked USING (term) JOIN idf USING (term), len GROUP BY ALL)
 SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
 UNION ALL SELECT query_id, (SELECT min(chunk_id) FROM ch), 0.0::DOUBLE, 1 FROM asked GROUP BY 1 HAVING count(*) FILTER (term IN (SELECT term FROM df)) = 0 AND (SELECT min(chunk_id) FROM ch) IS NOT NULL""",
    "dense_top10": f"WITH {_DENSE} SELECT query_id, chunk_id, score, rank FROM top WHERE rank <= 10",
    "dense_label_precision": f"WITH {_DENSE} SELECT query_id, round(avg((la = lb)::INT), 4) AS precision FROM top WHERE rank <= 10 GROUP BY 1",
    "rrf_fusion_top10": f"WITH {_RUNS}, c AS (SELECT * FROM list WHERE rank <= 100 AND method IN ('bm25', 'dense')) SELECT * FROM ({_fuse('10')}) WHERE rank <= 10",
    "rrf_sweep": f"""WITH {_NEED}, {_RUNS}, c AS (SELECT *, unnest([10, 30, 60, 100])::BIGINT AS rrf_k FROM list WHERE rank <= 100 AND method IN ('bm25', 'dense')), f AS (SELECT * FROM ({_fuse('rrf_k', 'rrf_k, ')}) WHERE rank <= 10),
 each AS (SELECT query_id, count(*) AS m, rrf_k FROM need, (SELECT unnest([10, 30, 60, 100])::BIGINT AS rrf_k) GROUP BY ALL), got AS (SELECT rrf_k, f.query_id, count(*) AS n FROM f JOIN need ON f.query_id = need.query_id AND {_CLEAN.format('f.chunk_id')} = need.chunk_id GROUP BY ALL)
 SELECT rrf_k, round(avg(coalesce(n, 0) / m), 6) AS recall FROM each LEFT JOIN got USING (rrf_k, query_id) GROUP BY 1""",
    "query_metrics_at_k": f"WITH {_MET} SELECT * FROM met",
    "macro_metrics": f"WITH {_MET} SELECT method, k, {_MEANS} FROM met GROUP BY 1, 2",
    "metrics_by_attribute": f"WITH {_MET}, x AS (SELECT met.*, category, reasoning_type, difficulty FROM met JOIN q USING (query_id)) SELECT method, k, attribute, value, {_MEANS} FROM ({_stack('x', ('category', 'reasoning_type', 'difficulty'))}) GROUP BY 1, 2, 3, 4",
    "metrics_by_factor": f"WITH {_MET}, x AS (SELECT met.*, unnest(CASE WHEN len(retrieval_difficulty_factors) > 0 THEN list_distinct(retrieval_difficulty_factors) ELSE ['none'] END) AS factor FROM met JOIN q USING (query_id)) SELECT method, k, factor, {_MEANS} FROM x GROUP BY 1, 2, 3",
    "failure_patterns": f"""WITH {_EV} SELECT method, attribute, value, count(*) AS n_total, count(*) FILTER (recall_at_k = 0) AS n_zero, count(*) FILTER (recall_at_k > 0 AND recall_at_k < 1) AS n_partial, count(*) FILTER (recall_at_k = 1) AS n_perfect,
 round(count(*) FILTER (recall_at_k = 0) / count(*), 4) AS zero_rate, round(avg(recall_at_k), 4) AS avg_recall FROM ({_stack('ev', ('category', 'reasoning_type', 'difficulty', 'oracle_strategy'))}) GROUP BY 1, 2, 3""",
    "top_failures": f"WITH {_EV} SELECT method, place, failure_id, query_id, recall_at_k, mrr, n_relevant FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY recall_at_k NULLS LAST, mrr NULLS LAST, n_relevant DESC NULLS LAST, query_id NULLS FIRST, failure_id) AS place FROM ev) WHERE place <= 20",
    "comparison_vs_baseline": f"""WITH {_EV}, s AS (SELECT coalesce(nullif(category, ''), 'unknown') AS value, avg(recall_at_k) FILTER (method = 'hybrid') AS a, coalesce(avg(recall_at_k) FILTER (method = 'bm25'), 0) AS b FROM ev GROUP BY 1)
 SELECT value, round(a, 4) AS recall, round(b, 4) AS baseline_recall, round(a - b, 4) AS delta, CASE WHEN round(a - b, 4) > 0.05 THEN 'improved' WHEN round(a - b, 4) < -0.03 THEN 'regressed' ELSE 'same' END AS verdict FROM s WHERE a IS NOT NULL""",
    "multi_method_matrix": f"WITH {_EV} " + " UNION ALL ".join(
        f"SELECT '{m}' AS measure, " + ", ".join(f"round(avg({m}) FILTER (method = '{x}'), 4) AS {x}" for x in ("bm25", "dense", "hybrid", "rule_planner", "llm_planner", "v2_oracle"))
        + ", " + ", ".join(f"round(avg({m}) FILTER (method = '{x}') - avg({m}) FILTER (method = 'hybrid'), 4) AS delta_{x}" for x in ("bm25", "dense", "rule_planner", "llm_planner", "v2_oracle")) + " FROM ev"
        for m in ("recall_at_k", "mrr", "ndcg")
    ),
    "contribution_overall": f"WITH {_CONTRIB} SELECT *, {_LEVEL} FROM (SELECT {_SHARES} FROM cls)",
    "contribution_by_category": f"WITH {_CONTRIB} SELECT *, {_LEVEL} FROM (SELECT coalesce(nullif(category, ''), 'unknown') AS category, {_SHARES} FROM cls JOIN q USING (query_id) GROUP BY 1)",
    "rule_planner_decisions": f"WITH {_RULES} SELECT query_id, selected_strategy, matched_rules, planner_confidence, oracle_strategy_mapped, selected_strategy = oracle_strategy_mapped AS is_correct FROM planned",
    "planner_confusion": f"""WITH {_DEC}, c AS (SELECT strategy, count(*) FILTER (side = 'p' AND is_correct) AS tp, count(*) FILTER (side = 'p' AND NOT is_correct) AS fp, count(*) FILTER (side = 'o' AND NOT is_correct) AS fn, count(*) FILTER (side = 'o') AS support, count(*) FILTER (side = 'p') AS predicted
 FROM (SELECT selected_strategy AS strategy, 'p' AS side, is_correct FROM d UNION ALL SELECT oracle_strategy_mapped, 'o', is_correct FROM d) WHERE strategy IN ('bm25', 'dense', 'hybrid') GROUP BY 1)
 SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""",
    "planner_grouped_distribution": f"""WITH {_DEC}, x AS (SELECT *, CASE WHEN is_correct THEN 1.0 ELSE 0.0 END AS ok FROM d) SELECT attribute, value, count(*) AS n, round(avg(ok), 4) AS accuracy, round(coalesce(avg(ok) FILTER (NOT coalesce(oracle_discrepancy, false)), 0), 4) AS accuracy_ex_discrepancy,
 count(*) FILTER (selected_strategy = 'bm25') AS n_bm25, count(*) FILTER (selected_strategy = 'dense') AS n_dense, count(*) FILTER (selected_strategy = 'hybrid') AS n_hybrid FROM ({_stack('x', ('category', 'reasoning_type', 'prompt_version', 'model'))}) GROUP BY 1, 2""",
    "rule_contributions": f"WITH {_RULES} SELECT rule_id, strategy, count(first) AS n_used, count(*) FILTER (selected_strategy = oracle_strategy_mapped) AS n_correct, round(coalesce(count(*) FILTER (selected_strategy = oracle_strategy_mapped) / nullif(count(first), 0), 0), 4) AS accuracy FROM rules LEFT JOIN planned ON first = rule_id GROUP BY 1, 2",
    "strategy_distribution": f"WITH {_DEC} SELECT selected_strategy, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM d), 1) AS percent, round(count(*) FILTER (is_correct) / count(*), 4) AS accuracy FROM d WHERE selected_strategy IN ('bm25', 'dense', 'hybrid') GROUP BY 1",
    "planner_run_assembly": f"WITH {_RULES}, {_RUNS} SELECT list.query_id, list.method, chunk_id, rank FROM list JOIN planned ON list.query_id = planned.query_id AND list.method = selected_strategy WHERE rank <= 10",
    "mock_planner_decisions": f"""WITH {_Q}, x AS (SELECT query_id, {_MAPPED} AS oracle_strategy_mapped, ({_FOLD}) / 100000 AS u FROM q), y AS (SELECT *, CASE WHEN u < 0.18 THEN CASE WHEN oracle_strategy_mapped = 'hybrid' THEN 'dense' ELSE 'hybrid' END ELSE oracle_strategy_mapped END AS selected_strategy FROM x)
 SELECT query_id, 'structured' AS prompt_version, selected_strategy, CASE WHEN u < 0.18 THEN round(0.5 + u * 0.25, 2) ELSE least(0.98, round(0.72 + (1 - u) * 0.28, 2)) END AS planner_confidence, oracle_strategy_mapped, selected_strategy = oracle_strategy_mapped AS is_correct FROM y""",
    "llm_cost_analysis": f"WITH {_DEC} SELECT model, {_COST} FROM d GROUP BY 1",
    "llm_latency_p95": f"WITH {_DEC} " + _percentiles("d", "model", "latency_s", "[50, 95]"),
    "llm_error_categories": f"WITH {_DEC} SELECT {_ERROR} AS error, coalesce(nullif(reasoning_type, ''), 'unknown') AS reasoning_type, count(*) AS n FROM d WHERE NOT is_correct GROUP BY 1, 2",
    "prompt_comparison": f"WITH {_DEC} SELECT prompt_version, {_COST} FROM d GROUP BY 1",
    "pilot_summary": f"""WITH {_DEC} SELECT prompt_version, model, count(*) AS n, round(avg(CASE WHEN parse_success THEN 1.0 ELSE 0.0 END), 4) AS parse_rate, round(avg(CASE WHEN fallback_used THEN 1.0 ELSE 0.0 END), 4) AS fallback_rate,
 round(avg(parse_attempts), 4) AS avg_attempts, min(latency_s) AS min_latency_s, max(latency_s) AS max_latency_s FROM d GROUP BY 1, 2""",
    "heuristic_classify": f"WITH {_Q} SELECT {_KINDS} AS by_wording, coalesce(nullif(reasoning_type, ''), 'unknown') AS reasoning_type, count(*) AS n FROM q GROUP BY 1, 2",
    "validation_scores": f"WITH {_SCORED} SELECT * FROM scored",
    "validation_decisions": f"WITH {_VERDICT} SELECT * FROM verdict",
    "loop_outcome": f"WITH {_LOOP} SELECT * FROM outcome",
    "pipeline_stats": f"""WITH {_LOOP}, x AS (SELECT outcome.*, coalesce(reasoning_type, 'unknown') AS reasoning_type FROM outcome JOIN q USING (query_id)), r AS (SELECT reasoning_type, failure_reason, count(*) AS n FROM x WHERE NOT passed AND failure_reason IS NOT NULL GROUP BY ALL),
 t AS (SELECT reasoning_type, failure_reason AS top_failure_reason FROM (SELECT *, row_number() OVER (PARTITION BY reasoning_type ORDER BY n DESC, failure_reason) AS place FROM r) WHERE place = 1)
 SELECT * FROM (SELECT reasoning_type, count(*) AS n_queries, round(avg(passed::INT), 4) AS pass_rate, round(avg(loop_count), 3) AS mean_loops FROM x GROUP BY 1) LEFT JOIN t USING (reasoning_type)""",
    "dedup_keep_max_rerank": f"WITH {_MERGE} SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, chunk_id) AS rank FROM (SELECT query_id, chunk_id, score, rank AS old, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, rank) AS copy FROM c) WHERE copy = 1) WHERE rank <= 10",
    "dedup_keep_best_rank": f"WITH {_MERGE} SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, chunk_id) AS rank FROM (SELECT query_id, chunk_id, score, rank AS old, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, score DESC) AS copy FROM c) WHERE copy = 1) WHERE rank <= 10",
    "extractive_answers": f"WITH {_ANSWER} SELECT * FROM ans",
    "citation_extract": f"WITH {_ANSWER} SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,6}})\\]', 1), lambda n: n::INT), lambda n: n BETWEEN 1 AND 3))), ',') AS cited FROM ans",
    "slot_fill": f"WITH {_Q} SELECT query_id, array_to_string(s, ',') AS slots, replace(query_text, '{{id}}', coalesce(required_document_ids[1], '?')) AS filled FROM (SELECT *, list_distinct(regexp_extract_all(query_text, '\\{{(\\w+)\\}}', 1)) AS s FROM q) WHERE len(s) > 0",
    "plan_json_parse": f"""WITH {_DEC}, j AS (SELECT selected_strategy, nullif(regexp_extract(raw_response, '(?s)\\{{.*\\}}', 0), '') AS j FROM d), p AS (SELECT selected_strategy, CASE WHEN json_valid(j) THEN lower(trim(j ->> 'selected_strategy')) END AS s, CASE WHEN json_valid(j) THEN greatest(0, least(1, try_cast(j ->> 'confidence' AS DOUBLE))) END AS c FROM j)
 SELECT CASE WHEN s IN ('bm25', 'dense', 'hybrid') THEN s ELSE 'none' END AS strategy, count(*) AS n, round(avg(c) FILTER (s IN ('bm25', 'dense', 'hybrid')), 4) AS avg_confidence, count(*) FILTER (s = selected_strategy) AS n_as_recorded FROM p GROUP BY 1""",
    "evidence_spans": f"WITH {_CH}, {_DOC}, x AS (SELECT chunk_id, CASE WHEN text <> '' THEN nullif(strpos(body, text), 0) - 1 END AS found_at, char_start::BIGINT AS char_start FROM ch LEFT JOIN doc ON ch.document_id = doc.document_id) SELECT *, coalesce(found_at = char_start, false) AS as_recorded FROM x",
    "document_sections": f"WITH {_SECTIONS} SELECT * FROM sect",
    "section_of_offset": f"WITH {_CH}, {_SECTIONS} SELECT chunk_id AS point_id, ch.char_start::BIGINT AS at, min(section_no) AS section_no FROM ch LEFT JOIN sect s ON ch.document_id = s.document_id AND s.char_start <= ch.char_start AND ch.char_start < s.char_end WHERE ch.char_start IS NOT NULL AND ch.document_id IS NOT NULL GROUP BY 1, 2".replace(" AS at,", ' AS "at",'),
    "asof_chunk_of_section": f"""WITH {_CH}, {_SECTIONS}, m AS (SELECT document_id, char_start AS a, min(chunk_id) AS id FROM ch WHERE char_start IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2)
 SELECT s.document_id || '#' || s.section_no AS point_id, s.char_start AS "at", coalesce((SELECT arg_max(id, a) FROM m WHERE m.document_id = s.document_id AND a <= s.char_start), (SELECT arg_min(id, a) FROM m WHERE m.document_id = s.document_id)) AS mark_id FROM sect s""",
    "chunk_statistics": f"""WITH {_CH}, t AS (SELECT *, greatest(1, length(coalesce(text, '')) // 4) AS t FROM ch), g AS (SELECT category, chunk_strategy, document_id, count(*) AS n, sum(t) AS s, min(t) AS lo, max(t) AS hi, count(*) FILTER (contains(text, '| --- |')) AS n_table FROM t GROUP BY ALL)
 SELECT category, chunk_strategy, sum(n)::BIGINT AS n_chunks, count(*) AS n_documents, sum(n_table)::BIGINT AS n_table_chunks, round(sum(s) / sum(n), 4) AS avg_tokens, min(lo)::INT AS min_tokens, max(hi)::INT AS max_tokens, round(avg(n), 4) AS avg_chunks_per_document, max(n) AS max_chunks_per_document FROM g GROUP BY 1, 2""",
    "chunk_token_percentiles": f"WITH {_CH}, t AS (SELECT category, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS t FROM ch) " + _percentiles("t", "category", "t", "[25, 50, 75, 90, 95]::BIGINT[]"),
    "dq_violations": _violations("chunks", _CHUNK_RULES) + " UNION ALL " + _violations("enterprise_documents", _DOC_RULES) + " UNION ALL " + _violations("queries", _QUERY_RULES),
    "dq_duplicates": " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k}::VARCHAR AS record_id, count(*) - 1 AS n_extra FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1" for t, k in (("chunks", "chunk_id"), ("enterprise_documents", "document_id"), ("queries", "query_id"), ("failure_analysis", "failure_id"), ("pilot_decisions", "decision_id"))),
    "first_last_event": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_value, arg_max(event_type, (ts, event_id)) AS last_value, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1",
    "first_two_documents": f"WITH {_DOC} SELECT category, place, document_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY created_at NULLS FIRST, document_id) AS place FROM doc WHERE title IS NOT NULL AND category IS NOT NULL) WHERE place <= 2",
    "references_of_meetings": f"""WITH {_DOC}, r AS (SELECT document_id AS meeting_id, {_CLEAN.format('r')} AS document_id FROM (SELECT document_id, unnest(list_distinct(reference_ids)) AS r FROM doc WHERE category = 'Project Meeting Notes'))
 SELECT doc.category AS target_category, count(*) AS n_references, count(DISTINCT meeting_id) AS n_meetings FROM r JOIN doc ON r.document_id = doc.document_id WHERE doc.deleted_at IS NULL GROUP BY 1""",
    "label_rebalance": f"""WITH {_Q}, l AS (SELECT query_id, planner_oracle_strategy AS label FROM q WHERE planner_oracle_strategy IS NOT NULL AND coalesce(answerable, true)), n AS (SELECT label, count(*) AS n FROM l WHERE label IN ('keyword', 'dense', 'hybrid', 'table_aware', 'multi_hop', 'metadata_filtered') GROUP BY 1), total AS (SELECT sum(n) AS total FROM n),
 c AS (SELECT total, coalesce(max(n) FILTER (label = 'keyword'), 0) AS k, coalesce(max(n) FILTER (label = 'dense'), 0) AS d, coalesce(max(n) FILTER (label = 'hybrid'), 0) AS h, coalesce(max(n) FILTER (label = 'table_aware'), 0) AS t, coalesce(max(n) FILTER (label = 'metadata_filtered'), 0) AS m FROM n, total GROUP BY 1),
 m1 AS (SELECT *, greatest(0, least(k - floor(0.20::DOUBLE * total), floor(0.24::DOUBLE * total) - h)) AS a, greatest(0, least(t - floor(0.12::DOUBLE * total), floor(0.12::DOUBLE * total) - m)) AS b FROM c),
 m2 AS (SELECT *, greatest(0, least(d - floor(0.20::DOUBLE * total), floor(0.24::DOUBLE * total) - h - a)) AS e FROM m1),
 move AS (SELECT 'keyword' AS giver, 'hybrid' AS taker, a AS m FROM m2 UNION ALL SELECT 'table_aware', 'metadata_filtered', b FROM m2 UNION ALL SELECT 'dense', 'hybrid', e FROM m2),
 o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || query_id), query_id) AS place FROM l)
 SELECT label, CASE WHEN place <= m THEN taker ELSE label END AS new_label, count(*) AS n FROM o LEFT JOIN move ON giver = label GROUP BY 1, 2""",
    "oracle_validation": f"""WITH {_EV}, m AS (SELECT coalesce(nullif(reasoning_type, ''), 'unknown') AS value, method, round(avg(recall_at_k), 4) AS recall, count(*) AS n FROM ev GROUP BY 1, 2),
 o AS (SELECT *, row_number() OVER w AS place, round(recall - lead(recall) OVER w, 4) AS lead_over_next FROM m WINDOW w AS (PARTITION BY value ORDER BY recall DESC NULLS LAST, method)) SELECT value, method AS best_method, recall, n, lead_over_next FROM o WHERE place = 1""",
    "table_rows": f"""WITH {_CH}, ln AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM ch WHERE contains(text, '|')), tr AS (SELECT chunk_id, line_no, trim(replace(line, chr(13), '')) AS line FROM ln),
 r AS (SELECT *, regexp_matches(line, '^[|]([ ]*:?-+:?[ ]*[|])+$') AS sep FROM tr WHERE regexp_matches(line, '^[|].*[|]$')),
 h AS (SELECT *, coalesce(lead(sep) OVER w AND lead(line_no) OVER w = line_no + 1, false) AS is_header FROM r WINDOW w AS (PARTITION BY chunk_id ORDER BY line_no)),
 c AS (SELECT chunk_id, line_no, list_transform(string_split(substring(line, 2, length(line) - 2), '|'), lambda x: trim(x)) AS cells, is_header FROM h WHERE NOT sep),
 f AS (SELECT *, last_value(CASE WHEN is_header THEN len(cells) END IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS width FROM c)
 SELECT chunk_id, line_no, array_to_string(CASE WHEN width IS NULL THEN cells ELSE list_resize(cells, width, '') END, '|') AS cells, is_header, width FROM f""",
    "repeated_projects": "SELECT project_code, count(*) AS n_records, sum(length(text))::BIGINT AS n_chars, strftime(min(collected_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS first_day, strftime(max(collected_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS last_day FROM documents WHERE translate(lower(regexp_replace(source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '- ', '__') = 'meeting_archive' AND project_code IS NOT NULL GROUP BY 1 HAVING count(*) >= 3",
    "label_counts": f"WITH {_Q} SELECT attribute, value, count(*) AS n FROM (" + _stack("q", ("category", "reasoning_type", "difficulty", "planner_oracle_strategy", "lang")) + ") GROUP BY 1, 2",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_counts": _P4 + """
, n AS (SELECT table_name, field_name, period, reason, count(*) AS n_orphans, count(DISTINCT missing_id) AS n_missing_ids FROM found GROUP BY ALL),
t AS (SELECT table_name, field_name, period, count(*) AS n_references FROM (SELECT DISTINCT table_name, field_name, record_id, key, period FROM r) GROUP BY ALL)
SELECT n.table_name, n.field_name, n.period, reason, n_orphans, n_missing_ids, n_references, round(n_orphans / n_references, 6) AS orphan_share
FROM n JOIN t ON n.table_name = t.table_name AND n.field_name = t.field_name AND n.period = t.period
""",
}

_KNOWN = "coalesce(nullif({0}, ''), 'unknown')"
_KINDQ = f"kq AS (SELECT query_id, {_KNOWN.format('category')} AS category, {_KNOWN.format('reasoning_type')} AS reasoning_type FROM q)"
_PCT = ", ".join(f"round(100 * n_{c} / greatest(n_required, 1), 1) AS pct_{c}" for c in ("both", "bm25_only", "dense_only", "hybrid_only", "not_found"))
_RATES = "round(avg(CASE WHEN parse_success THEN 1.0 ELSE 0.0 END), 4) AS parse_rate, round(avg(CASE WHEN fallback_used THEN 1.0 ELSE 0.0 END), 4) AS fallback_rate, round(avg(parse_attempts), 4) AS avg_attempts, min(latency_s) AS min_latency_s, max(latency_s) AS max_latency_s"


def _shares_of(source: str, label: str, attributes: tuple[str, ...]) -> str:
    stacked = f"SELECT *, 'all' AS attribute, 'all' AS value FROM {source} UNION ALL " + _stack(source, attributes)
    return f"SELECT *, round(100 * n / sum(n) OVER (PARTITION BY attribute, value), 1) AS percent, row_number() OVER (PARTITION BY attribute, value ORDER BY n DESC, {label}) AS place FROM (SELECT attribute, value, {label}, count(*) AS n FROM ({stacked}) GROUP BY ALL)"


def _quality(s: str) -> str:
    tp, fp, fn = (f"count(*) FILTER ({c})" for c in (f"selected_strategy = '{s}' AND is_correct", f"selected_strategy = '{s}' AND NOT coalesce(is_correct, false)", f"oracle_strategy_mapped = '{s}' AND NOT coalesce(is_correct, false)"))
    return f"round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 4) AS precision_{s}, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 4) AS recall_{s}, round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 4) AS f1_{s}"


def _experiment(name: str, sql: str) -> str:
    counts = ", ".join(f"count(*) FILTER (loop_count = {i}) AS n_loops_{i}" for i in range(4))
    return f"SELECT '{name}' AS config, * FROM (WITH {sql} SELECT count(*) AS n_queries, round(avg(passed::INT), 4) AS pass_rate, round(avg(loop_count), 3) AS mean_loops, {counts} FROM outcome)"


def _plain(sql: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        assert sql.count(a) >= 1, a
        sql = sql.replace(a, b)
    return sql


_TOLD = _LOOP.replace(_Q, _Q.replace("q AS (", "q0 AS (", 1) + f", q AS (SELECT * REPLACE ({_KINDS} AS reasoning_type) FROM q0)", 1)
_SWEEP = SQL["rrf_sweep"]
_LISTED = "list_sort(list_distinct(list_filter(list_transform(coalesce({0}, []), lambda x: " + _CLEAN.format("x") + "), lambda x: x <> '')))"
_META = ("title", "doc_version", "region", "status", "department", "document_owner", "confidentiality", "effective_date", "source_path")

SQL |= {
    "contribution_report": f"WITH {_CONTRIB}, {_KINDQ}, x AS (SELECT cls.*, category, reasoning_type FROM cls JOIN kq USING (query_id)) SELECT *, {_PCT}, {_LEVEL}, CASE WHEN hybrid_gain > 0.05 THEN 'significant' ELSE 'small' END AS hybrid_gain_level FROM (SELECT attribute, value, {_SHARES} FROM ({_stack('x', ('category', 'reasoning_type'))}) GROUP BY 1, 2)",
    "prompt_quality": f"WITH {_DEC} SELECT prompt_version, count(*) AS n, round(avg(coalesce(is_correct, false)::INT), 4) AS accuracy, count(*) FILTER (NOT coalesce(parse_success, false)) AS n_parse_failures, {', '.join(map(_quality, ('bm25', 'dense', 'hybrid')))} FROM d GROUP BY 1",
    "pilot_report": f"WITH {_DEC} SELECT prompt_version, model, count(*) AS n, {_RATES}, count(*) FILTER (NOT coalesce(parse_success, false)) AS n_failed, round(avg(latency_s), 4) AS mean_latency_s, round(quantile_cont(latency_s, 0.5), 4) AS median_latency_s, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum(estimated_cost_usd), 4) AS cost_usd FROM d GROUP BY 1, 2",
    "pilot_samples": f"WITH {_DEC} SELECT prompt_version, place, decision_id, query_id, selected_strategy, is_correct FROM (SELECT *, row_number() OVER (PARTITION BY prompt_version ORDER BY decision_id) AS place FROM d WHERE prompt_version IS NOT NULL) WHERE place <= 5",
    "error_report": f"WITH {_DEC}, x AS (SELECT {_ERROR} AS error, reasoning_type, category FROM d WHERE NOT is_correct) {_shares_of('x', 'error', ('reasoning_type', 'category'))}",
    "notable_changes": f"WITH {_EV}, s AS (SELECT attribute, value, avg(recall_at_k) FILTER (method = 'hybrid') AS a, coalesce(avg(recall_at_k) FILTER (method = 'bm25'), 0) AS b FROM ({_stack('ev', ('category', 'reasoning_type', 'difficulty'))}) GROUP BY 1, 2), v AS (SELECT attribute, value, CASE WHEN round(a - b, 4) > 0.05 THEN 'improved' WHEN round(a - b, 4) < -0.03 THEN 'regressed' END AS verdict, round(a, 4) AS recall, round(b, 4) AS baseline_recall, round(a - b, 4) AS delta FROM s WHERE a IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY attribute, verdict ORDER BY abs(delta) DESC, value) AS place FROM v WHERE verdict IS NOT NULL",
    "reasoning_type_union": f"WITH {_EV}, a AS (SELECT {_KNOWN.format('reasoning_type')} AS reasoning_type, round(avg(recall_at_k), 4) AS a FROM ev WHERE method = 'v2_oracle' GROUP BY 1), b AS (SELECT {_KNOWN.format('reasoning_type')} AS reasoning_type, round(avg(recall_at_k), 4) AS b FROM ev WHERE method = 'hybrid' GROUP BY 1) SELECT reasoning_type, a, b, round(a - b, 4) AS delta FROM a FULL JOIN b USING (reasoning_type)",
    "missed_chunks": f"WITH {_EV}, m AS (SELECT failure_id, method, list_filter({_LISTED.format('required_chunk_ids')}, lambda x: NOT list_contains({_LISTED.format('retrieved_chunk_ids').replace('x:', 'y:').replace('upper(regexp_replace(x', 'upper(regexp_replace(y').replace('y: x <>', 'y: y <>')}, x)) AS m FROM ev) SELECT failure_id, method, array_to_string(m, '|') AS missed, len(m)::BIGINT AS n_missed FROM m",
    "rrf_best_run": f"WITH best AS (SELECT rrf_k FROM ({_SWEEP}) ORDER BY recall DESC, rrf_k LIMIT 1), {_RUNS}, c AS (SELECT list.*, rrf_k FROM list, best WHERE rank <= 100 AND method IN ('bm25', 'dense')) SELECT * FROM ({_fuse('rrf_k', 'rrf_k, ')}) WHERE rank <= 10",
    "pipeline_loops": f"WITH {_LOOP}, {_KINDQ}, x AS (SELECT outcome.*, kq.reasoning_type FROM outcome JOIN kq USING (query_id)) SELECT attribute, value, loop_count::BIGINT AS loop_count, count(*) AS n_queries, count(*) FILTER (passed) AS n_passed FROM (SELECT *, 'all' AS attribute, 'all' AS value FROM x UNION ALL {_stack('x', ('reasoning_type',))}) GROUP BY 1, 2, 3",
    "pipeline_reasons": f"WITH {_LOOP}, {_KINDQ}, x AS (SELECT outcome.*, kq.reasoning_type FROM outcome JOIN kq USING (query_id) WHERE NOT passed AND failure_reason IS NOT NULL) SELECT * FROM ({_shares_of('x', 'failure_reason', ('reasoning_type',))}) WHERE place <= 5",
    "pipeline_experiments": " UNION ALL ".join((
        _experiment("v2_oracle", _LOOP), _experiment("v2_oracle_noloop", _plain(_LOOP, ("FROM l3 l", "FROM l0 l"))),
        _experiment("v2_oracle_rankproxy", _plain(_LOOP, ("count(adaptive)", "count(rank_proxy)"), ("(adaptive >=", "(rank_proxy >="), ("(adaptive <", "(rank_proxy <"))), _experiment("v2_heuristic", _TOLD))),
    "rescored_validation": f"""WITH {_IDF}, {_Q}, {_SCORED}, len AS (SELECT sum(dl) / (SELECT n FROM n) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM post)),
 asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('query_text', True)}) AS term FROM q WHERE regexp_extract(query_id, '([0-9]+)$', 1)::BIGINT % 100 = 0) GROUP BY ALL),
 b AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25 FROM post JOIN asked USING (term) JOIN idf USING (term), len GROUP BY ALL),
 t AS (SELECT query_id, max(bm25) AS top FROM b GROUP BY 1),
 y AS (SELECT scored.method, scored.query_id, scored.chunk_id, rank, dense, CASE WHEN top >= 1e-9 THEN floor(coalesce(bm25, 0) / top * 10000 + 0.5) / 10000 ELSE 0 END AS lexical FROM scored LEFT JOIN b ON b.query_id = scored.query_id AND b.chunk_id = scored.chunk_id LEFT JOIN t ON t.query_id = scored.query_id
   WHERE scored.query_id IN (SELECT query_id FROM q WHERE regexp_extract(query_id, '([0-9]+)$', 1)::BIGINT % 100 = 0))
 SELECT *, CASE method WHEN 'dense' THEN dense WHEN 'bm25' THEN lexical ELSE floor((round(lexical * 10000) + round(dense * 10000)) / 2 + 0.5) / 10000 END AS adaptive FROM y""",
    "complete_answers": f"WITH {_ANSWER}, {_Q} SELECT q.query_id, coalesce(answer, 'No relevant evidence was found to answer this question.') AS answer, coalesce(confidence, 0) AS confidence, coalesce(coverage, 0) AS coverage FROM q LEFT JOIN ans ON q.query_id = ans.query_id",
    "slot_fill_from_runs": f"WITH {_Q}, {_CH}, {_RUNS}, best AS (SELECT query_id, arg_min(document_id, (rank, list.chunk_id)) FILTER (document_id IS NOT NULL) AS value FROM list JOIN ch ON list.chunk_id = ch.chunk_id WHERE rank <= 3 AND method = 'hybrid' GROUP BY 1) SELECT q.query_id, replace(query_text, '{{id}}', coalesce(value, '{{id}}')) AS query_text FROM q LEFT JOIN best ON q.query_id = best.query_id WHERE query_text LIKE '%{{id}}%'",
    "merged_retrieval": f"""WITH {_RULES}, {_RUNS}, c AS (SELECT list.* FROM list JOIN q ON list.query_id = q.query_id WHERE rank <= 10 AND method IN ('bm25', 'dense', 'hybrid') AND reasoning_type = 'aggregation'),
 m AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, chunk_id) AS rank FROM (SELECT query_id, chunk_id, score, rank AS old, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, score DESC) AS copy FROM c) WHERE copy = 1)
 SELECT *, 'merged' AS mode FROM m WHERE rank <= 10 UNION ALL SELECT list.query_id, chunk_id, rank, 'independent' FROM list JOIN planned ON list.query_id = planned.query_id AND list.method = selected_strategy WHERE rank <= 10 AND reasoning_type IS DISTINCT FROM 'aggregation'""",
    "response_cache_hits": f"WITH {_DEC}, k AS (SELECT *, translate(query_id || '__' || model || '__' || prompt_version, '/: ', '___') AS key FROM d WHERE query_id IS NOT NULL AND model IS NOT NULL AND prompt_version IS NOT NULL), q0 AS (SELECT DISTINCT query_id, model, prompt_version, key FROM k) SELECT model, count(*) AS n_requests, count(*) FILTER (key IN (SELECT key FROM k WHERE parse_success AND raw_response IS NOT NULL)) AS n_hits FROM q0 GROUP BY 1",
    "seeded_sample": f"WITH {_Q} SELECT query_id, category, row_number() OVER (ORDER BY md5('42|' || query_id), query_id) AS place FROM q QUALIFY place <= 100",
    "query_sequence": f"WITH {_NEED} SELECT query_id, 'Q-' || lpad(row_number() OVER (ORDER BY md5('42|' || query_id), query_id)::VARCHAR, 9, '0') AS new_id FROM (SELECT DISTINCT query_id FROM need)",
    "inherited_metadata": f"WITH {_CH}, {_DOC}, x AS (SELECT chunk_id, doc.* EXCLUDE (document_id) FROM ch LEFT JOIN doc ON ch.document_id = doc.document_id) SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in _META) + "], lambda v: v IS NOT NULL), '|') AS missing, count(*) AS n_chunks FROM x GROUP BY 1",
    "dependency_order": f"WITH {_DOC}, r AS (SELECT DISTINCT document_id FROM (SELECT document_id, {_CLEAN.format('r')} AS key FROM (SELECT document_id, unnest(reference_ids) AS r FROM doc)) WHERE key IN (SELECT document_id FROM doc WHERE deleted_at IS NULL)) SELECT category, CASE WHEN document_id IN (SELECT document_id FROM r) THEN 1::BIGINT ELSE 0 END AS level, count(*) AS n_documents FROM doc GROUP BY 1, 2",
    "deprecated_replacements": f"WITH {_DOC}, p AS (SELECT document_id, translate(lower(regexp_replace(status, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '- ', '__') AS status, category, department, deleted_at FROM doc), f AS (SELECT category, department, min(document_id) AS replacement FROM p WHERE status = 'active' AND deleted_at IS NULL GROUP BY 1, 2) SELECT document_id, replacement FROM p LEFT JOIN f ON p.category = f.category AND p.department = f.department WHERE status = 'deprecated'",
    "first_document_pairs": f"""WITH {_DOC}, o AS (SELECT category || '/' || department AS family, document_id, row_number() OVER (PARTITION BY category || '/' || department ORDER BY created_at NULLS FIRST, document_id) AS place FROM doc WHERE category IS NOT NULL AND department IS NOT NULL)
 SELECT family, max(document_id) FILTER (place = 1) AS "first", max(document_id) FILTER (place = 2) AS "second" FROM o WHERE place <= 2 GROUP BY 1 HAVING count(*) = 2""",
    "last_chunk_at_section": f"WITH {_CH}, {_SECTIONS}, h AS (SELECT s.document_id, section_no, arg_max(ch.chunk_id, (ch.char_start, ch.chunk_id)) AS chunk_id FROM sect s LEFT JOIN ch ON ch.document_id = s.document_id AND ch.char_start <= s.char_start AND s.char_start < ch.char_end GROUP BY 1, 2) SELECT * FROM h",
    "evidence_chunks": f"""WITH {_CH}, {_DOC}, p AS (SELECT chunk_id AS point_id, ch.document_id, strpos(body, text) - 1 AS "at" FROM ch JOIN doc ON ch.document_id = doc.document_id WHERE text <> '' AND strpos(body, text) > 0),
 m AS (SELECT document_id, char_start AS a, min(chunk_id) AS id FROM ch WHERE char_start IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2)
 SELECT point_id, "at", coalesce((SELECT arg_min(chunk_id, (char_start, chunk_id)) FROM ch WHERE ch.document_id = p.document_id AND char_start <= p."at" AND p."at" < char_end), (SELECT arg_max(id, a) FROM m WHERE m.document_id = p.document_id AND a <= p."at"), (SELECT arg_min(id, a) FROM m WHERE m.document_id = p.document_id)) AS chunk_id FROM p""",
    "dq_samples": _samples("chunks", "chunk_id", _CHUNK_RULES) + " UNION ALL " + _samples("enterprise_documents", "document_id", _DOC_RULES) + " UNION ALL " + _samples("queries", "query_id", _QUERY_RULES),
    "query_analysis": f"WITH {_Q} SELECT query_id, {_KINDS} AS by_wording, array_to_string(list_filter([CASE WHEN regexp_matches(lower(query_text), {_quote(QUESTION_TYPES[0][1])}) THEN 'temporal_reasoning' END, CASE WHEN regexp_matches(lower(query_text), {_quote(QUESTION_TYPES[1][1])}) THEN 'exception_handling' END], lambda x: x IS NOT NULL), '|') AS signals, 0.6::DOUBLE AS confidence FROM q",
    "planner_sources": f"WITH {_LOOP}, {_DEC}, s AS (SELECT query_id, arg_max(selected_strategy, decision_id) AS second FROM d WHERE query_id IS NOT NULL AND selected_strategy IS NOT NULL GROUP BY 1), v AS (SELECT query_id, suggested_strategy FROM verdict WHERE method = 'hybrid') SELECT CASE WHEN suggested_strategy IS NOT NULL THEN 'validation_override' WHEN planner_confidence < 0.75 AND second IS NOT NULL THEN 'llm' ELSE 'rule' END AS source, coalesce(suggested_strategy, CASE WHEN planner_confidence < 0.75 THEN second END, selected_strategy) AS strategy, count(*) AS n_queries FROM planned LEFT JOIN v ON planned.query_id = v.query_id LEFT JOIN s ON planned.query_id = s.query_id GROUP BY 1, 2",
    "fixed_windows": f"""WITH RECURSIVE {_DOC}, w AS (
  SELECT document_id, body, length(body) AS n, 0::BIGINT AS a, 0::BIGINT AS e, 0::BIGINT AS f FROM doc WHERE body IS NOT NULL
  UNION ALL
  SELECT document_id, body, n, a, e, CASE WHEN NOT regexp_matches(substring(body, a + 1, e - a), '[^\\s\\p{{Z}}]') THEN e WHEN e = n THEN n ELSE CASE WHEN j > 0 THEN greatest(g - 2, 0) + j + 1 ELSE g END END AS f FROM (
    SELECT *, greatest(a + 1, e - 200) AS g, strpos(substring(body, greatest(greatest(a + 1, e - 200) - 2, 0) + 1, e - 1 - greatest(greatest(a + 1, e - 200) - 2, 0)), chr(10) || chr(10)) AS j FROM (
      SELECT document_id, body, n, f AS a, CASE WHEN f + 1600 >= n THEN n WHEN strpos(reverse(substring(body, f + 1, 1600)), chr(10) || chr(10)) > 0 THEN f + 1600 - strpos(reverse(substring(body, f + 1, 1600)), chr(10) || chr(10)) + 1 ELSE f + 1600 END AS e
      FROM w WHERE f < n AND (e < n OR n = 0)))
), k AS (SELECT document_id, body, n, a, e FROM w WHERE e > 0 AND regexp_matches(substring(body, a + 1, e - a), '[^\\s\\p{{Z}}]')),
 o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY a) AS i, lead(e) OVER v AS next_e, lead(a) OVER v AS next_a FROM k WINDOW v AS (PARTITION BY document_id ORDER BY a))
 SELECT document_id || '-C' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END AS chunk_id, a::INTEGER AS char_start, (CASE WHEN next_e = n AND next_e - next_a < 80 THEN n ELSE e END)::INTEGER AS char_end FROM o WHERE NOT (e = n AND e - a < 80 AND i > 1)""",
}

# The same over every run: the text of each query once per round, for the runs of that round.
_LAST = _RUNS.split(",\nrows0", 1)[0]


def _each_round(sql: str, methods: tuple[str, ...] | None = None) -> str:
    assert sql.count(_LAST) == 1
    some = "" if methods is None else " AND method IN (" + ", ".join(map(_quote, methods)) + ")"
    turn = f"turn AS (SELECT method, run_id, row_number() OVER (PARTITION BY method ORDER BY max(run_at) DESC NULLS LAST, run_id DESC) AS round FROM retrieval_results WHERE method IS NOT NULL AND run_id IS NOT NULL{some} GROUP BY 1, 2)"
    inner = sql.replace(_LAST, "last AS (SELECT method, run_id FROM turn WHERE turn.round = every.round)")
    return f"WITH {turn}, every AS (SELECT DISTINCT round FROM turn) SELECT every.round, x.* FROM every, LATERAL ({inner}) x"


SQL["run_rounds"] = "SELECT method, run_id, row_number() OVER (PARTITION BY method ORDER BY max(run_at) DESC NULLS LAST, run_id DESC) AS round FROM retrieval_results WHERE method IS NOT NULL AND run_id IS NOT NULL GROUP BY 1, 2"
SQL |= {
    f"{new}_rounds": _each_round(SQL[old], methods)
    for methods, names in (
        (None, {"query_metrics": "query_metrics_at_k"} | {n: n for n in ("macro_metrics", "metrics_by_attribute", "metrics_by_factor")}),
        (("bm25", "dense"), {"rrf_fusion": "rrf_fusion_top10", "rrf_sweep": "rrf_sweep"}),
        (("bm25", "dense", "hybrid"), {n: n for n in ("contribution_overall", "contribution_by_category", "planner_run_assembly", "validation_scores", "validation_decisions", "loop_outcome", "pipeline_stats", "dedup_keep_max_rerank", "dedup_keep_best_rank", "extractive_answers", "citation_extract")}),
    )
    for new, old in names.items()
}
