"""The registered queries of the core operators.

Searches take as queries all rows whose number is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, chunking, constraints, dense, evidence, fusion, metrics, planning, search, sparse, tables, validation
from ..operators import references as refs
from ..session import staged
from ..sources.tables import cache_key, cache_lookup, table
from ..sources.tables import inherited_metadata as inherited

RUN_METHODS = ("bm25", "dense", "hybrid")
EVALUATED = ("bm25", "dense", "hybrid", "rule_planner", "llm_planner", "v2_oracle")


def _chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return metrics.one_per_key(table(spark, folder, "chunks"), "chunk_id", *columns)


def _docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return metrics.one_per_key(table(spark, folder, "enterprise_documents"), "document_id", *columns)


def _queries(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return metrics.one_per_key(table(spark, folder, "queries"), "query_id", *columns)


def _decisions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return metrics.one_per_key(table(spark, folder, "pilot_decisions"), "decision_id", *columns)


def _evaluated(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return metrics.one_per_key(table(spark, folder, "failure_analysis"), "failure_id", *columns)


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.latest_runs(table(spark, folder, "retrieval_results"))


def _lists(spark: SparkSession, folder: str, k: int, methods: tuple[str, ...] = RUN_METHODS) -> DataFrame:
    return fusion.top_lists(_latest(spark, folder).where(F.col("method").isin(*methods)), k)


def _rounds(spark: SparkSession, folder: str, methods: tuple[str, ...] | None = None) -> DataFrame:
    """All runs by rounds; a table of one row per run."""
    return staged(fusion.run_rounds(table(spark, folder, "retrieval_results"), methods), "rounds")


def _all_lists(spark: SparkSession, folder: str, k: int, rounds: DataFrame) -> DataFrame:
    """The lists of every run in rounds, with round."""
    runs = table(spark, folder, "retrieval_results").join(F.broadcast(rounds), ["method", "run_id"], "left_semi")
    return fusion.top_lists(runs, k).join(F.broadcast(rounds), ["method", "run_id"])


def _references(spark: SparkSession, folder: str):
    docs, chunks, failures = (table(spark, folder, t) for t in ("enterprise_documents", "chunks", "failure_analysis"))
    fields = [
        refs.Reference("failure_analysis", "required_chunk_ids", failures, "failure_id", "evaluated_at", "chunks"),
        refs.Reference("failure_analysis", "retrieved_chunk_ids", failures, "failure_id", "evaluated_at", "chunks"),
        refs.Reference("enterprise_documents", "reference_ids", docs, "document_id", "updated_at", "enterprise_documents"),
        refs.Reference("chunks", "document_id", chunks, "chunk_id", "indexed_at", "enterprise_documents"),
    ]
    parents = [
        refs.Target("chunks", chunks, "chunk_id", "indexed_at", "deleted_at"),
        refs.Target("enterprise_documents", docs, "document_id", "created_at", "deleted_at"),
    ]
    return fields, parents


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return refs.orphan_references(*_references(spark, folder))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return refs.orphan_counts(*_references(spark, folder))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    index = sparse.postings(_chunks(spark, folder, "section_path", "text"), T.index_text())
    return index.groupBy("term").agg(F.sum("tf").alias("n_total"), F.count("*").alias("n_chunks"))


def term_stats_idf(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).weighted().select("term", "df", F.round("idf", 6).alias("idf"))


def _index(spark: SparkSession, folder: str) -> sparse.Index:
    return sparse.build(_chunks(spark, folder, "section_path", "text"), T.index_text())


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return _queries(spark, folder, "query_text").where("cast(regexp_extract(query_id, '([0-9]+)$', 1) AS bigint) % 100 = 0")


def bm25_top10(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.bm25(_index(spark, folder), _asked(spark, folder))


def dense_top10(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), dense.unit("embedding").alias("v"))
    return dense.nearest(vectors, vectors.where("id % 100 = 0"))


def dense_label_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the ten nearest vectors with the label of the query vector."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    found = dense_top10(spark, folder).join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "a"}), "query_id").join(labels.withColumnsRenamed({"vec_id": "chunk_id", "label": "b"}), "chunk_id")
    return found.groupBy("query_id").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 4).alias("precision"))


def rrf_fusion_top10(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.fuse(_lists(spark, folder, 100, ("bm25", "dense")), 10)


def rrf_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Mean recall at 10 for each fusion constant, over the queries with required chunks."""
    lists = staged(_lists(spark, folder, 100, ("bm25", "dense")), "lists")
    need = metrics.relevant(_queries(spark, folder, "answerable", "required_chunk_ids"))
    found = fusion.sweep(lists).withColumn("chunk_id", refs.clean_key("chunk_id")).join(need, ["query_id", "chunk_id"]).groupBy("rrf_k", "query_id").agg(F.count("*").alias("n"))
    each = need.groupBy("query_id").agg(F.count("*").alias("m")).withColumn("rrf_k", F.explode(F.array(*(F.lit(k) for k in (10, 30, 60, 100)))))
    recall = each.join(found, ["rrf_k", "query_id"], "left").groupBy("rrf_k").agg(F.round(F.avg(F.coalesce(F.col("n"), F.lit(0)) / F.col("m")), 6).alias("recall"))
    return recall.withColumn("rrf_k", F.col("rrf_k").cast("long"))


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.query_metrics(_latest(spark, folder), metrics.relevant(_queries(spark, folder, "answerable", "required_chunk_ids")))


def query_metrics_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder)


def macro_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.means(_metrics(spark, folder), "method", "k")


def metrics_by_attribute(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.means_by_attributes(_metrics(spark, folder), _queries(spark, folder, "category", "reasoning_type", "difficulty"))


def metrics_by_factor(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.means_by_factor(_metrics(spark, folder), _queries(spark, folder, "retrieval_difficulty_factors"))


def failure_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.failure_patterns(_evaluated(spark, folder, "method", "recall_at_k", "category", "reasoning_type", "difficulty", "oracle_strategy"))


def top_failures(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.top_failures(_evaluated(spark, folder, "method", "query_id", "recall_at_k", "mrr", "n_relevant"))


def comparison_vs_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.comparison(_evaluated(spark, folder, "method", "recall_at_k", "category"), "hybrid", "bm25")


def multi_method_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.method_matrix(_evaluated(spark, folder, "method", "recall_at_k", "mrr", "ndcg"), EVALUATED, "hybrid")


def _contributions(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.contributions(metrics.relevant(_queries(spark, folder, "answerable", "required_chunk_ids")), _lists(spark, folder, 10))


def contribution_overall(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.contribution_shares(_contributions(spark, folder))


def contribution_by_category(spark: SparkSession, folder: str) -> DataFrame:
    kinds = _queries(spark, folder, "category").select("query_id", analysis.known("category").alias("category"))
    return analysis.contribution_shares(_contributions(spark, folder).join(kinds, "query_id"), "category")


def rule_planner_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return planning.rule_decisions(_queries(spark, folder, "reasoning_type", "retrieval_difficulty_factors", "category", "planner_oracle_strategy")).withColumn("matched_rules", F.array_join("matched_rules", "|"))


def planner_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return planning.confusion(_decisions(spark, folder, "selected_strategy", "oracle_strategy_mapped", "is_correct"))


def planner_grouped_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return planning.grouped_accuracy(_decisions(spark, folder, "selected_strategy", "is_correct", "oracle_discrepancy", "category", "reasoning_type", "prompt_version", "model"), ("category", "reasoning_type", "prompt_version", "model"))


def rule_contributions(spark: SparkSession, folder: str) -> DataFrame:
    return planning.rule_contributions(planning.rule_decisions(_queries(spark, folder, "reasoning_type", "retrieval_difficulty_factors", "category", "planner_oracle_strategy")))


def strategy_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return planning.strategy_distribution(_decisions(spark, folder, "selected_strategy", "is_correct"))


def planner_run_assembly(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.assemble(planning.rule_decisions(_queries(spark, folder, "reasoning_type", "retrieval_difficulty_factors", "category", "planner_oracle_strategy")), _lists(spark, folder, 10)).select("query_id", "method", "chunk_id", "rank")


def mock_planner_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return planning.mock_decisions(_queries(spark, folder, "planner_oracle_strategy"), "structured")


def llm_cost_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.cost_analysis(_decisions(spark, folder, "model", "latency_s", "prompt_tokens", "completion_tokens", "estimated_cost_usd"), "model")


def llm_latency_p95(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.distribution_percentiles(_decisions(spark, folder, "model", "latency_s"), "latency_s", (50, 95), "model")


def llm_error_categories(spark: SparkSession, folder: str) -> DataFrame:
    wrong = _decisions(spark, folder, "is_correct", "prompt_version", "oracle_strategy_source", "reasoning_type", "difficulty_factors", "category").where("NOT is_correct").withColumn("error", planning.error_category())
    return wrong.groupBy("error", analysis.known("reasoning_type").alias("reasoning_type")).agg(F.count("*").alias("n"))


def prompt_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.cost_analysis(_decisions(spark, folder, "prompt_version", "latency_s", "prompt_tokens", "completion_tokens", "estimated_cost_usd"), "prompt_version")


def pilot_summary(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.pilot_summary(_decisions(spark, folder, "prompt_version", "model", "parse_success", "fallback_used", "parse_attempts", "latency_s"), "prompt_version", "model")


def heuristic_classify(spark: SparkSession, folder: str) -> DataFrame:
    kinds = _queries(spark, folder, "query_text", "reasoning_type").select(T.question_type(F.col("query_text")).alias("by_wording"), analysis.known("reasoning_type").alias("reasoning_type"))
    return kinds.groupBy("by_wording", "reasoning_type").agg(F.count("*").alias("n"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return validation.relevance(_lists(spark, folder, 10))


def validation_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).drop("run_id")


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return validation.verdicts(_scored(spark, folder), _queries(spark, folder, "reasoning_type", "query_text"))


def validation_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder)


def _outcome(spark: SparkSession, folder: str) -> DataFrame:
    start = planning.rule_decisions(_queries(spark, folder, "reasoning_type", "retrieval_difficulty_factors", "category", "planner_oracle_strategy")).select("query_id", F.col("selected_strategy").alias("strategy"))
    return validation.retry(start, staged(_verdicts(spark, folder), "verdicts"))


def loop_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return _outcome(spark, folder)


def pipeline_stats(spark: SparkSession, folder: str) -> DataFrame:
    return validation.loop_statistics(_outcome(spark, folder), _queries(spark, folder, "reasoning_type"))


def dedup_keep_max_rerank(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.merge_best_score(_lists(spark, folder, 20))


def dedup_keep_best_rank(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.merge_best_rank(_lists(spark, folder, 20))


def extractive_answers(spark: SparkSession, folder: str) -> DataFrame:
    return validation.extractive_answers(_scored(spark, folder).where("method = 'hybrid'"), _chunks(spark, folder, "text"))


def citation_extract(spark: SparkSession, folder: str) -> DataFrame:
    answers = extractive_answers(spark, folder)
    return answers.select("query_id", F.array_join(T.citations(F.col("answer"), F.lit(3)).cast("array<string>"), ",").alias("cited"))


def slot_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with a slot, the slot filled with the first required document."""
    q = _queries(spark, folder, "query_text", "required_document_ids").withColumn("slots", T.slots(F.col("query_text"))).where(F.size("slots") > 0)
    value = F.coalesce(F.try_element_at("required_document_ids", F.lit(1)), F.lit("?"))
    return q.select("query_id", F.array_join("slots", ",").alias("slots"), T.fill_slot(F.col("query_text"), "id", value).alias("filled"))


def plan_json_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Strategy and confidence read out of the responses, and how often they are what was recorded."""
    d = _decisions(spark, folder, "raw_response", "selected_strategy").withColumn("json", T.outer_json(F.col("raw_response")))
    parsed = F.from_json("json", "selected_strategy string, confidence string")
    d = d.withColumn("strategy", F.lower(F.trim(parsed["selected_strategy"]))).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("try_cast(from_json(json, 'confidence string').confidence AS double)"))))
    valid = F.when(F.col("strategy").isin(*planning.STRATEGIES), F.col("strategy")).otherwise("none")
    return d.groupBy(valid.alias("strategy")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("strategy").isin(*planning.STRATEGIES), F.col("confidence"))), 4).alias("avg_confidence"), F.count(F.when(F.col("strategy") == F.col("selected_strategy"), 1)).alias("n_as_recorded"))


def evidence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where each chunk's text stands in its document, against its recorded offset."""
    chunks = _chunks(spark, folder, "document_id", "text", "char_start")
    found = evidence.locate_quotes(chunks.select("chunk_id", "document_id", "text"), _docs(spark, folder, "body"))
    return found.join(chunks.select("chunk_id", F.col("char_start").cast("long").alias("char_start")), "chunk_id").select("chunk_id", F.col("found_at").cast("long").alias("found_at"), "char_start", F.coalesce(F.col("found_at") == F.col("char_start"), F.lit(False)).alias("as_recorded"))


def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.sections(_docs(spark, folder, "body"))


def section_of_offset(spark: SparkSession, folder: str) -> DataFrame:
    s = evidence.sections(_docs(spark, folder, "body")).select("document_id", F.col("section_no").alias("no"), F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    p = _chunks(spark, folder, "document_id", "char_start").where("char_start IS NOT NULL AND document_id IS NOT NULL").select("document_id", F.col("chunk_id").alias("point_id"), F.col("char_start").cast("long").alias("at"))
    return evidence.containing(p, s).select("point_id", "at", F.col("no").alias("section_no"))


def asof_chunk_of_section(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk that begins last before each section, or else the first of the document."""
    s = evidence.sections(_docs(spark, folder, "body")).select(F.col("document_id").alias("key"), F.concat_ws("#", "document_id", F.col("section_no").cast("string")).alias("point_id"), F.col("char_start").alias("at"))
    m = _chunks(spark, folder, "document_id", "char_start").where("char_start IS NOT NULL AND document_id IS NOT NULL").select(F.col("document_id").alias("key"), F.col("chunk_id").alias("mark_id"), F.col("char_start").cast("long").alias("at"))
    return evidence.as_of(s, m).select("point_id", "at", "mark_id")


def chunk_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_statistics(_chunks(spark, folder, "document_id", "category", "chunk_strategy", "text"), "category", "chunk_strategy")


def chunk_token_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.token_percentiles(_chunks(spark, folder, "category", "text"), "category").withColumn("percent", F.col("percent").cast("long")).withColumn("value", F.col("value").cast("long"))


def _cut(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    return chunking.chunk(_docs(spark, folder, "body", "category"), strategy)


def chunk_section_aware(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder, "section_aware")


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder, "fixed_size")


def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder, "recursive")


def dq_violations(spark: SparkSession, folder: str) -> DataFrame:
    parts = (("chunks", constraints.chunk_rules()), ("enterprise_documents", constraints.document_rules()), ("queries", constraints.query_rules()))
    out = [constraints.violations(table(spark, folder, t), t, rules) for t, rules in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def dq_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"chunks": "chunk_id", "enterprise_documents": "document_id", "queries": "query_id", "failure_analysis": "failure_id", "pilot_decisions": "decision_id"}
    out = None
    for t, key in keys.items():
        rows = constraints.repeated_keys(table(spark, folder, t), t, key)
        out = rows if out is None else out.unionByName(rows)
    return out


def first_last_event(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.first_and_last(table(spark, folder, "events"), "user_id", "ts", "event_type", "event_id")


def first_two_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder, "category", "title", "created_at").where("title IS NOT NULL")
    return evidence.first_rows(docs, "category", ["created_at", "document_id"]).select("category", "place", "document_id")


def references_of_meetings(spark: SparkSession, folder: str) -> DataFrame:
    """Live documents that meeting notes refer to, with their categories (a self-join by reference)."""
    docs = _docs(spark, folder, "category", "reference_ids", "deleted_at")
    out = docs.where("category = 'Project Meeting Notes'").select(F.col("document_id").alias("meeting_id"), F.explode(F.array_distinct("reference_ids")).alias("r")).select("meeting_id", refs.clean_key("r").alias("document_id"))
    return out.join(docs.where("deleted_at IS NULL").select("document_id", F.col("category").alias("target_category")), "document_id").groupBy("target_category").agg(F.count("*").alias("n_references"), F.countDistinct("meeting_id").alias("n_meetings"))


def label_rebalance(spark: SparkSession, folder: str) -> DataFrame:
    labels = _queries(spark, folder, "planner_oracle_strategy", "answerable").where("coalesce(answerable, true)").select("query_id", F.col("planner_oracle_strategy").alias("label")).where("label IS NOT NULL")
    target = {"keyword": 0.20, "dense": 0.20, "hybrid": 0.24, "table_aware": 0.12, "multi_hop": 0.12, "metadata_filtered": 0.12}
    return analysis.rebalance(labels, target, (("keyword", "hybrid"), ("table_aware", "metadata_filtered"), ("dense", "hybrid"))).groupBy("label", "new_label").agg(F.count("*").alias("n"))


def oracle_validation(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.best_methods(_evaluated(spark, folder, "method", "recall_at_k", "reasoning_type"))


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.stack(_queries(spark, folder, "category", "reasoning_type", "difficulty", "planner_oracle_strategy", "lang"), ("category", "reasoning_type", "difficulty", "planner_oracle_strategy", "lang")).groupBy("attribute", "value").agg(F.count("*").alias("n"))


def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.fitted(tables.table_rows(_chunks(spark, folder, "text")))
    return rows.select("chunk_id", "line_no", F.array_join("cells", "|").alias("cells"), "is_header", "width")


def numbered_sections(spark: SparkSession, folder: str) -> DataFrame:
    return tables.numbered_sections(_docs(spark, folder, "body"))


def repeated_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects with at least three meeting records, however their source is spelt: how many, and the characters of their texts."""
    docs = table(spark, folder, "documents").where((T.plain_name(F.col("source")) == "meeting_archive") & F.col("project_code").isNotNull())
    sums = docs.groupBy("project_code").agg(F.count("*").alias("n_records"), F.sum(F.length("text")).alias("n_chars"), F.date_format(F.min("collected_at"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("collected_at"), "yyyy-MM-dd").alias("last_day"))
    return sums.where("n_records >= 3")


def _of_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _queries(spark, folder, "category", "reasoning_type").select("query_id", analysis.known("category").alias("category"), analysis.known("reasoning_type").alias("reasoning_type"))


def contribution_report(spark: SparkSession, folder: str) -> DataFrame:
    """Contributions by category and by reasoning type, with percentages and both levels."""
    each = analysis.stack(_contributions(spark, folder).join(_of_queries(spark, folder), "query_id"), ("category", "reasoning_type"))
    return analysis.contribution_shares(each, "attribute", "value", percent=True)


def prompt_quality(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.prompt_quality(_decisions(spark, folder, "prompt_version", "selected_strategy", "oracle_strategy_mapped", "is_correct", "parse_success"), planning.STRATEGIES, "prompt_version")


def pilot_report(spark: SparkSession, folder: str) -> DataFrame:
    d = _decisions(spark, folder, "prompt_version", "model", "parse_success", "fallback_used", "parse_attempts", "latency_s", "prompt_tokens", "completion_tokens", "estimated_cost_usd")
    return analysis.pilot_report(d, "prompt_version", "model")


def pilot_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The first five decisions of each prompt version."""
    d = _decisions(spark, folder, "prompt_version", "query_id", "selected_strategy", "is_correct")
    return evidence.first_rows(d, "prompt_version", ["decision_id"], 5).select("prompt_version", "place", "decision_id", "query_id", "selected_strategy", "is_correct")


def error_report(spark: SparkSession, folder: str) -> DataFrame:
    """Error categories of wrong decisions in all, by reasoning type and by category, with percentages, most frequent first."""
    wrong = _decisions(spark, folder, "is_correct", "prompt_version", "oracle_strategy_source", "reasoning_type", "difficulty_factors", "category").where("NOT is_correct").withColumn("error", planning.error_category())
    return analysis.shares_of(wrong, "error", ("reasoning_type", "category"))


def notable_changes(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.notable_changes(_evaluated(spark, folder, "method", "recall_at_k", "category", "reasoning_type", "difficulty"), "hybrid", "bm25", ("category", "reasoning_type", "difficulty"))


def reasoning_type_union(spark: SparkSession, folder: str) -> DataFrame:
    """Mean recall of two methods for the reasoning types that either has."""
    ev = _evaluated(spark, folder, "method", "recall_at_k", "reasoning_type")
    return analysis.key_union(ev.where("method = 'v2_oracle'"), ev.where("method = 'hybrid'"), "reasoning_type", "recall_at_k")


def missed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Required chunks that were not retrieved, per evaluated query (the difference of two sets), and whether all were found."""
    keys = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), refs.clean_key), lambda x: x.isNotNull()))
    ev = _evaluated(spark, folder, "method", "required_chunk_ids", "retrieved_chunk_ids")
    missed = F.array_except(keys("required_chunk_ids"), keys("retrieved_chunk_ids"))
    return ev.select("failure_id", "method", F.array_join(F.array_sort(missed), "|").alias("missed"), F.size(missed).cast("long").alias("n_missed"))


def rrf_best_run(spark: SparkSession, folder: str) -> DataFrame:
    """The fused run of the constant with the best mean recall at 10 (the smallest of equals)."""
    best = rrf_sweep(spark, folder).agg(F.max_by("rrf_k", F.struct("recall", -F.col("rrf_k"))).alias("k")).first()["k"]  # one number of four
    return fusion.fuse(_lists(spark, folder, 100, ("bm25", "dense")), int(best), 10).withColumn("rrf_k", F.lit(int(best)).cast("long"))


def pipeline_loops(spark: SparkSession, folder: str) -> DataFrame:
    """Loops that queries took, in all and by reasoning type."""
    rows = analysis.stack(_outcome(spark, folder).join(_of_queries(spark, folder), "query_id").withColumn("all", F.lit("all")), ("all", "reasoning_type"))
    return validation.loop_histogram(rows, "attribute", "value")


def pipeline_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The five most frequent reasons of failure, in all and by reasoning type."""
    rows = _outcome(spark, folder).where("NOT passed AND failure_reason IS NOT NULL").join(_of_queries(spark, folder), "query_id")
    return analysis.shares_of(rows, "failure_reason", ("reasoning_type",)).where("place <= 5")


def pipeline_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """Queries, pass rate, mean loops and loop counts of each configuration of the pipeline."""
    scored = staged(_scored(spark, folder), "scored")
    given = staged(_queries(spark, folder, "reasoning_type", "query_text", "retrieval_difficulty_factors", "category", "planner_oracle_strategy"), "asked")
    told = given.withColumn("reasoning_type", T.question_type(F.col("query_text")))
    out = None
    for name, oracle, scorer, loops in validation.EXPERIMENTS:
        queries = given if oracle else told
        judged = staged(validation.verdicts(scored, queries, scorer), "verdicts")
        end = validation.retry(planning.rule_decisions(queries).select("query_id", F.col("selected_strategy").alias("strategy")), judged, loops)
        n = [F.count(F.when(F.col("loop_count") == i, 1)).alias(f"n_loops_{i}") for i in range(4)]
        row = end.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"), F.round(F.avg("loop_count"), 3).alias("mean_loops"), *n).withColumn("config", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def rescored_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The lists of the searched queries, with BM25 scores over the best of the corpus in place of scores over the list's own best."""
    index, asked = _index(spark, folder), staged(_asked(spark, folder), "asked")
    scored = _scored(spark, folder).drop("run_id").join(asked.select("query_id"), "query_id", "left_semi")
    top = sparse.bm25(index, asked, 1).select("query_id", F.col("score").alias("top"))
    own = sparse.pair_scores(index, asked, scored.select("query_id", "chunk_id").distinct())
    return validation.rescored(scored, own, top).select("method", "query_id", "chunk_id", "rank", "lexical", "dense", "adaptive")


def complete_answers(spark: SparkSession, folder: str) -> DataFrame:
    """An answer for every query, also where nothing was retrieved."""
    return validation.answered(extractive_answers(spark, folder), _queries(spark, folder, "query_text"))


def slot_fill_from_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The second stage of dependent questions: their slot filled from what the hybrid run found for them first."""
    q = _queries(spark, folder, "query_text").where("query_text LIKE '%{id}%'").select("query_id", "query_text", F.lit("id").alias("slot"), F.col("query_id").alias("needs"))
    return search.fill_from(_lists(spark, folder, 3, ("hybrid",)), q, _chunks(spark, folder, "document_id"))


def merged_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval by question type: for aggregations the lists of all methods merged (best rank of a chunk), for others the planned one."""
    kinds = _queries(spark, folder, "reasoning_type", "retrieval_difficulty_factors", "category", "planner_oracle_strategy")
    lists = staged(_lists(spark, folder, 10), "lists")
    many = kinds.where("reasoning_type = 'aggregation'").select("query_id")
    merged = fusion.merge_best_rank(lists.join(many, "query_id", "left_semi"))
    single = fusion.assemble(planning.rule_decisions(kinds).join(many, "query_id", "left_anti"), lists)
    return merged.select("query_id", "chunk_id", "rank", F.lit("merged").alias("mode")).unionByName(single.select("query_id", "chunk_id", "rank", F.lit("independent").alias("mode")))


def response_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    """How many requests of each model the cache of parsed responses would have answered."""
    d = _decisions(spark, folder, "query_id", "model", "prompt_version", "raw_response", "parse_success", "decided_at").where("query_id IS NOT NULL AND model IS NOT NULL AND prompt_version IS NOT NULL")
    kept = d.where("parse_success AND raw_response IS NOT NULL").select(cache_key().alias("cache_key"), "raw_response", F.struct("decided_at", "decision_id").alias("created_at"))
    found = cache_lookup(d.select("query_id", "model", "prompt_version").distinct(), kept)
    return found.groupBy("model").agg(F.count("*").alias("n_requests"), F.count(F.when(F.col("cache_hit"), 1)).alias("n_hits"))


def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred queries without replacement, the same in every run."""
    return analysis.seeded_sample(_queries(spark, folder, "category"), "query_id", 100)


def query_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """New ids in one sequence over all queries that have required chunks, in a shuffled order."""
    kept = metrics.relevant(_queries(spark, folder, "answerable", "required_chunk_ids")).select("query_id").distinct()
    return analysis.places_by_hash(kept, "query_id").select("query_id", F.concat(F.lit("Q-"), F.lpad(F.col("place").cast("string"), 9, "0")).alias("new_id"))


def inherited_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with what they inherit from their documents, counted by what is missing."""
    keys = ("title", "doc_version", "region", "status", "department", "document_owner", "confidentiality", "effective_date", "source_path")
    found = inherited(_chunks(spark, folder, "document_id"), _docs(spark, folder, *keys), keys)
    return found.groupBy(F.array_join("missing", "|").alias("missing")).agg(F.count("*").alias("n_chunks"))


def dependency_order(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the order in which they can be read: 0 where no live document is referred to, 1 where one is."""
    docs = _docs(spark, folder, "category", "reference_ids", "deleted_at")
    live = docs.where("deleted_at IS NULL").select(F.col("document_id").alias("key"))
    out = docs.select("document_id", F.explode("reference_ids").alias("r")).select("document_id", refs.clean_key("r").alias("key")).join(live, "key", "left_semi").select("document_id").distinct().withColumn("level", F.lit(1).cast("long"))
    return docs.join(out, "document_id", "left").groupBy("category", F.coalesce("level", F.lit(0).cast("long")).alias("level")).agg(F.count("*").alias("n_documents"))


def deprecated_replacements(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder, "status", "category", "department", "deleted_at").withColumn("status", T.plain_name(F.col("status")))
    return evidence.replacements(docs, "deprecated", "active", ("category", "department"))


def first_document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder, "category", "department", "created_at").where("category IS NOT NULL AND department IS NOT NULL").withColumn("family", F.concat_ws("/", "category", "department"))
    return evidence.first_pairs(docs, "family", ["created_at", "document_id"], "document_id")


def last_chunk_at_section(spark: SparkSession, folder: str) -> DataFrame:
    """The last of the chunks that a section's start lies in (chunks may overlap), by their place in the document."""
    s = evidence.sections(_docs(spark, folder, "body")).select("document_id", F.col("section_no").alias("point_id"), F.col("char_start").alias("at"))
    c = _chunks(spark, folder, "document_id", "char_start", "char_end").where("char_start IS NOT NULL AND char_end IS NOT NULL AND document_id IS NOT NULL")
    c = c.select("document_id", F.struct(F.col("char_start").cast("long").alias("a"), "chunk_id").alias("no"), F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    return evidence.containing(s, c, last=True).select("document_id", F.col("point_id").alias("section_no"), F.col("no.chunk_id").alias("chunk_id"))


def evidence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """For the text of each chunk, found in its document, the chunk that the place found lies in or is nearest to."""
    chunks = _chunks(spark, folder, "document_id", "text", "char_start", "char_end")
    found = evidence.locate_quotes(chunks.select("chunk_id", "document_id", "text"), _docs(spark, folder, "body")).where("found_at IS NOT NULL")
    points = found.select("document_id", F.col("chunk_id").alias("point_id"), F.col("found_at").cast("long").alias("at"))
    return evidence.chunks_at(points, chunks).select("point_id", "at", "chunk_id")


def dq_samples(spark: SparkSession, folder: str) -> DataFrame:
    parts = (("chunks", "chunk_id", constraints.chunk_rules()), ("enterprise_documents", "document_id", constraints.document_rules()), ("queries", "query_id", constraints.query_rules()))
    out = [constraints.samples(table(spark, folder, t), t, key, rules) for t, key, rules in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def query_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """What the wording of each question tells: its type and signals."""
    q = _queries(spark, folder, "query_text")
    return q.select("query_id", T.question_type(F.col("query_text")).alias("by_wording"), F.array_join(T.signals(F.col("query_text")), "|").alias("signals"), F.lit(0.6).alias("confidence"))


def planner_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Who planned the strategies of the second pass: validation of the hybrid lists, a model where rules are unsure, or the rules."""
    rules = planning.rule_decisions(_queries(spark, folder, "reasoning_type", "retrieval_difficulty_factors", "category", "planner_oracle_strategy"))
    second = _decisions(spark, folder, "query_id", "selected_strategy").where("query_id IS NOT NULL").groupBy("query_id").agg(F.max_by("selected_strategy", "decision_id").alias("second_strategy"))
    suggested = _verdicts(spark, folder).where("method = 'hybrid'").select("query_id", "suggested_strategy")
    return planning.plans(rules, second, suggested).groupBy("source", "strategy").agg(F.count("*").alias("n_queries"))


def fixed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows of fixed_size as offsets."""
    return chunk_fixed(spark, folder).select("chunk_id", "char_start", "char_end")


# --- The same over every run, by rounds (fusion.run_rounds); round 1 is what the queries of the latest runs give. -------------

BY = ("round",)


def run_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.run_rounds(table(spark, folder, "retrieval_results"))


def query_metrics_rounds(spark: SparkSession, folder: str) -> DataFrame:
    need = metrics.relevant(_queries(spark, folder, "answerable", "required_chunk_ids"))
    return metrics.query_metrics(table(spark, folder, "retrieval_results"), need, rounds=_rounds(spark, folder))


def macro_metrics_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.means(query_metrics_rounds(spark, folder), *BY, "method", "k")


def metrics_by_attribute_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.means_by_attributes(query_metrics_rounds(spark, folder), _queries(spark, folder, "category", "reasoning_type", "difficulty"), by=BY)


def metrics_by_factor_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.means_by_factor(query_metrics_rounds(spark, folder), _queries(spark, folder, "retrieval_difficulty_factors"), by=BY)


def rrf_fusion_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.fuse(_all_lists(spark, folder, 100, _rounds(spark, folder, ("bm25", "dense"))), 10, by=BY)


def rrf_sweep_rounds(spark: SparkSession, folder: str) -> DataFrame:
    rounds = _rounds(spark, folder, ("bm25", "dense"))
    lists = staged(_all_lists(spark, folder, 100, rounds), "lists")
    need = metrics.relevant(_queries(spark, folder, "answerable", "required_chunk_ids"))
    found = fusion.sweep(lists, by=BY).withColumn("chunk_id", refs.clean_key("chunk_id")).join(need, ["query_id", "chunk_id"]).groupBy("round", "rrf_k", "query_id").agg(F.count("*").alias("n"))
    each = need.groupBy("query_id").agg(F.count("*").alias("m")).withColumn("rrf_k", F.explode(F.array(*(F.lit(k) for k in (10, 30, 60, 100))))).crossJoin(F.broadcast(rounds.select("round").distinct()))
    recall = each.join(found, ["round", "rrf_k", "query_id"], "left").groupBy("round", "rrf_k").agg(F.round(F.avg(F.coalesce(F.col("n"), F.lit(0)) / F.col("m")), 6).alias("recall"))
    return recall.withColumn("rrf_k", F.col("rrf_k").cast("long"))


def _contributions_rounds(spark: SparkSession, folder: str) -> DataFrame:
    rounds = _rounds(spark, folder, RUN_METHODS)
    need = metrics.relevant(_queries(spark, folder, "answerable", "required_chunk_ids")).crossJoin(F.broadcast(rounds.select("round").distinct()))
    return analysis.contributions(need, _all_lists(spark, folder, 10, rounds), by=BY)


def contribution_overall_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.contribution_shares(_contributions_rounds(spark, folder), *BY)


def contribution_by_category_rounds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = _queries(spark, folder, "category").select("query_id", analysis.known("category").alias("category"))
    return analysis.contribution_shares(_contributions_rounds(spark, folder).join(kinds, "query_id"), *BY, "category")


def planner_run_assembly_rounds(spark: SparkSession, folder: str) -> DataFrame:
    decisions = planning.rule_decisions(_queries(spark, folder, "reasoning_type", "retrieval_difficulty_factors", "category", "planner_oracle_strategy"))
    return fusion.assemble(decisions, _all_lists(spark, folder, 10, _rounds(spark, folder, RUN_METHODS))).select("round", "query_id", "method", "chunk_id", "rank")


def _scored_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return validation.relevance(_all_lists(spark, folder, 10, _rounds(spark, folder, RUN_METHODS)), BY)


def validation_scores_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return _scored_rounds(spark, folder).drop("run_id")


def validation_decisions_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return validation.verdicts(staged(_scored_rounds(spark, folder), "scored"), _queries(spark, folder, "reasoning_type", "query_text"), by=BY)


def loop_outcome_rounds(spark: SparkSession, folder: str) -> DataFrame:
    judged = staged(validation_decisions_rounds(spark, folder), "verdicts")
    start = planning.rule_decisions(_queries(spark, folder, "reasoning_type", "retrieval_difficulty_factors", "category", "planner_oracle_strategy")).select("query_id", F.col("selected_strategy").alias("strategy"))
    return validation.retry(start.crossJoin(F.broadcast(judged.select("round").distinct())), judged, by=BY)


def pipeline_stats_rounds(spark: SparkSession, folder: str) -> DataFrame:
    rounds = _rounds(spark, folder, RUN_METHODS)
    kinds = _queries(spark, folder, "reasoning_type", "query_text", "retrieval_difficulty_factors", "category", "planner_oracle_strategy")
    queries = staged(planning.rule_decisions(kinds, "reasoning_type", "query_text").select("query_id", "reasoning_type", "query_text", F.col("selected_strategy").alias("strategy")), "queries")
    outcome = validation.retried(validation.relevance(_all_lists(spark, folder, 10, rounds), BY), queries, by=BY)
    return validation.retried_statistics(outcome, queries, rounds.select("round").distinct(), by=BY)


def dedup_keep_max_rerank_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.merge_best_score(_all_lists(spark, folder, 20, _rounds(spark, folder, RUN_METHODS)), by=BY)


def dedup_keep_best_rank_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.merge_best_rank(_all_lists(spark, folder, 20, _rounds(spark, folder, RUN_METHODS)), by=BY)


def extractive_answers_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return validation.extractive_answers(_scored_rounds(spark, folder).where("method = 'hybrid'"), _chunks(spark, folder, "text"), by=BY)


def citation_extract_rounds(spark: SparkSession, folder: str) -> DataFrame:
    answers = extractive_answers_rounds(spark, folder)
    return answers.select("round", "query_id", F.array_join(T.citations(F.col("answer"), F.lit(3)).cast("array<string>"), ",").alias("cited"))


FLAGSHIP = rrf_fusion_top10
QUERIES = {
    f.__name__: f
    for f in (
        bm25_top10, token_counts, term_stats_idf, dense_top10, dense_label_precision, rrf_fusion_top10, rrf_sweep, query_metrics_at_k, macro_metrics, metrics_by_attribute, metrics_by_factor,
        failure_patterns, top_failures, comparison_vs_baseline, multi_method_matrix, contribution_overall, contribution_by_category, rule_planner_decisions, planner_confusion,
        planner_grouped_distribution, rule_contributions, strategy_distribution, planner_run_assembly, mock_planner_decisions, llm_cost_analysis, llm_latency_p95, llm_error_categories, prompt_comparison,
        pilot_summary, heuristic_classify, validation_scores, validation_decisions, loop_outcome, pipeline_stats, dedup_keep_max_rerank, dedup_keep_best_rank, extractive_answers, citation_extract,
        slot_fill, plan_json_parse, evidence_spans, document_sections, section_of_offset, asof_chunk_of_section, chunk_statistics, chunk_token_percentiles, chunk_section_aware, chunk_fixed,
        chunk_recursive, dq_violations, dq_duplicates, first_last_event, first_two_documents, references_of_meetings, label_rebalance, oracle_validation, label_counts, table_rows, numbered_sections, repeated_projects, p4_found, p4_counts,
        contribution_report, prompt_quality, pilot_report, pilot_samples, error_report, notable_changes, reasoning_type_union, missed_chunks, rrf_best_run, pipeline_loops, pipeline_reasons, pipeline_experiments,
        rescored_validation, complete_answers, slot_fill_from_runs, merged_retrieval, response_cache_hits, seeded_sample, query_sequence, inherited_metadata, dependency_order, deprecated_replacements,
        first_document_pairs, last_chunk_at_section, evidence_chunks, dq_samples, query_analysis, planner_sources, fixed_windows,
        run_rounds, query_metrics_rounds, macro_metrics_rounds, metrics_by_attribute_rounds, metrics_by_factor_rounds, rrf_fusion_rounds, rrf_sweep_rounds, contribution_overall_rounds, contribution_by_category_rounds,
        planner_run_assembly_rounds, validation_scores_rounds, validation_decisions_rounds, loop_outcome_rounds, pipeline_stats_rounds, dedup_keep_max_rerank_rounds, dedup_keep_best_rank_rounds, extractive_answers_rounds, citation_extract_rounds,
    )
}
