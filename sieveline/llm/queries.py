"""The registered queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import table
from . import leakage, mixing, pairs, prose, spans, splitting, topn


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies of documents and texts of chunks as records; the owner of a chunk is its document."""
    docs, chunks = table(spark, folder, "enterprise_documents"), table(spark, folder, "chunks")
    owner = F.coalesce(F.expr("substring_index(chunk_id, '-C', size(split(chunk_id, '-C')) - 1)"), F.lit(""))
    return docs.select(F.lit("document").alias("record_type"), F.col("document_id").alias("id"), F.col("document_id").alias("owner"), F.col("body").alias("text")).unionByName(
        chunks.select(F.lit("chunk").alias("record_type"), F.col("chunk_id").alias("id"), owner.alias("owner"), "text")
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_pairs(spans.find_shared(_records(spark, folder), 200))


def p1_shared_chars(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    return spans.shared_amounts(records, spans.find_shared(records, 200))


def p1_spans(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_stretches(spans.find_shared(_records(spark, folder), 200)).drop("version").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "retrieval_results")
    return topn.top_n(runs, ["run_id", "query_id"], "chunk_id", "score", "rank", 3).select("run_id", "query_id", "chunk_id")


def p2_top3(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "retrieval_results")
    return topn.top_n(runs, ["run_id", "query_id"], "chunk_id", "score", "rank", 3, keep=("method",))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(table(spark, folder, "enterprise_documents"), table(spark, folder, "chunking_config"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.cut_kinds(_pieces(spark, folder))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p3_soundness(spark: SparkSession, folder: str) -> DataFrame:
    """Per configuration: texts, oversized ones, and how many of their pieces break a promise: too long, no core, a core that does
    not follow the one before or cover the text, a repeat that is too long or begins before the piece it repeats."""
    limits = table(spark, folder, "chunking_config").select("config_id", "max_tokens", "overlap_tokens")
    before = W.partitionBy("config_id", "document_id", "version").orderBy("number")
    p = _pieces(spark, folder).join(F.broadcast(limits), "config_id").withColumn("from", F.coalesce(F.lag("char_end").over(before), F.lit(0))).withColumn("start", F.coalesce(F.lag("char_start").over(before), F.lit(0)))
    n = lambda c, name: F.count(F.when(F.expr(c), 1)).alias(name)
    return p.groupBy("config_id").agg(
        n("number = 0", "n_texts"), n("number = 0 AND oversized", "n_oversized"), n("floor((char_end - char_start) / 4) > max_tokens", "n_too_long"), n("core_start >= char_end AND n_chars > 0", "n_empty"),
        n("core_start <> from OR (cut = 'end') <> (char_end = n_chars)", "n_gaps"), n("core_start - char_start > 4 * overlap_tokens OR char_start < start", "n_bad_overlap"),
    )


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "queries").where("query_id IS NOT NULL").groupBy("query_id").agg(F.min(F.struct(F.col("query_text").alias("prompt"), "lang")).alias("q"))
    given = table(spark, folder, "pilot_decisions").select(F.col("decision_id").alias("id"), "query_id", F.col("raw_response").alias("response"))
    # A null key of its own for each row, so that these rows don't meet in one task.
    given = given.withColumn("query_id", F.coalesce("query_id", F.concat(F.lit("none:"), F.col("id").cast("string"))))
    return given.join(asked, "query_id", "left").select("id", "q.prompt", "response", "q.lang")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(_pairs(spark, folder), table(spark, folder, "common_words")).withColumnRenamed("id", "decision_id")


def p5_flags(spark: SparkSession, folder: str) -> DataFrame:
    """How far the recorded flags show the defects; 'not judged' are answers in a language without a refusal grammar."""
    flags = table(spark, folder, "pilot_decisions").groupBy("decision_id").agg(F.min("parse_success").alias("parse_success"), F.max("fallback_used").alias("fallback_used"))
    told = pairs.assessed(_pairs(spark, folder), table(spark, folder, "common_words")).select(F.col("id").alias("decision_id"), F.coalesce("defect", F.when(~F.col("judged"), "not judged")).alias("defect")).distinct()
    found = flags.join(told, "decision_id", "left")
    return found.groupBy(F.coalesce("defect", F.lit("none")).alias("defect"), "parse_success", "fallback_used").agg(F.count("*").alias("n_decisions"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p6_leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("leaked_windows").alias("most_windows"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), mixing.clean_source("source").alias("source"), mixing.token_count("text").alias("n_tokens"))
    return mixing.mix(docs, table(spark, folder, "mix_targets"))


def p7_mix_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p7_mix_records(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0].withColumnRenamed("id", "doc_id")


def _estimated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), mixing.clean_source("source").alias("source"), mixing.estimated_tokens("text").alias("n_tokens"))
    return mixing.mix(docs, table(spark, folder, "mix_targets"))


def p7_mix_estimated(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture with a quarter of the characters as the size of a text."""
    return _estimated(spark, folder)[1].drop("actual_share", "passes")


def p7_uses_estimated(spark: SparkSession, folder: str) -> DataFrame:
    return _estimated(spark, folder)[0].withColumnRenamed("id", "doc_id")


def _prose(spark: SparkSession, folder: str) -> DataFrame:
    return prose.judged(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _prose(spark, folder).where("text_kind <> 'prose'").select("doc_id", "text_kind").distinct()


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _prose(spark, folder)


def p8_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that do not depend on what a line is, rounded."""
    ratios = ("mean_word_length", "symbol_ratio", "alpha_word_ratio", "end_punct_ratio", "bullet_ratio", "common_ratio")
    return _prose(spark, folder).select("doc_id", "n_chars", "n_words", "n_lines", *(F.round(c, 6).alias(c) for c in ratios))


def p8_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents of each source fail each rule."""
    rows = _prose(spark, folder).join(table(spark, folder, "documents").select("doc_id", mixing.clean_source("source").alias("source")), "doc_id")
    return rows.select(F.coalesce("source", F.lit("unknown")).alias("source"), F.explode("failed_rules").alias("rule")).groupBy("source", "rule").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shared_chars, p1_spans, p2_found, p2_top3, p3_found, p3_pieces, p3_soundness, p5_found, p5_flags, p6_found, p6_leaks, p6_items, p7_mix_report, p7_mix_records, p7_mix_estimated, p7_uses_estimated, p8_found, p8_statistics, p8_measures, p8_reasons)}
