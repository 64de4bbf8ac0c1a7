"""Integrity constraints as data-quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import is_chunk_id, parent_id


def violations(df: DataFrame, table_name: str, rules: dict[str, Column]) -> DataFrame:
    """table_name, rule, n_rows, n_violations of all rules in one pass. A rule is a condition that a good row fulfils; a null
    condition is no violation."""
    sums = df.agg(F.count("*").alias("n"), *(F.count(F.when(~c, 1)).alias(r) for r, c in rules.items()))
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in rules))
    return sums.select(F.lit(table_name).alias("table_name"), "n", F.explode(pairs).alias("x")).select("table_name", "x.rule", F.col("n").alias("n_rows"), F.col("x.v").alias("n_violations"))


def samples(df: DataFrame, table_name: str, key: str, rules: dict[str, Column], n: int = 20) -> DataFrame:
    """table_name, rule, place, record_id: the first n records by key that break each rule; rows without a key can't be named."""
    broken = F.filter(F.array(*(F.when(~c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record_id"), F.explode(broken).alias("rule")).distinct()
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("rule").orderBy("record_id"))).where(F.col("place") <= n)
    return placed.select(F.lit(table_name).alias("table_name"), "rule", "place", "record_id")


def chunk_rules() -> dict[str, Column]:
    return {
        "id_format": is_chunk_id(F.col("chunk_id")),
        "parent_is_prefix": parent_id(F.col("chunk_id")) == F.upper(F.trim(F.regexp_replace("document_id", r"\t", ""))),
        "offsets_ordered": F.col("char_end") > F.col("char_start"),
        "text_present": F.length(F.trim(F.coalesce("text", F.lit("")))) > 0,
        "length_matches_offsets": F.length("text") == F.col("char_end") - F.col("char_start"),
        "path_present": F.coalesce(F.size("section_path") > 0, F.lit(False)),
    }


def document_rules() -> dict[str, Column]:
    return {"updated_after_created": F.col("updated_at") >= F.col("created_at"), "deleted_after_created": F.col("deleted_at") >= F.col("created_at"), "body_present": F.length(F.coalesce("body", F.lit(""))) > 0, "title_present": F.length(F.trim(F.coalesce("title", F.lit("")))) > 0}


def query_rules() -> dict[str, Column]:
    n, d = F.size(F.coalesce("required_chunk_ids", F.array().cast("array<string>"))), F.size(F.coalesce("required_document_ids", F.array().cast("array<string>")))
    many = F.array_contains("retrieval_difficulty_factors", "multi_document_dependency")
    return {"answerable_has_chunks": ~F.col("answerable") | (n > 0), "unanswerable_has_none": F.col("answerable") | ((n == 0) & (d == 0)), "many_documents_flagged": (d < 2) | F.coalesce(many, F.lit(False))}


def repeated_keys(df: DataFrame, table_name: str, key: str) -> DataFrame:
    """table_name, record_id, n_extra: keys that occur more than once, with the number of extra rows."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("record_id")).agg((F.count("*") - 1).alias("n_extra")).where("n_extra > 0").select(F.lit(table_name).alias("table_name"), "record_id", "n_extra")
