"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """Typed JSON Lines. strict: a row that does not parse fails the job, else it is dropped. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A report as one CSV file with a header; arrays are joined with '|'. Meant for aggregated reports."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_runs(df: DataFrame, path: str, mode: str = "error") -> None:
    """The fact table of ranked rows, partitioned by method so that a planner reads only the methods it needs."""
    df.write.mode(mode).partitionBy("method").parquet(path)


def schema_json(df: DataFrame) -> str:
    return df.schema.json()


def cache_key(query_id: str = "query_id", model: str = "model", prompt: str = "prompt_version"):
    """Key of a response cache: the three parts joined by '__', with '/', ':' and blanks as '_'."""
    return F.translate(F.concat_ws("__", query_id, model, prompt), "/: ", "___")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached raw_response, null on a miss; the cache holds one row per cache_key."""
    one = cache.groupBy("cache_key").agg(F.max_by("raw_response", "created_at").alias("raw_response"))
    return requests.withColumn("cache_key", cache_key()).join(one, "cache_key", "left").withColumn("cache_hit", F.col("raw_response").isNotNull())


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """An aggregated report as one file of JSON Lines, one object per row; nulls are kept."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_baseline(spark: SparkSession, path: str, k: int, schema: StructType | None = None) -> DataFrame:
    """Saved metrics (write_report) at one k: what a later run is compared with. The filter reaches the scan."""
    return (spark.read.schema(schema) if schema else spark.read).json(path).where(F.col("k") == k)


def inherited_metadata(chunks: DataFrame, docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """chunks (chunk_id, document_id) with the named columns of their document, and missing: the names of those that are null, or
    of all of them where the document is not there."""
    joined = chunks.join(docs.select("document_id", *keys), "document_id", "left")
    return joined.withColumn("missing", F.filter(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in keys)), lambda x: x.isNotNull()))
