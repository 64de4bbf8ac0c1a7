"""Structured Streaming over retrieval results: an extension, the engine's batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_results(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def delivered_once(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows without repeated deliveries: a (run, query, chunk) counts once if its copies arrive within `late`. State is bounded by
    the watermark; later copies pass."""
    keyed = stream.where("run_id IS NOT NULL AND query_id IS NOT NULL AND chunk_id IS NOT NULL AND ingested_at IS NOT NULL")
    return keyed.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["run_id", "query_id", "chunk_id"])


def activity(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per tumbling window of run_at and method: rows, distinct queries (approximate) and mean score; a window is final once
    `late` has passed."""
    rows = stream.where("run_at IS NOT NULL").withWatermark("run_at", late)
    return rows.groupBy(F.window("run_at", window), "method").agg(
        F.count("*").alias("n_rows"), F.approx_count_distinct("query_id").alias("n_queries"), F.avg(F.when(~F.isnan("score"), F.col("score"))).alias("avg_score")
    )


def append_trace(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of trace rows to a table, each row exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
