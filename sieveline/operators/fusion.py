"""Ranked lists: order, latest runs, reciprocal rank fusion, merging and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def order_key() -> Column:
    """Order of a list: score descending, the recorded rank ascending with nulls last, chunk_id."""
    return F.struct((-F.col("score")).alias("s"), F.coalesce(F.col("rank").cast("long"), F.lit(2**62)).alias("p"), F.col("chunk_id").alias("c"))


def once_per_chunk(runs: DataFrame) -> DataFrame:
    """run_id, method, query_id, chunk_id, score, key: one row per chunk and list (its first), rows without keys or score
    left out. Copies are combined before the shuffle."""
    rows = runs.where("run_id IS NOT NULL AND query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy("run_id", "method", "query_id", "chunk_id").agg(F.min(order_key()).alias("key")).withColumn("score", -F.col("key.s"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The rows of the latest run of each method."""
    last = runs.where("method IS NOT NULL").groupBy("method").agg(F.max(F.struct("run_at", "run_id")).alias("x")).select("method", F.col("x.run_id").alias("run_id"))
    return runs.join(last, ["method", "run_id"], "left_semi")


def run_rounds(runs: DataFrame, methods: tuple[str, ...] | None = None) -> DataFrame:
    """method, run_id, round of every run (of the methods named): round 1 holds the latest run of each method, round 2 the one
    before it, and so on (ties by run_id). A method with fewer runs has no list in the later rounds."""
    rows = runs.where("method IS NOT NULL AND run_id IS NOT NULL")
    if methods is not None:
        rows = rows.where(F.col("method").isin(*methods))
    each = rows.groupBy("method", "run_id").agg(F.max("run_at").alias("at"))
    place = F.row_number().over(W.partitionBy("method").orderBy(F.desc_nulls_last("at"), F.desc("run_id")))
    return each.select("method", "run_id", place.cast("long").alias("round"))


def top_lists(runs: DataFrame, k: int) -> DataFrame:
    """The first k chunks of each list with their position as rank."""
    w = W.partitionBy("run_id", "query_id").orderBy("key")
    ranked = once_per_chunk(runs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("run_id", "method", "query_id", "chunk_id", "score", "rank")


def fuse(lists: DataFrame, rrf_k: int | Column = 60, n: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of all lists of a query: the n chunks with the largest sum of 1 / (rrf_k + rank); ties by
    chunk_id; score to 6 decimals after ranking. by: further columns that keep fusions apart."""
    k = F.lit(rrf_k) if isinstance(rrf_k, int) else rrf_k
    sums = lists.groupBy(*by, "query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("sum"))
    w = W.partitionBy(*by, "query_id").orderBy(F.desc("sum"), "chunk_id")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*by, "query_id", "chunk_id", F.round("sum", 6).alias("score"), "rank")


def sweep(lists: DataFrame, ks: tuple[int, ...] = (10, 30, 60, 100), n: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """fuse for several constants at once, from the same lists."""
    each = lists.withColumn("rrf_k", F.explode(F.array(*(F.lit(k) for k in ks))))
    return fuse(each, F.col("rrf_k"), n, (*by, "rrf_k"))


def merge_best_score(rows: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of several lists of a query merged: a chunk keeps its largest score (then the smaller rank), ranked again.
    by: further columns that keep lists apart."""
    best = rows.groupBy(*by, "query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"))).alias("x"))
    w = W.partitionBy(*by, "query_id").orderBy(F.desc("x.score"), F.desc("x.r"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "query_id", "chunk_id", "x.score", "rank")


def merge_best_rank(rows: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """As merge_best_score, but a chunk keeps the row with its lowest rank (then the larger score)."""
    best = rows.groupBy(*by, "query_id", "chunk_id").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"))).alias("x"))
    w = W.partitionBy(*by, "query_id").orderBy("x.s", "x.rank", "chunk_id")
    return best.withColumn("new", F.row_number().over(w)).where(F.col("new") <= k).select(*by, "query_id", "chunk_id", (-F.col("x.s")).alias("score"), F.col("new").alias("rank"))


def assemble(decisions: DataFrame, lists: DataFrame, k: int = 10) -> DataFrame:
    """The run that a planner's decisions (query_id, selected_strategy) pick out of lists by method."""
    picked = decisions.select("query_id", F.col("selected_strategy").alias("method")).where("query_id IS NOT NULL AND method IS NOT NULL").distinct()
    return lists.where(F.col("rank") <= k).join(picked, ["query_id", "method"])
