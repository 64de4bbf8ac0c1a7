"""One search call for all strategies, and dependent (two-stage) retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense, fusion, sparse

#: Results a call gives by default and at most, and candidates of each side of a fusion.
TOP, MOST, CANDIDATES = 10, 50, 100


def search(strategy: str, index: sparse.Index | None, queries: DataFrame | None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = TOP, rrf_k: int = 10) -> DataFrame:
    """query_id, chunk_id, score, rank by 'bm25', 'dense', or both fused (any other strategy). k is at most MOST.

    index: of chunks, built or loaded; queries: query_id, query_text; vectors and query_vectors: id, v, where ids are longs and equal
    the ids of chunks and queries as strings."""
    k = min(k, MOST)
    each = k if strategy in ("bm25", "dense") else CANDIDATES
    if strategy == "bm25":
        return sparse.bm25(index, queries, each)
    near = dense.nearest(vectors, query_vectors, each).select(F.col("query_id").cast("string").alias("query_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "score", "rank")
    if strategy == "dense":
        return near
    lexical = sparse.bm25(index, queries, each)
    as_text = lexical.select(F.col("query_id").cast("string").alias("query_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "score", "rank")
    return fusion.fuse(as_text.unionByName(near), rrf_k, k)


def fill_from(first: DataFrame, dependent: DataFrame, chunks: DataFrame, n: int = 3) -> DataFrame:
    """Queries of the second stage: dependent (query_id, query_text with '{slot}', slot, needs) with the slot filled by the document
    of the best of the first n chunks that first (query_id, chunk_id, rank) found for the query it needs; unfilled if none."""
    best = first.where(F.col("rank") <= n).join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy(F.col("query_id").alias("needs")).agg(F.min_by("document_id", F.struct("rank", "chunk_id")).alias("value"))
    filled = F.replace(F.col("query_text"), F.concat(F.lit("{"), F.col("slot"), F.lit("}")), F.coalesce("value", F.concat(F.lit("{"), F.col("slot"), F.lit("}"))))
    return dependent.join(best, "needs", "left").select("query_id", filled.alias("query_text"))
