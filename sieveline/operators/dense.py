"""Exact dense retrieval: blocks of queries meet cells of vectors in tasks, which keep their local top k; a window ranks them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Query vectors of one block and vectors of one cell; a task holds one of each.
BLOCK, CELL = 8192, 32_768
#: Queries multiplied at once.
STRIPE = 256


def unit(vector: str) -> Column:
    """The vector as doubles of length 1; a zero vector stays as it is."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _matrix(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of the rows with vectors of that dimension."""
    t = t.filter(pc.equal(pc.list_value_length(t["v"]), dim))
    return t["id"].to_numpy(), pc.list_flatten(t["v"]).to_numpy().reshape(t.num_rows, dim)


def _local_top(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(cell: pa.Table, block: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        for dim in pc.unique(pc.list_value_length(block["v"])).to_pylist():
            own, vectors = _matrix(cell, dim)
            ids, asked = _matrix(block, dim)
            keep = min(k, len(own))
            for a in range(0, len(ids) if keep else 0, STRIPE):
                q = ids[a : a + STRIPE]
                score = np.round(asked[a : a + STRIPE] @ vectors.T, 6)
                score[q[:, None] == own[None, :]] = -np.inf  # a row does not find itself
                # All rows that reach the k-th best score, so ties are left to the ranking.
                bound = np.partition(score, -keep, axis=1)[:, -keep]
                at_q, at_c = np.nonzero((score >= bound[:, None]) & np.isfinite(score))
                for out, x in zip(found, (q[at_q], own[at_c], score[at_q, at_c])):
                    out.append(x)
        return pa.table([pa.array(np.concatenate(x)) for x in found], names=["query_id", "chunk_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """query_id, chunk_id, score, rank: the k rows of vectors (id, v) with the largest inner product for each row of
    queries (id, v), ties by id; a row does not find itself. ids are longs, v arrays of doubles; rows with a null in
    either are left out, and vectors meet queries of their own dimension only.

    Vectors are read once and dealt into cells, queries into blocks, both by a hash of the id and of bounded size; each pair
    of a cell and a block is the work of one task. No vector comes to the driver.
    """
    clean = "id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)"
    of = lambda df: df.where(clean).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    blocks, cells = max(1, -(-queries.select("id").count() // block)), max(1, -(-vectors.select("id").count() // cell))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = of(vectors).withColumn("cell", place(cells)).withColumn("block", every(blocks))
    asked = of(queries).withColumn("block", place(blocks)).withColumn("cell", every(cells))
    found = held.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(_local_top(k), "query_id long, chunk_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
