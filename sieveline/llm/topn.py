"""Top N items within every group, by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import SEEDS, small, staged

#: A bound is worth sending only for a group with so many rows in one partition; smaller groups are ranked as they are.
MIN_ROWS = 64
#: Bounds are broadcast up to so many rows (about 100 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows a task holds before it cuts them back to the best N of each group.
BUFFER_ROWS = 200_000

_BOUND = "g1 long, g2 long, score double, place long, item string"


def _local_bounds(n: int, min_rows: int):
    """The N-th best (score, place, item) of each large group of one partition, items counted once."""

    def best(g1, g2, score, place, item, seen):
        """Sorted arrays of the first n distinct items of each group, with place in the group; seen summed into the first."""
        coded = item.dictionary_encode()
        by_text = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by_text), np.int64)
        rank[by_text] = np.arange(len(by_text))
        rank = rank[coded.indices.to_numpy()]
        o = np.lexsort((rank, place, -score, g2, g1))
        g1, g2, rank, seen = g1[o], g2[o], rank[o], seen[o]
        starts = np.flatnonzero(np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
        gid = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g1)]))
        first = np.sort(np.unique(gid * np.int64(len(by_text)) + rank, return_index=True)[1])
        gid = gid[first]
        begin = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
        nth = np.arange(len(gid)) - np.repeat(begin, np.diff(np.r_[begin, len(gid)]))
        total = np.add.reduceat(seen, starts)[gid]
        alive = nth < n
        at = o[first[alive]]
        return at, nth[alive], total[alive]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def cut():
            cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
            item, seen = pa.concat_arrays([h[4] for h in held]), np.concatenate([h[5] for h in held])
            at, nth, total = best(*cols, item, seen)
            return [c[at] for c in cols], item.take(pa.array(at)), nth, total

        for b in batches:
            if b.num_rows:
                held.append((*(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)), b.column(4), np.ones(b.num_rows, np.int64)))
                rows += b.num_rows
            if rows > BUFFER_ROWS:
                cols, item, nth, total = cut()
                held, rows = [(*cols, item, np.where(nth == 0, total, 0))], 0
        if held:
            cols, item, nth, total = cut()
            at = np.flatnonzero((nth == n - 1) & (total >= min_rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols), item.take(pa.array(at))], ["g1", "g2", "score", "place", "item"])

    return run


def top_n(df: DataFrame, group: list[str], item: str, score: str, place: str, n: int, keep: tuple[str, ...] = (), min_rows: int = MIN_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The n best items of every group: the group columns, item, score, place, the keep columns, and position (1..n).

    Order: score descending, place ascending with nulls last, item ascending; an item counts once per group, with
    its first row in that order (if such rows differ only in the keep columns, the smallest of these). Rows with a
    null in a group column or in the item, or with a null or NaN score, are left out. A group with fewer than n
    items is returned whole. Empty input gives an empty result; columns not named are ignored.

    Each partition's N-th best item of a group bounds that group's N-th best from below, so the best of these
    bounds, joined back, removes all rows that cannot be among the first N, before anything is shuffled. Groups of
    a third of all rows thus shrink to a few rows per partition. The item is part of the bound, so ties at the
    bound, however many, are cut too. Bounds are broadcast if there are few (checked), else joined by shuffle.
    keep columns must be orderable (no maps).
    """
    rank = F.coalesce(F.col(place).cast("long"), F.lit(2**62)).alias("place")
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(item).isNotNull())
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    keys = [F.xxhash64(F.lit(s), *group).alias(f"g{i + 1}") for i, s in enumerate(SEEDS)]
    rows = rows.select(*keys, F.struct(*group).alias("group"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"), rank, F.col(item).cast("string").alias("item"), F.struct(*[F.col(c) for c in (score, place, *keep)]).alias("kept"))

    local = rows.select("g1", "g2", "score", "place", "item").mapInArrow(_local_bounds(n, min_rows), _BOUND)
    best = F.struct((-F.col("score")).alias("s"), F.col("place").alias("p"), F.col("item").alias("i"))
    bounds = staged(local.groupBy("g1", "g2").agg(F.min(best).alias("bound")), "topn-bounds")
    if small(bounds, broadcast_rows):
        bounds = F.broadcast(bounds)
    alive = rows.join(bounds, ["g1", "g2"], "left").where(F.col("bound").isNull() | (best <= F.col("bound")))

    first = F.min(F.struct((-F.col("score")).alias("s"), F.col("place").alias("p"), F.col("kept").alias("k"))).alias("first")
    once = alive.groupBy("group", "item").agg(first)
    w = W.partitionBy("group").orderBy("first.s", "first.p", "item")
    out: list[Column] = [F.col(f"group.{g}").alias(g) for g in group]
    out += [F.col("item").alias(item), *(F.col(f"first.k.{c}").alias(c) for c in (score, place, *keep)), F.col("position")]
    return once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select(*out)
