"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GOLDEN = 0.6180339887498949
#: Shuffled records of a source are laid out in so many stretches, slots in stretches of so many; each is one window group.
STRETCHES, SLOTS = 4096, 1 << 16
#: Sources that a table of targets may name: it is turned into one expression.
MAX_SOURCES = 1000


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    if not os.path.isabs(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(path)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text in a public byte-level BPE vocabulary; null for null. vocabulary is a path that every executor has, or the
    name of a file that was sent to them with SparkContext.addFile."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for s in batches:
            yield s.map(lambda t: len(encode(t)), na_action="ignore").astype("Int64")

    return count(text)


def estimated_tokens(text: str) -> Column:
    """A quarter of the characters, where no vocabulary is at hand; null for null."""
    return F.floor(F.length(text) / 4)


def clean_source(c: str) -> Column:
    """One spelling per source: trimmed, lower case, '-' and blanks as '_'."""
    return F.translate(F.lower(F.trim(F.col(c))), "- ", "__")


def _totals_before(df: DataFrame, group: str, stretch: str, order: list[str], value: Column) -> DataFrame:
    """df with `before`: the sum of value over all rows of the group that come earlier, by stretch, then order.
    Two steps (sums of stretches, then rows inside a stretch), so no task holds a whole group."""
    sums = df.groupBy(group, stretch).agg(F.sum(value).alias("_sum"))
    w = W.partitionBy(group).orderBy(stretch).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(group, stretch, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(group, stretch).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    running = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return running.join(offsets, [group, stretch]).withColumn("before", F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")


def schedule(weights: list[tuple[str, float]], slots: int, spark) -> DataFrame:
    """slot, source, nth (0-based number of the slot within its source). Slot i takes the golden-ratio point
    frac((i + 1) * 0.618...) through the cumulative weights; any run of slots has its shares to within a few slots."""
    cumulative, total = [], sum(w for _, w in weights)
    for _, w in weights:
        cumulative.append((cumulative[-1] if cumulative else 0.0) + w / total)
    names = F.array(*(F.lit(s) for s, _ in weights))
    upto = F.array(*(F.lit(c) for c in cumulative[:-1] or [1.0]))
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    point = point - F.floor(point)
    index = F.size(F.filter(upto, lambda c: c <= point))
    rows = spark.range(slots).withColumnRenamed("id", "slot").withColumn("source", F.element_at(names, index + 1)).withColumn("stretch", F.floor(F.col("slot") / SLOTS))
    return _totals_before(rows, "source", "stretch", ["slot"], F.lit(1)).select("slot", "source", F.col("before").alias("nth"))


def mix(records: DataFrame, targets: DataFrame, block_tokens: int = 512, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """records: id, source, n_tokens; targets: source, target_share, max_repeats. Returns (uses, report).

    uses: id, source, n_tokens, repeats, one row per record that is used. report: one row per target source with the
    tokens it has and gives, its passes, and target and actual share.

    The records of a source are shuffled by hash and laid end to end; a record belongs to the block of block_tokens
    in which it begins. Slots of the schedule are dealt to sources by weight, and the nth slot of a source takes its
    block n modulo the number of blocks, so no block is used more often than the source's max_repeats. total_tokens
    defaults to the largest mixture in which every source can give its share under its cap; above it, sources fall
    short and the report says so. Records of sources without a target, with a null id or source, or without tokens
    are not used. A target source without records gives nothing and is left out of the default total. Repeated ids are
    records of their own. The table of targets must name at most MAX_SOURCES sources, each once.
    """
    spark = records.sparkSession
    wanted = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").cast("double").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    goal = wanted.limit(MAX_SOURCES + 1).collect()
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    names = sorted(r["source"] for r in goal)
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")  # 60 bits
    rows = records.select("id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).where(F.col("id").isNotNull() & F.col("source").isin(names) & (F.col("n_tokens") > 0))
    rows = staged(rows.withColumn("key", key).withColumn("stretch", F.shiftright("key", 60 - STRETCHES.bit_length() + 1)), "mix-records")
    # At most MAX_SOURCES rows: one sum per target source.
    have = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    weight, cap = {r["source"]: r["target_share"] for r in goal}, {r["source"]: r["max_repeats"] or 0 for r in goal}
    usable = [s for s in names if have.get(s) and cap[s] > 0]
    shares = sum(weight.values())
    if total_tokens is None:
        total_tokens = int(min((have[s] * cap[s] * shares / weight[s] for s in usable), default=0))
    slots = total_tokens // block_tokens if usable else 0
    blocks = {s: -(-have[s] // block_tokens) for s in usable}

    placed = _totals_before(rows, "source", "stretch", ["key", "id"], F.col("n_tokens")).withColumn("block", F.floor(F.col("before") / block_tokens))
    of = lambda d: F.element_at(F.create_map(*(x for s in usable for x in (F.lit(s), F.lit(d[s]).cast("long")))), F.col("source")) if usable else F.lit(None).cast("long")
    plan = schedule([(s, weight[s]) for s in names] or [("", 1.0)], slots, spark)
    plan = plan.where(F.col("source").isin(usable)).withColumn("block", F.col("nth") % of(blocks)).where(F.col("nth") < of(blocks) * of(cap))
    repeats = plan.groupBy("source", "block").agg(F.count("*").alias("repeats"))
    uses = placed.join(repeats, ["source", "block"]).select("id", "source", "n_tokens", "repeats")

    given = uses.groupBy("source").agg(F.count("*").alias("n_used"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"))
    held = rows.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("tokens"))
    all_ = W.partitionBy()  # over one row per target source
    report = (
        wanted.join(held, "source", "left")
        .join(given, "source", "left")
        .fillna(0, ["n_records", "tokens", "n_used", "most_repeats", "tokens_used"])
        .withColumn("passes", F.round(F.col("tokens_used") / F.greatest("tokens", F.lit(1)), 4))
        .withColumn("actual_share", F.round(F.col("tokens_used") / F.greatest(F.sum("tokens_used").over(all_), F.lit(1)), 6))
    )
    return uses, report.select("source", "target_share", "max_repeats", "n_records", "tokens", "n_used", "most_repeats", "passes", "tokens_used", "actual_share")
