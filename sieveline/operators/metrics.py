"""Retrieval metrics per query and their means over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import once_per_chunk
from .references import clean_key

KS = (1, 3, 5, 10)
#: Lists (run_id) that one evaluation may cover: each is set against all queries.
MAX_RUNS = 1000
#: Places over which the rows of one list are spread when ranks are counted.
SALTS = 16


def one_per_key(df: DataFrame, key: str, *columns: str, order: str = "ingested_at") -> DataFrame:
    """key and columns (all if none are named) of the row of each non-null key that came last by order; repeated deliveries
    are combined before the shuffle. Name the columns: others are then not read from the files."""
    rest = list(columns) or [c for c in df.columns if c not in (key, order)]
    tie = F.xxhash64(*[c for c in rest if not dict(df.dtypes)[c].startswith("map")]) if rest else F.lit(0)
    row = F.max_by(F.struct(*rest), F.struct(F.col(order), tie)).alias("x")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *(F.col(f"x.{c}").alias(c) for c in rest))


def relevant(queries: DataFrame, answerable_only: bool = True) -> DataFrame:
    """query_id, chunk_id: the required chunks of each query, ids in one spelling; queries without any are skipped. A query that
    does not say whether it can be answered counts as one that can."""
    q = queries.where("coalesce(answerable, true)") if answerable_only else queries
    return q.select("query_id", F.explode("required_chunk_ids").alias("c")).select("query_id", clean_key("c").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()


def relevant_ranks(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """run_id, method, query_id, chunk_id, rank of every required chunk that a list has. The rank is counted from the rows that
    precede it: rows are spread over SALTS places by their chunk, each of which knows all hits of the list, so a list of
    any length is never gathered in one task."""
    rows = once_per_chunk(runs)
    hits = rows.withColumn("id", clean_key("chunk_id")).join(qrels.select("query_id", F.col("chunk_id").alias("id")), ["query_id", "id"], "left_semi")
    hits = hits.select("run_id", "query_id", F.col("key").alias("hit"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ahead = rows.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")).join(hits, ["run_id", "query_id", "salt"]).where(F.col("key") <= F.col("hit"))
    return ahead.groupBy("run_id", "method", "query_id", F.col("hit.c").alias("chunk_id")).agg(F.count("*").alias("rank"))


def query_metrics(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, rounds: DataFrame | None = None) -> DataFrame:
    """method, query_id, k, n_relevant, n_retrieved_relevant, recall, precision, mrr, ndcg, hit for every required query and
    every method of runs (one run per method), also where the method returned nothing. With rounds (method, run_id, round;
    fusion.run_rounds), runs may hold any number of runs per method, and round is a further column.

    precision divides by k; mrr looks at the whole list whatever k is; ndcg is binary, with log2(rank + 1).
    """
    need = qrels.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    if rounds is not None:
        lists = ("round", "method")
        base = need.crossJoin(F.broadcast(rounds.select(*lists)))
        return _measured(base, relevant_ranks(runs, qrels).join(rounds, ["run_id", "method"]), lists, ks)
    methods = [r[0] for r in runs.select("method").where("method IS NOT NULL").distinct().limit(MAX_RUNS + 1).collect()]
    if len(methods) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs")
    base = need.select("query_id", "n_relevant", F.explode(F.array(*(F.lit(m) for m in sorted(methods))) if methods else F.array().cast("array<string>")).alias("method"))
    return _measured(base, relevant_ranks(runs, qrels), ("method",), ks)


def _measured(base: DataFrame, ranks: DataFrame, lists: tuple[str, ...], ks: tuple[int, ...]) -> DataFrame:
    """The measures of every row of base (lists, query_id, n_relevant) from the ranks found."""
    ranks = ranks.groupBy(*lists, "query_id").agg(F.collect_list("rank").alias("ranks"))  # at most n_relevant each
    joined = base.join(ranks, [*lists, "query_id"], "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<bigint>")))
    each = joined.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))))
    within = F.filter("ranks", lambda r: r <= F.col("k"))
    gain = lambda r: 1.0 / F.log2(r + 1.0)
    dcg = F.aggregate(F.array_sort(within), F.lit(0.0), lambda a, r: a + gain(r))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", "k").cast("int")), F.lit(0.0), lambda a, r: a + gain(r))
    n = F.size(within).cast("long")
    return each.select(
        *lists, "query_id", "k", "n_relevant", n.alias("n_retrieved_relevant"), F.round(n / F.col("n_relevant"), 6).alias("recall"), F.round(n / F.col("k"), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.array_min("ranks"), F.lit(0.0)), 6).alias("mrr"), F.round(dcg / ideal, 6).alias("ndcg"), F.when(n > 0, 1.0).otherwise(0.0).alias("hit"),
    )


MEANS = ("recall", "precision", "mrr", "ndcg", "hit")


def means(metrics: DataFrame, *by: str) -> DataFrame:
    """Macro means over queries per group: n_queries and the MEANS, 4 decimals."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 4).alias(c) for c in MEANS))


def means_by_attributes(metrics: DataFrame, queries: DataFrame, attributes: tuple[str, ...] = ("category", "reasoning_type", "difficulty"), by: tuple[str, ...] = ()) -> DataFrame:
    """means per method, k, by, and value of each attribute in turn, by grouping sets in one pass; null or '' counts as 'unknown'."""
    q = queries.select("query_id", *(F.coalesce(F.when(F.col(a) != "", F.col(a)), F.lit("unknown")).alias(a) for a in attributes))
    rows = metrics.join(q, "query_id", "left").fillna("unknown", list(attributes))
    stacked = rows.select(*metrics.columns, F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes))).alias("g"))
    return means(stacked.select("*", "g.attribute", "g.value"), *by, "method", "k", "attribute", "value")


def means_by_factor(metrics: DataFrame, queries: DataFrame, factors: str = "retrieval_difficulty_factors", by: tuple[str, ...] = ()) -> DataFrame:
    """means per method, k, by and difficulty factor; a query counts once in the group of each of its factors, or under 'none'."""
    f = F.when(F.size(factors) > 0, F.array_distinct(factors)).otherwise(F.array(F.lit("none")))
    q = queries.select("query_id", F.explode(f).alias("factor"))
    return means(metrics.join(q, "query_id"), *by, "method", "k", "factor")
