"""BM25 as a saved index of postings and term statistics, and searches over it by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import finished_token, tokens, with_raw_tokens
from ..session import small, staged

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms that may be broadcast (checked); beyond it postings and terms are joined by shuffle, a term at SALTS places.
BROADCAST_TERMS, SALTS = 200_000, 32
#: Postings that all queries together may score outright; beyond it chunks that cannot reach the top are left out first.
DIRECT = 50_000_000


@dataclass
class Index:
    """postings: chunk_id, dl, term, tf. terms: term, df, cf, max_tf, min_dl, idf0. stats: one row of n_chunks, first_chunk,
    total_length, mean_idf0."""

    postings: DataFrame
    terms: DataFrame
    n_chunks: int
    first_chunk: str | None
    mean_length: float
    mean_idf: float

    def weighted(self) -> DataFrame:
        """term, df, idf, bound: ln((N - df + 0.5) / (df + 0.5)), where that is negative EPSILON times its mean over all terms; and
        the most that one chunk can have of the term, as a factor of idf."""
        idf = F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(EPSILON * self.mean_idf)
        return self.terms.select("term", "df", idf.alias("idf"), self.saturated(F.col("max_tf"), F.col("min_dl")).alias("bound"))

    def saturated(self, tf: Column, dl: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(self.mean_length)))


def postings(chunks: DataFrame, text: Column) -> DataFrame:
    """chunk_id, dl, term, tf for each term of each chunk. Chunks without a term have no posting.

    If chunks is already partitioned by chunk_id (as one_per_key leaves it), nothing is shuffled. explode_outer, as a
    filter inferred from explode would tokenize every text a second time.
    """
    each = with_raw_tokens(chunks, text).select("chunk_id", F.explode_outer("raw").alias("raw")).select("chunk_id", finished_token(F.col("raw")).alias("term")).where("term IS NOT NULL")
    counts = each.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    return counts.withColumn("dl", F.sum("tf").over(W.partitionBy("chunk_id"))).select("chunk_id", "dl", "term", "tf")


def build(chunks: DataFrame, text: Column, folder: str | None = None) -> Index:
    """The index of chunks (chunk_id, one row each), with text as an expression over their columns; written to folder, from where
    load reads it again, or else to the shared folder for this session."""
    keep = lambda df, name: staged(df, name) if folder is None else _written(df, f"{folder}/{name}")
    posted = keep(postings(chunks, text), "postings")
    n, first = chunks.agg(F.count("*"), F.min("chunk_id")).first()
    terms = posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    terms = keep(terms.withColumn("idf0", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    total, mean = terms.agg(F.sum("cf"), F.avg("idf0")).first()  # over the whole vocabulary
    if folder is not None:
        _written(chunks.sparkSession.createDataFrame([(n, first, total, mean)], _STATS), f"{folder}/stats")
    return Index(posted, terms, n, first, (total or 0) / n if total else 1.0, mean or 0.0)


_STATS = "n_chunks long, first_chunk string, total_length long, mean_idf0 double"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, folder: str) -> Index:
    """An index that build has written."""
    n, first, total, mean = spark.read.parquet(f"{folder}/stats").first()
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms"), n, first, (total or 0) / n if total else 1.0, mean or 0.0)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: queries (query_id, query_text) keep their stop words, and repeated words count as often as they stand."""
    each = queries.select("query_id", F.explode(tokens(F.col("query_text"), keep_stop_words=True)).alias("term"))
    return each.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _scores(index: Index, asked: DataFrame, broadcast_terms: int) -> DataFrame:
    """query_id, chunk_id, score of all chunks that have one of the terms asked (query_id, term, weight)."""
    held = index.postings
    on = ["term"]
    if small(asked, broadcast_terms):
        asked = F.broadcast(asked)
    else:
        asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
        on = ["term", "salt"]
    part = F.col("weight") * index.saturated(F.col("tf"), F.col("dl"))
    return held.join(asked.select("query_id", "weight", *on), on).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def _pruned(index: Index, asked: DataFrame, k: int, broadcast_terms: int) -> DataFrame:
    """_scores of all chunks that can be among the first k of a query, from asked with the columns df, weight and bound.

    The two rarest terms of a query are scored first; the k-th score so found is a bound that the final k-th score cannot
    fall below. Terms whose largest parts together stay under it cannot bring a chunk to the top on their own: chunks are
    found by the other terms only, and just these chunks are looked up for the rest."""
    rare = F.row_number().over(W.partitionBy("query_id").orderBy("df", "term"))
    first = _scores(index, asked.withColumn("place", rare).where("place <= 2"), broadcast_terms)
    kth = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") <= k)
    kth = kth.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") == k, F.col("least")).otherwise(0.0).alias("least"))
    most = F.col("weight") * F.col("bound")
    upto = F.sum(most).over(W.partitionBy("query_id").orderBy(most, "term").rowsBetween(W.unboundedPreceding, 0))
    ranked = staged(asked.join(kth, "query_id", "left").withColumn("most", most).withColumn("weak", upto < F.coalesce("least", F.lit(0.0)) - 1e-5), "bm25-terms")
    found = _scores(index, ranked.where("NOT weak"), broadcast_terms)
    spare = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("weak"), F.col("most")).otherwise(0.0)).alias("spare"), F.max("least").alias("least"))
    found = found.join(spare, "query_id").where("score + spare >= coalesce(least, 0D) - 1e-5").select("query_id", "chunk_id", "score")
    rest = found.select("query_id", "chunk_id").join(ranked.where("weak").select("query_id", "term", "weight"), "query_id").join(index.postings, ["chunk_id", "term"])
    rest = rest.select("query_id", "chunk_id", (F.col("weight") * index.saturated(F.col("tf"), F.col("dl"))).alias("score"))
    return found.unionByName(rest).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))


def bm25(index: Index, queries: DataFrame, k: int = 10, broadcast_terms: int = BROADCAST_TERMS, direct: int = DIRECT) -> DataFrame:
    """query_id, chunk_id, score (6 decimals), rank: the k best chunks of each query (query_id, query_text) with a positive score,
    ties by chunk_id. A query with terms of which the index knows none gets its first chunk, with score 0; one
    without any term gets no row.

    Up to `direct` postings of query terms are scored outright; above, chunks that cannot reach the first k are left
    out by bounds, which changes no result.
    """
    all_ = staged(query_terms(queries).join(index.weighted(), "term", "left").withColumn("weight", F.col("qtf") * F.col("idf")), "query-terms")
    asked = all_.where("df IS NOT NULL")
    work = asked.agg(F.sum("df")).first()[0] or 0
    scores = _scores(index, asked, broadcast_terms) if work <= direct else _pruned(index, asked, k, broadcast_terms)
    scores = scores.select("query_id", "chunk_id", F.round("score", 6).alias("score")).where("score > 0")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    nothing = all_.groupBy("query_id").agg(F.count("df").alias("n")).where("n = 0")
    nothing = nothing.select("query_id", F.lit(index.first_chunk).alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("chunk_id IS NOT NULL")
    return top.unionByName(nothing)


def pair_scores(index: Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (query_id, chunk_id, ...) with bm25: the score of just these chunks, 0 without a common term."""
    asked = query_terms(queries).join(index.weighted(), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    wanted = pairs.select("query_id", "chunk_id").distinct()
    each = wanted.join(asked, "query_id").join(index.postings, ["chunk_id", "term"])
    sums = each.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * index.saturated(F.col("tf"), F.col("dl"))).alias("bm25"))
    return pairs.join(sums, ["query_id", "chunk_id"], "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 6))
