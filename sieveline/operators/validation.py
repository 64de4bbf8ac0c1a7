"""Validation of retrieved evidence: relevance scores, verdicts with a diagnosis, bounded retries, extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Least relevance by question type (others the default), passing chunks needed, and what counts as zero.
THRESHOLDS, DEFAULT, NEEDED, ZERO, MOSTLY = {"temporal": 0.20, "exception": 0.22, "multi_hop": 0.20}, 0.30, 3, 0.05, 0.6
#: The strategy that suits a question type; hybrid for all others.
SUITS = {"temporal": "bm25", "exception": "dense"}


def by_type(values: dict[str, object], default: object, c: str = "reasoning_type") -> Column:
    """The value of a question type, or the default."""
    out = None
    for k, v in values.items():
        out = F.when(F.col(c) == k, v) if out is None else out.when(F.col(c) == k, v)
    return F.lit(default) if out is None else out.otherwise(default)


def _four(x: Column) -> Column:
    """x to 4 decimals, half up, by plain arithmetic that every engine does alike."""
    return F.floor(x * 10_000 + 0.5) / 10_000


def relevance(lists: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """lists (method, query_id, chunk_id, score, rank) with rank_proxy, lexical (score over the largest of the query's list),
    dense (score cut to 0..1) and adaptive (lexical for bm25, dense for dense, the mean of both otherwise), 4 decimals.
    by, here and below: further columns that keep lists apart."""
    w = W.partitionBy(*by, "method", "query_id")
    top = F.max("score").over(w)
    lexical = F.when(top < 1e-9, 0.0).otherwise(_four(F.greatest(F.col("score"), F.lit(0.0)) / top))
    dense = _four(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    rows = lists.withColumn("rank_proxy", F.round(F.greatest(F.lit(0.0), 1.0 - (F.col("rank") - 1) * 0.1), 4)).withColumn("lexical", lexical).withColumn("dense", dense)
    mean = F.floor((F.round(F.col("lexical") * 10_000) + F.round(F.col("dense") * 10_000)) / 2 + 0.5) / 10_000
    adaptive = F.when(F.col("method") == "dense", F.col("dense")).when(F.col("method") == "bm25", F.col("lexical")).otherwise(mean)
    return rows.withColumn("adaptive", adaptive)


def verdicts(scored: DataFrame, queries: DataFrame, scorer: str = "adaptive", by: tuple[str, ...] = ()) -> DataFrame:
    """method, query_id, reasoning_type, n_chunks, n_passed, passed, failure_reason, suggested_strategy for every query and every
    method that scored has. A list passes with NEEDED chunks at or above the threshold of its question type; else the
    first reason that holds is given, with the strategy to try next (null: the same again). If queries have a query_text, one
    of several hops that still has a slot in it misses an entity."""
    kinds = _kinds(queries)
    base = kinds.crossJoin(F.broadcast(scored.select("method").where("method IS NOT NULL").distinct()))
    if by:
        base = base.crossJoin(F.broadcast(scored.select(*by).distinct()))
    rows = base.join(scored.select(*by, "method", "query_id", F.col(scorer).alias("x")), [*by, "method", "query_id"], "left")
    count = lambda c: F.count(F.when(c, 1))
    v = rows.groupBy(*by, "method", "query_id", "reasoning_type", "open_slot").agg(F.count("x").alias("n_chunks"), count(F.col("x") >= by_type(THRESHOLDS, DEFAULT)).alias("n_passed"), count(F.col("x") < ZERO).alias("n_zero"))
    return _judged(v).select(*by, "method", "query_id", "reasoning_type", "n_chunks", "n_passed", "passed", "failure_reason", "suggested_strategy")


def _kinds(queries: DataFrame, *keep: str) -> DataFrame:
    """query_id, the columns to keep, open_slot and reasoning_type of each query."""
    slot = F.coalesce((F.col("reasoning_type") == "multi_hop") & F.col("query_text").rlike(r"\{\w+\}"), F.lit(False)) if "query_text" in queries.columns else F.lit(False)
    return queries.select("query_id", *keep, slot.alias("open_slot"), F.coalesce("reasoning_type", F.lit("unknown")).alias("reasoning_type"))


def _judged(v: DataFrame) -> DataFrame:
    """v (method, reasoning_type, open_slot, n_chunks, n_passed, n_zero) with passed, failure_reason and suggested_strategy."""
    v = v.withColumn("passed", F.col("n_passed") >= NEEDED).withColumn("suits", by_type(SUITS, "hybrid"))
    fits, hybrid = F.col("method") == F.col("suits"), F.col("method") == "hybrid"
    all_zero = F.col("n_zero") == F.col("n_chunks")
    reason = (
        F.when(F.col("passed"), F.lit(None).cast("string"))
        .when(F.col("n_chunks") == 0, "no_chunks")
        .when(all_zero & fits & hybrid, "too_narrow")
        .when(all_zero, "wrong_strategy")
        .when(F.col("open_slot"), "missing_entity")
        .when(~fits & (F.col("n_zero") > MOSTLY * F.col("n_chunks")), "wrong_strategy")
        .when(F.col("n_passed") > 0, "insufficient_coverage")
        .otherwise("low_quality")
    )
    v = v.withColumn("failure_reason", reason)
    next_ = (
        F.when(F.col("failure_reason") == "no_chunks", "hybrid")
        .when((F.col("failure_reason") == "wrong_strategy") & ~fits, F.col("suits"))
        .when((F.col("failure_reason") == "wrong_strategy"), "hybrid")
        .when(F.col("failure_reason") == "missing_entity", F.col("method"))
        .when(F.col("failure_reason").isin("insufficient_coverage", "low_quality") & ~hybrid, "hybrid")
    )
    return v.withColumn("suggested_strategy", next_)


def retry(start: DataFrame, judged: DataFrame, loops: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, strategy, loop_count, passed, failure_reason after up to `loops` retries: in each pass all queries that still
    fail take the suggested strategy, or keep theirs, and look up its verdict. start: query_id, strategy."""
    v = judged.select(*by, "query_id", F.col("method").alias("strategy"), "passed", "failure_reason", "suggested_strategy")
    state = start.join(v, [*by, "query_id", "strategy"], "left").withColumn("loop_count", F.lit(0))
    for _ in range(loops):
        failing = ~F.coalesce("passed", F.lit(False))
        moved = state.select(*by, "query_id", F.when(failing, F.coalesce("suggested_strategy", "strategy")).otherwise(F.col("strategy")).alias("strategy"), (F.col("loop_count") + failing.cast("int")).alias("loop_count"))
        state = moved.join(v, [*by, "query_id", "strategy"], "left")
    return state.select(*by, "query_id", "strategy", "loop_count", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("failure_reason", F.when(F.col("passed"), F.lit(None)).otherwise("no_chunks")).alias("failure_reason"))


def loop_statistics(outcome: DataFrame, kinds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per question type: queries, pass rate, mean loops, and the most frequent failure reason (ties by name)."""
    rows = outcome.join(kinds.select("query_id", F.coalesce("reasoning_type", F.lit("unknown")).alias("reasoning_type")), "query_id")
    sums = rows.groupBy(*by, "reasoning_type").agg(F.count("*").alias("n_queries"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"), F.round(F.avg("loop_count"), 3).alias("mean_loops"))
    reasons = rows.where("NOT passed AND failure_reason IS NOT NULL").groupBy(*by, "reasoning_type", "failure_reason").agg(F.count("*").alias("n"))
    top = reasons.groupBy(*by, "reasoning_type").agg(F.min(F.struct((-F.col("n")).alias("n"), "failure_reason")).alias("x")).select(*by, "reasoning_type", F.col("x.failure_reason").alias("top_failure_reason"))
    return sums.join(top, [*by, "reasoning_type"], "left")


def retried(scored: DataFrame, queries: DataFrame, loops: int = 3, scorer: str = "adaptive", by: tuple[str, ...] = ()) -> DataFrame:
    """What verdicts and retry give, but only for the queries that scored has a list of: by, query_id, reasoning_type, strategy,
    loop_count, passed, failure_reason. All verdicts of a query are in one row, and its retries stay in that row: nothing as
    long as by x queries is made or joined. queries: query_id, reasoning_type, strategy (the first), and query_text."""
    lists = scored.groupBy(*by, "method", "query_id").agg(F.collect_list(scorer).alias("x"))  # as long as a list
    rows = lists.join(_kinds(queries, "strategy").hint("merge"), "query_id")  # as many as queries: never sent to the driver
    size = lambda f: F.size(F.filter("x", f))
    v = rows.withColumns({"n_chunks": F.size("x"), "n_passed": size(lambda x: x >= by_type(THRESHOLDS, DEFAULT)), "n_zero": size(lambda x: x < ZERO)})
    one = F.struct("method", F.struct("passed", "failure_reason", "suggested_strategy"))
    each = _judged(v).groupBy(*by, "query_id", "reasoning_type", "strategy").agg(F.map_from_entries(F.collect_list(one)).alias("v"))  # one per method
    missing = F.struct(F.lit(False).alias("passed"), F.lit("no_chunks").alias("failure_reason"), F.lit("hybrid").alias("suggested_strategy"))
    verdict = lambda strategy: F.coalesce(F.try_element_at("v", strategy), missing)

    def turn(s: Column, _: Column) -> Column:
        x = verdict(s["strategy"])
        after = F.struct(F.coalesce(x["suggested_strategy"], s["strategy"]).alias("strategy"), (s["loop_count"] + 1).alias("loop_count"))
        return F.when(x["passed"], s).otherwise(after)

    turns = F.array(*(F.lit(i) for i in range(loops))) if loops else F.array().cast("array<int>")
    end = each.withColumn("s", F.aggregate(turns, F.struct("strategy", F.lit(0).alias("loop_count")), turn)).withColumn("x", verdict(F.col("s.strategy")))
    return end.select(*by, "query_id", "reasoning_type", "s.strategy", "s.loop_count", "x.passed", "x.failure_reason")


def retried_statistics(outcome: DataFrame, queries: DataFrame, every: DataFrame, loops: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """loop_statistics of all queries in each row of every (by), from the outcome that retried gives. Queries without any list
    fail with no_chunks after all loops, so they are counted, not listed: all queries of a type count so at first, and
    those with an outcome are taken off again."""
    keys = (*by, "reasoning_type")
    long = lambda i: F.lit(i).cast("long")
    part = lambda reason, n, passed, turns: F.struct(reason.alias("failure_reason"), n.alias("n"), passed.alias("n_passed"), turns.alias("loops"))
    none = F.lit("no_chunks")
    found = outcome.groupBy(*keys, "failure_reason").agg(F.count("*").alias("n"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"), F.sum("loop_count").alias("loops"))
    found = found.select(*keys, F.inline(F.array(part(F.col("failure_reason"), F.col("n"), F.col("n_passed"), F.col("loops")), part(none, -F.col("n"), long(0), -loops * F.col("n")))))
    types = _kinds(queries).groupBy("reasoning_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(every))
    start = types.select(*keys, none.alias("failure_reason"), "n", long(0).alias("n_passed"), (loops * F.col("n")).alias("loops"))
    sums = start.unionByName(found).groupBy(*keys, "failure_reason").agg(*(F.sum(c).alias(c) for c in ("n", "n_passed", "loops")))
    top = F.min(F.when(F.col("failure_reason").isNotNull() & (F.col("n") > 0), F.struct((-F.col("n")).alias("n"), "failure_reason")))
    rows = sums.groupBy(*keys).agg(F.sum("n").alias("n_queries"), F.sum("n_passed").alias("passed"), F.sum("loops").alias("loops"), top.alias("x"))
    rate = lambda c, digits: F.round(F.col(c) / F.col("n_queries"), digits)
    return rows.select(*keys, "n_queries", rate("passed", 4).alias("pass_rate"), rate("loops", 3).alias("mean_loops"), F.col("x.failure_reason").alias("top_failure_reason"))


def loop_histogram(outcome: DataFrame, *by: str) -> DataFrame:
    """by, loop_count, n_queries, n_passed."""
    return outcome.groupBy(*by, F.col("loop_count").cast("long").alias("loop_count")).agg(F.count("*").alias("n_queries"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"))


#: Experiments by name: whether question types are given (else told from the wording), the scorer, and the retries.
EXPERIMENTS = (("v2_oracle", True, "adaptive", 3), ("v2_oracle_noloop", True, "adaptive", 0), ("v2_oracle_rankproxy", True, "rank_proxy", 3), ("v2_heuristic", False, "adaptive", 3))
#: Ways to score a chunk; a column of relevance each, more by with_scorer.
SCORERS = ("rank_proxy", "lexical", "dense", "adaptive")


def with_scorer(scored: DataFrame, name: str, score: Column) -> DataFrame:
    """scored with a scorer of one's own, cut to 0..1 with 4 decimals; where it is null the rank proxy stands in."""
    return scored.withColumn(name, F.when(score.isNull(), F.col("rank_proxy")).otherwise(_four(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))))


def rescored(scored: DataFrame, pair_scores: DataFrame, top_scores: DataFrame) -> DataFrame:
    """scored with lexical as the chunk's own BM25 score (query_id, chunk_id, bm25) over the largest that any chunk of the corpus has
    for the query (query_id, top), so that fused lists are judged by a text score; adaptive follows."""
    own = scored.drop("lexical", "adaptive").join(pair_scores, ["query_id", "chunk_id"], "left").join(top_scores, "query_id", "left")
    lexical = F.coalesce(F.when(F.col("top") >= 1e-9, _four(F.col("bm25") / F.col("top"))), F.lit(0.0))
    mean = F.floor((F.round(F.col("lexical") * 10_000) + F.round(F.col("dense") * 10_000)) / 2 + 0.5) / 10_000
    adaptive = F.when(F.col("method") == "dense", F.col("dense")).when(F.col("method") == "bm25", F.col("lexical")).otherwise(mean)
    return own.withColumn("lexical", lexical).withColumn("adaptive", adaptive).drop("bm25", "top")


#: Fixed value: the answer where nothing was found.
NO_ANSWER = "No relevant evidence was found to answer this question."


def answered(answers: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """answers of all queries (query_id): those without a chunk get NO_ANSWER, with confidence and coverage 0."""
    full = queries.select(*by, "query_id").distinct().join(answers, [*by, "query_id"], "left")
    return full.withColumn("answer", F.coalesce("answer", F.lit(NO_ANSWER))).fillna(0.0, ["confidence", "coverage"])


def extractive_answers(scored: DataFrame, chunks: DataFrame, scorer: str = "adaptive", n: int = 3, length: int = 200, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, answer, confidence, coverage: the first n chunks of each list quoted as '[i] text', with the mean of their
    scores and their share of the list. scored is one list per query; chunks has one row per chunk_id."""
    rows = scored.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    quote = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.substring("text", 1, length), F.lit("")))
    first = F.when(F.col("rank") <= n, F.struct(F.col("rank").alias("r"), quote.alias("q")))
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["q"]), " | ")  # n per query
    used = F.count(F.when(F.col("rank") <= n, 1))
    return rows.groupBy(*by, "query_id").agg(answer.alias("answer"), F.round(F.avg(F.when(F.col("rank") <= n, F.col(scorer))), 4).alias("confidence"), F.round(used / F.count("*"), 4).alias("coverage"))
