"""Failure, comparison, contribution and cost reports over evaluated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import staged
from .references import clean_key

IMPROVED, REGRESSED = 0.05, -0.03


def known(c: str) -> Column:
    """The value, or 'unknown' for null and ''."""
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown"))


def stack(df: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """One row per row and attribute, with attribute and value: several groupings in one pass."""
    return df.withColumn("g", F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), known(a).alias("value")) for a in attributes)))).select("*", "g.attribute", "g.value").drop("g")


def failure_patterns(evaluated: DataFrame, attributes: tuple[str, ...] = ("category", "reasoning_type", "difficulty", "oracle_strategy")) -> DataFrame:
    """Per method, attribute and value: queries in all, with recall zero, partial and full, the zero rate and mean recall."""
    r = F.col("recall_at_k")
    count = lambda c: F.count(F.when(c, 1))
    return stack(evaluated, attributes).groupBy("method", "attribute", "value").agg(
        F.count("*").alias("n_total"), count(r == 0).alias("n_zero"), count((r > 0) & (r < 1)).alias("n_partial"), count(r == 1).alias("n_perfect"),
        F.round(count(r == 0) / F.count("*"), 4).alias("zero_rate"), F.round(F.avg(r), 4).alias("avg_recall"),
    )


def top_failures(evaluated: DataFrame, n: int = 20) -> DataFrame:
    """The n worst queries of each method: recall, then mrr ascending, n_relevant descending, then the ids."""
    w = W.partitionBy("method").orderBy(F.asc_nulls_last("recall_at_k"), F.asc_nulls_last("mrr"), F.desc_nulls_last("n_relevant"), "query_id", "failure_id")
    return evaluated.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("method", "place", "failure_id", "query_id", "recall_at_k", "mrr", "n_relevant")


def comparison(evaluated: DataFrame, method: str, baseline: str, attribute: str = "category") -> DataFrame:
    """Mean recall of two methods per value, the difference, and whether it improved or regressed; a missing baseline is 0."""
    rows = evaluated.select(known(attribute).alias("value"), "method", "recall_at_k")
    of = lambda m: F.avg(F.when(F.col("method") == m, F.col("recall_at_k")))
    sides = rows.where(F.col("method").isin(method, baseline)).groupBy("value").agg(of(method).alias("a"), F.coalesce(of(baseline), F.lit(0.0)).alias("b")).where("a IS NOT NULL")
    delta = F.round(F.col("a") - F.col("b"), 4)
    verdict = F.when(delta > IMPROVED, "improved").when(delta < REGRESSED, "regressed").otherwise("same")
    return sides.select("value", F.round("a", 4).alias("recall"), F.round("b", 4).alias("baseline_recall"), delta.alias("delta"), verdict.alias("verdict"))


def method_matrix(evaluated: DataFrame, methods: tuple[str, ...], reference: str) -> DataFrame:
    """One row per measure with a column per method, and differences to the reference method."""
    measures = ("recall_at_k", "mrr", "ndcg")
    long = evaluated.where(F.col("method").isin(*methods)).select("method", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures))).alias("m")).select("method", "m.measure", "m.x")
    wide = long.groupBy("measure").pivot("method", list(methods)).agg(F.avg("x"))
    return wide.select("measure", *(F.round(m, 4).alias(m) for m in methods), *(F.round(F.col(m) - F.col(reference), 4).alias(f"delta_{m}") for m in methods if m != reference))


def contributions(qrels: DataFrame, lists: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, source of every required chunk: both, bm25_only, dense_only, hybrid_only or not_found within the
    first k of the three methods' lists. by: further columns of qrels and lists that keep lists apart."""
    top = lists.where(F.col("rank") <= k).select(*by, "query_id", clean_key("chunk_id").alias("chunk_id"), "method")
    has = lambda m: F.max(F.when(F.col("method") == m, True).otherwise(False)).alias(m)
    found = qrels.join(top, [*by, "query_id", "chunk_id"], "left").groupBy(*by, "query_id", "chunk_id").agg(has("bm25"), has("dense"), has("hybrid"))
    source = F.expr("CASE WHEN bm25 AND dense THEN 'both' WHEN bm25 THEN 'bm25_only' WHEN dense THEN 'dense_only' WHEN hybrid THEN 'hybrid_only' ELSE 'not_found' END")
    return found.select(*by, "query_id", "chunk_id", source.alias("source"))


SOURCES = ("both", "bm25_only", "dense_only", "hybrid_only", "not_found")


def contribution_shares(classified: DataFrame, *by: str, percent: bool = False) -> DataFrame:
    """Counts of each source (and percentages, 1 decimal), complementarity (one method alone) and the gain of fusion with their
    levels, per group or overall."""
    counts = [F.count(F.when(F.col("source") == s, 1)).alias(f"n_{s}") for s in SOURCES]
    g = classified.groupBy(*by).agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_required"), *counts)
    total = F.greatest("n_required", F.lit(1))
    g = g.withColumns({f"pct_{c}": F.round(100 * F.col(f"n_{c}") / total, 1) for c in SOURCES}) if percent else g
    g = g.withColumn("complementarity", F.round((F.col("n_bm25_only") + F.col("n_dense_only")) / total, 4)).withColumn("hybrid_gain", F.round(F.col("n_hybrid_only") / total, 4))
    level = F.when(F.col("complementarity") > 0.30, "high").when(F.col("complementarity") > 0.15, "moderate").otherwise("low")
    g = g.withColumn("complementarity_level", level)
    return g.withColumn("hybrid_gain_level", F.when(F.col("hybrid_gain") > 0.05, "significant").otherwise("small")) if percent else g


def same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """a left-joined with b on keys, where null equals null; the keys of a are kept."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, on, "left").drop(*(f"_{k}" for k in keys)) if keys else a.crossJoin(b)


def values_at(df: DataFrame, value: str, places: dict[int, Column], *by: str) -> DataFrame:
    """by, place, value: the value at a 0-based index of the sorted values of each group, for each named place, an expression
    over the number `total` of values. Nulls don't count.

    Counts of values are range-partitioned in their order and written; sums per range tell in which range of a group each
    index lies, and only inside that one range rows are counted up. So no group is sorted in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ordered = staged(counts.repartitionByRange(*by, value).withColumn("range", F.spark_partition_id()), "ordered")
    w = W.partitionBy(*by)
    ranges = ordered.groupBy(*by, "range").agg(F.sum("n").alias("m")).withColumn("total", F.sum("m").over(w)).withColumn("before", F.sum("m").over(w.orderBy("range")) - F.col("m"))
    each = ranges.withColumn("p", F.explode(F.array(*(F.struct(F.lit(p).alias("place"), at.cast("long").alias("at")) for p, at in places.items()))))
    each = each.select(*by, "range", "before", "m", "p.place", "p.at").where("at >= before AND at < before + m").select(*by, "range", "place", (F.col("at") - F.col("before")).alias("at"))
    inside = same(each, ordered, *by, "range")
    upto = F.sum("n").over(W.partitionBy(*by, "range", "place").orderBy(value))
    return inside.withColumn("upto", upto).where("at >= upto - n AND at < upto").select(*by, "place", value)


def distribution_percentiles(df: DataFrame, value: str, percents: tuple[int, ...], *by: str) -> DataFrame:
    """by, percent, value: the value at index int(p * n / 100), at most n - 1, of the sorted values of each group."""
    at = {p: F.least(F.floor(F.lit(p) * F.col("total") / 100), F.col("total") - 1) for p in percents}
    return values_at(df, value, at, *by).select(*by, F.col("place").alias("percent"), F.col(value).alias("value"))


def medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, median: the mean of the middle two values of each group (of the middle one, if their number is odd)."""
    total = F.col("total")
    return values_at(df, value, {0: F.floor((total - 1) / 2), 1: F.floor(total / 2)}, *by).groupBy(*by).agg(F.avg(value).alias("median"))


def cost_analysis(decisions: DataFrame, *by: str) -> DataFrame:
    """Latency (mean, median, sample deviation), tokens and recorded costs per group; a deviation of one value is 0."""
    sums = decisions.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("latency_s"), 4).alias("mean_latency_s"), F.round(F.coalesce(F.stddev_samp("latency_s"), F.lit(0.0)), 4).alias("stdev_latency_s"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.avg("prompt_tokens"), 2).alias("avg_prompt_tokens"),
        F.round(F.sum("estimated_cost_usd"), 4).alias("cost_usd"), F.round(1000 * F.sum("estimated_cost_usd") / F.count("*"), 4).alias("cost_per_1000_usd"),
    )
    return same(sums, medians(decisions, "latency_s", *by), *by).withColumn("median_latency_s", F.round("median", 4)).drop("median")


def _rate(c: str) -> Column:
    return F.round(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 4)


def pilot_summary(decisions: DataFrame, *by: str) -> DataFrame:
    """Rates of parse success and fallback, attempts and latency per group; null flags count as false."""
    return decisions.groupBy(*by).agg(
        F.count("*").alias("n"), _rate("parse_success").alias("parse_rate"), _rate("fallback_used").alias("fallback_rate"), F.round(F.avg("parse_attempts"), 4).alias("avg_attempts"),
        F.min("latency_s").alias("min_latency_s"), F.max("latency_s").alias("max_latency_s"),
    )


def pilot_report(decisions: DataFrame, *by: str) -> DataFrame:
    """pilot_summary with mean and median latency, tokens, costs and the number of answers that failed to parse."""
    costs = cost_analysis(decisions, *by).drop("n", "stdev_latency_s", "avg_prompt_tokens", "cost_per_1000_usd")
    failed = decisions.groupBy(*by).agg(F.count(F.when(~F.coalesce("parse_success", F.lit(False)), 1)).alias("n_failed"))
    return same(same(pilot_summary(decisions, *by), failed, *by), costs, *by)


def prompt_quality(decisions: DataFrame, strategies: tuple[str, ...], *by: str) -> DataFrame:
    """One row per group: decisions, accuracy, parse failures, and per strategy precision, recall and f1 (0 where undefined)."""
    n = lambda c: F.count(F.when(c, 1))
    right, cols = F.coalesce("is_correct", F.lit(False)), []
    for s in strategies:
        selected, oracle = F.col("selected_strategy") == s, F.col("oracle_strategy_mapped") == s
        tp, fp, fn = n(selected & right), n(selected & ~right), n(oracle & ~right)
        ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
        cols += [ratio(tp, tp + fp).alias(f"precision_{s}"), ratio(tp, tp + fn).alias(f"recall_{s}"), ratio(2 * tp, 2 * tp + fp + fn).alias(f"f1_{s}")]
    return decisions.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(right.cast("int")), 4).alias("accuracy"), n(~F.coalesce("parse_success", F.lit(False))).alias("n_parse_failures"), *cols)


def shares_of(rows: DataFrame, label: str, attributes: tuple[str, ...]) -> DataFrame:
    """attribute, value, label, n, percent, place: how often each label stands in each group, its percentage of the group (1 decimal)
    and its place by frequency (ties by name); attribute 'all' is one group of all rows."""
    each = stack(rows.withColumn("all", F.lit("all")), ("all", *attributes)).groupBy("attribute", "value", label).agg(F.count("*").alias("n"))
    w = W.partitionBy("attribute", "value")  # a few labels each
    each = each.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(w), 1)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), label)))
    return each.select("attribute", "value", label, "n", "percent", "place")


def notable_changes(evaluated: DataFrame, method: str, baseline: str, attributes: tuple[str, ...]) -> DataFrame:
    """attribute, value, verdict, place and the figures of comparison for values that improved (largest first) or regressed
    (worst first); ties by value."""
    out = None
    for a in attributes:
        rows = comparison(evaluated, method, baseline, a).where("verdict <> 'same'").withColumn("attribute", F.lit(a))
        out = rows if out is None else out.unionByName(rows)
    w = W.partitionBy("attribute", "verdict").orderBy(F.desc(F.abs("delta")), "value")  # one row per value
    return out.withColumn("place", F.row_number().over(w)).select("attribute", "value", "verdict", "place", "recall", "baseline_recall", "delta")


def key_union(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """The means of value per key of two row sets, for the keys of either: key, a, b, delta; null where a side lacks the key."""
    mean = lambda df, name: df.groupBy(known(key).alias(key)).agg(F.round(F.avg(value), 4).alias(name))
    return mean(a, "a").join(mean(b, "b"), key, "full").withColumn("delta", F.round(F.col("a") - F.col("b"), 4))


def best_methods(evaluated: DataFrame, attribute: str = "reasoning_type") -> DataFrame:
    """Per value, the method with the highest mean recall (ties by name) and the mean of the label's own method, if any:
    where the recorded label disagrees with what the runs show."""
    mean = evaluated.groupBy(known(attribute).alias("value"), "method").agg(F.round(F.avg("recall_at_k"), 4).alias("recall"), F.count("*").alias("n"))
    w = W.partitionBy("value").orderBy(F.desc_nulls_last("recall"), "method")
    second = F.lead("recall").over(w)
    best = mean.withColumn("place", F.row_number().over(w)).withColumn("lead", F.round(F.col("recall") - second, 4)).where("place = 1")
    return best.select("value", F.col("method").alias("best_method"), "recall", "n", F.col("lead").alias("lead_over_next"))


def places_by_hash(rows: DataFrame, key: str, *by: str, seed: int = 42) -> DataFrame:
    """rows with place: their number from 1 within each group, in the order of a hash of the key. In two steps: counts of
    65,536 stretches of hashes, then rows inside a stretch, so no group is numbered in one task."""
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), key))).withColumn("stretch", F.substring("h", 1, 4))
    earlier = W.partitionBy(*by).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "stretch").agg(F.count("*").alias("n")).select(*by, "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy(*by, "stretch").orderBy("h", key))
    placed = same(rows.withColumn("inside", inside), offsets, *by, "stretch")
    return placed.withColumn("place", F.col("offset") + F.col("inside")).drop("h", "stretch", "inside", "offset")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the first by a hash of the key and the seed: the same rows in every run. place is their order."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key))
    return rows.withColumn("h", h).orderBy("h", key).limit(n).withColumn("place", F.row_number().over(W.orderBy("h", key))).drop("h")


def rebalance(labelled: DataFrame, target: dict[str, float], allowed: tuple[tuple[str, str], ...], seed: int = 42) -> DataFrame:
    """query_id, label, new_label: labels above their target share give surplus rows to labels below their own, pair by pair
    (giver, taker) in the order of allowed, rows in the order of a hash of the id. target: share per label. A label that
    takes does not give."""
    counts = {r[0]: r[1] for r in labelled.groupBy("label").agg(F.count("*")).where(F.col("label").isin(*target)).collect()}  # one row per named label
    total = sum(counts.values())
    given = dict.fromkeys(target, 0)
    new = F.col("label")
    for giver, taker in allowed:
        surplus, deficit = counts.get(giver, 0) - int(target[giver] * total), int(target[taker] * total) - counts.get(taker, 0)
        n = max(0, min(surplus, deficit))
        upto = given[giver] + n
        new = F.when((F.col("label") == giver) & (F.col("place") > given[giver]) & (F.col("place") <= upto), taker).otherwise(new)
        given[giver] = upto
        counts[giver], counts[taker] = counts.get(giver, 0) - n, counts.get(taker, 0) + n
    placed = places_by_hash(labelled.select("query_id", "label"), "query_id", "label", seed=seed)
    return placed.select("query_id", "label", new.alias("new_label"))
