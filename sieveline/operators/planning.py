"""Strategy planning: ordered rules, decisions and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("bm25", "dense", "hybrid")
#: What planned strategies mean among the three methods; others stand for themselves.
STRATEGY_OF = {"keyword": "bm25", "dense": "dense", "hybrid": "hybrid", "table_aware": "hybrid", "multi_hop": "hybrid", "metadata_filtered": "hybrid", "hierarchical": "dense"}
TECHNICAL = ("System Design Documents", "API Documentation")
#: Rules in order (id, strategy, confidence); the last holds if no other does.
RULES = (("R01", "bm25", 0.80), ("R02", "dense", 0.85), ("R03", "hybrid", 0.90), ("R04", "hybrid", 0.75), ("R05", "hybrid", 0.75), ("R06", "dense", 0.70), ("R07", "hybrid", 0.60))
ERROR_RATES = {"zero_shot": 0.28, "structured": 0.18, "few_shot": 0.16}


def mapped(strategy: Column) -> Column:
    """The method that a planned strategy stands for."""
    table = F.create_map(*(F.lit(x) for pair in STRATEGY_OF.items() for x in pair))
    return F.coalesce(F.element_at(table, strategy), strategy)


def rule_decisions(queries: DataFrame, *keep: str) -> DataFrame:
    """query_id, selected_strategy, matched_rules, planner_confidence, oracle_strategy_mapped, is_correct for each query
    (query_id, reasoning_type, retrieval_difficulty_factors, category, planner_oracle_strategy), after the columns of queries
    to keep. The first rule that matches decides; all that match are recorded."""
    kind, factors = F.coalesce("reasoning_type", F.lit("")), F.coalesce("retrieval_difficulty_factors", F.array().cast("array<string>"))
    has = lambda f: F.array_contains(factors, f)
    tests = (
        (kind == "temporal") | has("temporal_reasoning"),
        (kind == "exception") | has("exception_handling"),
        (kind == "multi_hop") | has("multi_document_dependency"),
        has("table_dependency"),
        kind.isin("comparison", "aggregation"),
        F.coalesce("category", F.lit("")).isin(*TECHNICAL) & (kind == "single_hop"),
    )
    fired = F.filter(F.array(*(F.when(t, r[0]) for t, r in zip(tests, RULES))), lambda x: x.isNotNull())
    fired = F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit(RULES[-1][0])))
    of = lambda i: F.create_map(*(F.lit(x) for r in RULES for x in (r[0], r[i])))
    d = queries.withColumn("matched_rules", fired).withColumn("first", F.element_at("matched_rules", 1))
    d = d.withColumn("selected_strategy", F.element_at(of(1), F.col("first"))).withColumn("planner_confidence", F.element_at(of(2), F.col("first")))
    d = d.withColumn("oracle_strategy_mapped", mapped(F.coalesce(F.when(F.col("planner_oracle_strategy") != "", F.col("planner_oracle_strategy")), F.lit("hybrid"))))
    return d.select("query_id", *keep, "selected_strategy", "matched_rules", "planner_confidence", "oracle_strategy_mapped", (F.col("selected_strategy") == F.col("oracle_strategy_mapped")).alias("is_correct"))


#: Fixed value: least confidence of a rule's decision that needs no second opinion.
CONFIDENT = 0.75


def plans(decisions: DataFrame, second: DataFrame, suggested: DataFrame) -> DataFrame:
    """query_id, strategy, source of each of decisions (rule_decisions): a strategy that validation suggested (query_id,
    suggested_strategy) overrides; below CONFIDENT a second opinion (query_id, second_strategy) replaces the rule's; else the
    rule's stands. Both have at most one row per query; their nulls count for nothing."""
    d = decisions.select("query_id", "selected_strategy", "planner_confidence").join(suggested, "query_id", "left").join(second, "query_id", "left")
    asked = (F.col("planner_confidence") < CONFIDENT) & F.col("second_strategy").isNotNull()
    source = F.when(F.col("suggested_strategy").isNotNull(), "validation_override").when(asked, "llm").otherwise("rule")
    return d.select("query_id", F.coalesce("suggested_strategy", F.when(asked, F.col("second_strategy")), "selected_strategy").alias("strategy"), source.alias("source"))


#: Question types for which recorded oracles are known to disagree with what the runs show.
DISPUTED = ("temporal",)


def discrepancy(kind: str = "reasoning_type", source: str = "oracle_strategy_source") -> Column:
    """Whether an oracle is in dispute: a DISPUTED type whose oracle does not come from the runs themselves."""
    return F.coalesce(F.col(kind).isin(*DISPUTED), F.lit(False)) & (F.coalesce(source, F.lit("")) != "empirical_validation")


def confusion(decisions: DataFrame) -> DataFrame:
    """Per strategy of STRATEGIES: tp, fp, fn, support, predicted, precision, recall and f1 (0 where undefined)."""
    each = F.array(F.struct(F.col("selected_strategy").alias("strategy"), F.lit("p").alias("side")), F.struct(F.col("oracle_strategy_mapped").alias("strategy"), F.lit("o").alias("side")))
    rows = decisions.select("is_correct", F.explode(each).alias("e")).select("is_correct", "e.strategy", "e.side").where(F.col("strategy").isin(*STRATEGIES))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    sums = rows.groupBy("strategy").agg(n("side = 'p' AND is_correct").alias("tp"), n("side = 'p' AND NOT is_correct").alias("fp"), n("side = 'o' AND NOT is_correct").alias("fn"), n("side = 'o'").alias("support"), n("side = 'p'").alias("predicted"))
    names = decisions.sparkSession.createDataFrame([(s,) for s in STRATEGIES], "strategy string")
    full = names.join(sums, "strategy", "left").fillna(0)
    p, r = F.expr("coalesce(tp / nullif(tp + fp, 0), 0D)"), F.expr("coalesce(tp / nullif(tp + fn, 0), 0D)")
    f1 = F.expr("coalesce(2D * tp / nullif(2 * tp + fp + fn, 0), 0D)")
    return full.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def grouped_accuracy(decisions: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Per attribute and value: n, accuracy, accuracy without discrepancies, and how often each strategy was selected."""
    from .analysis import stack

    n = lambda c: F.count(F.when(c, 1))
    right = F.when(F.col("is_correct"), 1.0).otherwise(0.0)
    clean = ~F.coalesce("oracle_discrepancy", F.lit(False))
    return stack(decisions, attributes).groupBy("attribute", "value").agg(
        F.count("*").alias("n"), F.round(F.avg(right), 4).alias("accuracy"), F.round(F.coalesce(F.avg(F.when(clean, right)), F.lit(0.0)), 4).alias("accuracy_ex_discrepancy"),
        *(n(F.col("selected_strategy") == s).alias(f"n_{s}") for s in STRATEGIES),
    )


def rule_contributions(decisions: DataFrame) -> DataFrame:
    """Per rule of RULES, also unused ones: how often it decided, and how often it was right."""
    used = decisions.where(F.size("matched_rules") > 0).select(F.element_at("matched_rules", 1).alias("rule_id"), "is_correct")
    sums = used.groupBy("rule_id").agg(F.count("*").alias("n_used"), F.count(F.when(F.col("is_correct"), 1)).alias("n_correct"))
    rules = decisions.sparkSession.createDataFrame([(r[0], r[1]) for r in RULES], "rule_id string, strategy string")
    return rules.join(sums, "rule_id", "left").fillna(0).withColumn("accuracy", F.round(F.expr("coalesce(n_correct / nullif(n_used, 0), 0D)"), 4))


def strategy_distribution(decisions: DataFrame) -> DataFrame:
    """Per strategy of STRATEGIES: count, percent of all decisions (1 decimal) and accuracy."""
    from pyspark.sql.window import Window as W

    sums = decisions.groupBy("selected_strategy").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_correct"), 1)).alias("right"))
    share = F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 1)  # over a few rows
    sums = sums.withColumn("percent", share).withColumn("accuracy", F.round(F.col("right") / F.col("n"), 4))
    names = decisions.sparkSession.createDataFrame([(s,) for s in STRATEGIES], "selected_strategy string")
    return names.join(sums.drop("right"), "selected_strategy", "left").fillna(0)


def noise(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key: the 128-bit value modulo 100,000, folded 32 bits at a time."""
    digest = F.md5(key)
    acc = F.lit(0).cast("long")
    for i in range(4):
        acc = F.pmod(acc * 67296 + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(100_000).cast("long"))
    return acc / 100_000.0


def mock_decisions(queries: DataFrame, prompt_version: str) -> DataFrame:
    """Decisions of a stand-in planner that errs at the rate of its prompt version, from a hash of the id: reproducible
    input for the evaluation of planners without a model."""
    oracle = mapped(F.coalesce(F.when(F.col("planner_oracle_strategy") != "", F.col("planner_oracle_strategy")), F.lit("hybrid")))
    x = noise(F.concat_ws("|", "query_id", F.lit(prompt_version), F.lit("mock_v1")))
    d = queries.select("query_id", oracle.alias("oracle_strategy_mapped"), x.alias("noise"))
    wrong = F.col("noise") < ERROR_RATES.get(prompt_version, 0.20)
    selected = F.when(wrong, F.when(F.col("oracle_strategy_mapped") == "hybrid", "dense").otherwise("hybrid")).otherwise(F.col("oracle_strategy_mapped"))
    confidence = F.when(wrong, F.round(0.50 + F.col("noise") * 0.25, 2)).otherwise(F.least(F.lit(0.98), F.round(0.72 + (1.0 - F.col("noise")) * 0.28, 2)))
    return d.select("query_id", F.lit(prompt_version).alias("prompt_version"), selected.alias("selected_strategy"), confidence.alias("planner_confidence"), "oracle_strategy_mapped", (selected == F.col("oracle_strategy_mapped")).alias("is_correct"))


def error_category(prompt_version: str = "prompt_version", source: str = "oracle_strategy_source", kind: str = "reasoning_type", factors: str = "difficulty_factors", category: str = "category") -> Column:
    """Why a wrong decision may be wrong: the first of these that holds."""
    has = lambda f: F.coalesce(F.array_contains(factors, f), F.lit(False))
    is_ = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    return (
        F.when(is_(prompt_version, "zero_shot"), "prompt_ambiguity")
        .when(is_(source, "empirical_validation"), "oracle_disagreement")
        .when(is_(kind, "temporal", "exception") | has("temporal_reasoning") | has("exception_handling"), "reasoning_confusion")
        .when(has("multi_document_dependency") | is_(kind, "multi_hop") | has("table_dependency"), "difficulty_factor_confusion")
        .when(is_(category, *TECHNICAL), "category_confusion")
        .otherwise("oracle_disagreement")
    )
