"""Statistics of every round: those of the SQL, and no table of rounds x queries on the way."""

import datetime as dt
import random
import re

import duckdb
import pytest

from sieveline.operators import planning, validation
from sieveline.plans import queries as plans
from sieveline.plans.sql import SQL

KINDS = ("temporal", "exception", "multi_hop", "single_hop", "aggregation", None)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Queries with lists of all lengths and scores, some with none; the third run of hybrid has no score at all."""
    at, r, path = dt.datetime(2024, 1, 1), random.Random(5), tmp_path_factory.mktemp("rounds")
    asked = [(f"Q{i}", "of {id}" if i % 4 == 0 else "of it", KINDS[i % 6], [], "x", None, at) for i in range(90)]
    rows = [("H3", "hybrid", f"Q{i}", "c", None, 1, at) for i in range(3)]
    for no, (run, method) in enumerate((("B1", "bm25"), ("B2", "bm25"), ("D1", "dense"), ("H1", "hybrid"), ("H2", "hybrid"))):
        for i in range(90):
            high = r.choice((0.04, 0.2, 0.35, 1.0))
            rows += [(run, method, f"Q{i}", f"c{j}", round(r.random() * high, 3), j, at + dt.timedelta(days=no + 1)) for j in range(r.choice((0, 0, 2, 5, 14)))]
    spark.createDataFrame(asked, "query_id string, query_text string, reasoning_type string, retrieval_difficulty_factors array<string>, category string, planner_oracle_strategy string, ingested_at timestamp").write.parquet(f"{path}/queries.parquet")
    spark.createDataFrame(rows, "run_id string, method string, query_id string, chunk_id string, score double, rank int, run_at timestamp").write.parquet(f"{path}/retrieval_results.parquet")
    return str(path)


def test_statistics_have_every_round_and_query(spark, folder, rows):
    duck = duckdb.connect()
    for name in ("queries", "retrieval_results"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    want = duck.execute(SQL["pipeline_stats_rounds"])
    assert [d[0] for d in want.description] == plans.pipeline_stats_rounds(spark, folder).columns
    got = rows(plans.pipeline_stats_rounds(spark, folder))
    assert got == sorted(want.fetchall(), key=repr)
    assert {x[2:] for x in got if x[0] == 3} == {(15, 0.0, 3.0, "no_chunks")} and any(x[3] > 0 for x in got)


def test_statistics_send_no_verdicts_to_the_driver(spark, folder):
    plan = plans.pipeline_stats_rounds(spark, folder)._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join)\b(.*)", plan)
    assert [j for j, on in joins if "query_id" in on] == ["SortMergeJoin"]


@pytest.mark.parametrize("loops", [0, 1, 3])
def test_retries_in_a_row_end_as_those_by_joins(spark, folder, rows, loops):
    scored = validation.relevance(plans._all_lists(spark, folder, 10, plans._rounds(spark, folder, plans.RUN_METHODS)), plans.BY)
    queries = spark.read.parquet(f"{folder}/queries.parquet")
    start = planning.rule_decisions(queries, "reasoning_type", "query_text").withColumnRenamed("selected_strategy", "strategy")
    judged = validation.verdicts(scored, queries, by=plans.BY)
    every = validation.retry(start.select("query_id", "strategy").crossJoin(judged.select("round").distinct()), judged, loops, plans.BY)
    found = validation.retried(scored, start, loops, by=plans.BY)
    listed = every.join(found.select("round", "query_id"), ["round", "query_id"], "left_semi")
    assert rows(found.select(listed.columns)) == rows(listed)
    rest = every.join(found, ["round", "query_id"], "left_anti")
    assert {tuple(x)[3:] for x in rest.collect()} == {(loops, False, "no_chunks")}
