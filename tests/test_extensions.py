"""Tables and numbered sections in texts, planning by a provider, combined search, streams, sources."""

import datetime as dt

from pyspark.sql import functions as F

from sieveline.operators import providers, search, sparse, tables
from sieveline.sources import tables as sources
from sieveline.streaming import runs


def test_tables_are_fitted_to_their_header(spark):
    text = "intro\n| a | b |\r\n| --- | :-: |\n| 1 |\n| 2 | 3 | 4 |\nno | table\n| x |"
    rows = tables.fitted(tables.table_rows(spark.createDataFrame([("C", text), ("N", None), (None, text)], "chunk_id string, text string"))).orderBy("line_no").collect()
    assert [(r["cells"], r["is_header"]) for r in rows] == [(["a", "b"], True), (["1", ""], False), (["2", "3"], False), (["x", ""], False)]


def test_numbered_sections_count_up(spark):
    body = "1. Scope\n\ntext\n2. not after a blank line\n\n3. Skipped\n\n2. Rules of use\n\n3. This title has far too many words\n\n3. Ends in a stop.\n\n3. Last"
    got = tables.numbered_sections(spark.createDataFrame([("D", body), ("E", ""), ("N", None)], "document_id string, body string")).orderBy("number").collect()
    assert [(r["number"], r["title"]) for r in got] == [(1, "Scope"), (2, "Rules of use"), (3, "Last")]


def test_provider_with_cache_retries_and_fallback(spark):
    req = spark.createDataFrame([("Q1", "m/1", "p", "ask 1"), ("Q2", "m/1", "p", "ask 2"), ("Q3", "m/1", "p", "fail"), ("Q4", "m/1", "p", "raise")], "query_id string, model string, prompt_version string, prompt string")
    cache = spark.createDataFrame([("Q1__m_1__p", '{"selected_strategy": "dense", "confidence": 7}', dt.datetime(2024, 1, 1))], "cache_key string, raw_response string, created_at timestamp")

    def provider(prompt, attempt):
        if prompt == "raise":
            raise RuntimeError("down")
        return 'x {"selected_strategy": "BM25", "confidence": 0.5} y' if prompt == "ask 2" and attempt == 2 else "no plan"

    got = {r["query_id"]: (r["selected_strategy"], r["planner_confidence"], r["parse_attempts"], r["fallback_used"]) for r in providers.decide(req, cache, provider).collect()}
    assert got == {"Q1": ("dense", 1.0, 0, False), "Q2": ("bm25", 0.5, 2, False), "Q3": ("hybrid", 0.5, 3, True), "Q4": ("hybrid", 0.5, 3, True)}
    assert providers.cache_rows(providers.decide(req, cache, provider)).count() == 2


def test_search_by_strategy(spark):
    chunks = spark.createDataFrame([(str(i), f"alpha word{i}", f"D{i}") for i in range(1, 8)], "chunk_id string, text string, document_id string")
    queries = spark.createDataFrame([("100", "word3")], "query_id string, query_text string")
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 8)], "id long, v array<double>")
    qv = spark.createDataFrame([(100, [1.0, 0.0])], "id long, v array<double>")
    index = sparse.build(chunks, F.col("text"))
    of = lambda s: [r["chunk_id"] for r in search.search(s, index, queries, v, qv, k=3).orderBy("rank").collect()]
    assert of("bm25") == ["3"] and of("dense") == ["7", "6", "5"] and of("hybrid")[0] == "3"
    dependent = spark.createDataFrame([("Q2", "limits in {doc}", "doc", "100"), ("Q3", "limits in {doc}", "doc", "none")], "query_id string, query_text string, slot string, needs string")
    got = {r[0]: r[1] for r in search.fill_from(search.search("bm25", index, queries), dependent, chunks).collect()}
    assert got == {"Q2": "limits in D3", "Q3": "limits in {doc}"}


def test_streams_deliver_once(spark, tmp_path):
    rows = [("r", "m", "q", f"c{i % 5}", float(i), dt.datetime(2024, 1, 1 + i % 3), dt.datetime(2024, 1, 5)) for i in range(20)] + [(None, "m", "q", "c", 1.0, None, dt.datetime(2024, 1, 5))]
    df = spark.createDataFrame(rows, "run_id string, method string, query_id string, chunk_id string, score double, run_at timestamp, ingested_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: runs.read_results(spark, str(tmp_path / "in"), df.schema)
    runs.append_trace(runs.delivered_once(stream()), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    q = runs.activity(stream()).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("activity").agg(F.sum("n_rows")).first()[0] == 20


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Q1", "bm25", ["a", "b"], 0.5), ("Q2", "dense", [], None)], "query_id string, method string, tags array<string>, score double")
    sources.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, sources.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    sources.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("query_id = 'Q1'").first()["tags"] == "a|b"
    sources.write_runs(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("method = 'dense'").count() == 1
