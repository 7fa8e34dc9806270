"""Behaviour that matters on large or skewed data: bounded work, plan shapes, brute-force checks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodestone.operators import matching, ranking, search
from lodestone.plans.evaluation import passages_in_documents
from lodestone.registry import QUERIES
from lodestone.streaming import indexing, logs

NOW = datetime(2024, 1, 31)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def world(spark):
    """A corpus where a third of the vectors are copies of one another."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(600, 8)).round(3)
    vectors[:200] = vectors[0]
    vectors[599] = 0.0
    rows = [
        (i, [float(x) for x in v], f"p{i % 3}", NOW - timedelta(days=i), f"text {i} {'magic' if i % 4 else 'other'}", ["active"] if i % 5 == 0 else None)
        for i, v in enumerate(vectors)
    ]
    corpus = spark.createDataFrame(
        rows,
        "chunk_id long, embedding array<float>, project string, source_date timestamp_ntz, content string, statuses array<string>",
    ).repartition(5)
    asked = [
        (q, [float(x) for x in vectors[q]], ["p1"] if q % 2 else None, NOW - timedelta(days=400) if q % 3 == 0 else None, ["Magic"] if q % 5 == 0 else [], ["other"] if q % 7 == 0 else [], "active" if q % 4 == 1 else None)
        for q in range(0, 300, 11)
    ]
    queries = spark.createDataFrame(
        asked,
        "query_id long, embedding array<float>, projects array<string>, date_after timestamp_ntz, phrases array<string>, excluded array<string>, decision_status string",
    )
    return corpus, queries, rows, asked


def brute(rows, asked, k):
    out = set()
    for q, vector, projects, after, phrases, excluded, status in asked:
        scored = []
        for i, v, project, date, content, statuses in rows:
            a, b = np.float32(v).astype(float), np.float32(vector).astype(float)
            norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            if norm == 0 or (projects and project not in projects) or (after and date < after):
                continue
            if any(p.lower() not in content for p in phrases) or any(t in content for t in excluded):
                continue
            if status and status not in (statuses or []):
                continue
            scored.append((round(1 - float(a @ b) / norm, 9), i))
        out |= {(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_nearest_equals_brute_force_with_ties_and_filters(world):
    corpus, queries, rows, asked = world
    got = {(r.query_id, r.chunk_id, r.rank) for r in matching.nearest(corpus, queries, 7).collect()}
    assert got == brute(rows, asked, 7)


def test_zero_vectors_rank_last(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "chunk_id long, embedding array<float>")
    got = [(r.chunk_id, r.distance) for r in search.vector_search(corpus, [1.0, 1.0], k=2).collect()]
    assert got == [(2, 0.0), (1, None)]
    assert {r.distance for r in search.vector_search(corpus, [0.0, 0.0], k=2).collect()} == {None}


def test_query_slices_give_the_same_result(world, monkeypatch):
    corpus, queries, rows, asked = world
    monkeypatch.setattr(matching, "QUERY_SLICE", 10)
    monkeypatch.setattr(matching, "QUERY_TILE", 3)
    got = {(r.query_id, r.chunk_id, r.rank) for r in matching.nearest(corpus, queries, 7).collect()}
    assert got == brute(rows, asked, 7)


def test_bm25_slices_give_the_same_result(spark, monkeypatch):
    from lodestone.registry.retrieval import asked, docs

    chunks, queries = docs(spark, SMALL), asked(spark, SMALL).select("query_id", "text")
    whole = {tuple(r) for r in search.bm25_corpus(chunks, queries, k=5).collect()}
    monkeypatch.setattr(matching, "QUERY_SLICE", 7)
    assert {tuple(r) for r in search.bm25_corpus(chunks, queries, k=5).collect()} == whole


def test_exhaustive_mode_filters_before_the_limit(spark):
    chunks = spark.createDataFrame(
        [(i, "needle" if i == 49 else f"hay {i}", "p", "en", None) for i in range(50)],
        "chunk_id long, content string, project string, language string, source_date timestamp_ntz",
    )
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(50)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, '"needle"', [1.0, 0.0])], "query_id long, raw string, embedding array<float>")
    found = {
        mode: [r.chunk_id for r in search.hybrid_search(chunks, vectors, queries, now=NOW, k=1, mode=mode).collect()]
        for mode in ("candidate", "exhaustive")
    }
    assert found == {"candidate": [], "exhaustive": [49]}


def test_passages_equal_brute_force(spark):
    random.seed(3)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [" ".join(random.choices(words, k=30)) for _ in range(40)] + ["ALPHA beta"] * 20
    needles = [" ".join(random.choices(words, k=2)) for _ in range(15)] + ["ta ga", "alpha beta"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    passages = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")
    got = {tuple(r) for r in passages_in_documents(chunks, passages).collect()}
    assert got == {(i, c) for i, n in enumerate(needles) for c, t in enumerate(texts) if n in t.lower()}


def test_running_total_of_one_huge_key(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("key"), F.col("id").alias("pos"), (F.col("id") % 3).alias("v"))
    got = ranking.running_total(df, ["key"], "pos", F.col("v"), "total", block=512)
    wrong = got.where("total <> (floor((pos + 1) / 3) * 3 + CASE WHEN (pos + 1) % 3 = 2 THEN 1 ELSE 0 END)")
    assert got.count() == 20_000 and wrong.count() == 0


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("q"), "id")
    assert plan(ranking.top_k(df, ["q"], [F.desc("id")], 5)).count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_metadata"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text
    assert "EqualTo(lang,en)" in text and "In(source" in text


NO_PRODUCTS = [
    "hybrid_search",
    "bm25_candidates",
    "failure_signals",
    "coach_suggestions",
    "fix_queue",
    "decision_history",
    "eval_compare",
    "stale_decision_buckets",
]


@pytest.mark.parametrize("name", NO_PRODUCTS)
def test_no_pairwise_products(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_chunking_needs_no_shuffle(spark):
    from lodestone.operators.chunking import chunk_documents
    from lodestone.registry.base import docs
    from lodestone.sources.sections import markdown_sections

    assert "Exchange" not in plan(chunk_documents(markdown_sections(docs(spark, SMALL).select("document_id", "content"))))


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    schema = "error_type string, created_at timestamp_ntz"
    day = datetime(2024, 1, 1)
    deliveries = [
        [("a", day + timedelta(hours=1)), ("a", day + timedelta(hours=2))],
        [("", day + timedelta(days=3))],
        [("a", day + timedelta(hours=3)), ("a", day + timedelta(days=3, hours=1))],
    ]
    out = tmp_path / "out"
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counted = logs.stream_error_counts(stream_of(spark, tmp_path / "in", schema))
        table = logs.run_available(counted, str(out))
    assert [(r.window_start, r.error_type, r.row_count) for r in table.collect()] == [(day, "a", 2)]


def test_cooldown_stream(spark, tmp_path):
    schema = "project string, suggestion_type string, logged_at timestamp_ntz"
    day = datetime(2024, 1, 1)
    out = tmp_path / "out"
    for offset in (0, 3, 20, 40):
        rows = [("p", "staleness", day + timedelta(days=offset))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept = logs.stream_suggestion_cooldown(stream_of(spark, tmp_path / "in", schema), cooldown="7 days")
        table = logs.run_available(kept, str(out))
    days = sorted((r.logged_at.replace(tzinfo=None) - day).days for r in table.collect())
    assert days[0] == 0 and 3 not in days and 40 in days


def test_incremental_index_replaces_versions(spark, tmp_path):
    body = "A paragraph with quite enough different words to be kept as one meaningful chunk number {}."
    schema = "source_path string, project string, content string, source_date timestamp_ntz, version long"

    def rows(version, changed):
        return [(f"f{i}", "p", body.format(i) + (" Revised text." if i in changed else ""), None, version) for i in range(4)]

    base = str(tmp_path / "index")
    batches = [rows(0, ()), rows(1, (1, 2))]
    for n, batch in enumerate(batches):
        indexing.index_batch(spark.createDataFrame(batch, schema), n, base)
    # A repeated batch changes nothing.
    indexing.index_batch(spark.createDataFrame(batches[1], schema), 1, base)
    docs = {r.source_path: r.batch for r in indexing.current_documents(spark, base).collect()}
    assert docs == {"f0": 0, "f1": 1, "f2": 1, "f3": 0}
    chunks = {r.source_path: r.content for r in indexing.current_chunks(spark, base).collect()}
    assert len(chunks) == 4 and "Revised" in chunks["f1"] and "Revised" not in chunks["f0"]
