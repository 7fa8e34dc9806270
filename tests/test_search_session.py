"""Search as the first thing that a session does, its scope, and metrics of empty expectations."""

from conftest import SMALL  # noqa: F401

from lodestone.operators import search
from lodestone.plans import evaluation


def corpus(spark):
    chunks = spark.createDataFrame(
        [(1, "alpha beta", "a", "en"), (2, "alpha gamma", "b", "en"), (3, "alpha gamma delta", "c", "en")],
        "chunk_id long, content string, project string, language string",
    ).selectExpr("*", "'markdown' as source_type", "cast(null as timestamp_ntz) as source_date")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    return chunks, vectors


def asked(spark, raw):
    return spark.createDataFrame([(7, raw, [1.0, 0.1])], "query_id long, raw string, embedding array<float>")


def test_first_query_of_a_session(spark):
    fresh = spark.newSession()
    chunks, vectors = corpus(fresh)
    for mode in ("candidate", "exhaustive"):
        found = search.hybrid_search(
            chunks, vectors, asked(fresh, 'alpha "gamma" -delta'), now="2024-01-31", k=3, mode=mode
        )
        assert [r.chunk_id for r in found.collect()] == [2]


def test_projects_of_call_and_query_are_one_scope(spark):
    chunks, vectors = corpus(spark)
    found = search.hybrid_search(chunks, vectors, asked(spark, "alpha project:b"), now="2024-01-31", k=3, projects=["a"])
    assert {r.chunk_id for r in found.collect()} == {1, 2}


def test_empty_expectation_is_fully_met(spark):
    golden = spark.createDataFrame([(1, ["x"]), (2, [])], "id long, expected_chunks array<string>")
    retrieved = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "id long, chunk_id string, rank int")
    found = evaluation.average_precision(evaluation.expected_rows(golden), retrieved, golden)
    assert {r.id: r.average_precision for r in found.collect()} == {1: 0.5, 2: 1.0}
