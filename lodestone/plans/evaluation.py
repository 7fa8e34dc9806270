"""Retrieval evaluation against a golden set, all queries in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.matching import cut, slices
from lodestone.operators.ranking import running_total
from lodestone.session import bounded_batches

# Reciprocal rank that passes, and the tolerance of comparisons.
PASS_MRR = 0.5
TOLERANCE = 0.05

# Bytes of texts scanned together.
SCAN_BYTES = 1 << 20


def passages_in_documents(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, chunk_id) for every passage found as a case-insensitive substring of a chunk.

    Each task scans its texts once for a whole slice of passages with an Aho-Corasick automaton,
    so neither pairs nor texts are shuffled.
    """
    import ahocorasick

    spark = chunks.sparkSession
    bounded_batches(spark)
    texts = chunks.select("chunk_id", F.lower("content").alias("content"))
    found: list[DataFrame] = []
    needles = passages.select(F.col("item_id").alias("query_id"), F.lower("text").alias("text"))
    for part in slices(needles.where("text <> ''")):
        table = part.toArrow()
        wanted: dict[str, list[int]] = {}
        for item, phrase in zip(*(table.column(c).to_pylist() for c in ("query_id", "text")), strict=True):
            wanted.setdefault(phrase, []).append(item)
        shared = spark.sparkContext.broadcast(wanted)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared):
            automaton = ahocorasick.Automaton()
            for phrase, items in shared.value.items():
                automaton.add_word(phrase, items)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in cut(batches, "content", SCAN_BYTES):
                ids, contents = batch.column("chunk_id").to_pylist(), batch.column("content").to_pylist()
                hits = {
                    (item, chunk)
                    for chunk, content in zip(ids, contents, strict=True)
                    if content
                    for _, items in automaton.iter(content)
                    for item in items
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())],
                    names=["item_id", "chunk_id"],
                )

        found.append(texts.mapInArrow(scan, "item_id long, chunk_id long"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def expected_rows(golden: DataFrame) -> DataFrame:
    """One row per (id, expected chunk)."""
    return golden.select("id", F.explode("expected_chunks").alias("chunk_id")).distinct()


def _hits(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    return retrieved.select("id", "chunk_id", "rank").join(expected, ["id", "chunk_id"])


def overlap(expected: DataFrame, retrieved: DataFrame, *, k: int) -> DataFrame:
    """Size of expected and of expected ∩ retrieved@k per query with expectations."""
    found = (
        _hits(expected, retrieved)
        .where(F.col("rank") <= k)
        .groupBy("id")
        .agg(F.count_distinct("chunk_id").alias("overlap"))
    )
    sizes = expected.groupBy("id").agg(F.count("*").alias("expected_count"))
    return sizes.join(found, "id", "left").na.fill(0, ["overlap"])


def first_relevant_rank(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    return _hits(expected, retrieved).groupBy("id").agg(F.min("rank").alias("first_rank"))


def average_precision(expected: DataFrame, retrieved: DataFrame, golden: DataFrame | None = None) -> DataFrame:
    """Sum of precision at every hit over the number of expected chunks; 0 without hits.

    With ``golden``, its queries that expect nothing are listed too, with 1.
    """
    running = running_total(_hits(expected, retrieved), ["id"], "rank", F.lit(1), "found")
    sums = running.groupBy("id").agg(F.sum(F.col("found") / F.col("rank")).alias("_sum"))
    sizes = expected.groupBy("id").agg(F.count("*").alias("_size"))
    scored = sizes.join(sums, "id", "left").select(
        "id", (F.coalesce("_sum", F.lit(0.0)) / F.col("_size")).alias("average_precision")
    )
    if golden is None:
        return scored
    return golden.select("id").distinct().join(scored, "id", "left").na.fill(1.0, ["average_precision"])


def recall_metric(expected: DataFrame, retrieved: DataFrame, golden: DataFrame, *, k: int = 5) -> DataFrame:
    """Share of the expected chunks among the first ``k``; 1 for a query that expects nothing, whatever was retrieved."""
    shares = overlap(expected, retrieved, k=k).select("id", (F.col("overlap") / F.col("expected_count")).alias("recall"))
    return golden.select("id").distinct().join(shares, "id", "left").na.fill(1.0, ["recall"])


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.coalesce(2 * precision * recall / F.nullif(both, F.lit(0.0)), F.lit(0.0))


def evaluate_queries(
    golden: DataFrame, retrieved: DataFrame, *, k: int = 5, expected: DataFrame | None = None
) -> DataFrame:
    """recall, precision, mrr, f1, passed per golden query.

    Expectations are the golden rows' ``expected_chunks``, or the rows (id, chunk_id) of
    ``expected``, which suits queries with very many relevant chunks.

    A query without expectations is a negative example: recall and precision are 1 when nothing
    was retrieved and 0 otherwise, mrr is 0, and it passes.
    """
    if expected is None:
        expected = expected_rows(golden)
    sizes = expected.groupBy("id").agg(F.count("*").alias("_size"))
    found = _hits(expected, retrieved).groupBy("id").agg(
        F.count_if(F.col("rank") <= k).alias("_hits"), F.min("rank").alias("_first")
    )
    returned = retrieved.groupBy("id").agg(F.count("*").alias("_returned"))
    rows = golden.join(sizes, "id", "left").join(found, "id", "left").join(returned, "id", "left")
    hits = F.coalesce("_hits", F.lit(0))
    negative = F.col("_size").isNull()
    empty = F.when(F.col("_returned").isNull(), 1.0).otherwise(0.0)
    rows = (
        rows.withColumn("recall", F.when(negative, empty).otherwise(hits / F.col("_size")))
        .withColumn("precision", F.when(negative, empty).otherwise(hits / F.lit(k)))
        .withColumn(
            "mrr", F.when(negative, 0.0).otherwise(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)))
        )
        .withColumn("passed", negative | (F.col("mrr") >= PASS_MRR))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
    )
    return rows.drop("_size", "_hits", "_first", "_returned")


def summarize(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means, sample standard deviations (0 for one query) and pass counts."""
    measures = []
    for name in ("recall", "precision", "mrr"):
        measures.append(F.avg(name).alias(f"{name}_mean"))
        measures.append(F.coalesce(F.stddev_samp(name), F.lit(0.0)).alias(f"{name}_std"))
    return per_query.groupBy(*(by or [])).agg(
        *measures,
        F.count("*").alias("num_queries"),
        F.count_if("passed").alias("num_passed"),
        F.count_if(~F.col("passed")).alias("num_failed"),
    )


def evaluate(
    golden: DataFrame, retrieved: DataFrame, *, k: int = 5, expected: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    per_query = evaluate_queries(golden, retrieved, k=k, expected=expected)
    return per_query, summarize(per_query)


def eval_run(
    golden: DataFrame,
    retriever: Callable[[DataFrame], DataFrame],
    *,
    k: int = 5,
    expected: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Evaluate a retriever: it takes (query_id, text) and returns (query_id, chunk_id, rank)."""
    asked = golden.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    found = retriever(asked).select(F.col("query_id").alias("id"), "chunk_id", "rank")
    return evaluate(golden, found, k=k, expected=expected)


def compare(current: DataFrame, baseline: DataFrame, *, tolerance: float = TOLERANCE) -> DataFrame:
    """Deltas of two one-row summaries and whether each stays within the tolerance."""
    names = ("recall", "precision", "mrr")
    rows = current.select(
        *[
            (F.col(f"{n}_mean") - baseline.select(f"{n}_mean").scalar()).alias(f"{n}_delta")
            for n in names
        ]
    )
    checks = {f"{n}_passed": F.col(f"{n}_delta") >= -tolerance for n in names}
    rows = rows.withColumns(checks)
    passed = F.col("recall_passed") & F.col("precision_passed") & F.col("mrr_passed")
    return rows.withColumn("overall_passed", passed).withColumn("tolerance", F.lit(tolerance))
