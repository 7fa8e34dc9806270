"""Evaluation queries: benchmark passages as questions, documents holding them as expectations."""

from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.plans import evaluation as ev
from lodestone.registry.base import register, table, texts
from lodestone.registry.retrieval import BM25_SQL


def golden(spark, sf):
    level = F.when(F.col("item_id") % 2 == 0, "easy").otherwise("hard")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("question"), level.alias("difficulty")
    )


def expected(spark, sf):
    found = ev.passages_in_documents(texts(spark, sf), table(spark, sf, "benchmark"))
    return found.select(F.col("item_id").alias("id"), "chunk_id")


def retriever(spark, sf):
    return lambda asked: search.bm25_corpus(texts(spark, sf), asked, k=10)


def retrieved(spark, sf):
    asked = golden(spark, sf).select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    return retriever(spark, sf)(asked).select(F.col("query_id").alias("id"), "chunk_id", "rank")


RUN = (
    BM25_SQL.replace("FROM asked", "FROM (SELECT item_id AS query_id, text FROM benchmark)")
    + """, ret AS (SELECT query_id AS id, chunk_id, rank FROM ranked WHERE rank <= 10),
    ex AS (SELECT item_id AS id, chunk_id FROM benchmark b JOIN docs ON contains(lower(content), lower(b.text))),
    size AS (SELECT id, count(*) AS n FROM ex GROUP BY 1),
    hit AS (SELECT id, rank, row_number() OVER (PARTITION BY id ORDER BY rank) AS cum FROM ret JOIN ex USING (id, chunk_id)),
    per AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, n,
      count(rank) FILTER (WHERE rank <= 5) AS hits, min(rank) AS first, coalesce(sum(cum / rank), 0) AS ap,
      item_id IN (SELECT id FROM ret) AS found_any FROM benchmark LEFT JOIN size ON size.id = item_id LEFT JOIN hit ON hit.id = item_id
      GROUP BY ALL),
    met AS (SELECT id, difficulty, CASE WHEN n IS NULL THEN (NOT found_any)::INTEGER::DOUBLE ELSE hits / n END AS recall,
      CASE WHEN n IS NULL THEN (NOT found_any)::INTEGER::DOUBLE ELSE hits / 5 END AS precision,
      CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE coalesce(1.0 / first, 0)::DOUBLE END AS mrr, n, first, ap FROM per)"""
)
MEASURES = """round(avg(recall), 6) AS recall_mean, round(coalesce(stddev_samp(recall), 0), 6) AS recall_std,
      round(avg(precision), 6) AS precision_mean, round(coalesce(stddev_samp(precision), 0), 6) AS precision_std,
      round(avg(mrr), 6) AS mrr_mean, round(coalesce(stddev_samp(mrr), 0), 6) AS mrr_std, count(*) AS num_queries,
      count(*) FILTER (WHERE n IS NULL OR mrr >= 0.5) AS num_passed,
      count(*) FILTER (WHERE NOT (n IS NULL OR mrr >= 0.5)) AS num_failed"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register(
    "expected_retrieved_overlap",
    RUN + " SELECT id, n AS expected_count, hits AS overlap FROM per WHERE n IS NOT NULL",
    "docs",
)
def expected_retrieved_overlap(spark, sf):
    return ev.overlap(expected(spark, sf), retrieved(spark, sf), k=5)


@register("first_relevant_rank", RUN + " SELECT id, first::INTEGER AS first_rank FROM per WHERE first IS NOT NULL", "docs")
def first_relevant_rank(spark, sf):
    return ev.first_relevant_rank(expected(spark, sf), retrieved(spark, sf))


def _per_query(spark, sf):
    return ev.evaluate_queries(golden(spark, sf), retrieved(spark, sf), k=5, expected=expected(spark, sf))


@register("recall_at_k", RUN + " SELECT id, round(recall, 6) AS recall FROM met", "docs")
def recall_at_k(spark, sf):
    return _rounded(_per_query(spark, sf).select("id", "recall"))


@register("precision_at_k", RUN + " SELECT id, round(precision, 6) AS precision FROM met", "docs")
def precision_at_k(spark, sf):
    return _rounded(_per_query(spark, sf).select("id", "precision"))


@register("mrr", RUN + " SELECT id, round(mrr, 6) AS mrr FROM met", "docs")
def mrr(spark, sf):
    return _rounded(_per_query(spark, sf).select("id", "mrr"))


@register(
    "f1_at_k",
    RUN
    + """ SELECT id, round(CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END, 6)
    ::DOUBLE AS f1 FROM met""",
    "docs",
)
def f1_at_k(spark, sf):
    return _rounded(_per_query(spark, sf).select("id", "f1"))


@register(
    "average_precision",
    RUN + " SELECT id, CASE WHEN n IS NULL THEN 1.0 ELSE round(ap / n, 6) END::DOUBLE AS average_precision FROM met",
    "docs",
)
def average_precision(spark, sf):
    return _rounded(ev.average_precision(expected(spark, sf), retrieved(spark, sf), golden(spark, sf)))


@register(
    "recall_metric",
    RUN + " SELECT id, CASE WHEN n IS NULL THEN 1.0 ELSE round(recall, 6) END::DOUBLE AS recall FROM met",
    "docs",
)
def recall_metric(spark, sf):
    return _rounded(ev.recall_metric(expected(spark, sf), retrieved(spark, sf), golden(spark, sf), k=5))


@register("eval_run", RUN + f" SELECT {MEASURES} FROM met", "docs")
def eval_run(spark, sf):
    _, summary = ev.eval_run(golden(spark, sf), retriever(spark, sf), k=5, expected=expected(spark, sf))
    return _rounded(summary)


@register("eval_by_category", RUN + f" SELECT difficulty, {MEASURES} FROM met GROUP BY 1", "docs")
def eval_by_category(spark, sf):
    return _rounded(ev.summarize(_per_query(spark, sf), ["difficulty"]))


# Baseline: the same run without its first result.
BASE = RUN.replace("FROM ranked WHERE rank <= 10", "FROM ranked WHERE rank <= 10 AND rank > 1").replace(
    "SELECT query_id AS id, chunk_id, rank FROM", "SELECT query_id AS id, chunk_id, rank - 1 AS rank FROM"
)


@register(
    "eval_compare",
    f"""
    SELECT round(recall_delta, 6) AS recall_delta, round(precision_delta, 6) AS precision_delta, round(mrr_delta, 6) AS mrr_delta,
      recall_delta >= -0.05 AS recall_passed, precision_delta >= -0.05 AS precision_passed, mrr_delta >= -0.05 AS mrr_passed,
      least(recall_delta, precision_delta, mrr_delta) >= -0.05 AS overall_passed, 0.05::DOUBLE AS tolerance
    FROM (SELECT c.recall_mean - b.recall_mean AS recall_delta, c.precision_mean - b.precision_mean AS precision_delta,
      c.mrr_mean - b.mrr_mean AS mrr_delta FROM ({RUN} SELECT avg(recall) AS recall_mean, avg(precision) AS precision_mean,
      avg(mrr) AS mrr_mean FROM met) b, ({BASE} SELECT avg(recall) AS recall_mean, avg(precision) AS precision_mean,
      avg(mrr) AS mrr_mean FROM met) c)""",
    "docs",
)
def eval_compare(spark, sf):
    full = retrieved(spark, sf)
    worse = full.where("rank > 1").withColumn("rank", F.col("rank") - 1)
    wanted = expected(spark, sf)
    _, current = ev.evaluate(golden(spark, sf), worse, k=5, expected=wanted)
    _, baseline = ev.evaluate(golden(spark, sf), full, k=5, expected=wanted)
    return _rounded(ev.compare(current, baseline))
