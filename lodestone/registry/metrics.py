"""Aggregation, listing and paging queries."""

from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.registry.base import (
    NOW,
    NOW_SQL,
    decided,
    denials,
    docs,
    errors,
    feedback,
    gappy,
    register,
    searches,
)


@register(
    "corpus_stats",
    """
    SELECT project, source_type, count(*) AS document_count, count(chunk_id) AS chunk_count FROM docs GROUP BY 1, 2""",
    "docs",
)
def corpus_stats(spark, sf):
    base = docs(spark, sf)
    stats = metrics.corpus_stats(base, base.select("chunk_id", "document_id"))
    return stats.withColumn("chunk_count", F.col("chunk_count").cast("long"))


@register(
    "project_stats",
    """
    SELECT project, sum(n)::BIGINT AS document_count, sum(n)::BIGINT AS chunk_count,
      string_agg(source_type || '=' || n, ',' ORDER BY source_type) AS source_types
    FROM (SELECT project, source_type, count(*) AS n FROM docs GROUP BY 1, 2) GROUP BY 1""",
    "docs",
)
def project_stats(spark, sf):
    base = docs(spark, sf)
    stats = metrics.project_stats(base, base.select("chunk_id", "document_id"))
    entries = F.transform(
        F.array_sort(F.map_entries("source_types")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return stats.withColumn("source_types", F.array_join(entries, ","))


@register(
    "project_document_counts",
    "SELECT project, count(*) AS document_count FROM docs GROUP BY 1",
    "docs",
)
def project_document_counts(spark, sf):
    return metrics.project_document_counts(docs(spark, sf))


HIT_RATE = f"""
    SELECT * , (total - not_found) / total AS hit_rate FROM (
      SELECT coalesce(nullif(project, ''), 'all') AS project, count(*) AS total,
        count(*) FILTER (WHERE results_count = 0) AS not_found
      FROM searches WHERE searched_at >= {NOW_SQL} - INTERVAL 168 HOUR GROUP BY 1)"""


@register("search_hit_rate", HIT_RATE + " WHERE total >= 5", "ev searches")
def search_hit_rate(spark, sf):
    return metrics.search_hit_rate(searches(spark, sf), now=NOW, min_count=5)


@register(
    "feedback_reason_counts",
    """
    SELECT feedback_reason, count(*) AS reason_count, (SELECT count(*) FROM feedback) AS total,
      (SELECT count(*) FILTER (WHERE feedback_reason = 'didnt_answer') / count(*) FROM feedback) AS not_found_frequency
    FROM feedback GROUP BY 1""",
    "ev feedback",
)
def feedback_reason_counts(spark, sf):
    return metrics.feedback_reason_counts(feedback(spark, sf))


REPEATED = f"""
    SELECT question, project, count(*) AS repeat_count FROM feedback
    WHERE created_at >= {NOW_SQL} - INTERVAL 48 HOUR GROUP BY 1, 2 HAVING count(*) > 1"""


@register("repeated_questions", REPEATED, "ev feedback")
def repeated_questions(spark, sf):
    return metrics.repeated_questions(feedback(spark, sf), now=NOW)


@register(
    "permission_denial_metrics",
    f"""
    SELECT reason_code, count(*) AS row_count FROM denials WHERE created_at >= {NOW_SQL} - INTERVAL 168 HOUR GROUP BY 1""",
    "ev denials",
)
def permission_denial_metrics(spark, sf):
    return metrics.permission_denial_metrics(denials(spark, sf), now=NOW)


@register(
    "ingestion_error_metrics",
    f"""
    SELECT coalesce(nullif(error_type, ''), 'unknown') AS error_type, count(*) AS row_count FROM errors
    WHERE created_at >= {NOW_SQL} - INTERVAL 168 HOUR GROUP BY 1""",
    "ev errors",
)
def ingestion_error_metrics(spark, sf):
    return metrics.ingestion_error_metrics(errors(spark, sf), now=NOW)


@register(
    "missing_metadata_total",
    "SELECT count(*) AS missing_count FROM gappy WHERE source_date IS NULL OR project = '' OR language = ''",
    "docs gappy",
)
def missing_metadata_total(spark, sf):
    return metrics.missing_metadata_total(gappy(spark, sf))


@register(
    "missing_metadata_by_project",
    """
    SELECT coalesce(nullif(project, ''), 'unknown') AS project, count(*) AS missing_count FROM gappy
    WHERE source_date IS NULL OR project = '' OR language = '' GROUP BY 1""",
    "docs gappy",
)
def missing_metadata_by_project(spark, sf):
    return metrics.missing_metadata_by_project(gappy(spark, sf))


@register(
    "stale_document_buckets",
    f"""
    SELECT project, days, count(*) FILTER (WHERE source_date <= {NOW_SQL} - to_days(days)) AS stale_count
    FROM docs, (VALUES (90), (180), (365)) t(days) WHERE source_type = 'markdown' GROUP BY 1, 2""",
    "docs",
)
def stale_document_buckets(spark, sf):
    return metrics.stale_document_buckets(
        docs(spark, sf), now=NOW, days=[365, 180, 90, 90, 0], source_type="markdown", by=["project"]
    )


@register(
    "stale_decision_buckets",
    f"""
    SELECT days, count(*) FILTER (WHERE decision_date <= {NOW_SQL} - to_days(days)) AS stale_count
    FROM decided JOIN docs USING (chunk_id), (VALUES (90), (9000), (10000)) t(days)
    WHERE status = 'active' AND decision_date IS NOT NULL GROUP BY 1""",
    "docs decided",
)
def stale_decision_buckets(spark, sf):
    base = docs(spark, sf)
    return metrics.stale_decision_buckets(decided(spark, sf), base, base, now=NOW, days=[90, 9000, 10000])


@register(
    "list_documents_page",
    """
    SELECT document_id, source_path, updated_at, (SELECT count(*) FROM docs WHERE source_type = 'markdown') AS total
    FROM docs WHERE source_type = 'markdown' ORDER BY updated_at DESC, document_id LIMIT 20 OFFSET 20""",
    "docs",
)
def list_documents_page(spark, sf):
    page = metrics.list_documents_page(docs(spark, sf), page=2, page_size=20, source_type="MD ")
    return page.select("document_id", "source_path", "updated_at", "total")


@register(
    "recent_log_rows",
    f"""
    SELECT event_id, source_path, error_type, created_at FROM errors WHERE created_at >= {NOW_SQL} - INTERVAL 168 HOUR
    ORDER BY created_at DESC, event_id DESC LIMIT 5""",
    "ev errors",
)
def recent_log_rows(spark, sf):
    rows = metrics.recent_log_rows(errors(spark, sf), now=NOW, window_hours=168)
    return rows.select("event_id", "source_path", "error_type", "created_at")


@register(
    "low_volume_projects",
    """
    SELECT project, count(*) AS document_count, greatest(0, 600 - count(*)) AS gap FROM docs
    GROUP BY 1 HAVING count(*) < 600""",
    "docs",
)
def low_volume_projects(spark, sf):
    return metrics.low_volume_projects(docs(spark, sf), threshold=600)


@register("low_hit_rate_projects", HIT_RATE + " WHERE total >= 5 AND (total - not_found) / total < 0.4", "ev searches")
def low_hit_rate_projects(spark, sf):
    return metrics.low_hit_rate_projects(searches(spark, sf), now=NOW)


@register(
    "append_log",
    "SELECT event_id, query, project, results_count, (results_count = 0)::INTEGER AS not_found FROM searches",
    "ev searches",
)
def append_log(spark, sf):
    """Append to a log table, then read it back."""
    from lodestone.session import scratch_path
    from lodestone.sources.store import append_log as append

    path = scratch_path(spark, "search_history")
    return append(searches(spark, sf), path).select("event_id", "query", "project", "results_count", "not_found")
