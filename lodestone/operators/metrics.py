"""Corpus statistics, log metrics, staleness and listings.

Every metric takes ``by``: the columns it is reported for. An empty list gives one global row.
All of them are map-side combined aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.operators import filters

# Default thresholds and windows.
SEARCH_WINDOW_HOURS = 168
ERROR_WINDOW_HOURS = 168
DENIAL_WINDOW_HOURS = 168
REPEAT_WINDOW_HOURS = 48
STALE_BUCKETS = (90, 180, 365)
LOW_VOLUME = 5
LOW_HIT_RATE = 0.4
MIN_SEARCHES = 5
RECENT_ROWS = 5


def corpus_stats(documents: DataFrame, chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """document_count and chunk_count per project and source type in one pass over each table."""
    keys = by if by is not None else ["project", "source_type"]
    placed = chunks.select("document_id").groupBy("document_id").agg(F.count("*").alias("_chunks"))
    return (
        documents.select("document_id", *keys)
        .join(placed, "document_id", "left")
        .groupBy(*keys)
        .agg(F.count("*").alias("document_count"), F.coalesce(F.sum("_chunks"), F.lit(0)).alias("chunk_count"))
    )


def project_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per project: documents, chunks and a map of documents per source type."""
    per_type = corpus_stats(documents, chunks)
    entry = F.struct("source_type", "document_count")
    return (
        per_type.groupBy("project")
        .agg(
            F.sum("document_count").alias("document_count"),
            F.sum("chunk_count").alias("chunk_count"),
            F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("source_types"),
        )
        .orderBy("project")
    )


def _document_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("project").agg(F.count("*").alias("document_count"))


def project_document_counts(documents: DataFrame) -> DataFrame:
    return _document_counts(documents).orderBy("document_count", "project")


def within(df: DataFrame, column: str, now, hours: int | None) -> DataFrame:
    return df if hours is None else df.where(F.col(column) >= dates.before(now, hours=hours))


def label(name: str, blank: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(blank)).alias(name)


def search_hit_rate(
    log: DataFrame, *, now, window_hours: int = SEARCH_WINDOW_HOURS, min_count: int = 1
) -> DataFrame:
    """project, total, not_found, hit_rate over the window; the blank project is 'all'."""
    return _hit_rates(log, now, window_hours, min_count).orderBy(F.desc("total"), "project")


def _hit_rates(log: DataFrame, now, window_hours: int, min_count: int) -> DataFrame:
    grouped = within(log, "searched_at", now, window_hours).groupBy(label("project", "all"))
    return (
        grouped.agg(
            F.count("*").alias("total"), F.count_if(F.col("results_count") == 0).alias("not_found")
        )
        .where(F.col("total") >= min_count)
        .withColumn("hit_rate", (F.col("total") - F.col("not_found")) / F.col("total"))
    )


def feedback_metrics(feedback: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, didnt_answer and not_found_frequency over all time."""
    total = F.count("*")
    missed = F.count_if(F.col("feedback_reason") == "didnt_answer")
    return feedback.groupBy(*(by or [])).agg(
        total.alias("total"),
        missed.alias("didnt_answer"),
        F.coalesce(missed / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("not_found_frequency"),
    )


def feedback_reason_counts(feedback: DataFrame) -> DataFrame:
    """Rows per reason with the share of all feedback that was not answered."""
    counts = feedback.groupBy("feedback_reason").agg(F.count("*").alias("reason_count"))
    totals = feedback_metrics(feedback)
    return counts.withColumn("total", totals.select("total").scalar()).withColumn(
        "not_found_frequency", totals.select("not_found_frequency").scalar()
    )


def repeated_counts(feedback: DataFrame, *, now, window_hours: int = REPEAT_WINDOW_HOURS) -> DataFrame:
    return (
        within(feedback, "created_at", now, window_hours)
        .groupBy("question", "project")
        .agg(F.count("*").alias("repeat_count"))
        .where(F.col("repeat_count") > 1)
    )


def repeated_questions(
    feedback: DataFrame, *, now, window_hours: int = REPEAT_WINDOW_HOURS, limit: int | None = None
) -> DataFrame:
    """The repeated (question, project) pairs of the window, or the ``limit`` most repeated of them."""
    rows = repeated_counts(feedback, now=now, window_hours=window_hours)
    return rows.orderBy(F.desc("repeat_count"), "question", "project").limit(limit) if limit else rows


def counts_by(df: DataFrame, column: str, *, now, window_hours: int | None, blank: str = "unknown") -> DataFrame:
    """Rows per value of a code column within a window; blank codes get a name."""
    return (
        within(df, "created_at", now, window_hours)
        .groupBy(label(column, blank))
        .agg(F.count("*").alias("row_count"))
    )


def permission_denial_metrics(denials: DataFrame, *, now, window_hours=DENIAL_WINDOW_HOURS) -> DataFrame:
    return counts_by(denials, "reason_code", now=now, window_hours=window_hours)


def ingestion_error_metrics(errors: DataFrame, *, now, window_hours=ERROR_WINDOW_HOURS) -> DataFrame:
    return counts_by(errors, "error_type", now=now, window_hours=window_hours)


def recent_log_rows(
    log: DataFrame, *, now, window_hours: int | None = None, limit: int = RECENT_ROWS, column: str = "created_at"
) -> DataFrame:
    """Newest rows of a log, later id first on equal times."""
    return within(log, column, now, window_hours).orderBy(F.desc(column), F.desc("event_id")).limit(limit)


def missing_metadata_total(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_if(filters.lacks_metadata()).alias("missing_count"))


def missing_metadata_by_project(documents: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Documents lacking metadata per project, or of the ``limit`` projects with most of them."""
    counts = (
        documents.where(filters.lacks_metadata())
        .groupBy(label("project", "unknown"))
        .agg(F.count("*").alias("missing_count"))
    )
    return counts.orderBy(F.desc("missing_count"), "project").limit(limit) if limit else counts


def bucket_days(days) -> list[int]:
    return sorted({int(d) for d in days if int(d) > 0})


def stale_buckets(
    df: DataFrame, column: str, *, now, days=STALE_BUCKETS, by: list[str] | None = None
) -> DataFrame:
    """Rows at least so many days old, cumulative per threshold, in one pass over the table."""
    keys = by or []
    wanted = bucket_days(days)
    counts = [F.count_if(F.col(column) <= dates.before(now, days=d)).alias(f"_{d}") for d in wanted]
    pairs = F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"_{d}").alias("stale_count")) for d in wanted])
    return df.groupBy(*keys).agg(*counts).select(*keys, F.inline(pairs))


def stale_document_buckets(
    documents: DataFrame, *, now, days=STALE_BUCKETS, source_type: str | None = None, by=None
) -> DataFrame:
    kept = documents if source_type is None else documents.where(F.col("source_type") == source_type)
    return stale_buckets(kept, "source_date", now=now, days=days, by=by)


def stale_decision_buckets(
    decisions: DataFrame, chunks: DataFrame, documents: DataFrame, *, now, days=STALE_BUCKETS, by=None
) -> DataFrame:
    placed = (
        decisions.where((F.col("status") == "active") & F.col("decision_date").isNotNull())
        .select("chunk_id", "decision_date")
        .join(chunks.select("chunk_id", "document_id"), "chunk_id")
        .join(documents.select("document_id", "project"), "document_id")
    )
    return stale_buckets(placed, "decision_date", now=now, days=days, by=by)


def list_documents_page(
    documents: DataFrame, *, page: int = 1, page_size: int = 20, project=None, source_type=None
) -> DataFrame:
    """One page by newest update with the total of the filtered set."""
    kept = filters.filter_metadata(
        documents,
        projects=[project] if project else None,
        source_types=[source_type] if source_type else None,
    )
    total = kept.agg(F.count("*").alias("total"))
    return (
        kept.orderBy(F.desc("updated_at"), "document_id")
        .offset((page - 1) * page_size)
        .limit(page_size)
        .withColumn("total", total.scalar())
    )


def low_volume_projects(documents: DataFrame, *, threshold: int = LOW_VOLUME) -> DataFrame:
    counts = _document_counts(documents).where(F.col("document_count") < threshold)
    return counts.withColumn("gap", F.greatest(F.lit(0), F.lit(threshold) - F.col("document_count")))


def low_hit_rate_projects(
    log: DataFrame,
    *,
    now,
    threshold: float = LOW_HIT_RATE,
    window_hours: int = SEARCH_WINDOW_HOURS,
    min_count: int = MIN_SEARCHES,
) -> DataFrame:
    rates = _hit_rates(log, now, window_hours, min_count)
    return rates.where(F.col("hit_rate") < threshold)
