"""Canned retrieval bundles: every routine's queries with their date windows in one batch."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import matching

# Routine, bucket, query text, days before the target date (None for no window).
ROUTINE_QUERIES = [
    ("daily-checkin", "open_loops", "open loop", None),
    ("daily-checkin", "recent_context", "recent context", 3),
    ("daily-debrief", "recent_context", "recent context", 1),
    ("daily-debrief", "decisions_today", "decisions decided today", 1),
    ("weekly-review", "weekly_highlights", "weekly highlights", None),
    ("weekly-review", "stale_decisions", "stale decisions", None),
    ("weekly-review", "metadata_gaps", "missing metadata", None),
    ("meeting-prep", "recent_decisions", "recent decisions", None),
    ("meeting-prep", "unresolved_questions", "unresolved questions", None),
    ("meeting-prep", "recent_notes", "recent notes", 7),
    ("meeting-debrief", "meeting_notes", "meeting notes", 1),
    ("meeting-debrief", "open_decisions", "open decisions", None),
    ("new-decision", "related_sources", "related decision sources", None),
    ("new-decision", "conflicting_decisions", "conflicting decisions", None),
    ("trip-debrief", "trip_notes", "trip notes", 30),
    ("trip-debrief", "trip_recipes", "trip recipes", None),
    ("trip-debrief", "trip_open_loops", "trip open loops", None),
    ("trip-plan", "previous_trips", "trip learnings", None),
    ("trip-plan", "destination_notes", "destination travel", None),
    ("trip-plan", "packing_lists", "packing checklist", None),
]


def routine_queries(spark: SparkSession, target: datetime, queries=None) -> DataFrame:
    """query_id, routine, bucket, text, date_after and date_before (end of the target day)."""
    rows = []
    for i, (routine, bucket, text, days) in enumerate(queries or ROUTINE_QUERIES):
        after = before = None
        if days is not None:
            after = datetime.combine(target.date() - timedelta(days=days), time.min)
            before = datetime.combine(target.date(), time.max)
        rows.append((i, routine, bucket, text, after, before))
    schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("routine", T.StringType()),
            T.StructField("bucket", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("date_after", T.TimestampNTZType()),
            T.StructField("date_before", T.TimestampNTZType()),
        ]
    )
    return spark.createDataFrame(rows, schema)


def routine_bundle(
    chunks: DataFrame, *, target: datetime, k: int = 5, projects: list[str] | None = None, queries=None
) -> tuple[DataFrame, DataFrame]:
    """(sources, warnings): ranked chunks per routine bucket, and a warning per empty bucket.

    Keyword ranked, since canned queries come without vectors; all windows are masks of one scan.
    """
    from lodestone.operators.filters import filter_metadata

    asked = routine_queries(chunks.sparkSession, target, queries)
    corpus = filter_metadata(chunks, projects=projects)
    found = matching.bm25(corpus, asked.select("query_id", "text", "date_after", "date_before"), k)
    names = asked.select("query_id", "routine", "bucket")
    # The query list is fixed and tiny.
    sources = found.join(F.broadcast(names), "query_id").select("routine", "bucket", "rank", "chunk_id", "score")
    message = F.concat(F.lit("No citations found for "), "bucket", F.lit("; manual entry recommended."))
    empty = names.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return sources, empty.select("routine", "bucket", message.alias("warning"))
