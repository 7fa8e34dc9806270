"""Windowed log metrics as Structured Streaming queries.

Event time must be a TIMESTAMP, so logs with TIMESTAMP_NTZ columns are cast (the session runs in
UTC) and the window bounds are cast back. In append mode a window is written once the watermark has
passed it, and its state is then dropped; in update mode, with ``streaming.current``, a table holds all
windows with their counts so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAY = "1 hour"


def on_event_time(stream: DataFrame, column: str, delay: str = DELAY) -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def _bounds(window: str = "window") -> list[Column]:
    return [
        F.col(f"{window}.start").cast("timestamp_ntz").alias("window_start"),
        F.col(f"{window}.end").cast("timestamp_ntz").alias("window_end"),
    ]


def stream_hit_rate(
    searches: DataFrame, *, window: str = "168 hours", slide: str = "24 hours", delay: str = DELAY, min_count: int = 1
) -> DataFrame:
    """Hit rate per project over sliding windows."""
    project = F.coalesce(F.nullif("project", F.lit("")), F.lit("all")).alias("project")
    counted = (
        on_event_time(searches, "searched_at", delay)
        .groupBy(F.window("searched_at", window, slide), project)
        .agg(F.count("*").alias("total"), F.count_if(F.col("results_count") == 0).alias("not_found"))
    )
    rate = (F.col("total") - F.col("not_found")) / F.col("total")
    return counted.where(F.col("total") >= min_count).select(
        *_bounds(), "project", "total", "not_found", rate.alias("hit_rate")
    )


def stream_repeated_questions(
    feedback: DataFrame, *, window: str = "48 hours", delay: str = DELAY
) -> DataFrame:
    """Questions asked more than once per window and project."""
    counted = (
        on_event_time(feedback, "created_at", delay)
        .groupBy(F.window("created_at", window), "question", "project")
        .agg(F.count("*").alias("repeat_count"))
    )
    return counted.where("repeat_count > 1").select(*_bounds(), "question", "project", "repeat_count")


def stream_error_counts(
    log: DataFrame, column: str = "error_type", *, window: str = "24 hours", delay: str = DELAY
) -> DataFrame:
    """Rows per code and window; late rows beyond the watermark are dropped."""
    code = F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")).alias(column)
    counted = (
        on_event_time(log, "created_at", delay)
        .groupBy(F.window("created_at", window), code)
        .agg(F.count("*").alias("row_count"))
    )
    return counted.select(*_bounds(), column, "row_count")


def stream_suggestion_cooldown(suggestions: DataFrame, *, cooldown: str = "7 days") -> DataFrame:
    """First suggestion per (project, type) in order of arrival, written at once.

    The watermark delay is the cooldown, so a key is forgotten once that much event time has passed, which depends on
    the batches. ``streaming.current.cooldown_changes`` decides by event time, dismissals included.
    """
    return on_event_time(suggestions, "logged_at", cooldown).dropDuplicatesWithinWatermark(
        ["project", "suggestion_type"]
    )


def stream_feedback_sessions(feedback: DataFrame, *, gap: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """Feedback per user session: rows and unanswered ones between pauses of ``gap``."""
    counted = (
        on_event_time(feedback, "created_at", delay)
        .groupBy(F.session_window("created_at", gap), "user_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("feedback_reason") == "didnt_answer").alias("didnt_answer"),
        )
    )
    return counted.select(*_bounds("session_window"), "user_id", "total", "didnt_answer")


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything that is there into a parquet folder and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/data")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
