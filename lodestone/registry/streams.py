"""Streaming queries, each run over all events, in several deliveries with late rows, to the end of the input."""

from pyspark.sql import functions as F

from lodestone.registry import base
from lodestone.registry.base import register, table
from lodestone.session import scratch_path
from lodestone.streaming import current, indexing, logs


class _Streamed:
    """Stands in for a session so the table views read the delivered events as a stream, a file at a time."""

    def __init__(self, spark, sf):
        events = table(spark, sf, "events")
        self.read = self
        self.schema, self.spark = events.schema, spark
        self.folder = scratch_path(spark, "events")
        # three deliveries of ten days each; every tenth row comes one delivery late
        part = F.least(F.floor(F.dayofmonth("ts") / 11) + (F.col("event_id") % 10 == 3).cast("int"), F.lit(2))
        for n in range(3):
            events.where(part == n).coalesce(1).write.mode("append").parquet(self.folder)

    def parquet(self, path):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


#: The deliveries above are up to 20 days late.
LATE = "21 days"


def _run(changes, spark, label, keys):
    return current.current(current.keep_current(changes, scratch_path(spark, label), keys, buckets=4))


@register(
    "stream_hit_rate",
    """
    WITH w AS (SELECT *, unnest([date_trunc('day', searched_at) - to_days(i) FOR i IN range(0, 7)]) AS window_start FROM searches),
    g AS (SELECT window_start, window_start + INTERVAL 168 HOUR AS window_end, coalesce(nullif(project, ''), 'all') AS project,
      count(*) AS total, count(*) FILTER (WHERE results_count = 0) AS not_found FROM w
      WHERE searched_at < window_start + INTERVAL 168 HOUR GROUP BY 1, 2, 3)
    SELECT *, (total - not_found) / total AS hit_rate FROM g""",
    "ev searches",
)
def stream_hit_rate(spark, sf):
    rates = logs.stream_hit_rate(base.searches(_Streamed(spark, sf), sf), delay=LATE)
    return _run(rates, spark, "hit_rate", ["window_start", "window_end", "project"])


@register(
    "stream_repeated_questions",
    """
    WITH g AS (SELECT time_bucket(INTERVAL 48 HOUR, created_at, TIMESTAMP '1970-01-01') AS window_start, question, project,
      count(*) AS repeat_count FROM feedback GROUP BY 1, 2, 3 HAVING count(*) > 1)
    SELECT *, window_start + INTERVAL 48 HOUR AS window_end FROM g""",
    "ev feedback",
)
def stream_repeated_questions(spark, sf):
    repeats = logs.stream_repeated_questions(base.feedback(_Streamed(spark, sf), sf), delay=LATE)
    return _run(repeats, spark, "repeats", ["window_start", "window_end", "question", "project"])


@register(
    "stream_error_counts",
    """
    WITH g AS (SELECT date_trunc('day', created_at) AS window_start, coalesce(nullif(error_type, ''), 'unknown') AS error_type,
      count(*) AS row_count FROM errors GROUP BY 1, 2)
    SELECT *, window_start + INTERVAL 24 HOUR AS window_end FROM g""",
    "ev errors",
)
def stream_error_counts(spark, sf):
    counts = logs.stream_error_counts(base.errors(_Streamed(spark, sf), sf), delay=LATE)
    return _run(counts, spark, "errors", ["window_start", "window_end", "error_type"])


COOLDOWN_SQL = """
    WITH RECURSIVE {views}, ordered AS (SELECT *, row_number() OVER (PARTITION BY project, suggestion_type ORDER BY logged_at,
      event_id) AS n FROM shown),
    step AS (SELECT event_id, project, suggestion_type, logged_at, n, was_shown, was_shown = 1 AS shown, logged_at AS last
      FROM ordered WHERE n = 1
    UNION ALL SELECT event_id, project, suggestion_type, logged_at, n, was_shown, fresh AS shown,
      CASE WHEN fresh OR was_shown = 0 THEN logged_at ELSE last END AS last
      FROM (SELECT o.*, s.last, o.was_shown = 1 AND s.last < o.logged_at - INTERVAL 7 DAY AS fresh
        FROM step s JOIN ordered o ON o.project = s.project AND o.suggestion_type = s.suggestion_type AND o.n = s.n + 1))
    SELECT event_id, project, suggestion_type, logged_at, shown FROM step WHERE was_shown = 1"""


@register("stream_suggestion_cooldown", COOLDOWN_SQL.format(views=", ".join(f"{v} AS ({base.VIEWS[v]})" for v in ("ev", "shown"))))
def stream_suggestion_cooldown(spark, sf):
    """Every candidate with its decision; rows of the log that were not shown are dismissals."""
    log = base.shown(_Streamed(spark, sf), sf)
    decisions = current.cooldown_changes(log.where("was_shown = 1"), log.where("was_shown = 0"), cooldown_days=7, delay=LATE)
    return _run(decisions, spark, "cooldown", ["event_id"])


@register(
    "stream_feedback_sessions",
    """
    WITH marked AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
      FROM feedback WINDOW w AS (PARTITION BY user_id ORDER BY created_at, event_id)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS s FROM marked),
    g AS (SELECT user_id, s, min(created_at) AS window_start, max(created_at) + INTERVAL 6 HOUR AS window_end, count(*) AS total,
      count(*) FILTER (WHERE feedback_reason = 'didnt_answer') AS didnt_answer FROM numbered GROUP BY 1, 2)
    SELECT window_start, window_end, user_id, total, didnt_answer FROM g""",
    "ev feedback",
)
def stream_feedback_sessions(spark, sf):
    sessions = current.session_changes(base.feedback(_Streamed(spark, sf), sf), delay=LATE)
    return _run(sessions, spark, "sessions", ["user_id", "window_start"])


@register(
    "stream_incremental_index",
    """
    SELECT source_path, project, sha256(CASE WHEN document_id % 3 = 0 THEN content || ' (revised)' ELSE content END)
      AS content_hash FROM docs WHERE document_id % 7 <> 5""",
    "docs",
)
def stream_incremental_index(spark, sf):
    """Three deliveries: all documents, all again with a third of them revised, and the files that have vanished."""
    incoming, index = scratch_path(spark, "incoming"), scratch_path(spark, "index")
    rows = base.docs(spark, sf).select("document_id", "source_path", "project", "content", "source_date")
    revised = F.when(F.col("document_id") % 3 == 0, F.concat("content", F.lit(" (revised)"))).otherwise(F.col("content"))
    vanished = rows.where("document_id % 7 = 5").withColumn("content", F.lit(None).cast("string"))
    for version, delivery in enumerate((rows, rows.withColumn("content", revised), vanished)):
        delivery = delivery.withColumns({"version": F.lit(version).cast("long"), "vanished": F.lit(version == 2)})
        delivery.drop("document_id").write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(spark.read.parquet(incoming).schema).parquet(incoming)
        indexing.stream_incremental_index(stream, index, compact_every=2)
    return indexing.current_documents(spark, index).select("source_path", "project", "content_hash")
