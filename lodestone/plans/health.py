"""Failure signals and the fix queue.

Metrics are computed per scope: ``*`` for everything and every project by name. Each table is read
once, its rows counted for both scopes with map-side combine, and everything after that works on
rows per project.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.scoring import priority_from_count, priority_from_ratio
from lodestone.operators import filters, metrics
from lodestone.operators.ranking import first_per, numbered, top_k

GLOBAL = "*"
PREVIEW = 3

# Signal names in report order and the text of a signal without data.
SIGNALS = {
    "not_found_frequency": "0 of 0 feedback entries were 'didn't answer'",
    "metadata_deficits": "Documents missing source_date/project/language metadata",
    "metadata_top_offenders": "No metadata offenders detected.",
    "stale_notes": "Notes older than 90d+: 0, 180d+: 0, 365d+: 0",
    "stale_decisions": "Decisions older than 90d+: 0, 180d+: 0, 365d+: 0",
    "ingestion_errors": "No ingestion errors recorded.",
    "repeated_questions": "Repeated queries observed over the past 48 hours",
    "permission_denials": "No permission denials recorded.",
    "low_indexed_volume": "No projects below minimum document count.",
    "low_retrieval_hit_rate": "No projects below hit-rate threshold.",
}

TASK_COLUMNS = ["task_id", "action", "target", "project", "reason", "priority"]


@dataclass(frozen=True)
class HealthTables:
    """Inputs. ``decisions`` carries the project of its document; lint is the capture lint output."""

    documents: DataFrame
    decisions: DataFrame
    feedback: DataFrame
    searches: DataFrame
    denials: DataFrame
    errors: DataFrame
    lint: DataFrame | None = None

    def only(self, project: str) -> HealthTables:
        """The same tables restricted to a project."""
        kept = {
            f.name: getattr(self, f.name).where(F.col("project") == project)
            for f in fields(self)
            if f.name != "lint"
        }
        return replace(self, **kept)


@dataclass(frozen=True)
class Thresholds:
    """Default thresholds and windows."""

    low_volume: int = metrics.LOW_VOLUME
    low_hit_rate: float = metrics.LOW_HIT_RATE
    min_searches: int = metrics.MIN_SEARCHES
    search_hours: int = metrics.SEARCH_WINDOW_HOURS
    error_hours: int = metrics.ERROR_WINDOW_HOURS
    denial_hours: int = metrics.DENIAL_WINDOW_HOURS
    repeat_hours: int = metrics.REPEAT_WINDOW_HOURS
    stale_days: tuple[int, ...] = metrics.STALE_BUCKETS
    # tasks per family, newest or first ones; None for all
    metadata: int | None = None
    repeats: int | None = None
    recent: int | None = None
    lint: int | None = None


#: Document ids that are numbered by one task.
NUMBERED_TOGETHER = 65_536


def scoped(df: DataFrame) -> DataFrame:
    """Every row once for the global scope and once for its project, if it has one."""
    scopes = F.array_compact(F.array(F.lit(GLOBAL), F.nullif("project", F.lit(""))))
    return df.withColumn("scope", F.explode(scopes))


def _preview(df: DataFrame, order: list[Column], item: Column, limit: int = PREVIEW) -> DataFrame:
    """The first items per scope as one comma-separated text."""
    first = top_k(df.withColumn("_item", item), ["scope"], order, limit, "_place")
    parts = F.array_sort(F.collect_list(F.struct("_place", "_item")))
    return first.groupBy("scope").agg(F.array_join(F.transform(parts, lambda p: p["_item"]), ", ").alias("preview"))


def feedback_by_scope(t: HealthTables) -> DataFrame:
    return metrics.feedback_metrics(scoped(t.feedback), ["scope"])


def repeats_by_scope(t: HealthTables, now, th: Thresholds, limit: int = 5) -> DataFrame:
    """The most repeated questions per scope, with their place."""
    counted = metrics.repeated_counts(t.feedback, now=now, window_hours=th.repeat_hours)
    order = [F.desc("repeat_count"), F.asc("question"), F.asc("project")]
    return top_k(scoped(counted), ["scope"], order, limit, "place")


def missing_by_scope(t: HealthTables) -> DataFrame:
    """Documents lacking metadata per scope, and the first of them."""
    rows = t.documents.where(filters.lacks_metadata()).select("document_id", "project", "source_path")
    return scoped(rows).groupBy("scope").agg(
        F.count("*").alias("missing_count"),
        F.min_by(F.struct("source_path", "project"), "document_id").alias("first"),
    )


def stale_by_scope(t: HealthTables, now, th: Thresholds, what: str) -> DataFrame:
    """Cumulative counts per scope: ``value`` of the smallest bucket and the list as text."""
    if what == "Notes":
        rows, column = t.documents.where(F.col("source_type") == "markdown"), "source_date"
    else:
        rows, column = t.decisions.where(F.col("status") == "active"), "decision_date"
    buckets = metrics.stale_buckets(
        scoped(rows.select("project", column)), column, now=now, days=th.stale_days, by=["scope"]
    )
    smallest = metrics.bucket_days(th.stale_days)[0]
    entries = F.array_sort(F.collect_list(F.struct("days", "stale_count")))
    label = F.transform(entries, lambda e: F.concat(e["days"], F.lit("d+: "), e["stale_count"]))
    return buckets.groupBy("scope").agg(
        F.max(F.when(F.col("days") == smallest, F.col("stale_count"))).alias("value"),
        F.concat(F.lit(f"{what} older than "), F.array_join(label, ", ")).alias("details"),
    )


def errors_by_scope(t: HealthTables, now, th: Thresholds) -> DataFrame:
    """Errors of the window per scope: total, details and the newest error."""
    recent = scoped(metrics.within(t.errors, "created_at", now, th.error_hours))
    kind = F.coalesce(F.nullif("error_type", F.lit("")), F.lit("unknown"))
    counts = recent.groupBy("scope", kind.alias("kind")).agg(F.count("*").alias("n"))
    order = F.array_position(F.array(F.lit("parse_error"), F.lit("no_text"), F.lit("oversize")), F.col("kind"))
    entry = F.struct(order.alias("o"), "kind", "n")
    totals = counts.groupBy("scope").agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("_all")
    )
    known = F.filter("_all", lambda e: e["o"] > 0)
    shown = F.when(F.size(known) > 0, known).otherwise(F.col("_all"))
    label = F.transform(shown, lambda e: F.concat(F.replace(e["kind"], F.lit("_"), F.lit(" ")), F.lit(": "), e["n"]))
    names = _preview(
        recent.where(F.col("source_path") != ""),
        [F.desc("created_at"), F.desc("event_id")],
        F.regexp_extract("source_path", "[^/]*$", 0),
    )
    newest = recent.groupBy("scope").agg(
        F.max_by(F.struct("source_path", "project"), F.struct("created_at", "event_id")).alias("newest")
    )
    details = F.concat(
        F.array_join(label, ", "), F.coalesce(F.concat(F.lit(". Recent: "), "preview"), F.lit(""))
    )
    return (
        totals.join(names, "scope", "left")
        .join(newest, "scope")
        .select("scope", "total", details.alias("details"), "newest")
    )


def denials_by_scope(t: HealthTables, now, th: Thresholds) -> DataFrame:
    recent = scoped(metrics.within(t.denials, "created_at", now, th.denial_hours))
    counted = recent.groupBy("scope").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("reason_code") == "scope").alias("s"),
        F.count_if(F.col("reason_code") == "path").alias("p"),
    )
    parts = F.array_compact(
        F.array(
            F.when(F.col("s") > 0, F.concat("s", F.lit(" scope"))),
            F.when(F.col("p") > 0, F.concat("p", F.lit(" path"))),
        )
    )
    details = F.concat(
        F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("unknown"),
        F.when(F.col("total") == 1, " denial").otherwise(" denials"),
        F.lit(f" in the last {th.denial_hours}h"),
    )
    return counted.select("scope", "total", details.alias("details"))


def low_volume_by_scope(t: HealthTables, th: Thresholds) -> DataFrame:
    return scoped(metrics.low_volume_projects(t.documents, threshold=th.low_volume))


def low_hit_rate_by_scope(t: HealthTables, now, th: Thresholds) -> DataFrame:
    low = metrics.low_hit_rate_projects(
        t.searches,
        now=now,
        threshold=th.low_hit_rate,
        window_hours=th.search_hours,
        min_count=th.min_searches,
    )
    # 'all' is the label of searches without a project, which have no scope of their own.
    return scoped(low).where("scope <> 'all'")


def _percent(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value * 100)


def _projects(n: Column) -> Column:
    return F.when(n == 1, "project").otherwise("projects")


def failure_signals(t: HealthTables, *, now, thresholds: Thresholds | None = None) -> DataFrame:
    """scope, position, name, value, details: ten signals for every scope that has any data."""
    th = thresholds or Thresholds()
    feedback = feedback_by_scope(t).select(
        "scope",
        F.lit("not_found_frequency").alias("name"),
        F.col("not_found_frequency").alias("value"),
        F.concat("didnt_answer", F.lit(" of "), "total", F.lit(" feedback entries were 'didn't answer'")).alias("details"),
    )

    def signal(df: DataFrame, name: str, value, details: Column) -> DataFrame:
        return df.select(
            "scope", F.lit(name).alias("name"), F.col(value).cast("double").alias("value"), details.alias("details")
        )

    missing = t.documents.where(filters.lacks_metadata())
    offenders = missing.groupBy(F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown")).alias("label")).agg(
        F.count("*").alias("n"), F.max("project").alias("project")
    )
    offenders = scoped(offenders)
    by_count = [F.desc("n"), F.asc("label")]
    top = offenders.groupBy("scope").agg(F.count("*").alias("value"))
    top = top.join(_preview(offenders, by_count, F.concat("label", F.lit(" ("), "n", F.lit(")"))), "scope")
    volume = low_volume_by_scope(t, th)
    volume_item = F.concat(
        F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown")), F.lit(" ("), "document_count", F.lit(")")
    )
    low_volume = volume.groupBy("scope").agg(F.count("*").alias("value")).join(
        _preview(volume, [F.asc("document_count"), F.asc("project")], volume_item), "scope"
    )
    rates = low_hit_rate_by_scope(t, now, th)
    rate_item = F.concat("project", F.lit(" ("), _percent(F.col("hit_rate"), 0), F.lit("% hits)"))
    low_rate = rates.groupBy("scope").agg(F.count("*").alias("value")).join(
        _preview(rates, [F.desc("total"), F.asc("project")], rate_item), "scope"
    )
    n = F.col("value")
    parts = [
        feedback,
        signal(
            missing_by_scope(t), "metadata_deficits", "missing_count", F.lit(SIGNALS["metadata_deficits"])
        ),
        signal(
            top,
            "metadata_top_offenders",
            "value",
            F.concat(F.lit("Top "), _projects(n), F.lit(": "), "preview"),
        ),
        signal(stale_by_scope(t, now, th, "Notes"), "stale_notes", "value", F.col("details")),
        signal(stale_by_scope(t, now, th, "Decisions"), "stale_decisions", "value", F.col("details")),
        signal(errors_by_scope(t, now, th), "ingestion_errors", "total", F.col("details")),
        signal(
            scoped(metrics.repeated_counts(t.feedback, now=now, window_hours=th.repeat_hours))
            .groupBy("scope")
            .agg(F.count("*").alias("value")),
            "repeated_questions",
            "value",
            F.lit(SIGNALS["repeated_questions"]),
        ),
        signal(denials_by_scope(t, now, th), "permission_denials", "total", F.col("details")),
        signal(
            low_volume,
            "low_indexed_volume",
            "value",
            F.concat(n, F.lit(" "), _projects(n), F.lit(f" under {th.low_volume} docs: "), "preview"),
        ),
        signal(
            low_rate,
            "low_retrieval_hit_rate",
            "value",
            F.concat(
                n, F.lit(" "), _projects(n), F.lit(f" below {th.low_hit_rate * 100:.0f}% hit rate: "), "preview"
            ),
        ),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # At most ten signals per scope: gather them, then lay out all names with a default each.
    gathered = found.groupBy("scope").agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("value", "details")))).alias("_found")
    )
    names = F.array(
        *[F.struct(F.lit(k).alias("name"), F.lit(v).alias("default")) for k, v in SIGNALS.items()]
    )
    rows = gathered.select("scope", "_found", F.posexplode(names).alias("position", "_n"))
    hit = F.try_element_at("_found", F.col("_n.name"))
    return rows.select(
        "scope",
        "position",
        "_n.name",
        F.coalesce(hit["value"], F.lit(0.0)).alias("value"),
        F.coalesce(hit["details"], F.col("_n.default")).alias("details"),
    )


def _dashed(project: Column) -> Column:
    return F.replace(project, F.lit(" "), F.lit("-"))


def _task(df: DataFrame, task_id, action, target, project, reason, priority) -> DataFrame:
    values = [task_id, action, target, project, reason, priority.cast("int")]
    return df.select(*[v.alias(n) for v, n in zip(values, TASK_COLUMNS, strict=True)])


def _blank_to(column: str, project: str | None) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(project).cast("string"))


def fix_tasks_feedback(feedback: DataFrame, project: str | None = None) -> DataFrame:
    rows = metrics.feedback_metrics(feedback).where("total > 0 AND not_found_frequency > 0")
    freq = F.col("not_found_frequency")
    return _task(
        rows,
        F.lit(f"not-found-{(project or 'global').replace(' ', '-')}"),
        F.lit("run_routine"),
        F.lit("routines/daily-checkin"),
        F.lit(project).cast("string"),
        F.concat(
            _percent(freq, 1),
            F.lit(f"% of feedback entries from {project or 'all projects'} were 'didn't answer'"),
        ),
        priority_from_ratio(freq),
    )


def fix_tasks_metadata(documents: DataFrame, project: str | None = None, *, limit: int | None = None) -> DataFrame:
    found = filters.missing_metadata_docs(documents, limit=limit)
    found = found.withColumn("_block", F.floor(F.col("document_id") / NUMBERED_TOGETHER))
    return _task(
        numbered(found, ["_block"], "document_id", "_i"),
        F.concat(F.lit("metadata-"), "document_id", F.lit("-"), "_i"),
        F.lit("fix_metadata"),
        F.col("source_path"),
        _blank_to("project", project),
        F.concat(F.lit("Missing metadata fields: "), F.array_join("missing_fields", ", ")),
        F.lit(3),
    )


def fix_tasks_repeats(
    feedback: DataFrame, project: str | None = None, *, now, window_hours: int = metrics.REPEAT_WINDOW_HOURS, limit: int | None = None
) -> DataFrame:
    rows = metrics.repeated_questions(feedback, now=now, window_hours=window_hours, limit=limit)
    return _task(
        rows,
        F.concat(F.lit("repeat-"), text.short_hash(F.col("question"))),
        F.lit("run_query"),
        F.col("question"),
        _blank_to("project", project),
        F.concat(F.lit("Question repeated "), "repeat_count", F.lit(" times in the last 48h")),
        priority_from_count(F.col("repeat_count")),
    )


def _newest(rows: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """The newest row per key; with a limit the newest of these."""
    order = [F.desc("created_at"), F.desc("event_id")]
    found = first_per(rows, keys, order)
    return found.orderBy(*order).limit(limit) if limit else found


def fix_tasks_permissions(denials: DataFrame, project: str | None = None, *, now, thresholds=None) -> DataFrame:
    th = thresholds or Thresholds()
    recent = metrics.within(denials, "created_at", now, th.denial_hours)
    rows = _newest(recent, ["reason_code", "action_name", "target_path"], th.recent)
    code, routine, path = F.col("reason_code"), F.col("action_name"), F.col("target_path")
    blocked = F.concat(
        F.lit("Routine '"),
        routine,
        F.lit("' blocked at scope "),
        F.coalesce(F.col("scope_level").cast("string"), F.lit("None")),
        F.lit("; requires "),
        F.coalesce(F.col("required_scope_level").cast("string"), F.lit("None")),
        F.lit(" for "),
        path,
    )
    outside = F.concat(F.lit("Routine '"), routine, F.lit("' tried to write outside allowed paths: "), path)
    other = F.concat(F.lit("Permission denial for '"), routine, F.lit("' writing to "), path)
    return _task(
        rows,
        F.concat(F.lit("permission-"), text.short_hash(F.concat_ws(":", code, routine, path))),
        F.when(code == "scope", "raise_scope").when(code == "path", "allow_path").otherwise("review_permissions"),
        F.when(code == "scope", F.lit("permissions.default_scope")).otherwise(path),
        _blank_to("project", project),
        F.when(code == "scope", blocked).when(code == "path", outside).otherwise(other),
        F.when(code == "scope", 2).otherwise(3),
    )


def fix_tasks_lint(issues: DataFrame, *, limit: int | None = None) -> DataFrame:
    rows = issues.orderBy("path", "position").limit(limit) if limit else issues
    code = F.col("code")
    return _task(
        rows,
        F.concat(F.lit("lint-"), code, F.lit("-"), text.short_hash(F.concat_ws(":", code, "path"))),
        F.when(code == "missing_metadata", "fix_metadata").otherwise("fix_capture"),
        F.col("path"),
        F.lit(None).cast("string"),
        F.col("message"),
        F.col("priority"),
    )


def fix_tasks_ingestion(errors: DataFrame, *, now, thresholds=None) -> DataFrame:
    th = thresholds or Thresholds()
    recent = metrics.within(errors, "created_at", now, th.error_hours)
    kinds = recent.where(F.col("source_path") != "").withColumn(
        "error_type", F.coalesce(F.nullif("error_type", F.lit("")), F.lit("ingestion_error"))
    )
    rows = _newest(kinds, ["source_path", "error_type"], th.recent)
    kind = F.col("error_type")
    label = F.replace(kind, F.lit("_"), F.lit(" "))
    message = text.strip(F.col("error_message"))
    cut = F.when(F.length(message) > 160, F.concat(F.substring(message, 1, 157), F.lit("..."))).otherwise(message)
    return _task(
        rows,
        F.concat(F.lit("ingest-"), text.short_hash(F.concat_ws(":", "source_path", kind))),
        F.lit("open_file"),
        F.col("source_path"),
        F.col("project"),
        F.when(
            F.coalesce(F.col("error_message"), F.lit("")) == "", F.concat(label, F.lit(" while indexing this file."))
        ).otherwise(F.concat(label, F.lit(" while indexing: "), cut)),
        F.when(kind == "parse_error", 2).when(kind.isin("no_text", "oversize"), 3).otherwise(4),
    )


def fix_tasks_indexing(documents: DataFrame, searches: DataFrame, *, now, thresholds=None) -> DataFrame:
    th = thresholds or Thresholds()
    volume = metrics.low_volume_projects(documents, threshold=th.low_volume)
    name = F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown"))
    few = _task(
        volume,
        F.concat(F.lit("index-volume-"), _dashed(name)),
        F.lit("open_indexing"),
        name,
        name,
        F.concat(
            F.lit("Project '"),
            name,
            F.lit("' has only "),
            "document_count",
            F.lit(f" documents (threshold {th.low_volume})."),
        ),
        priority_from_count(F.col("gap")),
    )
    rates = metrics.low_hit_rate_projects(
        searches,
        now=now,
        threshold=th.low_hit_rate,
        window_hours=th.search_hours,
        min_count=th.min_searches,
    )
    missed = _task(
        rates,
        F.concat(F.lit("index-hit-rate-"), _dashed(name)),
        F.lit("open_indexing"),
        name,
        name,
        F.concat(
            F.lit("Project '"),
            name,
            F.lit("' has "),
            _percent(F.col("hit_rate"), 0),
            F.lit(f"% retrieval hit rate (threshold {th.low_hit_rate * 100:.0f}%)."),
        ),
        priority_from_ratio(hit_rate_severity(F.col("hit_rate"), th.low_hit_rate)),
    )
    return few.unionByName(missed)


def hit_rate_severity(rate: Column, threshold: float) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(threshold) - rate) / threshold) if threshold > 0 else F.lit(0.0)


def fix_tasks_staleness(
    documents: DataFrame, decisions: DataFrame, project: str | None = None, *, now, days=metrics.STALE_BUCKETS
) -> DataFrame:
    """One weekly-review task when the smallest bucket of notes or decisions is not empty.

    ``decisions`` carries the document's project, as in ``HealthTables``.
    """
    notes = metrics.stale_document_buckets(documents, now=now, days=days, source_type="markdown")
    active = decisions.where(F.col("status") == "active")
    aged = metrics.stale_buckets(active, "decision_date", now=now, days=days)
    rows = notes.withColumn("what", F.lit("Notes")).unionByName(aged.withColumn("what", F.lit("Decisions")))
    smallest = metrics.bucket_days(days)[0]
    entries = F.array_sort(F.collect_list(F.struct("days", "stale_count")))
    label = F.transform(entries, lambda e: F.concat(e["days"], F.lit("d+: "), e["stale_count"]))
    lists = rows.groupBy("what").agg(
        F.max(F.when(F.col("days") == smallest, F.col("stale_count"))).alias("n"),
        F.concat("what", F.lit(" older than "), F.array_join(label, ", ")).alias("details"),
    )
    # Notes before decisions.
    texts = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("what", "details"))), asc=False)
    both = lists.groupBy().agg(
        F.max("n").alias("n"), F.array_join(F.transform(texts, lambda e: e["details"]), " | ").alias("reason")
    )
    return _task(
        both.where("n > 0"),
        F.lit(f"stale-review-{(project or 'global').replace(' ', '-')}"),
        F.lit("run_routine"),
        F.lit("routines/weekly-review"),
        F.lit(project).cast("string"),
        F.col("reason"),
        priority_from_count(F.col("n")),
    )


def fix_queue(t: HealthTables, *, now, project: str | None = None, thresholds: Thresholds | None = None) -> DataFrame:
    """All tasks of a project (or of everything), most urgent first."""
    th = thresholds or Thresholds()
    if project is not None:
        t = t.only(project)
    parts = [
        fix_tasks_feedback(t.feedback, project),
        fix_tasks_metadata(t.documents, project, limit=th.metadata),
        fix_tasks_repeats(t.feedback, project, now=now, window_hours=th.repeat_hours, limit=th.repeats),
        fix_tasks_permissions(t.denials, project, now=now, thresholds=th),
        fix_tasks_ingestion(t.errors, now=now, thresholds=th),
        fix_tasks_indexing(t.documents, t.searches, now=now, thresholds=th),
        fix_tasks_staleness(t.documents, t.decisions, project, now=now, days=th.stale_days),
    ]
    if t.lint is not None:
        parts.append(fix_tasks_lint(t.lint, limit=th.lint))
    return sort_fix_queue(union_fix_tasks(parts))


def union_fix_tasks(parts: list[DataFrame]) -> DataFrame:
    tasks = parts[0]
    for part in parts[1:]:
        tasks = tasks.unionByName(part)
    return tasks


def sort_fix_queue(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("priority", "task_id")


def placed_fix_queue(tasks: DataFrame) -> DataFrame:
    """The queue with the place of every task, numbered in blocks of a priority and the start of an id."""
    start = F.regexp_extract("task_id", "^[^-]*-?.{0,3}", 0)
    found = numbered(tasks.withColumn("_start", start), ["priority", "_start"], "task_id", "place")
    return found.drop("_start").withColumn("place", F.col("place").cast("int"))
