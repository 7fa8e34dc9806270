"""Rule-ranked suggestions for a table of answered requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.scoring import priority_from_count, priority_from_ratio
from lodestone.operators.corpus import cooldown_anti_join
from lodestone.operators.ranking import first_per, top_k
from lodestone.plans import health
from lodestone.plans.health import GLOBAL, HealthTables, Thresholds

# Limits, routines and rules.
MIN_SOURCES = 2
MAX_SUGGESTIONS = 3
MIN_FEEDBACK = 3
COVERAGE_ROUTINE = "daily-checkin"
STALENESS_ROUTINE = "weekly-review"
COOLDOWN_DAYS = 7

CANDIDATE_COLUMNS = [
    "priority",
    "position",
    "suggestion_type",
    "text",
    "why",
    "hypothesis",
    "project",
    "routine_action",
    "action",
    "target",
]


def resolve_coach_mode(override: Column, project: Column, per_project: Column, default: Column) -> Column:
    """Request override, else the project's mode, else the default; 'coach' switches it on."""
    own = F.when(F.coalesce(project, F.lit("")) != "", F.try_element_at(per_project, project))
    mode = F.coalesce(own, default, F.lit("boring"))
    return F.coalesce(override, F.lower(mode) == "coach")


def _candidate(
    df: DataFrame,
    position: int,
    kind: str,
    message: Column,
    why: str,
    priority: Column,
    *,
    project: Column,
    routine: str | None = None,
    action: Column | str | None = None,
    target: Column | None = None,
) -> DataFrame:
    def text_or_null(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return df.select(
        "scope",
        priority.cast("int").alias("priority"),
        F.lit(position).alias("position"),
        F.lit(kind).alias("suggestion_type"),
        message.alias("text"),
        F.lit(why).alias("why"),
        F.lit(True).alias("hypothesis"),
        project.alias("project"),
        text_or_null(routine).alias("routine_action"),
        text_or_null(action).alias("action"),
        text_or_null(target).alias("target"),
    )


def coach_health_candidates(t: HealthTables, *, now, thresholds: Thresholds | None = None) -> DataFrame:
    """Up to eight candidates per scope, each with its priority and place in the rule list."""
    th = thresholds or Thresholds()
    scope = F.when(F.col("scope") != GLOBAL, F.col("scope"))

    def named(column: Column) -> Column:
        return F.nullif(text.strip(column), F.lit(""))

    feedback = health.feedback_by_scope(t).where((F.col("total") >= MIN_FEEDBACK) & (F.col("not_found_frequency") > 0))
    freq = F.col("not_found_frequency")
    repeats = health.repeats_by_scope(t, now, th, 1).where("place = 1 AND question <> ''")
    question = text.strip(F.col("question"))
    missing = health.missing_by_scope(t)
    path = F.nullif(F.col("first.source_path"), F.lit(""))
    denials = health.denials_by_scope(t, now, th)
    volume = first_per(
        health.low_volume_by_scope(t, th), ["scope"], [F.asc("document_count"), F.asc("project")]
    )
    label = F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown"))
    rates = first_per(
        health.low_hit_rate_by_scope(t, now, th), ["scope"], [F.asc("hit_rate"), F.desc("total"), F.asc("project")]
    )
    notes = health.stale_by_scope(t, now, th, "Notes").select("scope", F.col("value").alias("n"))
    aged = health.stale_by_scope(t, now, th, "Decisions").select("scope", F.col("value").alias("n"))
    stale = notes.unionByName(aged).groupBy("scope").agg(F.max("n").alias("n")).where("n > 0")
    errors = health.errors_by_scope(t, now, th)
    newest = F.nullif(F.col("newest.source_path"), F.lit(""))
    threshold = f"(threshold {th.low_hit_rate * 100:.0f}%)"
    parts = [
        _candidate(
            feedback,
            1,
            "health_not_found",
            F.concat(
                F.format_string("%.1f", freq * 100),
                F.lit(
                    '% of recent feedback entries were marked "didn\'t answer". '
                    "Run a Daily Check-in to capture missing context."
                ),
            ),
            "Feedback logs show unanswered questions.",
            priority_from_ratio(freq),
            project=scope,
            routine=COVERAGE_ROUTINE,
        ),
        _candidate(
            repeats,
            2,
            "health_repeated_questions",
            F.concat(
                F.lit('The question "'),
                question,
                F.lit('" was asked '),
                "repeat_count",
                F.lit(" times in the last 48h. Capture a decision or note so it is easier to retrieve."),
            ),
            "Repeated questions indicate a coverage gap.",
            priority_from_count(F.col("repeat_count")),
            project=named(F.col("project")),
            action="run_query",
            target=question,
        ),
        _candidate(
            missing,
            3,
            "health_metadata",
            F.concat(
                "missing_count",
                F.lit(
                    " documents are missing required metadata (project/date/language). "
                    "Fixing metadata will improve retrieval quality."
                ),
            ),
            "Health metrics show missing metadata fields.",
            priority_from_count(F.col("missing_count")),
            project=F.coalesce(named(F.col("first.project")), scope),
            action=F.when(path.isNotNull(), "open_file").otherwise("open_health"),
            target=path,
        ),
        _candidate(
            denials,
            4,
            "health_permissions",
            F.concat(
                "total",
                F.lit(
                    " permission denials were logged recently. "
                    "Review Settings > Permissions to allow routine writes."
                ),
            ),
            "Routine writes were blocked by current scope or path rules.",
            priority_from_count(F.col("total")),
            project=scope,
            action="open_settings",
        ),
        _candidate(
            volume,
            5,
            "health_low_volume",
            F.concat(
                F.lit('Project "'),
                label,
                F.lit('" has only '),
                "document_count",
                F.lit(f" documents (threshold {th.low_volume}). Index more sources to improve coverage."),
            ),
            "Health metrics show low indexed volume.",
            priority_from_count(F.col("gap")),
            project=F.nullif(label, F.lit("unknown")),
            action="open_indexing",
            target=label,
        ),
        _candidate(
            rates,
            6,
            "health_low_hit_rate",
            F.concat(
                F.lit('Project "'),
                label,
                F.lit('" has '),
                F.format_string("%.0f", F.col("hit_rate") * 100),
                F.lit(f"% retrieval hit rate {threshold}. Add sources or adjust queries to improve coverage."),
            ),
            "Recent searches returned few results.",
            priority_from_ratio(health.hit_rate_severity(F.col("hit_rate"), th.low_hit_rate)),
            project=F.nullif(label, F.lit("unknown")),
            action="open_indexing",
            target=label,
        ),
        _candidate(
            stale,
            7,
            "health_staleness",
            F.lit("Stale notes or decisions were detected. Run a Weekly Review to refresh them."),
            "Health metrics show items older than the staleness thresholds.",
            priority_from_count(F.col("n")),
            project=scope,
            routine=STALENESS_ROUTINE,
        ),
        _candidate(
            errors,
            8,
            "health_ingestion",
            F.concat(
                "total",
                F.lit(" ingestion errors were logged recently. Review the Health page to open failed files."),
            ),
            "Indexing errors reduce coverage.",
            priority_from_count(F.col("total")),
            project=F.coalesce(named(F.col("newest.project")), scope),
            action=F.when(newest.isNotNull(), "open_file").otherwise("open_health"),
            target=newest,
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def answer_facts(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests with source_count, overall_confidence, and the sources the rules would cite.

    ``requests`` has request_id and project, ``sources`` request_id, rank, snippet, date_confidence
    and may_be_outdated. An answer has at most top-k sources, so the lists are short.
    """
    from lodestone.functions.dates import confidence_name, confidence_rank

    snippet = F.coalesce("snippet", F.lit(""))
    bare = snippet.rlike(rf"(?iU)\bdecision\b[{text.SPACES}]*:") & ~snippet.rlike(
        rf"(?iU)\brationale\b[{text.SPACES}]*:"
    )
    facts = sources.groupBy("request_id").agg(
        F.count("*").alias("source_count"),
        confidence_name(F.min(confidence_rank(F.col("date_confidence")))).alias("overall_confidence"),
        F.array_sort(F.collect_list(F.when(F.col("may_be_outdated"), F.col("rank")))).alias("outdated"),
        F.array_sort(F.collect_list(F.when(bare, F.col("rank")))).alias("bare_decisions"),
        F.min("rank").alias("first_rank"),
    )
    none = F.array().cast("array<int>")
    rows = requests.join(facts, "request_id", "left").na.fill(0, ["source_count"])
    return rows.withColumns(
        {
            "not_found": F.col("source_count") == 0,
            "outdated": F.coalesce("outdated", none),
            "bare_decisions": F.coalesce("bare_decisions", none),
        }
    )


def coach_answer_candidates(facts: DataFrame) -> DataFrame:
    """Candidates per request after the evidence gates, in rule order, with cited ranks."""
    project, thin = F.col("project"), F.col("source_count") < MIN_SOURCES
    low = F.coalesce(F.col("overall_confidence") == "LOW", F.lit(False))
    has_project = F.coalesce(project, F.lit("")) != ""
    topic = F.when(
        has_project,
        F.concat(
            F.lit('Add or index documents for this topic under project "'),
            project,
            F.lit('" so future answers can be grounded.'),
        ),
    ).otherwise(
        "Add or index documents for this topic under the appropriate project tag so future answers can be grounded."
    )
    none = F.array().cast("array<int>")

    def rule(when, position, kind, message, why, hypothesis, routine, cited):
        return F.when(
            when,
            F.struct(
                F.lit(position).alias("position"),
                F.lit(kind).alias("suggestion_type"),
                message.alias("text"),
                why.alias("why"),
                F.lit(hypothesis).alias("hypothesis"),
                F.lit(routine).cast("string").alias("routine_action"),
                cited.alias("citations"),
            ),
        )

    outdated = F.slice("outdated", 1, 2)
    first = F.when(F.col("first_rank").isNotNull(), F.array("first_rank")).otherwise(none)
    coverage = rule(
        thin,
        1,
        "coverage_gaps",
        topic,
        F.when(F.col("not_found"), "No sources matched this query.").otherwise(
            f"Fewer than {MIN_SOURCES} sources were cited."
        ),
        True,
        COVERAGE_ROUTINE,
        none,
    )
    staleness = rule(
        ~thin & low,
        2,
        "staleness",
        F.lit("Consider re-checking this topic before acting on the answer."),
        F.lit("Date confidence is LOW based on older source dates."),
        False,
        STALENESS_ROUTINE,
        F.when(F.size(outdated) > 0, outdated).otherwise(first),
    )
    # A LOW answer gives one suggestion, the staleness one, so hygiene waits for better dates.
    hygiene = rule(
        ~thin & ~low & (F.size("bare_decisions") >= 2),
        3,
        "capture_hygiene",
        F.lit(
            "Add a short Rationale block alongside Decision entries in the cited excerpts "
            "to preserve why the choice was made."
        ),
        F.lit("Multiple Decision sections appear without a Rationale line in the cited snippets."),
        False,
        None,
        F.slice("bare_decisions", 1, 2),
    )
    rows = facts.select(
        "request_id", "project", F.explode_outer(F.array_compact(F.array(coverage, staleness, hygiene))).alias("_c")
    )
    return rows.where("_c IS NOT NULL").select("request_id", "project", "_c.*")


def coach_suggestions(
    facts: DataFrame,
    health_candidates: DataFrame,
    log: DataFrame,
    *,
    now,
    cooldown_days: int = COOLDOWN_DAYS,
    limit: int = MAX_SUGGESTIONS,
) -> DataFrame:
    """At most ``limit`` suggestions per request.

    ``facts`` comes from ``answer_facts`` plus coach_enabled and override_cooldown. Answer rules come
    first, then health rules by priority. Order of elimination: cooldown, repeated fingerprint,
    repeated routine (health rows only), limit.
    """
    enabled = facts.where("coach_enabled")
    own = coach_answer_candidates(enabled).withColumn("stage", F.lit(1)).withColumn("priority", F.lit(0))
    own = own.withColumn("action", F.lit(None).cast("string")).withColumn("target", F.lit(None).cast("string"))
    solid = ~F.col("not_found") & (F.col("source_count") >= MIN_SOURCES)
    allowed = enabled.where(solid & (F.coalesce("overall_confidence", F.lit("")) != "LOW")).select(
        "request_id", F.coalesce(F.nullif("project", F.lit("")), F.lit(GLOBAL)).alias("scope")
    )
    # Eight rows per scope at most, one scope per request.
    advised = (
        allowed.join(health_candidates, "scope")
        .drop("scope")
        .withColumn("stage", F.lit(2))
        .withColumn("citations", F.lit(None).cast("array<int>"))
    )
    asked = enabled.select(
        "request_id",
        F.coalesce(F.nullif("project", F.lit("")), F.lit("all")).alias("_project_key"),
        F.coalesce("override_cooldown", F.lit(False)).alias("_override"),
    )
    rows = own.unionByName(advised).join(asked, "request_id")
    # Without a project to look up, an overridden row meets no log entry and stays.
    key = F.when(~F.col("_override"), F.coalesce(F.nullif("project", F.lit("")), "_project_key"))
    rows = cooldown_anti_join(
        rows.withColumn("cooldown_project", key), log, now=now, cooldown_days=cooldown_days
    )
    rows = rows.withColumn("fingerprint", text.fingerprint(F.col("suggestion_type"), F.col("text")))
    order = [F.asc("stage"), F.asc("priority"), F.col("routine_action").isNull().asc(), F.asc("position")]
    rows = first_per(rows, ["request_id", "fingerprint"], order)
    # Rows without a routine are alone in their group, so only repeated routines compete; answer rules
    # never share a routine with each other.
    rows = rows.withColumn("_routine", F.coalesce("routine_action", "fingerprint"))
    rows = first_per(rows, ["request_id", "_routine"], order)
    ranked = top_k(rows, ["request_id"], order, limit, "place")
    return ranked.select(
        "request_id",
        "place",
        "suggestion_type",
        "fingerprint",
        "text",
        "why",
        "hypothesis",
        "project",
        "routine_action",
        "action",
        "target",
        "citations",
    )
