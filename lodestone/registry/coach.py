"""Coach queries."""

from pyspark.sql import functions as F

from lodestone.plans import coach
from lodestone.registry.base import (
    NOW,
    NOW_SQL,
    VIEWS,
    ev,
    register,
    shown,
    sql_count_priority,
    sql_ratio_priority,
    table,
)
from lodestone.registry.health import (
    LOGS,
    LOW_RATES,
    LOW_VOLUMES,
    RECENT_ERRORS,
    SIGNALS_SQL,
    THRESHOLDS,
    _scope,
    health_tables,
)


@register(
    "resolve_coach_mode",
    """
    SELECT event_id, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE
      CASE project WHEN 'p1' THEN true WHEN 'p2' THEN false ELSE k % 2 = 0 END END AS enabled FROM ev""",
    "ev",
)
def resolve_coach_mode(spark, sf):
    k = F.col("k")
    override = F.when(k % 4 == 0, True).when(k % 4 == 1, False)
    modes = F.create_map(F.lit("p1"), F.lit("Coach"), F.lit("p2"), F.lit("boring"))
    default = F.when(k % 2 == 0, "coach").otherwise("boring")
    enabled = coach.resolve_coach_mode(override, F.col("project"), modes, default)
    return ev(spark, sf).select("event_id", enabled.alias("enabled"))


HEALTH_CANDIDATES = f"""
    WITH sig AS ({SIGNALS_SQL.strip()}),
    rep AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, question, project) AS r FROM {_scope(f'''(
      SELECT question, project, count(*) AS n FROM feedback WHERE created_at >= {NOW_SQL} - INTERVAL 48 HOUR
      GROUP BY 1, 2 HAVING count(*) > 1)''')}),
    mis AS (SELECT scope, count(*) AS n, arg_min(source_path, document_id) AS path, arg_min(project, document_id) AS p
      FROM {_scope("gappy")} WHERE source_date IS NULL OR project = '' OR language = '' GROUP BY 1),
    vol AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n, project) AS r FROM {_scope(LOW_VOLUMES)}),
    rat AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY hit_rate, total DESC, project) AS r FROM {_scope(LOW_RATES)}),
    err AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, event_id DESC) AS r,
      count(*) OVER (PARTITION BY scope) AS n FROM {_scope(RECENT_ERRORS)}),
    cand AS (
      SELECT scope, {sql_ratio_priority("value")} AS priority, 1 AS position, 'health_not_found' AS suggestion_type,
        printf('%.1f', value * 100) || '% of recent feedback entries were marked "didn''t answer". Run a Daily Check-in to capture missing context.' AS text,
        nullif(scope, '*') AS project, 'daily-checkin' AS routine_action, NULL AS action, NULL AS target
      FROM sig WHERE name = 'not_found_frequency' AND value > 0
        AND scope IN (SELECT scope FROM {_scope("feedback")} GROUP BY 1 HAVING count(*) >= 3)
      UNION ALL SELECT scope, {sql_count_priority("n")}, 2, 'health_repeated_questions', 'The question "' || question || '" was asked '
        || n || ' times in the last 48h. Capture a decision or note so it is easier to retrieve.', nullif(project, ''), NULL,
        'run_query', question FROM rep WHERE r = 1
      UNION ALL SELECT scope, {sql_count_priority("n")}, 3, 'health_metadata', n || ' documents are missing required metadata (project/date/language). Fixing metadata will improve retrieval quality.',
        coalesce(nullif(p, ''), nullif(scope, '*')), NULL, 'open_file', path FROM mis
      UNION ALL SELECT scope, {sql_count_priority("value::BIGINT")}, 4, 'health_permissions', value::BIGINT || ' permission denials were logged recently. Review Settings > Permissions to allow routine writes.',
        nullif(scope, '*'), NULL, 'open_settings', NULL FROM sig WHERE name = 'permission_denials' AND value > 0
      UNION ALL SELECT scope, {sql_count_priority("49 - n")}, 5, 'health_low_volume', 'Project "' || coalesce(nullif(project, ''), 'unknown')
        || '" has only ' || n || ' documents (threshold 49). Index more sources to improve coverage.', nullif(project, ''), NULL,
        'open_indexing', coalesce(nullif(project, ''), 'unknown') FROM vol WHERE r = 1
      UNION ALL SELECT scope, {sql_ratio_priority("greatest(0.0::DOUBLE, (0.4::DOUBLE - hit_rate) / 0.4::DOUBLE)")}, 6,
        'health_low_hit_rate', 'Project "' || project || '" has ' || printf('%.0f', hit_rate * 100) || '% retrieval hit rate (threshold 40%). Add sources or adjust queries to improve coverage.',
        project, NULL, 'open_indexing', project FROM rat WHERE r = 1 AND scope <> 'all'
      UNION ALL SELECT scope, {sql_count_priority("max(value)::BIGINT")}, 7, 'health_staleness', 'Stale notes or decisions were detected. Run a Weekly Review to refresh them.',
        nullif(scope, '*'), 'weekly-review', NULL, NULL FROM sig WHERE name IN ('stale_notes', 'stale_decisions')
        GROUP BY scope HAVING max(value) > 0
      UNION ALL SELECT scope, {sql_count_priority("n")}, 8, 'health_ingestion', n || ' ingestion errors were logged recently. Review the Health page to open failed files.',
        coalesce(nullif(project, ''), nullif(scope, '*')), NULL, 'open_file', source_path FROM err WHERE r = 1)"""


@register(
    "coach_health_candidates",
    HEALTH_CANDIDATES
    + " SELECT scope, priority, position::INTEGER AS position, suggestion_type, text, project, routine_action, action, target FROM cand",
    LOGS,
)
def coach_health_candidates(spark, sf):
    rows = coach.coach_health_candidates(health_tables(spark, sf), now=NOW, thresholds=THRESHOLDS)
    return rows.drop("why", "hypothesis")


# Requests: user turns; sources: 0 to 4 per request, their text and dates from the turn's numbers.
VIEWS["requests"] = """
SELECT conv_id * 1000 + turn AS request_id, CASE conv_id % 11 WHEN 0 THEN NULL ELSE 'p' || (conv_id % 11) END AS project,
  conv_id % 9 <> 0 AS coach_enabled, conv_id % 6 = 0 AS override_cooldown, (conv_id % 5)::INTEGER AS n, conv_id, turn
FROM conversations WHERE role = 'user'"""
VIEWS["sources"] = """
SELECT request_id, rank::INTEGER AS rank, CASE WHEN conv_id % 4 = 0 THEN 'Decision : keep ' || rank || CASE WHEN rank = 3
    THEN ' Rationale: cheap' ELSE '' END ELSE 'plain' END AS snippet,
  CASE (conv_id + rank) % 13 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS date_confidence,
  (conv_id + rank) % 13 = 0 AS may_be_outdated FROM requests, range(1, 5) t(rank) WHERE rank <= n"""


def requests(spark, sf):
    conv = F.col("conv_id")
    return (
        table(spark, sf, "conversations")
        .where("role = 'user'")
        .select(
            (conv * 1000 + F.col("turn")).alias("request_id"),
            F.when(conv % 11 != 0, F.concat(F.lit("p"), conv % 11)).alias("project"),
            (conv % 9 != 0).alias("coach_enabled"),
            (conv % 6 == 0).alias("override_cooldown"),
            (conv % 5).cast("int").alias("n"),
            "conv_id",
        )
    )


def sources(spark, sf):
    rank, mix = F.col("rank"), (F.col("conv_id") + F.col("rank")) % 13
    rows = requests(spark, sf).where("n > 0").select("request_id", "conv_id", F.explode(F.sequence(F.lit(1), "n")).alias("rank"))
    decision = F.concat(F.lit("Decision : keep "), rank, F.when(rank == 3, " Rationale: cheap").otherwise(""))
    return rows.select(
        "request_id",
        "rank",
        F.when(F.col("conv_id") % 4 == 0, decision).otherwise("plain").alias("snippet"),
        F.when(mix == 0, "LOW").when(mix == 1, "MEDIUM").otherwise("HIGH").alias("date_confidence"),
        (mix == 0).alias("may_be_outdated"),
    )


def facts(spark, sf):
    return coach.answer_facts(requests(spark, sf).drop("n", "conv_id"), sources(spark, sf))


ANSWER_CANDIDATES = """
    facts AS (SELECT r.request_id, r.project, r.coach_enabled, r.override_cooldown, count(s.rank) AS sc,
      CASE WHEN count(*) FILTER (WHERE date_confidence = 'LOW') > 0 THEN 'LOW' WHEN count(*) FILTER (WHERE
        date_confidence = 'MEDIUM') > 0 THEN 'MEDIUM' WHEN count(s.rank) > 0 THEN 'HIGH' END AS conf,
      list(s.rank ORDER BY s.rank) FILTER (WHERE may_be_outdated) AS outd,
      list(s.rank ORDER BY s.rank) FILTER (WHERE snippet LIKE 'Decision%' AND snippet NOT LIKE '%Rationale:%') AS bare
      FROM requests r LEFT JOIN sources s USING (request_id) GROUP BY ALL),
    own AS (
      SELECT request_id, project, 1 AS position, 'coverage_gaps' AS suggestion_type,
        CASE WHEN project IS NOT NULL THEN 'Add or index documents for this topic under project "' || project || '" so future answers can be grounded.'
        ELSE 'Add or index documents for this topic under the appropriate project tag so future answers can be grounded.' END AS text,
        CASE WHEN sc = 0 THEN 'No sources matched this query.' ELSE 'Fewer than 2 sources were cited.' END AS why,
        'daily-checkin' AS routine_action, '' AS citations FROM facts WHERE sc < 2
      UNION ALL SELECT request_id, project, 2, 'staleness', 'Consider re-checking this topic before acting on the answer.',
        'Date confidence is LOW based on older source dates.', 'weekly-review',
        coalesce(array_to_string(outd[1:2], ','), '1') FROM facts WHERE sc >= 2 AND conf = 'LOW'
      UNION ALL SELECT request_id, project, 3, 'capture_hygiene', 'Add a short Rationale block alongside Decision entries in the cited excerpts to preserve why the choice was made.',
        'Multiple Decision sections appear without a Rationale line in the cited snippets.', NULL, array_to_string(bare[1:2], ',')
        FROM facts WHERE sc >= 2 AND conf <> 'LOW' AND len(bare) >= 2)"""


@register(
    "coach_answer_candidates",
    "WITH "
    + ANSWER_CANDIDATES.strip()
    + " SELECT request_id, project, position::INTEGER AS position, suggestion_type, text, why, routine_action, citations FROM own",
    "requests sources",
)
def coach_answer_candidates(spark, sf):
    rows = coach.coach_answer_candidates(facts(spark, sf))
    return rows.drop("hypothesis").withColumn("citations", F.array_join("citations", ","))


@register(
    "coach_suggestions",
    HEALTH_CANDIDATES
    + ", "
    + ANSWER_CANDIDATES.strip()
    + f""", allc AS (
      SELECT request_id, o.project, 1 AS stage, 0 AS priority, position, suggestion_type, text, routine_action, NULL AS action,
        NULL AS target FROM own o
      UNION ALL SELECT request_id, c.project, 2, priority, position, suggestion_type, text, routine_action, action, target
        FROM facts f JOIN cand c ON c.scope = coalesce(f.project, '*') WHERE sc >= 2 AND conf <> 'LOW'),
    warm AS (SELECT a.*, sha256(suggestion_type || ':' || lower(text)) AS fingerprint FROM allc a
      JOIN facts f USING (request_id) WHERE coach_enabled AND (override_cooldown OR NOT EXISTS (SELECT 1 FROM shown s
        WHERE s.project = coalesce(a.project, f.project, 'all') AND s.suggestion_type = a.suggestion_type
        AND s.logged_at >= {NOW_SQL} - INTERVAL 36 HOUR))),
    once AS (SELECT *, row_number() OVER (PARTITION BY request_id, coalesce(routine_action, fingerprint)
        ORDER BY stage, priority, routine_action IS NULL, position) AS r,
      row_number() OVER (PARTITION BY request_id, fingerprint ORDER BY stage, priority, routine_action IS NULL, position) AS f
      FROM warm),
    placed2 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY stage, priority, routine_action IS NULL, position)
      AS place FROM once WHERE r = 1 AND f = 1)
    SELECT request_id, place::INTEGER AS place, suggestion_type, fingerprint, text, project, routine_action, action, target
    FROM placed2 WHERE place <= 3""",
    LOGS + " shown requests sources",
)
def coach_suggestions(spark, sf):
    candidates = coach.coach_health_candidates(health_tables(spark, sf), now=NOW, thresholds=THRESHOLDS)
    rows = coach.coach_suggestions(facts(spark, sf), candidates, shown(spark, sf), now=NOW, cooldown_days=1.5)
    return rows.drop("why", "hypothesis", "citations")
