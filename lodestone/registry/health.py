"""Answer, health and fix-queue queries."""

from pyspark.sql import functions as F

from lodestone.operators import corpus
from lodestone.plans import answers, health, routines
from lodestone.registry.base import (
    NOW,
    NOW_SQL,
    VIEWS,
    asked,
    decided,
    denials,
    docs,
    errors,
    feedback,
    gappy,
    register,
    searches,
    sql_collapse,
    sql_confidence,
    sql_count_priority,
    sql_ratio_priority,
    sql_tokens,
    texts,
)
from lodestone.registry.metrics import HIT_RATE, REPEATED
from lodestone.registry.preparation import LINT_SQL, notes
from lodestone.registry.retrieval import CORPUS, vector_only_results

# Ranked results of the vector search with document facts and citation fields.
VIEWS["results"] = """
SELECT query_id, chunk_id, rank::INTEGER AS rank, greatest(0.0, 1 - d) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (
    SELECT q.query_id, v.chunk_id, round(list_cosine_distance(q.embedding, v.embedding), 9) AS d
    FROM asked q, vecs v JOIN docs USING (chunk_id) WHERE scope IS NULL OR project = scope)) WHERE rank <= 5"""
VIEWS["cited"] = f"""
SELECT query_id, rank, chunk_id, source_path, source_type, project, source_date, content,
  CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS snippet,
  {sql_confidence("source_date")} AS date_confidence,
  coalesce({NOW_SQL} - source_date > INTERVAL 180 DAY, false) AS may_be_outdated, round(score, 4) AS similarity_score
FROM results JOIN docs USING (chunk_id)"""
CITED = CORPUS + " results cited"


def cited(spark, sf):
    return answers.citations(vector_only_results(spark, sf), now=NOW)


@register(
    "citations",
    """
    SELECT query_id, rank, chunk_id, source_path, source_type, project, snippet, source_date, date_confidence,
      may_be_outdated, similarity_score FROM cited""",
    CITED,
)
def citations(spark, sf):
    return cited(spark, sf).drop("locator_text")


LEVEL_SQL = """CASE min(CASE date_confidence WHEN 'UNKNOWN' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END)
      WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' END"""


@register(
    "overall_date_confidence",
    f"SELECT query_id, {LEVEL_SQL} AS overall_confidence FROM cited GROUP BY 1",
    CITED,
)
def overall_date_confidence(spark, sf):
    return answers.overall_confidence(cited(spark, sf))


@register(
    "oldest_source_confidence",
    f"""
    SELECT query_id, oldest_date, {sql_confidence("oldest_date")} AS date_confidence FROM (
      SELECT query_id, min(source_date) AS oldest_date FROM cited GROUP BY 1)""",
    CITED,
)
def oldest_source_confidence(spark, sf):
    return answers.oldest_source_confidence(cited(spark, sf), now=NOW)


# Queries include some that found nothing.
@register(
    "answer_footer",
    f"""
    WITH facts AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE may_be_outdated) AS o, {LEVEL_SQL} AS c
      FROM cited WHERE query_id % 5 <> 0 GROUP BY 1)
    SELECT query_id, coalesce(n, 0) AS source_count, coalesce(o, 0) AS outdated_source_count, c AS date_confidence,
      coalesce(o, 0) > 0 AS may_be_outdated, n IS NULL AS not_found,
      CASE WHEN n IS NULL THEN 'Not found in sources.' END AS not_found_message
    FROM asked LEFT JOIN facts USING (query_id)""",
    CITED,
)
def answer_footer(spark, sf):
    found = cited(spark, sf).where("query_id % 5 <> 0")
    return answers.answer_footer(asked(spark, sf), found)


@register(
    "top_answer",
    """
    SELECT query_id, snippet || ' [1]' AS answer, CASE WHEN snippet IS NULL THEN 'Not found in sources.' END AS message
    FROM asked LEFT JOIN (SELECT query_id, snippet FROM cited WHERE rank = 1 AND query_id % 5 <> 0) USING (query_id)""",
    CITED,
)
def top_answer(spark, sf):
    return answers.top_answer(asked(spark, sf), cited(spark, sf).where("query_id % 5 <> 0"))


def _answer_sql(x):
    return sql_collapse(f"regexp_replace(replace({x}, '...', ''), '\\[\\d+\\]', '', 'g')")


@register(
    "grounding_audit",
    f"""
    WITH ans AS (SELECT document_id AS query_id, CASE document_id % 3 WHEN 0 THEN substr(content, 1, 60) || '... [1]'
      WHEN 1 THEN 'invented ' || document_id || ' claim [2]' ELSE '[1] ...' END AS answer, content FROM docs)
    SELECT query_id, answer AS text, 'Answer text not found in used chunks.' AS reason FROM ans
    WHERE {_answer_sql("answer")} <> '' AND NOT contains({sql_collapse("content")}, {_answer_sql("answer")})""",
    "docs",
)
def grounding_audit(spark, sf):
    n = F.col("document_id")
    answer = (
        F.when(n % 3 == 0, F.concat(F.substring("content", 1, 60), F.lit("... [1]")))
        .when(n % 3 == 1, F.concat(F.lit("invented "), n, F.lit(" claim [2]")))
        .otherwise("[1] ...")
    )
    rows = docs(spark, sf).select(n.alias("query_id"), answer.alias("answer"), F.col("content").alias("used_chunk"))
    return answers.grounding_audit(rows)


@register(
    "search_history_from_results",
    """
    SELECT query_id, raw AS query, scope AS project, coalesce(n, 0)::INTEGER AS results_count,
      (n IS NULL)::INTEGER AS not_found FROM asked LEFT JOIN (SELECT query_id, count(*) AS n FROM results
      WHERE query_id % 5 <> 0 GROUP BY 1) USING (query_id)""",
    CORPUS + " results",
)
def search_history_from_results(spark, sf):
    from lodestone.operators.search import prepare_queries

    found = vector_only_results(spark, sf).where("query_id % 5 <> 0")
    prepared = prepare_queries(asked(spark, sf).drop("text"))
    return answers.search_history_from_results(prepared, found, now=NOW).drop("searched_at")


@register(
    "decision_badges",
    """
    SELECT query_id, chunk_id, count(decision_id) FILTER (WHERE status = 'active') AS active_count,
      count(decision_id) FILTER (WHERE status = 'superseded') AS superseded_count
    FROM results LEFT JOIN decided USING (chunk_id) GROUP BY 1, 2""",
    CORPUS + " results decided",
)
def decision_badges(spark, sf):
    return corpus.decision_badges(vector_only_results(spark, sf), decided(spark, sf))


@register(
    "superseded_warning",
    """
    WITH hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, decision_id) AS place
      FROM results JOIN decided USING (chunk_id) WHERE status = 'superseded')
    SELECT query_id, count(*) AS superseded_count, string_agg('#' || decision_id || ': ' ||
      CASE WHEN length(decision_text) > 50 THEN substr(decision_text, 1, 50) || '...' ELSE decision_text END ||
      coalesce(' → replaced by #' || superseded_by, ''), '; ' ORDER BY place) FILTER (WHERE place <= 3) AS preview
    FROM hits GROUP BY 1""",
    CORPUS + " results decided",
)
def superseded_warning(spark, sf):
    return corpus.superseded_warning(vector_only_results(spark, sf), decided(spark, sf))


@register(
    "active_decisions_in_results",
    "SELECT query_id, decision_id, chunk_id FROM results JOIN decided USING (chunk_id) WHERE status = 'active'",
    CORPUS + " results decided",
)
def active_decisions_in_results(spark, sf):
    found = corpus.active_decisions(vector_only_results(spark, sf), decided(spark, sf))
    return found.select("query_id", "decision_id", "chunk_id")


ROUTINES_SQL = "(VALUES " + ", ".join(
    f"({i}, '{r}', '{b}', '{t}', {'NULL' if d is None else d})" for i, (r, b, t, d) in enumerate(routines.ROUTINE_QUERIES)
) + ") t(query_id, routine, bucket, text, days)"

ROUTINE_BM25 = f"""
    WITH toks AS (SELECT chunk_id, source_date, {sql_tokens("content")} AS t FROM docs),
    stats AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS mean FROM toks),
    post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM toks) GROUP BY 1, 2),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    rq AS (SELECT * FROM {ROUTINES_SQL}),
    ask AS (SELECT query_id, days, unnest(string_split(text, ' ')) AS term FROM rq),
    scored AS (SELECT query_id, chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1)
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))), 9) AS score
      FROM ask JOIN post USING (term) JOIN freq USING (term) JOIN toks USING (chunk_id), stats
      WHERE days IS NULL OR (source_date >= {NOW_SQL} - to_days(days) AND source_date < {NOW_SQL} + INTERVAL 1 DAY)
      GROUP BY query_id, chunk_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""


def spiced(spark, sf):
    """Documents whose text also names what routines ask for."""
    words = F.array(
        *[F.lit(w) for w in ("open loop", "recent context", "decisions today", "weekly notes", "trip checklist", "missing metadata", "travel")]
    )
    extra = F.get(words, (F.col("document_id") % 7).cast("int"))
    return texts(spark, sf).withColumn("content", F.concat("content", F.lit(" "), extra))


SPICED_SQL = VIEWS["docs"].replace(
    "text AS content",
    "text || ' ' || ['open loop', 'recent context', 'decisions today', 'weekly notes', 'trip checklist', "
    "'missing metadata', 'travel'][doc_id % 7 + 1] AS content",
)


def _spiced(sql: str) -> str:
    return sql.replace("WITH ", f"WITH docs AS ({SPICED_SQL}), ", 1)


@register(
    "routine_bundle",
    _spiced(
        ROUTINE_BM25
        + " SELECT routine, bucket, rank::INTEGER AS rank, chunk_id, round(score, 6) AS score "
        "FROM ranked JOIN rq USING (query_id) WHERE rank <= 5"
    ),
)
def routine_bundle(spark, sf):
    from datetime import datetime

    sources, _ = routines.routine_bundle(spiced(spark, sf), target=datetime.fromisoformat(NOW))
    return sources.withColumn("score", F.round("score", 6))


@register(
    "routine_warnings",
    _spiced(
        ROUTINE_BM25
        + """ SELECT routine, bucket, 'No citations found for ' || bucket || '; manual entry recommended.' AS warning
        FROM rq WHERE query_id NOT IN (SELECT query_id FROM ranked)"""
    ),
)
def routine_warnings(spark, sf):
    from datetime import datetime

    return routines.routine_bundle(spiced(spark, sf), target=datetime.fromisoformat(NOW))[1]


THRESHOLDS = health.Thresholds(low_volume=49, stale_days=(90, 180, 365))


def health_tables(spark, sf):
    base = gappy(spark, sf)
    placed = decided(spark, sf).join(base.select("chunk_id", "project"), "chunk_id")
    from lodestone.operators.chunking import capture_lint

    return health.HealthTables(
        documents=base,
        decisions=placed,
        feedback=feedback(spark, sf),
        searches=searches(spark, sf),
        denials=denials(spark, sf),
        errors=errors(spark, sf),
        lint=capture_lint(notes(spark, sf)),
    )


VIEWS["placed"] = "SELECT decided.*, gappy.project FROM decided JOIN gappy USING (chunk_id)"


def _scope(view):
    return f"(SELECT *, unnest(CASE WHEN project = '' THEN ['*'] ELSE ['*', project] END) AS scope FROM {view})"


RECENT_ERRORS = f"(SELECT * FROM errors WHERE created_at >= {NOW_SQL} - INTERVAL 168 HOUR)"
LOW_RATES = f"({HIT_RATE} WHERE total >= 5 AND (total - not_found) / total < 0.4)"
LOW_VOLUMES = "(SELECT project, count(*) AS n FROM gappy GROUP BY 1 HAVING count(*) < 49)"

SIGNALS_SQL = f"""
    WITH sig AS (
      SELECT scope, 'not_found_frequency' AS name, count(*) FILTER (WHERE feedback_reason = 'didnt_answer') / count(*) AS value,
        count(*) FILTER (WHERE feedback_reason = 'didnt_answer') || ' of ' || count(*)
          || ' feedback entries were ''didn''t answer''' AS details FROM {_scope("feedback")} GROUP BY 1
      UNION ALL SELECT scope, 'metadata_deficits', count(*), 'Documents missing source_date/project/language metadata'
        FROM {_scope("gappy")} WHERE source_date IS NULL OR project = '' OR language = '' GROUP BY 1
      UNION ALL SELECT scope, 'metadata_top_offenders', count(*), CASE WHEN count(*) = 1 THEN 'Top project: ' ELSE 'Top projects: ' END
          || string_agg(label || ' (' || n || ')', ', ' ORDER BY place) FILTER (WHERE place <= 3) FROM (
        SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, label) AS place FROM {_scope('''(
          SELECT coalesce(nullif(project, ''), 'unknown') AS label, project, count(*) AS n FROM gappy
          WHERE source_date IS NULL OR project = '' OR language = '' GROUP BY 1, 2)''')}) GROUP BY 1
      UNION ALL SELECT scope, 'stale_notes', count(*) FILTER (WHERE source_date <= {NOW_SQL} - INTERVAL 90 DAY),
        'Notes older than 90d+: ' || count(*) FILTER (WHERE source_date <= {NOW_SQL} - INTERVAL 90 DAY) || ', 180d+: '
          || count(*) FILTER (WHERE source_date <= {NOW_SQL} - INTERVAL 180 DAY) || ', 365d+: '
          || count(*) FILTER (WHERE source_date <= {NOW_SQL} - INTERVAL 365 DAY)
        FROM {_scope("gappy")} WHERE source_type = 'markdown' GROUP BY 1
      UNION ALL SELECT scope, 'stale_decisions', count(*) FILTER (WHERE decision_date <= {NOW_SQL} - INTERVAL 90 DAY),
        'Decisions older than 90d+: ' || count(*) FILTER (WHERE decision_date <= {NOW_SQL} - INTERVAL 90 DAY) || ', 180d+: '
          || count(*) FILTER (WHERE decision_date <= {NOW_SQL} - INTERVAL 180 DAY) || ', 365d+: '
          || count(*) FILTER (WHERE decision_date <= {NOW_SQL} - INTERVAL 365 DAY)
        FROM {_scope("placed")} WHERE status = 'active' GROUP BY 1
      UNION ALL SELECT scope, 'ingestion_errors', count(*), rtrim(
          CASE WHEN count(*) FILTER (WHERE error_type = 'parse_error') > 0 THEN 'parse error: '
            || count(*) FILTER (WHERE error_type = 'parse_error') || ', ' ELSE '' END
          || CASE WHEN count(*) FILTER (WHERE error_type = 'no_text') > 0 THEN 'no text: '
            || count(*) FILTER (WHERE error_type = 'no_text') || ', ' ELSE '' END
          || CASE WHEN count(*) FILTER (WHERE error_type = 'oversize') > 0 THEN 'oversize: '
            || count(*) FILTER (WHERE error_type = 'oversize') || ', ' ELSE '' END, ', ')
          || '. Recent: ' || string_agg('f' || regexp_extract(source_path, 'f(\\d+)[.]md$', 1) || '.md', ', '
            ORDER BY created_at DESC, event_id DESC) FILTER (WHERE r <= 3)
        FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, event_id DESC) AS r
          FROM {_scope(RECENT_ERRORS)}) GROUP BY 1
      UNION ALL SELECT scope, 'repeated_questions', count(*), 'Repeated queries observed over the past 48 hours'
        FROM {_scope(f'''(SELECT question, project, count(*) AS n FROM feedback WHERE created_at >= {NOW_SQL} - INTERVAL 48 HOUR
          GROUP BY 1, 2 HAVING count(*) > 1)''')} GROUP BY 1
      UNION ALL SELECT scope, 'permission_denials', count(*), coalesce(nullif(rtrim(
          CASE WHEN count(*) FILTER (WHERE reason_code = 'scope') > 0 THEN count(*) FILTER (WHERE reason_code = 'scope')
            || ' scope, ' ELSE '' END || CASE WHEN count(*) FILTER (WHERE reason_code = 'path') > 0
            THEN count(*) FILTER (WHERE reason_code = 'path') || ' path' ELSE '' END, ', '), ''), 'unknown')
          || CASE WHEN count(*) = 1 THEN ' denial' ELSE ' denials' END || ' in the last 168h'
        FROM {_scope(f"(SELECT * FROM denials WHERE created_at >= {NOW_SQL} - INTERVAL 168 HOUR)")} GROUP BY 1
      UNION ALL SELECT scope, 'low_indexed_volume', count(*), count(*) || CASE WHEN count(*) = 1 THEN ' project' ELSE ' projects' END
          || ' under 49 docs: ' || string_agg(coalesce(nullif(project, ''), 'unknown') || ' (' || n || ')', ', ' ORDER BY r)
          FILTER (WHERE r <= 3) FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n, project) AS r
          FROM {_scope(LOW_VOLUMES)}) GROUP BY 1
      UNION ALL SELECT scope, 'low_retrieval_hit_rate', count(*), count(*) || CASE WHEN count(*) = 1 THEN ' project' ELSE ' projects' END
          || ' below 40% hit rate: ' || string_agg(project || ' (' || printf('%.0f', hit_rate * 100) || '% hits)', ', ' ORDER BY r)
          FILTER (WHERE r <= 3) FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY total DESC, project) AS r
          FROM {_scope(LOW_RATES)} WHERE scope <> 'all') GROUP BY 1),
    names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')" for i, (k, v) in enumerate(health.SIGNALS.items()))})
      t(position, name, fallback))
    SELECT scope, position::INTEGER AS position, name, coalesce(value, 0)::DOUBLE AS value, coalesce(details, fallback) AS details
    FROM (SELECT DISTINCT scope FROM sig) CROSS JOIN names LEFT JOIN sig USING (scope, name)"""
LOGS = "docs gappy decided placed ev feedback searches errors denials"


@register("failure_signals", SIGNALS_SQL, LOGS)
def failure_signals(spark, sf):
    return health.failure_signals(health_tables(spark, sf), now=NOW, thresholds=THRESHOLDS)


TASKS = {}
TASKS["fix_tasks_feedback"] = f"""
    SELECT 'not-found-global' AS task_id, 'run_routine' AS action, 'routines/daily-checkin' AS target, NULL::VARCHAR AS project,
      printf('%.1f', f * 100) || '% of feedback entries from all projects were ''didn''t answer''' AS reason,
      {sql_ratio_priority("f")} AS priority
    FROM (SELECT count(*) FILTER (WHERE feedback_reason = 'didnt_answer') / count(*) AS f FROM feedback) WHERE f > 0"""
TASKS["fix_tasks_metadata"] = """
    SELECT 'metadata-' || document_id || '-' || row_number() OVER (ORDER BY document_id) AS task_id, 'fix_metadata' AS action,
      source_path AS target, nullif(project, '') AS project, 'Missing metadata fields: ' || array_to_string(list_filter([
      CASE WHEN source_date IS NULL THEN 'source_date' END, CASE WHEN project = '' THEN 'project' END,
      CASE WHEN language = '' THEN 'language' END], lambda x: x IS NOT NULL), ', ') AS reason, 3 AS priority
    FROM (SELECT * FROM gappy WHERE source_date IS NULL OR project = '' OR language = '')"""
TASKS["fix_tasks_repeats"] = f"""
    SELECT 'repeat-' || substr(sha256(question), 1, 10) AS task_id, 'run_query' AS action, question AS target,
      nullif(project, '') AS project, 'Question repeated ' || repeat_count || ' times in the last 48h' AS reason,
      {sql_count_priority("repeat_count")} AS priority FROM ({REPEATED})"""
TASKS["fix_tasks_permissions"] = f"""
    SELECT 'permission-' || substr(sha256(reason_code || ':' || action_name || ':' || target_path), 1, 10) AS task_id,
      CASE reason_code WHEN 'scope' THEN 'raise_scope' WHEN 'path' THEN 'allow_path' ELSE 'review_permissions' END AS action,
      CASE reason_code WHEN 'scope' THEN 'permissions.default_scope' ELSE target_path END AS target,
      nullif(project, '') AS project,
      CASE reason_code WHEN 'scope' THEN 'Routine ''' || action_name || ''' blocked at scope ' || scope_level || '; requires '
        || required_scope_level || ' for ' || target_path WHEN 'path' THEN 'Routine ''' || action_name
        || ''' tried to write outside allowed paths: ' || target_path
        ELSE 'Permission denial for ''' || action_name || ''' writing to ' || target_path END AS reason,
      (CASE reason_code WHEN 'scope' THEN 2 ELSE 3 END)::INTEGER AS priority
    FROM (SELECT *, row_number() OVER (PARTITION BY reason_code, action_name, target_path ORDER BY created_at DESC, event_id DESC)
      AS r FROM denials WHERE created_at >= {NOW_SQL} - INTERVAL 168 HOUR) WHERE r = 1"""
TASKS["fix_tasks_lint"] = (
    LINT_SQL
    + """, ordered AS (SELECT *, CASE code WHEN 'missing_metadata' THEN 0 WHEN 'missing_rationale' THEN 1
      WHEN 'missing_rejected_options' THEN 2 ELSE 3 END AS o FROM issues)
    SELECT 'lint-' || code || '-' || substr(sha256(code || ':' || path), 1, 10) AS task_id,
      CASE code WHEN 'missing_metadata' THEN 'fix_metadata' ELSE 'fix_capture' END AS action, path AS target,
      NULL::VARCHAR AS project, message AS reason, priority::INTEGER AS priority FROM ordered"""
)
TASKS["fix_tasks_ingestion"] = f"""
    SELECT 'ingest-' || substr(sha256(source_path || ':' || kind), 1, 10) AS task_id, 'open_file' AS action,
      source_path AS target, project, CASE WHEN error_message = '' THEN replace(kind, '_', ' ') || ' while indexing this file.'
        ELSE replace(kind, '_', ' ') || ' while indexing: ' || CASE WHEN length(trim(error_message)) > 160
        THEN substr(trim(error_message), 1, 157) || '...' ELSE trim(error_message) END END AS reason,
      (CASE kind WHEN 'parse_error' THEN 2 WHEN 'no_text' THEN 3 WHEN 'oversize' THEN 3 ELSE 4 END)::INTEGER AS priority
    FROM (SELECT *, coalesce(nullif(error_type, ''), 'ingestion_error') AS kind, row_number() OVER (
      PARTITION BY source_path, error_type ORDER BY created_at DESC, event_id DESC) AS r FROM errors
      WHERE created_at >= {NOW_SQL} - INTERVAL 168 HOUR) WHERE r = 1"""
TASKS["fix_tasks_indexing"] = f"""
    SELECT 'index-volume-' || coalesce(nullif(project, ''), 'unknown') AS task_id, 'open_indexing' AS action,
      coalesce(nullif(project, ''), 'unknown') AS target, coalesce(nullif(project, ''), 'unknown') AS project,
      'Project ''' || coalesce(nullif(project, ''), 'unknown') || ''' has only ' || n || ' documents (threshold 49).' AS reason,
      {sql_count_priority("49 - n")} AS priority FROM {LOW_VOLUMES}
    UNION ALL SELECT 'index-hit-rate-' || project, 'open_indexing', project, project, 'Project ''' || project || ''' has '
      || printf('%.0f', hit_rate * 100) || '% retrieval hit rate (threshold 40%).',
      {sql_ratio_priority("greatest(0.0::DOUBLE, (0.4::DOUBLE - hit_rate) / 0.4::DOUBLE)")} FROM {LOW_RATES}"""
TASKS["fix_tasks_staleness"] = f"""
    SELECT 'stale-review-global' AS task_id, 'run_routine' AS action, 'routines/weekly-review' AS target, NULL::VARCHAR AS project,
      string_agg(details, ' | ' ORDER BY name DESC) FILTER (WHERE value > 0) AS reason,
      {sql_count_priority("max(value)::BIGINT")} AS priority
    FROM ({SIGNALS_SQL}) WHERE scope = '*' AND name IN ('stale_notes', 'stale_decisions') HAVING max(value) > 0"""


def _task(name, fn):
    views = LOGS + (" notes" if "lint" in name else "")

    @register(name, TASKS[name], views)
    def query(spark, sf):
        return fn(health_tables(spark, sf))

    return query


_task("fix_tasks_feedback", lambda t: health.fix_tasks_feedback(t.feedback))
_task("fix_tasks_metadata", lambda t: health.fix_tasks_metadata(t.documents))
_task("fix_tasks_repeats", lambda t: health.fix_tasks_repeats(t.feedback, now=NOW))
_task("fix_tasks_permissions", lambda t: health.fix_tasks_permissions(t.denials, now=NOW))
_task("fix_tasks_lint", lambda t: health.fix_tasks_lint(t.lint))
_task("fix_tasks_ingestion", lambda t: health.fix_tasks_ingestion(t.errors, now=NOW))
_task(
    "fix_tasks_indexing",
    lambda t: health.fix_tasks_indexing(t.documents, t.searches, now=NOW, thresholds=THRESHOLDS),
)
_task("fix_tasks_staleness", lambda t: health.fix_tasks_staleness(t.documents, t.decisions, now=NOW))

ALL_TASKS = " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in TASKS.values())


@register("fix_queue", ALL_TASKS, LOGS + " notes")
def fix_queue(spark, sf):
    return health.fix_queue(health_tables(spark, sf), now=NOW, thresholds=THRESHOLDS)


@register(
    "union_fix_tasks",
    " UNION ALL ".join(
        f"SELECT task_id, action, priority FROM ({TASKS[n]})"
        for n in TASKS
    ),
    LOGS + " notes",
)
def union_fix_tasks(spark, sf):
    t = health_tables(spark, sf)
    tasks = health.union_fix_tasks(
        [
            health.fix_tasks_feedback(t.feedback),
            health.fix_tasks_metadata(t.documents),
            health.fix_tasks_repeats(t.feedback, now=NOW),
            health.fix_tasks_permissions(t.denials, now=NOW),
            health.fix_tasks_lint(t.lint),
            health.fix_tasks_ingestion(t.errors, now=NOW),
            health.fix_tasks_indexing(t.documents, t.searches, now=NOW, thresholds=THRESHOLDS),
            health.fix_tasks_staleness(t.documents, t.decisions, now=NOW),
        ]
    )
    return tasks.select("task_id", "action", "priority")


@register(
    "sort_fix_queue",
    f"""
    SELECT task_id, priority, row_number() OVER (ORDER BY priority, task_id)::INTEGER AS place FROM ({ALL_TASKS})""",
    LOGS + " notes",
)
def sort_fix_queue(spark, sf):
    """Every task with its place in the queue."""
    queue = health.fix_queue(health_tables(spark, sf), now=NOW, thresholds=THRESHOLDS)
    return health.placed_fix_queue(queue).select("task_id", "priority", "place")
