"""Filter and predicate queries."""

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import filters
from lodestone.registry.base import (
    NOW,
    NOW_SQL,
    asked,
    decided,
    docs,
    gappy,
    register,
    spread,
    sql_collapse,
    sql_strip,
    table,
    texts,
)
from lodestone.functions.text import BOILERPLATE_RE, SPACES


@register(
    "filter_metadata",
    f"""
    SELECT document_id, project, source_type, language, source_date FROM docs
    WHERE project IN ('src1', 'src2', 'src3') AND source_type IN ('markdown', 'word') AND language = 'en'
      AND source_date >= {NOW_SQL} - INTERVAL 600 DAY AND source_date <= {NOW_SQL} - INTERVAL 30 DAY""",
    "docs",
)
def filter_metadata(spark, sf):
    from lodestone.functions.dates import before

    kept = filters.filter_metadata(
        docs(spark, sf),
        projects=["src1", "src2", "src3"],
        source_types=["md", "docx"],
        language="en",
        date_after=before(NOW, days=600),
        date_before=before(NOW, days=30),
    )
    return kept.select("document_id", "project", "source_type", "language", "source_date")


@register(
    "normalize_source_types",
    """
    WITH given AS (SELECT event_id, CASE WHEN k % 5 = 0 THEN [] ELSE [' MD', event_type, '', 'xls', 'Excel'] END AS kinds FROM ev)
    SELECT event_id, CASE WHEN len(kinds) = 0 THEN NULL ELSE array_to_string(list_sort(list_distinct(
      ['markdown', 'excel', event_type])), ',') END AS kinds
    FROM given JOIN ev USING (event_id)""",
    "ev",
)
def normalize_source_types(spark, sf):
    from lodestone.registry.base import ev

    given = F.array(F.lit(" MD"), "event_type", F.lit(""), F.lit("xls"), F.lit("Excel"))
    none = F.array().cast("array<string>")
    kinds = F.when(F.col("k") % 5 == 0, none).otherwise(given)
    return ev(spark, sf).select(
        "event_id", F.array_join(filters.normalize_source_types(kinds), ",").alias("kinds")
    )


@register(
    "resolve_project_scope",
    """
    SELECT event_id, CASE WHEN k % 3 = 0 THEN
        CASE WHEN k % 7 = 0 THEN 'a,b' WHEN k % 7 = 1 THEN 'a,b,p1' ELSE 'a,b,x' || (k % 7) END
      ELSE array_to_string(list_distinct_ordered, ',') END AS scope
    FROM (SELECT event_id, k, CASE WHEN project = '' AND k % 7 = 0 THEN []
        WHEN project = '' AND k % 7 = 1 THEN ['p1'] WHEN project = '' THEN ['x' || (k % 7)]
        WHEN k % 7 = 0 THEN [project] WHEN k % 7 = 1 AND project = 'p1' THEN ['p1']
        WHEN k % 7 = 1 THEN [project, 'p1'] ELSE [project, 'x' || (k % 7)] END AS list_distinct_ordered FROM ev)""",
    "ev",
)
def resolve_project_scope(spark, sf):
    from lodestone.registry.base import ev

    k = F.col("k")
    projects = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a")))
    inline = F.when(k % 7 == 1, "p1").when(k % 7 != 0, F.concat(F.lit("x"), k % 7))
    scope = filters.resolve_scope(projects, F.col("project"), inline)
    return ev(spark, sf).select("event_id", F.array_join(scope, ",").alias("scope"))


@register(
    "filter_required_phrases",
    """
    SELECT item_id, doc_id FROM documents JOIN (SELECT item_id, lower(text) AS phrase FROM benchmark)
      ON contains(lower(text), phrase)""",
)
def filter_required_phrases(spark, sf):
    """Which documents contain which benchmark passage, the passage being a required phrase."""
    from lodestone.plans.evaluation import passages_in_documents

    return passages_in_documents(texts(spark, sf), table(spark, sf, "benchmark")).select(
        "item_id", F.col("chunk_id").alias("doc_id")
    )


@register(
    "filter_excluded_terms",
    """
    SELECT chunk_id FROM docs WHERE NOT (contains(lower(content), 'the') OR contains(lower(content), 'er' || (chunk_id % 10)))""",
    "docs",
)
def filter_excluded_terms(spark, sf):
    terms = F.array(F.lit("the"), F.concat(F.lit("er"), F.col("chunk_id") % 10))
    return filters.filter_excluded_terms(docs(spark, sf).withColumn("excluded", terms)).select("chunk_id")


@register(
    "filter_max_age",
    f"SELECT document_id, source_date FROM docs WHERE source_date IS NULL OR source_date >= {NOW_SQL} - INTERVAL 90 DAY",
    "docs",
)
def filter_max_age(spark, sf):
    return filters.filter_max_age(docs(spark, sf), now=NOW, days=90).select("document_id", "source_date")


@register(
    "docs_by_metadata",
    """
    SELECT document_id, source_path, source_date FROM docs WHERE project = 'src4' AND source_type = 'recipe'
    ORDER BY source_date DESC NULLS LAST, document_id LIMIT 100""",
    "docs",
)
def docs_by_metadata(spark, sf):
    found = filters.docs_by_metadata(docs(spark, sf), projects=["src4"], source_types=["recipe"])
    return found.select("document_id", "source_path", "source_date")


# Lines of documents, with some lines that are boilerplate.
LINES_SQL = """
    WITH ln AS (SELECT doc_id, generate_subscripts(parts, 1)::INTEGER - 1 AS line_no, unnest(parts) AS line FROM (
      SELECT doc_id, string_split(text || chr(10) || CASE doc_id % 6 WHEN 0 THEN 'Page 3 of 10' WHEN 1 THEN ' 1/10 '
        WHEN 2 THEN 'Copyright 2024 X' WHEN 3 THEN '----' WHEN 4 THEN 'Back to top' ELSE 'Chapter 12' END, chr(10))
        AS parts FROM documents))"""


def document_lines(spark, sf):
    tails = F.array(
        *[F.lit(x) for x in ("Page 3 of 10", " 1/10 ", "Copyright 2024 X", "----", "Back to top", "Chapter 12")]
    )
    full = F.concat("text", F.lit("\n"), F.get(tails, (F.col("doc_id") % 6).cast("int")))
    return spread(table(spark, sf, "documents")).select(
        "doc_id", F.posexplode_outer(F.split(full, "\n")).alias("line_no", "line")
    )


@register(
    "is_boilerplate",
    LINES_SQL
    + f"""SELECT doc_id, line_no FROM ln WHERE regexp_matches({sql_strip("lower(line)")},
      '{BOILERPLATE_RE}')""",
)
def is_boilerplate(spark, sf):
    return document_lines(spark, sf).where(text.is_boilerplate(F.col("line"))).select("doc_id", "line_no")


def minimal_sql(x: str) -> str:
    found = f"regexp_extract_all({x}, '[^{SPACES}]+')"
    return (
        f"(len({found}) >= 10 AND len(list_distinct(list_transform(list_filter({found}, lambda w: length(w) > 1), "
        f"lambda w: lower(w)))) >= 5 AND (length(replace({x}, ' ', '')) = 0 OR "
        f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) / length(replace({x}, ' ', '')) >= 0.5))"
    )


@register(
    "has_minimal_content",
    LINES_SQL + f"SELECT doc_id, line_no, {minimal_sql('line')} AS ok FROM ln",
)
def has_minimal_content(spark, sf):
    return document_lines(spark, sf).select(
        "doc_id", "line_no", text.has_minimal_content(F.col("line")).alias("ok")
    )


@register(
    "validate_chunk",
    LINES_SQL
    + f""", body AS (SELECT *, {sql_strip("line")} AS b FROM ln)
    SELECT doc_id, line_no, (b <> '' AND length(line) // 4 >= 5 AND NOT regexp_matches({sql_strip("lower(b)")},
      '{BOILERPLATE_RE}') AND {minimal_sql("b")}) AS ok FROM body""",
)
def validate_chunk(spark, sf):
    ok = text.validate_chunk(F.col("line"), text.estimate_tokens(F.col("line")))
    return document_lines(spark, sf).select("doc_id", "line_no", ok.alias("ok"))


@register(
    "missing_metadata_docs",
    """
    SELECT document_id, project, source_path, array_to_string(list_filter([
      CASE WHEN source_date IS NULL THEN 'source_date' END, CASE WHEN project = '' THEN 'project' END,
      CASE WHEN language = '' THEN 'language' END], lambda x: x IS NOT NULL), ',') AS missing_fields
    FROM gappy WHERE source_date IS NULL OR project = '' OR language = ''""",
    "docs gappy",
)
def missing_metadata_docs(spark, sf):
    found = filters.missing_metadata_docs(gappy(spark, sf), limit=None)
    return found.select(
        "document_id", "project", "source_path", F.array_join("missing_fields", ",").alias("missing_fields")
    )


@register(
    "decision_status_filter",
    "SELECT chunk_id, project FROM docs WHERE chunk_id IN (SELECT chunk_id FROM decided WHERE status = 'deprecated')",
    "docs decided",
)
def decision_status_filter(spark, sf):
    kept = filters.decided_chunks(docs(spark, sf), decided(spark, sf), "deprecated")
    return kept.select("chunk_id", "project")


@register(
    "parse_search_syntax",
    f"""
    SELECT query_id, {sql_collapse("text")} AS text, CASE WHEN query_id % 3 = 1 THEN 'src' || (query_id % 20) END AS project,
      CASE WHEN query_id % 3 = 2 THEN 'zzyzx' || query_id ELSE '' END AS excluded FROM asked""",
    "asked",
)
def parse_search_syntax(spark, sf):
    parsed = asked(spark, sf).withColumn("q", text.parse_query(F.col("raw")))
    return parsed.select(
        "query_id",
        F.col("q.text").alias("text"),
        F.col("q.project").alias("project"),
        F.array_join("q.excluded", ",").alias("excluded"),
    )


QUERY_LOG_SQL = """
    WITH raw AS (SELECT event_id, k, 'find  ' || event_type || CASE k % 3 WHEN 0 THEN ' "exact Match ' || k || '" ' ELSE '' END
      || CASE k % 4 WHEN 0 THEN ' project:docs' || p WHEN 1 THEN ' decision:Active' WHEN 2 THEN ' decision:maybe' ELSE '' END
      || CASE k % 5 WHEN 0 THEN ' -Bad -' || event_type WHEN 1 THEN ' --keep' ELSE '' END AS raw, p, event_type FROM ev)
    SELECT event_id, 'find ' || event_type || CASE WHEN k % 4 = 2 THEN ' decision:maybe' ELSE '' END AS text,
      CASE WHEN k % 3 = 0 THEN 'exact Match ' || k ELSE '' END AS phrases,
      CASE k % 5 WHEN 0 THEN 'bad,' || event_type ELSE '' END AS excluded,
      CASE WHEN k % 4 = 0 THEN 'docs' || p END AS project, CASE WHEN k % 4 = 1 THEN 'active' END AS status FROM raw"""


@register("parse_query_log", QUERY_LOG_SQL, "ev")
def parse_query_log(spark, sf):
    """All syntax elements over the query log built from events."""
    from lodestone.registry.base import ev

    k = F.col("k")
    raw = F.concat(
        F.lit("find  "),
        "event_type",
        F.when(k % 3 == 0, F.concat(F.lit(' "exact Match '), k, F.lit('" '))).otherwise(""),
        F.when(k % 4 == 0, F.concat(F.lit(" project:docs"), "p"))
        .when(k % 4 == 1, " decision:Active")
        .when(k % 4 == 2, " decision:maybe")
        .otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit(" -Bad -"), "event_type")).when(k % 5 == 1, " --keep").otherwise(""),
    )
    q = text.parse_query(raw)
    return (
        ev(spark, sf)
        .select("event_id", q.alias("q"))
        .select(
            "event_id",
            "q.text",
            F.array_join("q.phrases", ",").alias("phrases"),
            F.array_join("q.excluded", ",").alias("excluded"),
            "q.project",
            F.col("q.decision_status").alias("status"),
        )
    )
