"""Scalar function queries."""

from pyspark.sql import functions as F

from lodestone.functions import dates, scoring, text
from lodestone.plans.answers import highlight
from lodestone.registry.base import (
    NOW,
    NOW_SQL,
    docs,
    ev,
    register,
    spread,
    sql_collapse,
    sql_confidence,
    sql_count_priority,
    sql_ratio_priority,
    sql_recency,
    sql_tokens,
    table,
)
from lodestone.sources.sections import parse_locators


@register(
    "tokenize",
    f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents",
)
def tokenize(spark, sf):
    return spread(table(spark, sf, "documents")).select(
        "doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens")
    )


@register("estimate_tokens", "SELECT doc_id, (length(text) // 4)::INTEGER AS token_count FROM documents")
def estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("token_count"))


@register("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@register(
    "suggestion_fingerprint",
    f"SELECT doc_id, sha256(source || ':' || {sql_collapse('lower(text)')}) AS fingerprint FROM documents",
)
def suggestion_fingerprint(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.fingerprint(F.col("source"), F.col("text")).alias("fingerprint")
    )


@register("task_id_hash", "SELECT url, substr(sha256(url), 1, 10) AS task_hash FROM pages")
def task_id_hash(spark, sf):
    return table(spark, sf, "pages").select("url", text.short_hash(F.col("url")).alias("task_hash"))


@register(
    "slugify",
    """
    SELECT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'),
      '^-+|-+$', '', 'g'), ''), 'untitled') AS slug FROM conversations""",
)
def slugify(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.slugify(F.col("text"), "untitled").alias("slug")
    )


@register(
    "recency_score",
    f"SELECT event_id, round({sql_recency('(ts - to_days((k * 20)::INTEGER))')}, 6) AS recency FROM ev",
    "ev",
)
def recency_score(spark, sf):
    date = F.col("ts") - F.make_dt_interval(days=F.col("k") * 20)
    return ev(spark, sf).select("event_id", F.round(dates.recency(date, NOW), 6).alias("recency"))


@register(
    "date_confidence",
    f"SELECT document_id, {sql_confidence('source_date')} AS confidence FROM docs",
    "docs",
)
def date_confidence(spark, sf):
    return docs(spark, sf).select("document_id", dates.confidence(F.col("source_date"), NOW).alias("confidence"))


@register(
    "is_outdated",
    f"SELECT document_id, coalesce({NOW_SQL} - source_date > INTERVAL 180 DAY, false) AS outdated FROM docs",
    "docs",
)
def is_outdated(spark, sf):
    return docs(spark, sf).select("document_id", dates.outdated(F.col("source_date"), NOW).alias("outdated"))


@register(
    "format_locator",
    """
    SELECT doc_id, CASE doc_id % 8
      WHEN 0 THEN 'heading: "H' || doc_id || '" (lines 1-' || doc_id || ')'
      WHEN 1 THEN 'docs/f.md:abc12345 heading: "H' || doc_id || '" (lines 1-' || doc_id || ')'
      WHEN 2 THEN 'page ' || doc_id || '/9' WHEN 3 THEN 'paragraph ' || doc_id || ' under "P"'
      WHEN 4 THEN 'paragraph ' || doc_id WHEN 5 THEN 'sheet "S" (' || doc_id || ' rows)'
      WHEN 6 THEN 'section: ' || source ELSE 'docs/f.md:abc12345 lines 1-' || doc_id END AS label
    FROM documents""",
)
def format_locator(spark, sf):
    from lodestone.sources.sections import locator

    n = F.col("doc_id")
    kinds = ["heading", "heading", "page", "paragraph", "paragraph", "sheet", "section", "line"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (n % 8).cast("int"))
    git = n % 8
    where = locator(
        heading=F.when(git < 2, F.concat(F.lit("H"), n)),
        start_line=F.lit(1),
        end_line=n,
        page=n,
        total_pages=F.lit(9),
        paragraph_index=n,
        parent_heading=F.when(git == 3, "P"),
        sheet_name=F.lit("S"),
        row_count=n,
        section=F.col("source"),
        git_file=F.when(git.isin(1, 7), "docs/f.md"),
        git_commit=F.when(git.isin(1, 7), "abc12345"),
    )
    return table(spark, sf, "documents").select("doc_id", scoring.format_locator(kind, where).alias("label"))


@register(
    "snippet",
    "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS snippet FROM documents",
)
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@register(
    "priority_from_ratio",
    f"SELECT event_id, {sql_ratio_priority('(value / 30 - 0.1)')} AS priority FROM events",
)
def priority_from_ratio(spark, sf):
    priority = scoring.priority_from_ratio(F.col("value") / 30 - 0.1)
    return table(spark, sf, "events").select("event_id", priority.alias("priority"))


@register("priority_from_count", f"SELECT event_id, {sql_count_priority('k % 9')} AS priority FROM ev", "ev")
def priority_from_count(spark, sf):
    return ev(spark, sf).select("event_id", scoring.priority_from_count(F.col("k") % 9).alias("priority"))


@register(
    "staleness_value",
    f"""
    SELECT project, count(*) FILTER (WHERE source_date <= {NOW_SQL} - INTERVAL 90 DAY) AS stale FROM docs GROUP BY 1""",
    "docs",
)
def staleness_value(spark, sf):
    from lodestone.operators.metrics import stale_document_buckets

    buckets = stale_document_buckets(docs(spark, sf), now=NOW, by=["project"])
    pair = F.struct("days", F.col("stale_count").alias("count"))
    return buckets.groupBy("project").agg(
        scoring.smallest_bucket(F.collect_list(pair)).cast("long").alias("stale")
    )


@register(
    "parse_duration_days",
    """
    SELECT event_id, CASE k % 6 WHEN 0 THEN nullif(k, 0) WHEN 1 THEN nullif(k, 0) * 7 WHEN 2 THEN nullif(k, 0) * 30
      WHEN 3 THEN nullif(k, 0) * 365 WHEN 4 THEN nullif(k, 0) END::BIGINT AS days FROM ev""",
    "ev",
)
def parse_duration_days(spark, sf):
    units = F.array(F.lit("d"), F.lit("W"), F.lit(" m"), F.lit("y "), F.lit(""), F.lit("h"))
    raw = F.concat(F.lit(" "), "k", F.get(units, F.col("k") % 6))
    return ev(spark, sf).select("event_id", dates.duration_days(raw).alias("days"))


@register(
    "highlight_terms",
    """
    SELECT p_partkey, replace(upper(p_name), ' ', ',') AS terms,
      'A **' || replace(upper(p_name), ' ', '** **') || '** by ' || p_brand AS marked FROM part""",
)
def highlight_terms(spark, sf):
    query = F.concat(F.lit("the "), "p_name", F.lit(' -skip "quoted words" project:x'))
    content = F.concat(F.lit("A "), F.upper("p_name"), F.lit(" by "), "p_brand")
    rows = table(spark, sf, "part").select("p_partkey", query.alias("query"), content.alias("content"))
    return highlight(rows).select("p_partkey", F.array_join("terms", ",").alias("terms"), "marked")


@register(
    "extract_date",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 5 THEN o_orderdate END AS found FROM orders""",
)
def extract_date(spark, sf):
    d = F.col("o_orderdate")

    def fmt(pattern):
        return F.date_format(d, pattern)

    texts = [
        F.concat(F.lit("---\ntitle: T\ndate: "), fmt("yyyy-MM-dd"), F.lit("\n---\n# H\nBody 1999-01-01.")),
        F.concat(F.lit("First line\nUpdated: "), fmt("yyyy-MM-dd"), F.lit(" by us")),
        F.concat(F.lit("Created 1990-01-01\nLast modified "), fmt("yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("Published on "), fmt("MMMM d, yyyy"), F.lit(".")),
        F.concat(F.lit("Dated "), fmt("d MMMM yyyy"), F.lit(".")),
        F.lit("03/04/2025"),
        F.concat(F.lit("x "), fmt("yyyy/MM/dd"), F.lit(" y")),
        F.concat(F.lit("as of "), fmt("yyyy.MM.dd")),
    ]
    body = F.get(F.array(*texts), (F.col("o_orderkey") % 8).cast("int"))
    return spread(table(spark, sf, "orders")).select("o_orderkey", dates.extract_date(body).alias("found"))


@register(
    "parse_locator_json",
    """
    SELECT doc_id, source AS heading, doc_id::INTEGER AS start_line, CASE WHEN doc_id % 2 = 0 THEN lang END AS note
    FROM documents""",
)
def parse_locator_json(spark, sf):
    raw = F.to_json(
        F.struct(
            F.col("source").alias("heading"),
            F.col("doc_id").alias("start_line"),
            F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("note"),
        )
    )
    rows = table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return parse_locators(rows, "raw").select("doc_id", "locator.heading", "locator.start_line", F.col("extra")["note"].alias("note"))
