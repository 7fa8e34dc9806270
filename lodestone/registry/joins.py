"""Join queries and set operations."""

from pyspark.sql import functions as F

from lodestone.operators import corpus, ranking
from lodestone.registry.base import NOW, NOW_SQL, decided, docs, errors, ev, register, shown, table, vecs


def stored(spark, sf):
    """Documents as stored earlier: three quarters of them, some with other content."""
    text = F.when(F.col("document_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return (
        docs(spark, sf)
        .where("document_id % 4 <> 3")
        .select(
            "document_id",
            "source_path",
            F.lit("markdown").alias("source_type"),
            "project",
            F.lit("xx").alias("language"),
            F.lit(None).cast("timestamp_ntz").alias("source_date"),
            F.sha2(text, 256).alias("content_hash"),
            "updated_at",
        )
    )


STORED_SQL = """
    WITH stored AS (SELECT document_id, source_path, 'markdown' AS source_type, project, 'xx' AS language,
      NULL::TIMESTAMP AS source_date, sha256(CASE WHEN document_id % 5 = 0 THEN content || '!' ELSE content END)
      AS content_hash, updated_at FROM docs WHERE document_id % 4 <> 3),
    incoming AS (SELECT source_path, source_type, project, language, source_date, sha256(content) AS content_hash
      FROM docs WHERE document_id % 4 <> 1)"""


def incoming(spark, sf):
    return (
        docs(spark, sf)
        .where("document_id % 4 <> 1")
        .select(
            "source_path",
            "source_type",
            "project",
            "language",
            "source_date",
            F.sha2("content", 256).alias("content_hash"),
        )
    )


@register(
    "chunk_document_join",
    "SELECT chunk_id, project, length(content) AS size FROM docs",
    "docs",
)
def chunk_document_join(spark, sf):
    base = docs(spark, sf)
    chunks = base.select("chunk_id", "document_id", "content")
    joined = corpus.chunk_document_join(chunks, base.select("document_id", "project"))
    return joined.select("chunk_id", "project", F.length("content").cast("long").alias("size"))


@register(
    "embedding_chunk_join",
    "SELECT chunk_id, label, project, source_date FROM vecs JOIN docs USING (chunk_id)",
    "docs vecs",
)
def embedding_chunk_join(spark, sf):
    base = docs(spark, sf)
    joined = corpus.embedding_chunk_join(
        vecs(spark, sf).select("chunk_id", "label"),
        base.select("chunk_id", "document_id"),
        base.select("document_id", "project", "source_date"),
    )
    return joined.select("chunk_id", "label", "project", "source_date")


@register(
    "upsert_documents",
    STORED_SQL
    + f"""
    SELECT s.document_id, coalesce(s.source_path, i.source_path) AS source_path,
      coalesce(s.source_type, i.source_type) AS source_type, coalesce(s.project, i.project) AS project,
      coalesce(s.language, i.language) AS language,
      CASE WHEN i.source_path IS NOT NULL THEN i.source_date ELSE s.source_date END AS source_date,
      coalesce(i.content_hash, s.content_hash) AS content_hash,
      CASE WHEN i.source_path IS NOT NULL THEN {NOW_SQL} ELSE s.updated_at END AS updated_at
    FROM stored s FULL JOIN incoming i ON s.source_path = i.source_path AND s.project = i.project""",
    "docs",
)
def upsert_documents(spark, sf):
    return corpus.upsert_documents(stored(spark, sf), incoming(spark, sf), now=NOW)


@register(
    "changed_documents",
    STORED_SQL
    + """
    SELECT i.source_path, CASE WHEN s.source_path IS NULL THEN 'new' WHEN s.content_hash = i.content_hash
      THEN 'unchanged' ELSE 'changed' END AS change
    FROM incoming i LEFT JOIN stored s ON s.source_path = i.source_path AND s.project = i.project""",
    "docs",
)
def changed_documents(spark, sf):
    return corpus.changed_documents(stored(spark, sf), incoming(spark, sf)).select("source_path", "change")


@register(
    "semi_join_decided_chunks",
    "SELECT chunk_id, source_path FROM docs WHERE chunk_id IN (SELECT chunk_id FROM decided)",
    "docs decided",
)
def semi_join_decided_chunks(spark, sf):
    from lodestone.operators.filters import decided_chunks

    return decided_chunks(docs(spark, sf), decided(spark, sf)).select("chunk_id", "source_path")


@register(
    "enrich_with_decisions",
    """
    SELECT chunk_id, coalesce(info, '') AS decisions FROM docs LEFT JOIN (
      SELECT chunk_id, string_agg(decision_id || ':' || status || ':' || coalesce(superseded_by::VARCHAR, '-'), ','
        ORDER BY decision_id) AS info FROM decided GROUP BY 1) USING (chunk_id)""",
    "docs decided",
)
def enrich_with_decisions(spark, sf):
    rows = corpus.enrich_with_decisions(docs(spark, sf).select("chunk_id"), decided(spark, sf))
    parts = F.transform(
        "decisions",
        lambda d: F.concat_ws(
            ":", d["decision_id"].cast("string"), d["status"], F.coalesce(d["superseded_by"].cast("string"), F.lit("-"))
        ),
    )
    return rows.select("chunk_id", F.array_join(parts, ",").alias("decisions"))


@register(
    "invalidate_chunks",
    """
    SELECT decision_id FROM decided WHERE chunk_id NOT IN (SELECT chunk_id FROM docs WHERE document_id % 3 = 0)""",
    "docs decided",
)
def invalidate_chunks(spark, sf):
    """Cascade: decisions of the chunks of changed documents go."""
    changed = docs(spark, sf).where("document_id % 3 = 0").select("chunk_id")
    return corpus.invalidate_chunks(decided(spark, sf), changed, "chunk_id").select("decision_id")


@register(
    "explain_chunks",
    """
    SELECT chunk_id, source_path, source_date, substr(content, 1, 500) AS content_preview FROM docs
    WHERE chunk_id IN (SELECT conv_id * 3 FROM conversations)""",
    "docs",
)
def explain_chunks(spark, sf):
    base = docs(spark, sf)
    ids = table(spark, sf, "conversations").select((F.col("conv_id") * 3).alias("chunk_id")).distinct()
    found = corpus.explain_chunks(
        ids,
        base.select("chunk_id", "document_id", "content"),
        base.select("document_id", "source_path", "source_date"),
    )
    return found.select("chunk_id", "source_path", "source_date", "content_preview")


@register(
    "cooldown_anti_join",
    f"""
    WITH cand AS (SELECT DISTINCT CASE WHEN project = '' THEN 'all' ELSE project END AS cooldown_project, s AS suggestion_type
      FROM ev, (VALUES ('coverage_gaps'), ('staleness'), ('health_metadata'), ('capture_hygiene')) t(s))
    SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.project = c.cooldown_project
      AND s.suggestion_type = c.suggestion_type AND s.logged_at >= {NOW_SQL} - INTERVAL 36 HOUR)""",
    "ev shown",
)
def cooldown_anti_join(spark, sf):
    kinds = F.array(
        *[F.lit(x) for x in ("coverage_gaps", "staleness", "health_metadata", "capture_hygiene")]
    )
    name = F.when(F.col("project") == "", "all").otherwise(F.col("project"))
    candidates = (
        ev(spark, sf)
        .select(name.alias("cooldown_project"))
        .distinct()
        .select("cooldown_project", F.explode(kinds).alias("suggestion_type"))
    )
    return corpus.cooldown_anti_join(candidates, shown(spark, sf), now=NOW, cooldown_days=1.5)


@register(
    "decisions_superseded_by",
    """
    SELECT n.decision_id, o.decision_id AS predecessor, row_number() OVER (PARTITION BY n.decision_id ORDER BY
      coalesce(o.decision_date, o.extracted_at), o.decision_id)::INTEGER AS position
    FROM decided n JOIN decided o ON o.superseded_by = n.decision_id""",
    "decided",
)
def decisions_superseded_by(spark, sf):
    from lodestone.operators.decisions import superseded_by

    return superseded_by(decided(spark, sf))


@register(
    "latest_suggestion_context",
    """
    SELECT suggestion_fingerprint, project, suggestion_type, logged_at FROM (SELECT *, row_number() OVER (
      PARTITION BY suggestion_fingerprint ORDER BY logged_at DESC, event_id DESC) AS r FROM shown) WHERE r = 1""",
    "ev shown",
)
def latest_suggestion_context(spark, sf):
    return corpus.latest_suggestion_context(shown(spark, sf))


@register(
    "dedupe_first",
    """
    SELECT source_path, error_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_path, error_type
      ORDER BY created_at DESC, event_id DESC) AS r FROM errors) WHERE r = 1""",
    "ev errors",
)
def dedupe_first(spark, sf):
    order = [F.desc("created_at"), F.desc("event_id")]
    first = ranking.first_per(errors(spark, sf), ["source_path", "error_type"], order)
    return first.select("source_path", "error_type", "event_id")
