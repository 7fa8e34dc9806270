"""Decision queries."""

from pyspark.sql import functions as F

from lodestone.operators import decisions as ops
from lodestone.registry.base import NOW, NOW_SQL, VIEWS, decided, docs, register, spread, sql_strip, table

# Texts with decision phrases, one per order.
VIEWS["phrased"] = """
SELECT o_orderkey AS chunk_id, 'Intro line ' || o_orderkey || '.' || chr(10) || chr(10) || CASE o_orderkey % 6
  WHEN 0 THEN 'Decision: We will use supplier ' || o_custkey || ' for the frontend design.' || chr(10) || chr(10) || 'Next part.'
  WHEN 1 THEN 'We decided to ship order ' || o_orderkey || ' by air instead of by sea, not by rail. Done.'
  WHEN 2 THEN 'After review we have agreed on the price of order ' || o_orderkey || '. Going forward, we will audit customer '
    || o_custkey || ' in process reviews.'
  WHEN 3 THEN 'The team chose plan ' || o_custkey || ' rather than plan Q' || o_orderkey || '. Rejected: plan Z because of cost.'
  WHEN 4 THEN '## Decision' || chr(10) || chr(10) || 'Adopt schema ' || o_orderkey || ' for storage.' || chr(10) || '## Next'
  ELSE 'We considered option A' || o_custkey || ' but rejected it. Selected vendor ' || o_custkey
    || ' over others. From now on, we shall pack twice.' END AS content, o_orderdate AS source_date FROM orders"""


def phrased(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    bodies = [
        F.concat(F.lit("Decision: We will use supplier "), cust, F.lit(" for the frontend design.\n\nNext part.")),
        F.concat(F.lit("We decided to ship order "), key, F.lit(" by air instead of by sea, not by rail. Done.")),
        F.concat(
            F.lit("After review we have agreed on the price of order "),
            key,
            F.lit(". Going forward, we will audit customer "),
            cust,
            F.lit(" in process reviews."),
        ),
        F.concat(
            F.lit("The team chose plan "),
            cust,
            F.lit(" rather than plan Q"),
            key,
            F.lit(". Rejected: plan Z because of cost."),
        ),
        F.concat(F.lit("## Decision\n\nAdopt schema "), key, F.lit(" for storage.\n## Next")),
        F.concat(
            F.lit("We considered option A"),
            cust,
            F.lit(" but rejected it. Selected vendor "),
            cust,
            F.lit(" over others. From now on, we shall pack twice."),
        ),
    ]
    body = F.when(key % 6 == 0, bodies[0])
    for i in range(1, 6):
        body = body.when(key % 6 == i, bodies[i])
    return spread(table(spark, sf, "orders")).select(
        key.alias("chunk_id"),
        F.concat(F.lit("Intro line "), key, F.lit(".\n\n"), body).alias("content"),
        F.col("o_orderdate").alias("source_date"),
    )


def re2(pattern: str) -> str:
    """The same pattern for an engine without look-ahead: the end mark is consumed instead."""
    return pattern.replace("(?=", "(?:").replace(r"\Z", r"\z").replace("'", "''")


TYPE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(text, '(?i){keys}') THEN '{name}'" for name, keys in ops.DECISION_TYPES
) + " END"

MATCHES_SQL = " UNION ALL ".join(
    f"SELECT chunk_id, '{name}' AS pattern, {sql_strip('m')} AS text, {confidence}::DOUBLE AS confidence, "
    f"{repr(kind) if kind else 'NULL'} AS pattern_type FROM (SELECT chunk_id, "
    f"unnest(regexp_extract_all(content, '{re2(pattern)}', 1)) AS m FROM phrased)"
    for name, pattern, confidence, kind in ops.DECISION_PATTERNS
)


@register(
    "decision_matches",
    f"""
    WITH found AS ({MATCHES_SQL})
    SELECT chunk_id, pattern, text, confidence, coalesce(pattern_type, {TYPE_SQL}) AS decision_type FROM found
    WHERE length(text) >= 10""",
    "phrased",
)
def decision_matches(spark, sf):
    return ops.decision_matches(phrased(spark, sf)).select(
        "chunk_id", "pattern", "text", "confidence", "decision_type"
    )


@register(
    "resolve_overlaps",
    """
    WITH iv AS (SELECT o_orderkey AS id, (o_orderkey % 50)::INTEGER AS s1, (o_orderkey % 50 + 10)::INTEGER AS e1,
      (o_custkey % 50)::INTEGER AS s2, (o_custkey % 50 + 10)::INTEGER AS e2,
      (o_orderkey * 7 % 50)::INTEGER AS s3, (o_orderkey * 7 % 50 + 20)::INTEGER AS e3 FROM orders),
    k AS (SELECT *, NOT (s2 < e1 AND e2 > s1) AS keep2 FROM iv)
    SELECT id, s1 || '-' || e1 || CASE WHEN keep2 THEN ',' || s2 || '-' || e2 ELSE '' END
      || CASE WHEN NOT (s3 < e1 AND e3 > s1) AND NOT (keep2 AND s3 < e2 AND e3 > s2) THEN ',' || s3 || '-' || e3 ELSE '' END
      AS kept FROM k""",
)
def resolve_overlaps(spark, sf):
    def interval(start, length, confidence, seq):
        begin = start.cast("int")
        return F.struct(
            begin.alias("start"),
            (begin + length).alias("end"),
            F.lit(confidence).alias("confidence"),
            F.lit(seq).alias("seq"),
        )

    key = F.col("o_orderkey")
    matches = F.array(
        interval(key * 7 % 50, 20, 0.6, 0), interval(key % 50, 10, 0.9, 1), interval(F.col("o_custkey") % 50, 10, 0.9, 2)
    )
    kept = F.transform(ops.resolve_overlaps(matches), lambda m: F.concat(m["start"], F.lit("-"), m["end"]))
    return table(spark, sf, "orders").select(key.alias("id"), F.array_join(kept, ",").alias("kept"))


@register(
    "decision_type",
    f"SELECT chunk_id, {TYPE_SQL} AS decision_type FROM (SELECT chunk_id, content AS text FROM phrased)",
    "phrased",
)
def decision_type(spark, sf):
    return phrased(spark, sf).select("chunk_id", ops.decision_type(F.col("content")).alias("decision_type"))


REJECTED_SQL = " || ".join(
    "regexp_extract_all(content, '{}', 1)".format(p.replace("(?sd)", "(?s)")) for p in ops.REJECTED_PATTERNS
)


@register(
    "rejected_alternatives",
    f"""
    SELECT chunk_id, array_to_string(list_filter(list_transform({REJECTED_SQL}, lambda x: {sql_strip("x")}),
      lambda x: length(x) >= 5), '|') AS rejected FROM phrased""",
    "phrased",
)
def rejected_alternatives(spark, sf):
    return phrased(spark, sf).select(
        "chunk_id", F.array_join(ops.rejected_alternatives(F.col("content")), "|").alias("rejected")
    )


@register(
    "extract_decisions",
    """
    SELECT chunk_id, source_date AS decision_date,
      CASE chunk_id % 6 WHEN 0 THEN 'We will use supplier ' || o_custkey || ' for the frontend design.'
        WHEN 1 THEN 'ship order ' || chunk_id || ' by air instead of by sea, not by rail'
        WHEN 2 THEN n.t WHEN 3 THEN 'plan ' || o_custkey || ' rather than plan Q' || chunk_id
        WHEN 4 THEN 'Adopt schema ' || chunk_id || ' for storage.' ELSE 'pack twice' END AS decision_text,
      CASE chunk_id % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN n.c WHEN 3 THEN 0.7 WHEN 4 THEN 0.95 ELSE 0.6 END::DOUBLE
        AS confidence,
      CASE chunk_id % 6 WHEN 0 THEN 'architecture' WHEN 2 THEN n.d WHEN 4 THEN 'architecture' END AS decision_type,
      trim(substr(content, n.b, n.e), ' ' || chr(10)) AS context
    FROM phrased JOIN orders ON o_orderkey = chunk_id, LATERAL (VALUES
      (1, 'the price of order ' || chunk_id, 0.75, NULL,
        greatest(1, instr(content, CASE chunk_id % 6 WHEN 0 THEN chr(10) || 'Decision:' WHEN 1 THEN 'We decided'
          WHEN 2 THEN 'we have agreed' WHEN 3 THEN 'The team' WHEN 4 THEN chr(10) || '## Decision' ELSE 'From now' END) - 100),
        10000),
      (2, 'audit customer ' || o_custkey || ' in process reviews', 0.6, 'process',
        greatest(1, instr(content, 'Going forward') - 100), 10000)) n(i, t, c, d, b, e)
    WHERE (i = 1 OR chunk_id % 6 = 2)""",
    "phrased",
)
def extract_decisions(spark, sf):
    """All texts are shorter than the context, so every context ends with its text."""
    found = ops.extract_decisions(phrased(spark, sf))
    return found.select("chunk_id", "decision_date", "decision_text", "confidence", "decision_type", "context")


@register(
    "list_decisions",
    f"""
    SELECT decision_id, status, confidence, extracted_at FROM decided JOIN docs USING (chunk_id)
    WHERE project = 'src5' AND status = 'active' AND coalesce(decision_date, extracted_at) <= {NOW_SQL} - INTERVAL 8500 DAY
    ORDER BY confidence DESC, extracted_at DESC, decision_id LIMIT 100""",
    "docs decided",
)
def list_decisions(spark, sf):
    placed = decided(spark, sf).join(docs(spark, sf).select("chunk_id", "project"), "chunk_id")
    found = ops.list_decisions(placed, now=NOW, project="src5", status="active", older_than_days=8500)
    return found.select("decision_id", "status", "confidence", "extracted_at")


@register(
    "decision_review_queue",
    f"""
    SELECT decision_id, project, confidence FROM decided JOIN docs USING (chunk_id) WHERE status = 'active'
      AND coalesce(decision_date, extracted_at) <= {NOW_SQL} - INTERVAL 9125 DAY
    ORDER BY confidence DESC, extracted_at DESC, decision_id LIMIT 50""",
    "docs decided",
)
def decision_review_queue(spark, sf):
    placed = decided(spark, sf).join(docs(spark, sf).select("chunk_id", "project"), "chunk_id")
    found = ops.review_queue(placed, older_than="25y", now=NOW, status="active", limit=50)
    return found.select("decision_id", "project", "confidence")


@register(
    "supersede",
    """
    WITH pairs AS (SELECT o_orderkey AS old_id, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_orderkey + 1 END AS new_id
      FROM orders WHERE o_orderkey % 5 = 0),
    ok AS (SELECT old_id, new_id FROM pairs WHERE new_id IN (SELECT decision_id FROM decided))
    SELECT decision_id, CASE WHEN new_id IS NOT NULL THEN 'superseded' ELSE status END AS status,
      coalesce(new_id, superseded_by) AS superseded_by FROM decided LEFT JOIN ok ON old_id = decision_id""",
    "decided",
)
def supersede(spark, sf):
    key = F.col("o_orderkey")
    pairs = (
        table(spark, sf, "orders")
        .where(key % 5 == 0)
        .select(key.alias("old_id"), F.when(key % 10 == 0, -1).otherwise(key + 1).alias("new_id"), key.alias("seq"))
    )
    return ops.supersede(decided(spark, sf), pairs).select("decision_id", "status", "superseded_by")


CHAIN_SQL = """
    WITH RECURSIVE ch AS (SELECT decision_id AS root_id, 0 AS position, decision_id FROM decided
      UNION ALL SELECT root_id, position + 1, d.superseded_by FROM ch JOIN decided d USING (decision_id)
      WHERE d.superseded_by IS NOT NULL)"""


def _recursive(sql: str) -> str:
    """Named views go inside the WITH RECURSIVE list."""
    return sql.replace("WITH RECURSIVE ", f"WITH RECURSIVE decided AS ({VIEWS['decided']}), ", 1)


@register("supersession_chain", _recursive(CHAIN_SQL + " SELECT * FROM ch"))
def supersession_chain(spark, sf):
    return ops.supersession_chain(decided(spark, sf))


@register(
    "decision_history",
    _recursive(
        CHAIN_SQL
        + """ SELECT root_id AS decision_id, 'successor' AS relation, decision_id AS other_id, position AS distance
        FROM ch WHERE position > 0 UNION ALL SELECT decision_id, 'predecessor', root_id, position FROM ch WHERE position > 0"""
    ),
)
def decision_history(spark, sf):
    return ops.decision_history(decided(spark, sf))


@register(
    "clear_decisions",
    "SELECT decision_id FROM decided WHERE chunk_id NOT IN (SELECT chunk_id FROM docs WHERE project = 'src2')",
    "docs decided",
)
def clear_decisions(spark, sf):
    return ops.clear_decisions(decided(spark, sf), docs(spark, sf), "src2").select("decision_id")
