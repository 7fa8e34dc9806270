"""Registration, the views over the test tables, and the same views as SQL text.

Every view is deterministic: it never reads the clock, and ``NOW`` stands for the current time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import SPACES

NOW = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the SQL views its oracle text needs, in order."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql)
        return fn

    return wrap


def with_views(views: str, sql: str) -> str:
    parts = [f"{v} AS ({VIEWS[v]})" for v in views.split()]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table. Its footer is read once per application, not once per use in a plan."""
    if not isinstance(spark, SparkSession):
        return spark.read.parquet(f"{sf}/{name}.parquet")
    key = (spark.sparkContext.applicationId, id(spark), f"{sf}/{name}.parquet")
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(key[-1])
    return _TABLES[key]


def spread(df: DataFrame) -> DataFrame:
    """One partition per core for a table kept in fewer files than that, as the test tables are.

    Only for heavy work per row. A table of many files is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '[{SPACES}]+', ' ', 'g')")


def sql_tokens(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda t: length(t) > 1 AND regexp_full_match(t, '[a-z0-9]+'))"
    )


def sql_recency(date: str, half: int = 180) -> str:
    days = f"floor(epoch({NOW_SQL} - {date}) / 86400)"
    return (
        f"CASE WHEN {date} IS NULL OR {days} <= 0 THEN 1.0::DOUBLE "
        f"ELSE greatest(0.1::DOUBLE, pow(0.5::DOUBLE, {days} / {half})) END"
    )


def sql_confidence(date: str) -> str:
    return (
        f"CASE WHEN {date} IS NULL THEN 'UNKNOWN' WHEN {date} >= {NOW_SQL} - INTERVAL 30 DAY THEN 'HIGH' "
        f"WHEN {date} >= {NOW_SQL} - INTERVAL 90 DAY THEN 'MEDIUM' ELSE 'LOW' END"
    )


def sql_count_priority(x: str) -> str:
    return f"(6 - greatest(1, least(5, {x})))::INTEGER"


def sql_ratio_priority(x: str) -> str:
    return sql_count_priority(f"floor(greatest(0.0, least(1.0, {x})) * 10)::BIGINT")


def days_before(days) -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(days=days)


VIEWS: dict[str, str] = {}

# Documents: one chunk per document, project = source.
VIEWS["docs"] = f"""
SELECT doc_id AS document_id, doc_id AS chunk_id, text AS content, source AS project, lang AS language,
  CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'word' WHEN 3 THEN 'excel' ELSE 'recipe' END
    AS source_type,
  'corpus/' || source || '/doc-' || doc_id || '.md' AS source_path,
  CASE WHEN doc_id % 11 <> 0 THEN {NOW_SQL} - to_days(((doc_id * 7) % 720)::INTEGER) END AS source_date,
  {NOW_SQL} - to_days((doc_id % 97)::INTEGER) AS updated_at, n_chars
FROM documents"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same view for heavy work on the texts."""
    return docs(spark, sf, spread(table(spark, sf, "documents")))


def docs(spark: SparkSession, sf: str, documents: DataFrame | None = None) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("markdown", "pdf", "word", "excel", "recipe")])
    doc_id = F.col("doc_id")
    source = documents if documents is not None else table(spark, sf, "documents")
    return source.select(
        doc_id.alias("document_id"),
        doc_id.alias("chunk_id"),
        F.col("text").alias("content"),
        F.col("source").alias("project"),
        F.col("lang").alias("language"),
        F.get(kinds, (doc_id % 5).cast("int")).alias("source_type"),
        F.concat(F.lit("corpus/"), "source", F.lit("/doc-"), doc_id, F.lit(".md")).alias("source_path"),
        F.when(doc_id % 11 != 0, days_before((doc_id * 7 % 720).cast("int"))).alias("source_date"),
        days_before((doc_id % 97).cast("int")).alias("updated_at"),
        "n_chars",
    )


# The same documents with some blank projects and languages.
VIEWS["gappy"] = """
SELECT * REPLACE (CASE WHEN document_id % 17 = 0 THEN '' ELSE project END AS project,
  CASE WHEN document_id % 23 = 0 THEN '' ELSE language END AS language) FROM docs"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return (
        docs(spark, sf)
        .withColumn("project", F.when(F.col("document_id") % 17 == 0, "").otherwise(F.col("project")))
        .withColumn("language", F.when(F.col("document_id") % 23 == 0, "").otherwise(F.col("language")))
    )


VIEWS["vecs"] = "SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS embedding, label FROM embeddings"


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


# Queries: benchmark passages with the vector of the same number, every third one with syntax.
VIEWS["asked"] = """
SELECT item_id AS query_id,
  CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ' project:src' || (item_id % 20)
    ELSE text || ' -zzyzx' || item_id END AS raw,
  text, embedding::DOUBLE[] AS embedding, CASE WHEN item_id % 3 = 1 THEN 'src' || (item_id % 20) END AS scope
FROM benchmark JOIN embeddings ON vec_id = item_id"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id")
    raw = (
        F.when(item % 3 == 0, F.col("text"))
        .when(item % 3 == 1, F.concat("text", F.lit(" project:src"), item % 20))
        .otherwise(F.concat("text", F.lit(" -zzyzx"), item))
    )
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return (
        table(spark, sf, "benchmark")
        .join(vectors, "item_id")
        .select(item.alias("query_id"), raw.alias("raw"), "text", "embedding")
    )


# Event logs.
VIEWS["ev"] = """
SELECT event_id, ts, user_id, event_type, value, (props->>'k')::INTEGER AS k, (user_id % 10)::INTEGER AS p,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE 'p' || (user_id % 10) END AS project FROM events"""


def ev(spark: SparkSession, sf: str) -> DataFrame:
    p = (F.col("user_id") % 10).cast("int")
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        p.alias("p"),
        F.when(p == 0, "").otherwise(F.concat(F.lit("p"), p)).alias("project"),
    )


VIEWS["searches"] = """
SELECT event_id, 'q' || k AS query, project, CASE WHEN k < 10 * p THEN 0 ELSE floor(value)::INTEGER END
  AS results_count, ts AS searched_at, user_id FROM ev"""


def searches(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).select(
        "event_id",
        F.concat(F.lit("q"), "k").alias("query"),
        "project",
        F.when(F.col("k") < 10 * F.col("p"), 0).otherwise(F.floor("value").cast("int")).alias("results_count"),
        F.col("ts").alias("searched_at"),
        "user_id",
    )


VIEWS["feedback"] = """
SELECT event_id, 'q' || k AS question, project, ts AS created_at, user_id, CASE event_type WHEN 'error' THEN
  'didnt_answer' WHEN 'click' THEN 'helpful' WHEN 'view' THEN 'too_long' WHEN 'signup' THEN 'outdated'
  ELSE 'wrong_source' END AS feedback_reason FROM ev"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    reasons = F.create_map(
        *[
            F.lit(x)
            for x in ("error", "didnt_answer", "click", "helpful", "view", "too_long", "signup", "outdated")
        ]
    )
    return ev(spark, sf).select(
        "event_id",
        F.concat(F.lit("q"), "k").alias("question"),
        "project",
        F.col("ts").alias("created_at"),
        "user_id",
        F.coalesce(F.try_element_at(reasons, F.col("event_type")), F.lit("wrong_source")).alias(
            "feedback_reason"
        ),
    )


VIEWS["errors"] = """
SELECT event_id, 'in/' || project || '/f' || k || '.md' AS source_path, 'markdown' AS source_type, project,
  CASE k % 4 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'no_text' WHEN 2 THEN 'oversize' ELSE '' END AS error_type,
  repeat('line ' || k || ' ', k) AS error_message, ts AS created_at FROM ev WHERE event_type = 'error'"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("parse_error", "no_text", "oversize", "")])
    return (
        ev(spark, sf)
        .where("event_type = 'error'")
        .select(
            "event_id",
            F.concat(F.lit("in/"), "project", F.lit("/f"), "k", F.lit(".md")).alias("source_path"),
            F.lit("markdown").alias("source_type"),
            "project",
            F.get(kinds, F.col("k") % 4).alias("error_type"),
            F.expr("repeat(concat('line ', k, ' '), k)").alias("error_message"),
            F.col("ts").alias("created_at"),
        )
    )


VIEWS["denials"] = """
SELECT event_id, 'routine' || (k % 5) AS action_name, project, 'vault/' || project || '/n' || (k % 7) || '.md'
  AS target_path, CASE k % 3 WHEN 0 THEN 'scope' WHEN 1 THEN 'path' ELSE 'other' END AS reason_code,
  (k % 3)::INTEGER AS scope_level, 3 AS required_scope_level, ts AS created_at
FROM ev WHERE event_type = 'signup'"""


def denials(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    codes = F.array(F.lit("scope"), F.lit("path"), F.lit("other"))
    return (
        ev(spark, sf)
        .where("event_type = 'signup'")
        .select(
            "event_id",
            F.concat(F.lit("routine"), k % 5).alias("action_name"),
            "project",
            F.concat(F.lit("vault/"), "project", F.lit("/n"), k % 7, F.lit(".md")).alias("target_path"),
            F.get(codes, k % 3).alias("reason_code"),
            (k % 3).alias("scope_level"),
            F.lit(3).alias("required_scope_level"),
            F.col("ts").alias("created_at"),
        )
    )


# Suggestion log: views, type from k % 4, some events only.
VIEWS["shown"] = """
SELECT event_id, CASE WHEN project = '' THEN 'all' ELSE project END AS project,
  CASE k % 4 WHEN 0 THEN 'coverage_gaps' WHEN 1 THEN 'staleness' WHEN 2 THEN 'health_metadata'
    ELSE 'health_low_hit_rate' END AS suggestion_type,
  sha256('s' || (k % 13)) AS suggestion_fingerprint, (k % 2)::INTEGER AS was_shown, ts AS logged_at
FROM ev WHERE event_type = 'view'"""


def shown(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    kinds = F.array(
        *[F.lit(x) for x in ("coverage_gaps", "staleness", "health_metadata", "health_low_hit_rate")]
    )
    return (
        ev(spark, sf)
        .where("event_type = 'view'")
        .select(
            "event_id",
            F.when(F.col("project") == "", "all").otherwise(F.col("project")).alias("project"),
            F.get(kinds, k % 4).alias("suggestion_type"),
            F.sha2(F.concat(F.lit("s"), k % 13), 256).alias("suggestion_fingerprint"),
            (k % 2).alias("was_shown"),
            F.col("ts").alias("logged_at"),
        )
    )


# Decisions: one per order, superseded by the next order of the customer.
VIEWS["decided"] = """
SELECT o_orderkey AS decision_id, o_custkey AS chunk_id, 'We decided to handle ' || o_orderpriority || ' order '
  || o_orderkey AS decision_text, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded'
  ELSE 'deprecated' END AS status, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  AS superseded_by, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS decision_date,
  (50 + o_orderkey % 46) / 100.0::DOUBLE AS confidence,
  o_orderdate + to_days((o_orderkey % 30)::INTEGER) AS extracted_at
FROM orders"""


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """A customer has a handful of orders, so the window that links them is small by definition."""
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    chain = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "superseded")
    return table(spark, sf, "orders").select(
        key.alias("decision_id"),
        F.col("o_custkey").alias("chunk_id"),
        F.concat(F.lit("We decided to handle "), "o_orderpriority", F.lit(" order "), key).alias("decision_text"),
        status.otherwise("deprecated").alias("status"),
        F.lead("o_orderkey").over(chain).alias("superseded_by"),
        F.when(key % 7 != 0, F.col("o_orderdate")).alias("decision_date"),
        ((50 + key % 46) / 100.0).alias("confidence"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(key % 30).cast("int"))).alias("extracted_at"),
    )
