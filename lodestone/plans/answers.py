"""From ranked results to citations, answers, footers and audits, for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates, scoring, text

# Fixed values.
NOT_FOUND = "Not found in sources."
UNSUPPORTED = "Answer text not found in used chunks."


def citations(results: DataFrame, *, now) -> DataFrame:
    """Source rows of ranked results: locator text, snippet, date confidence, rounded score.

    ``results`` has query_id, rank, chunk_id, content, source_path, source_type, project,
    source_date, final_score and optionally locator_type, locator, git_repo, git_commit.
    """
    have = set(results.columns)
    label = F.lit(None).cast("string")
    if "locator" in have:
        label = scoring.format_locator(F.col("locator_type"), F.col("locator"))
    return results.select(
        "query_id",
        "rank",
        "chunk_id",
        "source_path",
        "source_type",
        "project",
        label.alias("locator_text"),
        text.snippet(F.col("content")).alias("snippet"),
        "source_date",
        dates.confidence(F.col("source_date"), now).alias("date_confidence"),
        dates.outdated(F.col("source_date"), now).alias("may_be_outdated"),
        F.round("final_score", 4).alias("similarity_score"),
        *[c for c in ("git_repo", "git_commit") if c in have],
    )


def overall_confidence(cited: DataFrame) -> DataFrame:
    """Lowest date confidence per query; UNKNOWN is lowest."""
    lowest = F.min(dates.confidence_rank(F.col("date_confidence")))
    return cited.groupBy("query_id").agg(dates.confidence_name(lowest).alias("overall_confidence"))


def oldest_source_confidence(cited: DataFrame, *, now) -> DataFrame:
    """Variant: the confidence of the oldest dated source; UNKNOWN when none is dated."""
    oldest = cited.groupBy("query_id").agg(F.min("source_date").alias("oldest_date"))
    return oldest.withColumn("date_confidence", dates.confidence(F.col("oldest_date"), now))


def answer_footer(queries: DataFrame, cited: DataFrame) -> DataFrame:
    """Per query, also those without results: counts, outdated flag, overall confidence."""
    lowest = F.min(dates.confidence_rank(F.col("date_confidence")))
    facts = cited.groupBy("query_id").agg(
        F.count("*").alias("source_count"),
        F.count_if("may_be_outdated").alias("outdated_source_count"),
        dates.confidence_name(lowest).alias("date_confidence"),
    )
    rows = queries.select("query_id").join(facts, "query_id", "left")
    rows = rows.na.fill(0, ["source_count", "outdated_source_count"])
    missing = F.col("source_count") == 0
    return (
        rows.withColumn("may_be_outdated", F.col("outdated_source_count") > 0)
        .withColumn("not_found", missing)
        .withColumn("not_found_message", F.when(missing, NOT_FOUND))
    )


def top_answer(queries: DataFrame, cited: DataFrame) -> DataFrame:
    """Snippet of the first source, with a marker unless it has one; NULL without sources."""
    first = cited.where("rank = 1").select("query_id", "snippet")
    marked = F.col("snippet").rlike(r"\[\d+\]") | (F.col("snippet") == "")
    answer = F.when(marked, F.col("snippet")).otherwise(F.concat("snippet", F.lit(" [1]")))
    rows = queries.select("query_id").join(first, "query_id", "left")
    return rows.select(
        "query_id", answer.alias("answer"), F.when(F.col("snippet").isNull(), NOT_FOUND).alias("message")
    )


def grounding_audit(answers: DataFrame) -> DataFrame:
    """Unsupported answers: the cleaned answer is no substring of the chunk it was taken from.

    ``answers`` has query_id, answer and used_chunk (NULL when no chunk was used).
    """
    wanted = text.audit_text(F.col("answer"))
    found = F.coalesce(F.contains(text.collapse(F.col("used_chunk")), wanted), F.lit(False))
    rows = answers.where(F.col("answer").isNotNull() & (wanted != "") & ~found)
    return rows.select("query_id", F.col("answer").alias("text"), F.lit(UNSUPPORTED).alias("reason"))


def search_history_from_results(queries: DataFrame, results: DataFrame, *, now) -> DataFrame:
    """One history row per query; the project only when the scope is exactly one project.

    ``queries`` has query_id, raw and projects (the resolved scope).
    """
    counts = results.groupBy("query_id").agg(F.count("*").alias("results_count"))
    rows = queries.join(counts, "query_id", "left").na.fill(0, ["results_count"])
    return rows.select(
        "query_id",
        F.col("raw").alias("query"),
        F.when(F.size("projects") == 1, F.get("projects", F.lit(0))).alias("project"),
        F.col("results_count").cast("int").alias("results_count"),
        (F.col("results_count") == 0).cast("int").alias("not_found"),
        dates.ts(now).alias("searched_at"),
    )


def highlight(rows: DataFrame) -> DataFrame:
    """Adds the query terms found in the content, in order of appearance, and the content with
    ``**`` around them."""
    pattern = text.highlight_pattern(text.highlight_words(F.col("query")))
    rows = rows.withColumn("_pattern", pattern)
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all("content", F.col("_pattern"), F.lit(1))
    marked = F.regexp_replace("content", F.col("_pattern"), F.lit("**$1**"))
    return (
        rows.withColumn("terms", F.coalesce(F.array_distinct(found), none))
        .withColumn("marked", F.coalesce(marked, "content"))
        .drop("_pattern")
    )


@dataclass(frozen=True)
class Answered:
    """Everything an answered table of queries gives."""

    sources: DataFrame
    answers: DataFrame
    footer: DataFrame
    audit: DataFrame
    history: DataFrame


def answer_queries(queries: DataFrame, results: DataFrame, *, now) -> Answered:
    """Citations, answers, footers, grounding audit and search history of ranked results.

    ``queries`` is the output of ``prepare_queries``; ``results`` that of a search over it.
    """
    cited = citations(results, now=now)
    answered = top_answer(queries, cited)
    used = results.where("rank = 1").select("query_id", F.col("content").alias("used_chunk"))
    return Answered(
        sources=cited,
        answers=answered,
        footer=answer_footer(queries, cited),
        audit=grounding_audit(answered.join(used, "query_id", "left")),
        history=search_history_from_results(queries, results, now=now),
    )
