"""Joins over documents, chunks and decisions, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates, text
from lodestone.operators.ranking import first_per

KEY = ["source_path", "project"]


def chunk_document_join(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents, "document_id")


def embedding_chunk_join(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return embeddings.join(chunks, "chunk_id").join(documents, "document_id")


def latest_per_key(incoming: DataFrame, order: list[Column]) -> DataFrame:
    """Newest incoming row per (source_path, project)."""
    return first_per(incoming, KEY, order)


def upsert_documents(existing: DataFrame, incoming: DataFrame, *, now) -> DataFrame:
    """Insert new documents; for known ones change hash, source date, commit and update time only.

    One full outer join on the key. ``incoming`` has one row per key and no document_id; new rows
    get a NULL id, to be assigned when they are written.
    """
    old = existing.alias("o")
    new = incoming.alias("n")
    here = F.col("n.source_path").isNotNull()
    known = F.col("o.source_path").isNotNull()
    replaced = {"content_hash", "source_date", "git_commit"}
    columns = []
    for name in existing.columns:
        before = F.col(f"o.{name}")
        if name in KEY:
            value = F.coalesce(before, F.col(f"n.{name}"))
        elif name == "updated_at":
            value = F.when(here, dates.ts(now)).otherwise(before)
        elif name == "indexed_at":
            value = F.when(known, before).otherwise(dates.ts(now))
        elif name in replaced and name in incoming.columns:
            value = F.when(here, F.col(f"n.{name}")).otherwise(before)
        elif name in incoming.columns:
            value = F.when(known, before).otherwise(F.col(f"n.{name}"))
        else:
            value = before
        columns.append(value.alias(name))
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY]
    return old.join(new, on, "full_outer").select(*columns)


def changed_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with ``change``: new, changed or unchanged by content hash."""
    known = existing.select(*KEY, F.col("content_hash").alias("_old"))
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_old") == F.col("content_hash"), "unchanged")
        .otherwise("changed")
    )
    hashed = incoming
    if "content_hash" not in incoming.columns:
        hashed = incoming.withColumn("content_hash", text.content_hash(F.col("content")))
    return hashed.join(known, KEY, "left").withColumn("change", change).drop("_old")


def invalidate_chunks(table: DataFrame, changed: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of chunks, embeddings or decisions that do not belong to changed documents."""
    return table.join(changed.select(key), key, "left_anti")


def explain_chunks(ids: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Content preview, locator, path and date of asked chunk ids; unknown ids drop out."""
    found = ids.select("chunk_id").join(chunks, "chunk_id").join(documents, "document_id")
    return found.withColumn("content_preview", F.substring("content", 1, 500)).drop("content")


def cooldown_anti_join(candidates: DataFrame, log: DataFrame, *, now, cooldown_days: int = 7) -> DataFrame:
    """Candidates whose (project, type) was not logged within the cooldown, shown or not.

    The log is reduced to its distinct recent pairs first, so the join sees each pair once.
    """
    recent = (
        log.where(F.col("logged_at") >= dates.before(now, days=cooldown_days))
        .select(F.col("project").alias("_p"), F.col("suggestion_type").alias("_t"))
        .distinct()
    )
    on = (F.col("cooldown_project") == F.col("_p")) & (F.col("suggestion_type") == F.col("_t"))
    return candidates.join(recent, on, "left_anti")


def latest_suggestion_context(log: DataFrame) -> DataFrame:
    """Project and type of the newest log row per fingerprint (highest id on equal times)."""
    newest = F.max_by(
        F.struct("project", "suggestion_type", "logged_at"), F.struct("logged_at", "event_id")
    )
    return (
        log.groupBy("suggestion_fingerprint").agg(newest.alias("_row")).select("suggestion_fingerprint", "_row.*")
    )


def enrich_with_decisions(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results with the array of decisions of their chunk, empty when there is none.

    Only decisions of chunks in the results are grouped. A chunk is a few kilobytes of text and its
    decisions are phrases in it, so the array is short by nature.
    """
    info = F.struct("decision_id", "decision_text", "status", "superseded_by", "confidence")
    wanted = decisions.join(results.select("chunk_id").distinct(), "chunk_id", "left_semi")
    grouped = wanted.groupBy("chunk_id").agg(F.array_sort(F.collect_list(info)).alias("decisions"))
    joined = results.join(grouped, "chunk_id", "left")
    empty = F.array().cast(grouped.schema["decisions"].dataType)
    return joined.withColumn("decisions", F.coalesce("decisions", empty))


def decision_badges(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """query_id, chunk_id with the number of active and superseded decisions."""
    shown = decisions.join(results.select("chunk_id").distinct(), "chunk_id", "left_semi")
    counts = shown.groupBy("chunk_id").agg(
        F.count_if(F.col("status") == "active").alias("active_count"),
        F.count_if(F.col("status") == "superseded").alias("superseded_count"),
    )
    return (
        results.select("query_id", "chunk_id")
        .join(counts, "chunk_id", "left")
        .na.fill(0, ["active_count", "superseded_count"])
    )


def superseded_warning(results: DataFrame, decisions: DataFrame, *, preview: int = 3) -> DataFrame:
    """Per query with superseded decisions: their number and the first ones in result order."""
    hits = results.select("query_id", "chunk_id", "rank").join(
        decisions.where(F.col("status") == "superseded"), "chunk_id"
    )
    totals = hits.groupBy("query_id").agg(F.count("*").alias("superseded_count"))
    order = [F.asc("rank"), F.asc("decision_id")]
    from lodestone.operators.ranking import top_k

    label = F.concat(
        F.lit("#"),
        "decision_id",
        F.lit(": "),
        F.replace(text.snippet(F.col("decision_text"), 50), F.lit("\n"), F.lit(" ")),
        F.coalesce(F.concat(F.lit(" → replaced by #"), "superseded_by"), F.lit("")),
    )
    shown = (
        top_k(hits, ["query_id"], order, preview, "_place")
        .select("query_id", F.struct("_place", label.alias("label")).alias("_item"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list("_item")).alias("_items"))
        .select("query_id", F.array_join(F.transform("_items", lambda i: i["label"]), "; ").alias("preview"))
    )
    return totals.join(shown, "query_id")


def active_decisions(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Active decisions of the chunks in the results."""
    return results.select("query_id", "rank", "chunk_id").join(
        decisions.where(F.col("status") == "active"), "chunk_id"
    )
