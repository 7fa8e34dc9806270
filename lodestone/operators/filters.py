"""Row filters and query scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates, text

# Names of source types.
SOURCE_TYPE_ALIASES = {
    "md": "markdown",
    "markdown": "markdown",
    "pdf": "pdf",
    "docx": "word",
    "word": "word",
    "xlsx": "excel",
    "xls": "excel",
    "excel": "excel",
    "recipe": "recipe",
    "git": "git",
}


def filter_metadata(
    df: DataFrame,
    *,
    projects: list[str] | None = None,
    source_types: list[str] | None = None,
    language: str | None = None,
    date_after=None,
    date_before=None,
) -> DataFrame:
    """All given conditions hold; rows without a date drop out once a date bound is set."""
    if projects:
        df = df.where(F.col("project").isin(list(projects)))
    if source_types:
        df = df.where(F.col("source_type").isin([alias_of(s) for s in source_types]))
    if language is not None:
        df = df.where(F.col("language") == language)
    if date_after is not None:
        df = df.where(F.col("source_date") >= dates.ts(date_after))
    if date_before is not None:
        df = df.where(F.col("source_date") <= dates.ts(date_before))
    return df


def alias_of(source_type: str) -> str:
    key = source_type.strip().lower()
    return SOURCE_TYPE_ALIASES.get(key, key)


def normalize_source_types(kinds: Column) -> Column:
    """Aliases resolved, blanks dropped, distinct and sorted; NULL when nothing is left."""
    pairs = [F.lit(x) for pair in SOURCE_TYPE_ALIASES.items() for x in pair]
    names = F.create_map(*pairs)

    def resolve(kind: Column) -> Column:
        key = F.lower(text.strip(kind))
        return F.coalesce(F.try_element_at(names, key), key)

    given = F.filter(kinds, lambda t: t.isNotNull() & (t != ""))
    found = F.array_sort(F.array_distinct(F.transform(given, resolve)))
    return F.when(F.size(found) > 0, found)


def resolve_scope(projects: Column, project: Column, inline: Column) -> Column:
    """Explicit list, or the single project when there is no list, plus the inline one."""
    none = F.array().cast("array<string>")
    given = F.when(F.size(F.coalesce(projects, none)) > 0, projects).otherwise(F.array(project))
    everything = F.concat(given, F.array(inline))
    return F.array_distinct(F.filter(everything, lambda p: p.isNotNull() & (p != "")))


def filter_required_phrases(df: DataFrame) -> DataFrame:
    return df.where(text.has_all_phrases(F.col("content"), F.col("phrases")))


def filter_excluded_terms(df: DataFrame) -> DataFrame:
    return df.where(~text.has_any_term(F.col("content"), F.col("excluded")))


def filter_max_age(df: DataFrame, *, now, days: int) -> DataFrame:
    """Keeps undated rows, unlike a date bound of ``filter_metadata``."""
    return df.where(F.col("source_date").isNull() | (F.col("source_date") >= dates.before(now, days=days)))


def docs_by_metadata(documents: DataFrame, *, limit: int = 100, **conditions) -> DataFrame:
    """Newest documents first, metadata only."""
    kept = filter_metadata(documents, **conditions)
    return kept.orderBy(F.desc_nulls_last("source_date"), "document_id").limit(limit)


def missing_fields(df: DataFrame) -> Column:
    """Names of the metadata fields a document lacks, in fixed order."""
    return F.array_compact(
        F.array(
            F.when(F.col("source_date").isNull(), "source_date"),
            F.when(F.coalesce(F.col("project"), F.lit("")) == "", "project"),
            F.when(F.coalesce(F.col("language"), F.lit("")) == "", "language"),
        )
    )


def lacks_metadata() -> Column:
    return F.col("source_date").isNull() | (F.col("project") == "") | (F.col("language") == "")


def missing_metadata_docs(documents: DataFrame, *, limit: int | None = 5) -> DataFrame:
    """Documents lacking metadata with the list of missing fields, lowest id first."""
    found = documents.where(lacks_metadata()).withColumn("missing_fields", missing_fields(documents))
    return found.orderBy("document_id").limit(limit) if limit else found


def decided_chunks(candidates: DataFrame, decisions: DataFrame, status: str | None = None) -> DataFrame:
    """Candidates with at least one decision (of the given status): a semi join."""
    wanted = decisions if status is None else decisions.where(F.col("status") == status)
    return candidates.join(wanted.select("chunk_id"), "chunk_id", "left_semi")
