"""An index run over a folder: scan, section, compare, chunk, and account for errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.dates import HEAD_LINES, extract_date
from lodestone.operators.chunking import chunk_documents, index_run_stats
from lodestone.operators.corpus import KEY, changed_documents, upsert_documents
from lodestone.sources import files
from lodestone.sources.sections import ByteSectioner, Sectioner, sections_by_type


@dataclass(frozen=True)
class IndexRun:
    """Results of a run: the new documents table, chunks of new and changed documents, errors,
    the change per document, and one row of counts."""

    documents: DataFrame
    chunks: DataFrame
    errors: DataFrame
    changes: DataFrame
    stats: DataFrame


def index_folder(
    spark: SparkSession,
    root: str,
    existing: DataFrame,
    *,
    project: str,
    now,
    language: str = "en",
    sectioners: dict[str, Sectioner] | None = None,
    byte_sectioners: dict[str, ByteSectioner] | None = None,
    max_mb: float | None = files.MAX_FILE_MB,
    head_lines: int | None = HEAD_LINES,
) -> IndexRun:
    """Index the supported files below a folder against an ``existing`` documents table.

    Oversize files, files without a sectioner and those whose sectioner fails become error rows and no documents; files
    without text are reported but stored. Unchanged documents are skipped by content hash. ``max_mb`` and
    ``head_lines`` may be None, for no limit.
    """
    oversize = files.scan_errors(spark, root, project=project, max_mb=max_mb)
    documents = files.scan_corpus(
        spark, root, project=project, language=language, max_mb=max_mb, byte_types=list(byte_sectioners or [])
    )
    sectioned = sections_by_type(documents, sectioners, byte_sectioners)
    good = sectioned.where(F.col("error").isNull()).drop("error")
    errors = oversize.unionByName(files.parse_errors(sectioned)).unionByName(files.empty_text_errors(good))
    dated = good.withColumn("source_date", F.coalesce(extract_date(F.col("content"), head_lines), "file_mtime"))
    changes = changed_documents(existing, dated)
    fresh = changes.where("change <> 'unchanged'")
    columns = [*KEY, "source_type", "language", "source_date", "content_hash"]
    chunks = chunk_documents(fresh.select(*KEY, "content_hash", "content", "sections"))
    return IndexRun(
        documents=upsert_documents(existing, fresh.select(*columns), now=now),
        chunks=chunks,
        errors=errors,
        changes=changes.select(*KEY, "content_hash", "change"),
        stats=index_run_stats(changes, chunks, errors),
    )
