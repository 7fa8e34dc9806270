"""File sources: folder scans, size and parse errors, golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import strip
from lodestone.schemas import GOLDEN
from lodestone.sources.sections import UNSUPPORTED

# Ignored names, extensions per source type, and the size limit.
IGNORED_NAMES = ["node_modules", ".git", "__pycache__", ".venv", "venv", ".env", ".DS_Store"]
IGNORED_SUFFIXES = [".pyc"]
EXTENSIONS = {
    "markdown": [".md", ".markdown"],
    "pdf": [".pdf"],
    "word": [".docx"],
    "excel": [".xlsx", ".xls"],
    "recipe": [".recipe.yaml", ".recipe.json"],
    "bookmarks": [".html", ".htm"],
}
MAX_FILE_MB = 50


def _quoted(names: list[str]) -> str:
    return "|".join(n.replace(".", r"\.") for n in names)


def is_ignored(relative_path: Column) -> Column:
    """A path component is an ignored name or ends with an ignored suffix."""
    return relative_path.rlike(
        rf"(^|/)(({_quoted(IGNORED_NAMES)})|[^/]*({_quoted(IGNORED_SUFFIXES)}))(/|$)"
    )


def source_type_of(path: Column) -> Column:
    low = F.lower(path)
    found = F.lit(None).cast("string")
    for kind, endings in EXTENSIONS.items():
        found = F.when(low.rlike(f"({_quoted(endings)})$"), kind).otherwise(found)
    return found


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below a folder: path, relative_path, source_type, size, modified, content.

    Columns that are not selected later are pruned, so listing alone never opens a file. Files of zero bytes are not
    seen, as Spark's file sources skip them.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    prefix = rf"^(?:[a-z0-9]+:/*)?/?{root.split(':', 1)[-1].strip('/')}/"
    relative = F.regexp_replace("path", prefix, "")
    return (
        files.withColumn("relative_path", relative)
        .where(~is_ignored(F.col("relative_path")))
        .withColumn("source_type", source_type_of(F.col("relative_path")))
        .where(F.col("source_type").isNotNull())
        .select(
            "path",
            "relative_path",
            "source_type",
            F.col("length").alias("size"),
            F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
            "content",
        )
    )


def decode(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are no valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def scan_corpus(
    spark: SparkSession, root: str, *, project: str, language: str = "en", max_mb: float | None = MAX_FILE_MB,
    byte_types: list[str] | None = None,
) -> DataFrame:
    """Files of a folder as a documents table with their content as text.

    Files above ``max_mb`` (None: no limit) are left out; ``scan_errors`` has a row for each of them. Files of the
    ``byte_types`` have no text yet but their bytes, in a column that the others leave empty.
    """
    files = scan_files(spark, root)
    if max_mb is not None:
        files = files.where(F.col("size") <= max_mb * 1024 * 1024)
    as_bytes = F.col("source_type").isin(list(byte_types or []))
    raw = [F.when(as_bytes, F.col("content")).alias("bytes")] if byte_types else []
    decoded = decode(F.col("content"))
    return files.select(
        F.col("path").alias("source_path"),
        "relative_path",
        "source_type",
        F.lit(project).alias("project"),
        F.lit(language).alias("language"),
        F.col("modified").alias("file_mtime"),
        (F.when(~as_bytes, decoded) if byte_types else decoded).alias("content"),
        *raw,
    )


def count_scan_targets(spark: SparkSession, root: str) -> DataFrame:
    """Number of files that would be indexed, per extension."""
    extension = F.lower(F.regexp_extract("relative_path", r"(\.recipe)?\.[^./]+$", 0))
    return scan_files(spark, root).groupBy(extension.alias("extension")).agg(F.count("*").alias("files"))


def error_rows(df: DataFrame, kind: str, message: Column) -> DataFrame:
    return df.select(
        "source_path", "source_type", "project", F.lit(kind).alias("error_type"), message.alias("error_message")
    )


def oversize_errors(files: DataFrame, *, size: str = "size", limit: int = MAX_FILE_MB * 1024 * 1024) -> DataFrame:
    """Error rows of files above the size limit; such files give no document."""
    message = F.lit(f"File exceeds {limit / 1024 / 1024:g} MB size limit.")
    return error_rows(files.where(F.col(size) > limit), "oversize", message)


def scan_errors(spark: SparkSession, root: str, *, project: str, max_mb: float | None = MAX_FILE_MB) -> DataFrame:
    """Error rows of the files that ``scan_corpus`` leaves out at the same limit."""
    scanned = scan_files(spark, root).withColumn("project", F.lit(project)).withColumnRenamed("path", "source_path")
    if max_mb is None:
        return oversize_errors(scanned.where(F.lit(False)))
    return oversize_errors(scanned, limit=max_mb * 1024 * 1024)


def empty_text_errors(documents: DataFrame) -> DataFrame:
    """Error rows of documents with blank text; the documents themselves are kept."""
    blank = documents.where(strip(F.col("content")) == "")
    return error_rows(blank, "no_text", F.lit("Parsed document contained no text."))


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Error rows of documents whose sectioner failed or that have none (see ``sources.sections.sections_by_type``)."""
    rows = error_rows(parsed.where(F.col("error").isNotNull()), "parse_error", F.col("error"))
    unsupported = F.col("error_message").startswith(UNSUPPORTED)
    return rows.withColumn("error_type", F.when(unsupported, "unsupported_type").otherwise(F.col("error_type")))


def load_golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from JSON lines; malformed lines and lines without id or question drop out."""
    schema = T.StructType([*GOLDEN.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    kept = rows.where(F.col("_bad").isNull() & F.col("id").isNotNull() & F.col("question").isNotNull())
    return kept.drop("_bad").withColumns(
        {
            "expected_chunks": F.coalesce("expected_chunks", F.array().cast("array<bigint>")),
            "difficulty": F.coalesce("difficulty", F.lit("medium")),
            "category": F.coalesce("category", F.lit("general")),
            "notes": F.coalesce("notes", F.lit("")),
        }
    )
