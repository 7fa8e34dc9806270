"""Explicit schemas of the logical tables."""

from pyspark.sql import types as T

LOCATOR = T.StructType(
    [
        T.StructField("heading", T.StringType()),
        T.StructField("heading_level", T.IntegerType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("total_pages", T.IntegerType()),
        T.StructField("paragraph_index", T.IntegerType()),
        T.StructField("parent_heading", T.StringType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("row_count", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("git_file", T.StringType()),
        T.StructField("git_commit", T.StringType()),
        T.StructField("chunk_part", T.IntegerType()),
        T.StructField("chunk_total", T.IntegerType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("source_date", T.TimestampNTZType()),
        T.StructField("git_repo", T.StringType()),
        T.StructField("git_commit", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("indexed_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

GOLDEN = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected_chunks", T.ArrayType(T.LongType())),
        T.StructField("expected_answer", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)

SECTION = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("locator_type", T.StringType()),
        T.StructField("locator", LOCATOR),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

DECISION_MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("pattern", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("pattern_type", T.StringType()),
            T.StructField("seq", T.IntegerType()),
        ]
    )
)
