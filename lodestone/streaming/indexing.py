"""Incremental indexing: a stream of document versions kept as current documents and their chunks.

Both are keyed tables by (source_path, project), a compacted base and deltas. Every micro-batch reads only the buckets
of its own documents and writes only its new, changed and vanished ones; rerunning a batch replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.chunking import chunk_documents
from lodestone.operators.corpus import KEY, changed_documents, latest_per_key
from lodestone.sources.keyed import BUCKETS, KeyedTable
from lodestone.sources.sections import markdown_sections

VERSIONS = "source_path string, project string, content_hash string, source_date timestamp_ntz, version long"
CHUNKED = ["source_path", "project", "content", "source_date", "version", "content_hash"]


def documents_table(spark: SparkSession, base: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, f"{base}/documents", KEY, VERSIONS, buckets)


def chunks_table(spark: SparkSession, base: str, buckets: int = BUCKETS) -> KeyedTable:
    unchunked = spark.createDataFrame([], f"{VERSIONS}, content string").select(CHUNKED)
    schema = chunk_documents(markdown_sections(unchunked)).schema
    return KeyedTable(spark, f"{base}/chunks", KEY, schema, buckets)


def current_documents(spark: SparkSession, base: str) -> DataFrame:
    """Latest version of every document that has not vanished, with the batch that brought it."""
    return documents_table(spark, base).read().withColumnRenamed("_batch", "batch")


def current_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of the latest versions only."""
    return chunks_table(spark, base).read().withColumnRenamed("_batch", "batch")


def index_batch(rows: DataFrame, batch: int, base: str, compact_every: int = 20) -> None:
    """Store the new and changed documents of a micro-batch and take out those that have vanished.

    ``rows`` has source_path, project, content, source_date and version, and possibly a boolean ``vanished``; of
    several versions of a document in one batch the highest counts.
    """
    spark = rows.sparkSession
    documents, chunks = documents_table(spark, base), chunks_table(spark, base)
    latest = latest_per_key(rows, [F.desc("version")])
    if "vanished" not in rows.columns:
        latest = latest.withColumn("vanished", F.lit(False))
    latest = latest.withColumn("vanished", F.coalesce("vanished", F.lit(False)))
    hashed = latest.withColumn("content_hash", text.content_hash(F.col("content"))).persist()
    try:
        known = documents.read(before=batch, of=hashed)
        compared = changed_documents(known, hashed.where("NOT vanished"))
        fresh = compared.where("change <> 'unchanged'").drop("change", "vanished")
        gone = hashed.where("vanished").drop("vanished").withColumn("_deleted", F.lit(True))
        # Texts are chunked once: a changed document without a chunk gives its own tombstone.
        made = chunk_documents(markdown_sections(fresh.select(CHUNKED)), keep_empty=True)
        made = made.withColumn("_deleted", F.col("chunk_index").isNull())
        # Documents last: a batch that stops before is indexed anew as a whole.
        chunks.write(made.unionByName(gone.select(*KEY, "_deleted"), allowMissingColumns=True), batch)
        documents.write(fresh.withColumn("_deleted", F.lit(False)).unionByName(gone), batch)
    finally:
        hashed.unpersist()
    if batch % compact_every == compact_every - 1:
        documents.compact()
        chunks.compact()


def stream_incremental_index(stream: DataFrame, base: str, compact_every: int = 20) -> None:
    """Run the index over everything available in the stream."""
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: index_batch(rows, batch, base, compact_every))
        .option("checkpointLocation", f"{base}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
