"""Parquet store of the corpus tables and the append-only logs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables that carry a project are laid out by it, so project filters prune whole folders.
PARTITIONED = {"documents", "chunks"}


def write_corpus(tables: dict[str, DataFrame], base: str, mode: str = "overwrite") -> None:
    """Write the given corpus tables (documents, chunks, embeddings, decisions) below ``base``.

    The rebalance hint lets AQE cut a project that holds a third of the corpus into several files
    of the advisory size and merge small ones.
    """
    for name, df in tables.items():
        if name in PARTITIONED and "project" in df.columns:
            writer = df.hint("rebalance", "project").write.mode(mode).partitionBy("project")
        else:
            writer = df.write.mode(mode)
        writer.parquet(f"{base}/{name}")


def read_corpus(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")


def append_log(rows: DataFrame, path: str) -> DataFrame:
    """Append log rows, deriving ``not_found`` for search history, and return the table."""
    if "results_count" in rows.columns:
        rows = rows.withColumn("not_found", (F.col("results_count") == 0).cast("int"))
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _table(base: str, name: str) -> str:
    return f"{name}_{hashlib.sha256(base.encode()).hexdigest()[:16]}"


def write_bucketed(
    tables: dict[str, DataFrame], base: str, *, key: str = "chunk_id", buckets: int = 64
) -> dict[str, DataFrame]:
    """Write tables below ``base`` in buckets of ``key`` and return them, so that joins on the key need no shuffle.

    Rows are dealt by their bucket before the write: a bucket becomes one file, or several where a hot key makes it
    large. Null keys share a bucket. The layout is stored beside the data for ``read_bucketed``.
    """
    base = base.rstrip("/")
    for name, df in tables.items():
        spark = df.sparkSession
        dealt = df.withColumn("_bucket", F.pmod(F.hash(key), F.lit(buckets))).hint("rebalance", "_bucket").drop("_bucket")
        writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("overwrite")
        writer.option("path", f"{base}/{name}").saveAsTable(_table(base, name))
        layout = spark.range(1).select(F.lit(key).alias("key"), F.lit(buckets).alias("buckets"))
        layout.write.mode("overwrite").json(f"{base}/layout/{name}")
    return {name: read_bucketed(df.sparkSession, base, name) for name, df in tables.items()}


def read_bucketed(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of ``write_bucketed`` with its buckets, also in a session that does not know it yet."""
    base = base.rstrip("/")
    table = _table(base, name)
    if not spark.catalog.tableExists(table):
        layout = spark.read.json(f"{base}/layout/{name}").first()
        fields = spark.read.parquet(f"{base}/{name}").schema.fields
        names = {f.name: "`" + f.name.replace("`", "``") + "`" for f in fields}
        columns = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in fields)
        key = names[layout["key"]]
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{base}/{name}'"
        )
    return spark.table(table)
