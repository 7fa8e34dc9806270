"""Helpers of the training-data operators: tables cut from their lineage, size-checked broadcasts, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at a space or at one of the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a side of a join may have to be broadcast by hint.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither repeat it nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if ``df`` has at most ``rows`` rows; any larger table joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def packed(docs: DataFrame, needed: list[str], results: list[str]) -> tuple[DataFrame, list[str]]:
    """The ``needed`` columns and one struct ``_more`` of the others, and what to select to have these back.

    So further columns clash with no name inside an operator. Those named like a result give way to it.
    """
    taken = {c.lower() for c in (*needed, *results)}
    others = [c for c in docs.columns if c.lower() not in taken]
    more = [F.struct(*[docs[c] for c in others]).alias("_more")] if others else []
    return docs.select(*needed, *more), ["_more.*"] if others else []


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once per row however often the body names it."""
    return F.transform(F.array(value), body)[0]
