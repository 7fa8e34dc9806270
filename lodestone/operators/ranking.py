"""Ranking within a key: top-k, first-of-group, normalisation, running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows 1..k of every key in the given order.

    The rank filter becomes a WindowGroupLimit on both sides of the shuffle, so at most k rows of
    a key leave any task, however large the key is.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of every key in a stated order."""
    return top_k(df, by, order, 1, "_first").drop("_first")


def minmax_normalize(df: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """Scale a column to 0..1 within a key; equal values give 1.

    The bounds come from a map-side combined aggregate and are joined back, so no task ever holds
    a whole key.
    """
    bounds = df.groupBy(F.col(by).alias("_key")).agg(
        F.min(column).alias("_lo"), F.max(column).alias("_hi")
    )
    value = scale(F.col(column), F.col("_lo"), F.col("_hi"))
    return (
        df.join(bounds, F.col(by).eqNullSafe(F.col("_key")))
        .withColumn(out, value)
        .drop("_key", "_lo", "_hi")
    )


def scale(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(1.0)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def numbered(df: DataFrame, block: list[str], order: str, out: str) -> DataFrame:
    """Place of every row from 1 in the order of the ``block`` columns, then ``order``.

    Blocks are counted first, so each is numbered by a task of its own; only one row per block is ordered as a whole.
    """
    counts = df.groupBy(*block).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*block).orderBy(order)
    return df.join(offsets, block).withColumn(out, F.row_number().over(inside) + F.col("_offset")).drop("_offset")


def running_total(
    df: DataFrame, by: list[str], order: str, value: Column, out: str, block: int = 4096
) -> DataFrame:
    """Running sum of ``value`` per key along an integer ``order`` column.

    Works in two levels: totals per block of ``block`` consecutive positions, an exclusive running
    sum over those few totals, then a running sum inside each block. A key that holds most rows is
    therefore spread over as many tasks as it has blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    totals = blocked.groupBy(*by, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(offsets, [*by, "_block"])
        .withColumn(out, F.sum("_value").over(inside) + F.col("_offset"))
        .drop("_block", "_value", "_offset")
    )
