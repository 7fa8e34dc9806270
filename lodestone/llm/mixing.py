"""Mixing sources to target weights by systematic sampling.

Within a source the documents are laid out by size; each one covers as much of a line as its expected number of
copies. One random offset per source is added, and a document is emitted once for each integer boundary that its
stretch crosses. Sampling in order of size keeps the sampled words close to the target.

Defined results: null text has size 0; null is a source of its own and the last in order; repeated rows are separate
documents; equal sizes are ordered by a hash of doc_id, then doc_id; an empty table gives no rows; a source of size 0
has target 0 and emits nothing. Reruns give the same rows. Further columns stay, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, broadcast_checked, packed, stored

WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3
SEED = "mix"
RESULTS = ["source_size", "target", "copies"]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Weights repeat over the sources in code-point order. A target stops at ``max_copies`` times the source's size,
    and the excess is shared by weight among the others. All targets together equal all sizes: with the sources
    ordered by the level at which they fill up, the level that the rest share is known after any number of full ones.
    """
    whole = Window.partitionBy()
    by_name = whole.orderBy(F.col("source").asc_nulls_last())
    by_cap = whole.orderBy("level", F.col("source").asc_nulls_last())
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    )
    cap = F.col("source_size") * F.lit(float(max_copies))
    per_source = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("level", cap / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0)))
        .withColumn(
            "share", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        )
        .withColumn("place", F.row_number().over(by_cap))
    )
    fits = F.when(F.col("share") <= F.col("level"), F.struct("place", "share"))
    return per_source.withColumn("common", F.min(fits).over(whole)["share"]).select(
        "source",
        "source_size",
        F.least(cap, F.coalesce(F.col("common") * F.col("weight"), cap)).alias("target"),
    )


def offset_of(source: Column, seed: str = SEED) -> Column:
    """Random offset in [0, 1) of a source, the same at every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(source, F.lit("")))), 1, 5), 16, 10).cast(
        "long"
    ) / F.lit(1048576.0)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED
) -> DataFrame:
    """``docs`` (doc_id, source, size and any further columns) with source_size, target and copies.

    Positions within a source come from a range-partitioned sort: each partition numbers its own rows and adds the
    rows of the source in earlier partitions, so a source that holds a third of the rows is spread over many tasks.
    The numbered rows are stored before use, since a repeated sort may order equal rows differently.
    """
    docs, more = packed(docs, ["doc_id", "source", "size"], RESULTS)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [
        F.col("source").asc_nulls_last(),
        F.col("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        F.col("doc_id"),
    ]
    numbered = docs.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    numbered = stored(numbered.withColumn("_at", F.monotonically_increasing_id()), "mixing")
    numbered = numbered.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = (
        numbered.groupBy("source", "_part")
        .agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_from", "_before")
    )
    targets = source_targets(numbered.select("source", "size"), weights, max_copies)
    same = F.col("_s").eqNullSafe(F.col("source"))
    stretches = stretches.join(broadcast_checked(targets), same).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    position = (F.col("_before") + F.col("_at") - F.col("_from")).cast("double")
    offset = offset_of(F.col("source"), seed)
    crossed = F.floor((position + 1) * rate + offset) - F.floor(position * rate + offset)
    return (
        numbered.join(
            broadcast_checked(stretches), F.col("_s").eqNullSafe(F.col("source")) & (F.col("_p") == F.col("_part"))
        )
        .withColumn("copies", crossed)
        .select("doc_id", "source", "size", *more, *RESULTS)
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("_copy")
