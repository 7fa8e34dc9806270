"""Exact vector search that skips blocks of chunks by the triangle inequality.

Unit vectors lie on a sphere, where the length of the chord between two of them is a metric and grows with the cosine
distance. Every chunk is dealt to the nearest of a fixed number of pivots and stored in blocks of one pivot, in rings
by distance from it. A query at distance d from the pivot is no nearer than ``d - outer`` or ``inner - d`` to any chunk
of a ring. A few blocks with the smallest of these bounds are scored for the distance of the k-th chunk found; blocks
whose bound lies beyond that are skipped, all others are scored. No neighbour is lost, ties included.

How much is skipped depends on the vectors: much where they form clusters, little where all are equally far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import matching
from lodestone.operators.ranking import top_k
from lodestone.session import stored

PIVOTS = 256  # collected and broadcast
BLOCK = 256
PROBES = 4  # blocks of a query that are scored for its reach
SLACK = 1e-6  # rounding of chords
ALL = 3.0  # beyond the longest chord, which is 2


def _chords(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (units @ pivots.T), 0.0))


def _gap(chord, inner, outer):
    """The least chord from a query to a ring."""
    return np.maximum(np.maximum(chord - outer, inner - chord), 0.0)


class PivotIndex:
    """The index below ``path``, a folder that all executors share.

    It holds vectors of one width; chunks without a vector of that width, with a zero vector or one with null or
    non-finite numbers take no part, as their distance is not defined. Queries of that kind find nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, corpus: DataFrame, *, width: int, pivots: int = PIVOTS, block: int = BLOCK) -> PivotIndex:
        """Store ``corpus`` (chunk_id, embedding). Pivots are chunks drawn by a hash of their id."""
        kind = corpus.schema["embedding"].dataType.elementType.simpleString()
        corpus = corpus.select("chunk_id", "embedding").where(F.size("embedding") == width)
        drawn = corpus.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).toArrow()
        centres = matching._matrix(drawn.column("embedding").combine_chunks(), width)
        centres = np.unique(centres[np.isfinite(centres).all(axis=1)], axis=0)
        if not len(centres):
            centres = np.eye(1, width)
        shared = self.spark.sparkContext.broadcast(centres)

        def deal(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                units = matching._matrix(batch.column("embedding"), width)
                good = np.isfinite(units).all(axis=1)
                chords = _chords(units[good], shared.value)
                near = chords.argmin(axis=1)
                kept = batch.filter(pa.array(good))
                far = chords[np.arange(len(near)), near]
                columns = [kept.column("chunk_id"), pa.array(near), pa.array(far), kept.column("embedding")]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "pivot", "far", "embedding"])

        def rings(batches: Iterator[pa.RecordBatch]):
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                pivot = batch.column("pivot").to_numpy()
                far = batch.column("far").to_numpy()
                starts = np.flatnonzero(np.diff(pivot, prepend=-1))
                for first, end in zip(starts, [*starts[1:], len(pivot)], strict=True):
                    for lo in range(first, end, block):
                        hi = min(lo + block, end)
                        rows = batch.slice(lo, hi - lo)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "block": pa.array([number]),
                                "pivot": pa.array([pivot[lo]]),
                                "n": pa.array([hi - lo]),
                                "inner": pa.array([far[lo]]),
                                "outer": pa.array([far[hi - 1]]),
                                "ids": pa.ListArray.from_arrays([0, hi - lo], rows.column("chunk_id")),
                                "vectors": pa.ListArray.from_arrays(
                                    [0, (hi - lo) * width], rows.column("embedding").flatten()
                                ),
                            }
                        )
                        number += 1

        dealt = corpus.mapInArrow(deal, f"chunk_id long, pivot long, far double, embedding array<{kind}>")
        # Ranges of (pivot, far), so a pivot with very many chunks is spread over tasks.
        ordered = dealt.repartitionByRange("pivot", "far").sortWithinPartitions("pivot", "far", "chunk_id")
        schema = f"block long, pivot long, n long, inner double, outer double, ids array<long>, vectors array<{kind}>"
        ordered.mapInArrow(rings, schema).write.mode("overwrite").parquet(f"{self.path}/blocks")
        listed = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        self.spark.createDataFrame(listed, "pivot long, centre array<double>").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/pivots"
        )
        return self

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def _centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centres, inner and outer radius of the pivots that have chunks: at most ``pivots`` rows."""
        cells = self.blocks().groupBy("pivot").agg(F.min("inner").alias("inner"), F.max("outer").alias("outer"))
        held = self.spark.read.parquet(f"{self.path}/pivots").join(cells, "pivot").orderBy("pivot").collect()
        centres = np.array([r.centre for r in held], dtype=float)
        return (
            np.array([r.pivot for r in held], dtype=np.int64),
            centres,
            np.array([r.inner for r in held]),
            np.array([r.outer for r in held]),
        )

    def _plans(self, queries: DataFrame, k: int, probes: int):
        """For each slice of queries: result, and pairs of query and block to score."""
        sc = self.spark.sparkContext
        numbers, centres, inner, outer = self._centres()
        width = centres.shape[1] if len(centres) else 0
        cells = sc.broadcast((numbers, centres, inner, outer))
        rings = self.blocks().select("block", "pivot", "inner", "outer")
        near_type = "query_id long, pivot long, chord double, reach double"

        def near(batches: Iterator[pa.RecordBatch]):
            """Pivots whose chunks may lie within reach of a query; without a reach the nearest few."""
            numbers, centres, inner, outer = cells.value
            for batch in batches:
                units = matching._matrix(batch.column("embedding"), width)
                reach = batch.column("reach").to_numpy(zero_copy_only=False)
                good = np.flatnonzero(np.isfinite(units).all(axis=1))
                for lo in range(0, len(good), matching.QUERY_TILE):
                    at = good[lo : lo + matching.QUERY_TILE]
                    chords = _chords(units[at], centres)
                    gaps = _gap(chords, inner, outer)
                    few = np.sort(gaps, axis=1)[:, min(probes, gaps.shape[1]) - 1]
                    limit = np.where(np.isnan(reach[at]), few, reach[at])
                    row, cell = np.nonzero(gaps <= limit[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("query_id").take(pa.array(at[row])),
                            pa.array(numbers[cell]),
                            pa.array(chords[row, cell]),
                            pa.array(limit[row]),
                        ],
                        names=["query_id", "pivot", "chord", "reach"],
                    )

        for part in matching.slices(queries):
            asks = part.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
            table = asks.toArrow()
            if not len(numbers) or not table.num_rows:
                empty = self.spark.createDataFrame([], f"{matching.RESULT}, rank int")
                yield empty, self.spark.createDataFrame([], "query_id long, block long")
                continue
            ids = table.column("query_id").to_numpy()
            shared = sc.broadcast((ids, matching._matrix(table.column("embedding").combine_chunks(), width)))

            def score(batches: Iterator[pa.RecordBatch], shared=shared):
                ids, wanted = shared.value
                best = matching.Best(ids, k)
                for batch in batches:
                    for i in range(batch.num_rows):
                        chunks = batch.column("ids")[i].values
                        flat = batch.column("vectors")[i].values
                        sizes = pa.array(np.arange(len(chunks) + 1) * width, pa.int32())
                        units = matching._matrix(pa.ListArray.from_arrays(sizes, flat), width)
                        asked = np.flatnonzero(np.isin(ids, batch.column("queries")[i].values.to_numpy()))
                        for lo in range(0, len(asked), matching.QUERY_TILE):
                            at = asked[lo : lo + matching.QUERY_TILE]
                            far = np.round(1.0 - units @ wanted[at].T, matching.DECIMALS)
                            far = np.where(np.isnan(far), np.inf, far)
                            for j, q in enumerate(at):
                                best.offer(far[:, j : j + 1], chunks.to_numpy(), q)
                yield from best.result()

            def scored(pairs: DataFrame, score=score) -> DataFrame:
                # at most the queries of a slice per block
                asked = pairs.groupBy("block").agg(F.collect_set("query_id").alias("queries"))
                held = self.blocks().select("block", "ids", "vectors").join(asked, "block")
                found = held.select("ids", "vectors", "queries").mapInArrow(score, matching.RESULT)
                return top_k(found, ["query_id"], [F.col("score").asc(), F.col("chunk_id").asc()], k)

            gap = F.greatest(F.col("chord") - F.col("outer"), F.col("inner") - F.col("chord"), F.lit(0.0))
            first = asks.withColumn("reach", F.lit(float("nan"))).mapInArrow(near, near_type).join(rings, "pivot")
            first = top_k(first.withColumn("gap", gap), ["query_id"], [F.asc("gap"), F.asc("block")], probes, "_place")
            reach = F.sqrt(2.0 * (F.col("score") + 10.0**-matching.DECIMALS)) + SLACK
            reaches = stored(scored(first).where(F.col("rank") == k).select("query_id", reach.alias("reach")), "reach")
            # one row per query of the slice at most
            known = asks.join(F.broadcast(reaches), "query_id", "left")
            known = known.select("query_id", "embedding", F.coalesce("reach", F.lit(ALL)).alias("reach"))
            pairs = known.mapInArrow(near, near_type).join(rings, "pivot").where(gap <= F.col("reach"))
            yield scored(pairs), pairs.select("query_id", "block")

    def search(self, queries: DataFrame, *, k: int = 5, probes: int = PROBES) -> DataFrame:
        """query_id, chunk_id, distance, rank: the rows of ``batch_vector_search``. Query ids are unique."""
        parts = [found.withColumnRenamed("score", "distance") for found, _ in self._plans(queries, k, probes)]
        return matching._union([p.select("query_id", "chunk_id", "distance", "rank") for p in parts])

    def skipped(self, queries: DataFrame, *, k: int = 5, probes: int = PROBES) -> DataFrame:
        """query_id, chunks (compared with the query), share_skipped of all indexed chunks."""
        pairs = matching._union([pairs for _, pairs in self._plans(queries, k, probes)])
        total = self.blocks().agg(F.sum("n")).scalar()
        counted = pairs.join(self.blocks().select("block", "n"), "block").groupBy("query_id").agg(F.sum("n").alias("chunks"))
        return counted.withColumn("share_skipped", 1.0 - F.col("chunks") / total)
