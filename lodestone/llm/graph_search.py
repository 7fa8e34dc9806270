"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors are one point. Points are dealt to shards by hash, so a shard has about ``shard_points`` of them. In a
shard every point is searched for in the graph so far (greedy search with a beam), and of what the search meets it
keeps the nearest as neighbour, drops all that this one is nearer to by the factor ``alpha``, and goes on with the
rest; edges are added both ways and pruned the same way. Beam search answers the queries in each shard, and the
nearest of all shards are merged. All points are indexed; distances are computed in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as
query nor as candidate; vectors are compared with those of their length only; copies of a vector are all found, ties
going to the smaller id; an empty table gives no rows; a repeated id is one candidate per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

SHARD_POINTS = 2048
QUERY_BLOCK = 4096
DEGREE = 24
BUILD_BEAM = 48
SEARCH_BEAM = 80
ALPHA = 1.2
#: Points that are searched for at a time.
BATCH = 256


def _squared(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return ((points[ids] - queries[:, None, :]) ** 2).sum(axis=2)


def beam_search(
    points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the ``beam`` nearest points met, nearest first, with squared distances (-1 and inf: none)."""
    many, width = len(queries), min(beam, len(points))
    ids = np.full((many, width), -1)
    near = np.full((many, width), np.inf)
    done = np.zeros((many, width), bool)
    seen = np.zeros((many, len(points)), bool)
    ids[:, 0] = start
    near[:, 0] = _squared(points, np.full((many, 1), start), queries)[:, 0]
    seen[:, start] = True
    rows = np.arange(many)
    while len(rows):
        waiting = np.where(done[rows], np.inf, near[rows])
        best = waiting.argmin(axis=1)
        going = np.isfinite(waiting[np.arange(len(rows)), best])
        rows, best = rows[going], best[going]
        if not len(rows):
            break
        done[rows, best] = True
        around = edges[ids[rows, best]]
        fresh = (around >= 0) & ~seen[rows[:, None], around]
        seen[rows[:, None], np.where(around >= 0, around, start)] = True
        distance = np.where(fresh, _squared(points, np.where(fresh, around, 0), queries[rows]), np.inf)
        all_ids = np.concatenate([ids[rows], np.where(fresh, around, -1)], axis=1)
        all_near = np.concatenate([near[rows], distance], axis=1)
        all_done = np.concatenate([done[rows], np.zeros(around.shape, bool)], axis=1)
        keep = np.argpartition(all_near, width - 1, axis=1)[:, :width]
        ids[rows] = np.take_along_axis(all_ids, keep, 1)
        near[rows] = np.take_along_axis(all_near, keep, 1)
        done[rows] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def robust_prune(
    points: np.ndarray, of: np.ndarray, candidates: np.ndarray, alpha: float, degree: int
) -> np.ndarray:
    """Neighbours of the points ``of`` among their candidates (-1: none): near ones in different directions."""
    far = _squared(points, np.maximum(candidates, 0), points[of])
    far[(candidates < 0) | (candidates == of[:, None])] = np.inf
    out = np.full((len(of), degree), -1)
    rows = np.arange(len(of))
    for k in range(min(degree, candidates.shape[1])):
        pick = far.argmin(axis=1)
        some = np.isfinite(far[rows, pick])
        if not some.any():
            break
        chosen = candidates[rows, pick]
        out[some, k] = chosen[some]
        between = _squared(points, np.maximum(candidates, 0), points[np.maximum(chosen, 0)])
        far[some[:, None] & (alpha * alpha * between <= far)] = np.inf
        far[rows, pick] = np.inf
    return out


def build_graph(
    points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1
) -> tuple[np.ndarray, int]:
    """Edges (a row of ``degree`` neighbours per point) and the point to start from, the one nearest to the mean."""
    many = len(points)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    lots = np.random.default_rng(seed)
    edges = np.full((many, degree), -1)
    if many > 1:
        half = min(degree // 2, many - 1)
        edges[:, :half] = (np.arange(many)[:, None] + lots.integers(1, many, (many, half))) % many
    for factor in (1.0, alpha):
        order = lots.permutation(many)
        for at in range(0, many, BATCH):
            batch = order[at : at + BATCH]
            met, _ = beam_search(points, edges, start, points[batch], beam)
            edges[batch] = robust_prune(points, batch, np.concatenate([met, edges[batch]], axis=1), factor, degree)
            _link_back(points, edges, batch, factor)
    return edges, start


def _link_back(points: np.ndarray, edges: np.ndarray, batch: np.ndarray, alpha: float) -> None:
    degree = edges.shape[1]
    sources, targets = np.repeat(batch, degree), edges[batch].reshape(-1)
    real = targets >= 0
    sources, targets = sources[real], targets[real]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    unique, first, count = np.unique(targets, return_index=True, return_counts=True)
    for part in range(0, len(unique), BATCH):
        own, begin, n = unique[part : part + BATCH], first[part : part + BATCH], count[part : part + BATCH]
        extra = np.full((len(own), n.max(initial=1)), -1)
        for row, (b, c) in enumerate(zip(begin, n)):
            extra[row, :c] = sources[b : b + c]
        edges[own] = robust_prune(points, own, np.concatenate([edges[own], extra], axis=1), alpha, degree)


def usable(embedding: Column) -> Column:
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & whole & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    shard_points: int = SHARD_POINTS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, embedding): the ``k`` nearest others of each query.

    A point keeps its ``k`` + 1 smallest ids, found in two steps so that a vector with very many copies is cut down
    in many tasks first: no query needs more, as ties go to smaller ids.
    """
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")))

    def smallest(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("vec_id")
        return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")

    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    kept = smallest(smallest(salted, "v", "salt"), "v")
    points = kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = stored(points.select(F.element_at("ids", 1).alias("point"), "ids", "v"), "points")
    shards = max(1, -(-points.count() // shard_points))
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id", "v"])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    shard = F.pmod(F.xxhash64("point", F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    size = F.size("v").alias("size")
    held = points.select("point", "v", size, shard, every(blocks, "block"))
    asked = queries.select("query_id", "v", size, every(shards, "shard"), block)

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if own.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "point": [], "score": []})
        own = own.sort_values("point")
        ids, data = own["point"].to_numpy(np.int64), np.stack(own["v"].to_list()).astype(np.float64)
        edges, start = build_graph(data)
        wanted = np.stack(queries["v"].to_list()).astype(np.float64)
        found, near = [], []
        for at in range(0, len(wanted), BATCH):
            a, b = beam_search(data, edges, start, wanted[at : at + BATCH], max(beam, k + 1))
            found.append(a[:, : k + 1])
            near.append(b[:, : k + 1])
        found, near = np.concatenate(found), np.concatenate(near)
        real = np.isfinite(near)
        query = np.repeat(queries["query_id"].to_numpy(np.int64)[:, None], found.shape[1], axis=1)
        return pd.DataFrame({"query_id": query[real], "point": ids[found[real]], "score": np.sqrt(near[real])})

    keys = ["size", "shard", "block"]
    met = (
        asked.groupBy(*keys)
        .cogroup(held.groupBy(*keys))
        .applyInPandas(lambda q, p: search(p, q), "query_id long, point long, score double")
    )
    by_point = Window.partitionBy("query_id").orderBy("score", "point")
    best = met.withColumn("_n", F.row_number().over(by_point)).where(F.col("_n") <= k + 1)
    named = best.join(points.select("point", F.explode("ids").alias("vec_id")), "point").where("vec_id <> query_id")
    by_id = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        named.withColumn("rank", F.row_number().over(by_id))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
