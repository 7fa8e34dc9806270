"""Vector search over blocks that the triangle inequality allows to skip finds the rows of the full scan."""

import numpy as np
import pytest

from lodestone.operators import search
from lodestone.operators.pivots import PivotIndex

WIDTH = 12
CHUNKS = "chunk_id long, embedding array<double>, pivot string, n int"  # the last two clash with columns of the index
ASKS = "query_id long, embedding array<double>"


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.distance) for r in df.collect())


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, "x", 1) for i, v in enumerate(vectors)], CHUNKS)


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, WIDTH)) * 10
    vectors = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, WIDTH))).tolist()
    vectors += [vectors[0]] * 700  # a third are copies of one: ties, and one ring without width
    asks = [(q, vectors[q * 37]) for q in range(30)] + [(90, rng.normal(size=WIDTH).tolist()), (91, [-x for x in vectors[3]])]
    return table(spark, vectors).repartition(5).cache(), spark.createDataFrame(asks, ASKS)


@pytest.mark.parametrize("pivots,block,k,probes", [(16, 32, 5, 2), (1, 64, 3, 1), (300, 16, 10, 4), (16, 50, 900, 2)])
def test_rows_of_the_full_scan(clusters, tmp_path, pivots, block, k, probes):
    chunks, asks = clusters
    index = PivotIndex(chunks.sparkSession, str(tmp_path)).build(chunks, width=WIDTH, pivots=pivots, block=block)
    expected = rows(search.batch_vector_search(chunks, asks, k=k))
    assert len(expected) == 32 * k and rows(index.search(asks, k=k, probes=probes)) == expected


def test_blocks_beyond_reach_are_skipped(clusters, tmp_path):
    chunks, asks = clusters
    index = PivotIndex(chunks.sparkSession, str(tmp_path)).build(chunks, width=WIDTH, pivots=48, block=16)
    shares = {r.query_id: r.share_skipped for r in index.skipped(asks.where("query_id < 90"), k=3).collect()}
    assert len(shares) == 30 and np.mean(list(shares.values())) > 0.5
    held = index.blocks().selectExpr("max(n)", "sum(n)", "count(distinct block) = count(*)").first()
    assert held[0] <= 16 and held[1] == 2200 and held[2]


def test_vectors_that_have_no_direction(spark, tmp_path):
    good = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [1.0, 0.0]]
    odd = [None, [], [0.0, 0.0], [1.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    chunks = table(spark, good + odd)
    asks = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.1], *odd])], ASKS)
    index = PivotIndex(spark, str(tmp_path)).build(chunks, width=2, pivots=3, block=2)
    found = rows(index.search(asks, k=9))
    assert [(q, r, c) for q, r, c, _ in found] == [(0, 1, 0), (0, 2, 3), (0, 3, 1), (0, 4, 2)]
    assert found == rows(search.batch_vector_search(chunks, asks.where("query_id = 0"), k=9))


def test_empty_tables(spark, tmp_path):
    none, asks = table(spark, [[1.0, 0.0]]).limit(0), spark.createDataFrame([(1, [1.0, 0.0])], ASKS)
    assert PivotIndex(spark, str(tmp_path / "a")).build(none, width=2).search(asks).collect() == []
    index = PivotIndex(spark, str(tmp_path / "b")).build(table(spark, [[1.0, 0.0]]), width=2)
    assert index.search(asks.limit(0)).collect() == [] and len(index.search(asks).collect()) == 1
