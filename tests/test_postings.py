"""The stored inverted index gives the rows of the full scan, whatever its blocks and batches."""

import random

import pytest

from lodestone.operators import search
from lodestone.operators.postings import PostingsIndex

CHUNKS = "chunk_id long, content string, n int, slots string"  # the last two clash with columns of the index
ASKS = "query_id long, text string"


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(1, 40))) for _ in range(300)]
    texts += texts[:20]  # copies tie
    texts += [None, "", "?! a", "w1 " * 3000, "w2"]
    data = [(i, t, i, "x") for i, t in enumerate(texts)]
    asks = [(q, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for q in range(40)]
    asks += [(40, None), (41, ""), (42, "nowhere"), (43, "w3 w3 w3 w9"), (44, "W2"), (45, "w59 nowhere w1")]
    return spark.createDataFrame(data, CHUNKS).repartition(3).cache(), spark.createDataFrame(asks, ASKS)


@pytest.mark.parametrize("block,k,probes", [(16, 5, 1), (256, 10, 4), (7, 1, 2), (16, 500, 2)])
def test_rows_of_the_full_scan(corpus, tmp_path, block, k, probes):
    chunks, asks = corpus
    index = PostingsIndex(chunks.sparkSession, str(tmp_path)).add(chunks, block=block)
    expected = rows(search.bm25_corpus(chunks, asks, k=k))
    assert rows(index.search(asks, k=k, probes=probes)) == expected and len(expected) > 40
    assert rows(index.search(asks, k=k, k1=2.0, b=0.1)) == rows(search.bm25_corpus(chunks, asks, k=k, k1=2.0, b=0.1))


def test_batches_and_a_batch_written_again(corpus, tmp_path):
    chunks, asks = corpus
    index = PostingsIndex(chunks.sparkSession, str(tmp_path), buckets=4)
    index.add(chunks.where("chunk_id < 100"), 0, 32).add(chunks.where("chunk_id >= 50"), 1, 32)
    index.add(chunks.where("chunk_id >= 100"), 1, 32)
    assert rows(index.search(asks)) == rows(search.bm25_corpus(chunks, asks))
    mine = {r.term: (r.df, round(r.idf, 9)) for r in index.idf().collect()}
    assert mine == {r.term: (r.df, round(r.idf, 9)) for r in search.idf(chunks).collect()}
    with pytest.raises(ValueError):
        index.add(chunks, 1 << 15)


def test_blocks_below_the_floor_are_skipped(spark, tmp_path):
    # 64 blocks; the terms asked for are frequent in one of them and rare in the others
    texts = [(i, "topic topic note" if i // 16 == 20 else "note " * 30 + "topic " * (i % 16 == 0), 0, "") for i in range(1024)]
    chunks = spark.createDataFrame(texts, CHUNKS).coalesce(1)
    asks = spark.createDataFrame([(1, "topic"), (2, "note")], ASKS)
    index = PostingsIndex(spark, str(tmp_path)).add(chunks, block=16)
    seen = {r.query_id: (r.blocks, r.scored) for r in index.skipped(asks, k=3).collect()}
    assert seen[1] == (64, 1) and seen[2][0] == 64
    assert rows(index.search(asks, k=3)) == rows(search.bm25_corpus(chunks, asks, k=3))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], CHUNKS)
    asks = spark.createDataFrame([(1, "topic")], ASKS)
    index = PostingsIndex(spark, str(tmp_path / "a")).add(none)
    assert index.search(asks).collect() == [] and index.idf().collect() == []
    blank = PostingsIndex(spark, str(tmp_path / "b")).add(spark.createDataFrame([(1, None, 0, ""), (2, "", 0, "")], CHUNKS))
    assert blank.search(asks).collect() == []
    assert blank.search(spark.createDataFrame([], ASKS)).collect() == []


def test_plan_reads_only_the_columns_and_buckets_it_needs(corpus, tmp_path, capsys):
    chunks, asks = corpus
    index = PostingsIndex(chunks.sparkSession, str(tmp_path)).add(chunks)
    index.search(asks.where("query_id = 44"), k=2).explain("formatted")
    plan = capsys.readouterr().out
    assert "content" not in plan and "front_tf" not in plan and "PartitionFilters: [bucket" in plan.replace("bucket#", "bucket")


def test_blocks_do_not_depend_on_the_borders_of_batches():
    import pyarrow as pa

    from lodestone.operators.postings import _blocks

    given = [pa.record_batch({"chunk_id": pa.array(range(lo, hi))}) for lo, hi in ((0, 5), (5, 5), (5, 6), (6, 17))]
    found = [b.column(0).to_pylist() for b in _blocks(iter(given), 4)]
    assert found == [list(range(lo, min(lo + 4, 17))) for lo in range(0, 17, 4)]
