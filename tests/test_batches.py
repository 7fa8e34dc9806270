"""Python kernels over texts hold batches and slices of bounded size, and a text is chunked once per delivery."""

import numpy as np
import pyarrow as pa
import pytest

from lodestone.functions.text import SPACES, words
from lodestone.operators import chunking, matching
from lodestone.plans import evaluation
from lodestone.session import BATCH_BYTES, BATCH_SETTING, bounded_batches
from lodestone.sources.sections import markdown_sections
from lodestone.streaming import indexing
from pyspark.sql import functions as F


def test_batches_are_cut_by_words_and_bytes():
    lists = pa.record_batch({"id": list(range(6)), "tokens": [["a"] * n for n in (3, 0, 2, 9, 1, 4)]})
    found = [b.column("id").to_pylist() for b in matching.cut(iter([lists.slice(1), lists.slice(0, 1)]), "tokens", 5)]
    assert found == [[1, 2], [3], [4, 5], [0]]
    strings = pa.record_batch({"id": [1, 2, 3, 4], "content": ["äö", None, "abc", ""]})
    assert [b.num_rows for b in matching.cut(iter([strings]), "content", 4)] == [2, 2]
    assert list(matching.pieces(np.array([], np.int64), 5)) == []


@pytest.fixture
def wide(spark):
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, "64m")
    yield spark
    spark.conf.set(BATCH_SETTING, before)


def _limit(spark):
    return int(spark.conf.get(BATCH_SETTING).rstrip("bB"))


def test_text_kernels_bound_their_batches(wide):
    texts = wide.createDataFrame([(1, "alpha beta " * 50), (2, "beta gamma")], "chunk_id long, content string")
    asks = wide.createDataFrame([(7, "gamma beta")], "query_id long, text string")
    for make in (
        lambda: matching.bm25(texts, asks, 2),
        lambda: evaluation.passages_in_documents(texts, asks.withColumnRenamed("query_id", "item_id")),
        lambda: chunking.chunk_documents(markdown_sections(texts)),
    ):
        wide.conf.set(BATCH_SETTING, "64m")
        make()
        assert _limit(wide) == BATCH_BYTES
    wide.conf.set(BATCH_SETTING, "1000")
    bounded_batches(wide)
    assert _limit(wide) == 1000


def test_slices_change_no_score(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * j) % 17:02d}" for j in range(1, 2 + i % 9))) for i in range(300)]
    chunks = spark.createDataFrame([*texts, (300, None), (301, "")], "chunk_id long, content string")
    asks = spark.createDataFrame([(1, "w01 w02"), (2, "w16"), (3, "none")], "query_id long, text string")
    whole = sorted(tuple(r) for r in matching.bm25(chunks, asks, 5).collect())
    monkeypatch.setattr(matching, "BATCH_WORDS", 7)
    assert whole and sorted(tuple(r) for r in matching.bm25(chunks, asks, 5).collect()) == whole


def test_words_end_at_the_same_characters(spark):
    points = [c for c in [*range(0x3100), 0xD7FF, 0xE000, 0xFEFF, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]]
    rows = spark.createDataFrame([("a" + chr(c) + "b",) for c in points], "t string")
    plain = F.regexp_extract_all("t", F.lit(f"[^{SPACES}]+"), F.lit(0))
    assert rows.where(words(F.col("t")) != plain).count() == 0


def test_a_delivery_chunks_each_text_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(documents):
        @F.udf("string")
        def same(value):
            seen.add(1)
            return value

        return markdown_sections(documents.withColumn("content", same.asNondeterministic()("content")))

    monkeypatch.setattr(indexing, "markdown_sections", counted)
    schema = "source_path string, project string, content string, source_date timestamp_ntz, version long, vanished boolean"
    text = "# Title\n" + "Several different words stand in this line of text, so it is kept. " * 3
    rows = [(f"p{i}", "a", text if i % 2 else "", None, 0, False) for i in range(20)]
    indexing.index_batch(spark.createDataFrame(rows, schema), 0, str(tmp_path))
    assert seen.value == 20
    found = indexing.current_chunks(spark, str(tmp_path))
    assert sorted(r.source_path for r in found.collect()) == sorted(f"p{i}" for i in range(1, 20, 2))
    # a text that has no chunk any more, and a document that has gone, lose their old ones
    later = [("p1", "a", "", None, 1, False), ("p3", "a", None, None, 1, True)]
    indexing.index_batch(spark.createDataFrame(later, schema), 1, str(tmp_path))
    left = {r.source_path for r in indexing.current_chunks(spark, str(tmp_path)).collect()}
    assert left == {f"p{i}" for i in range(5, 20, 2)}
