"""Work that has to grow no faster than the texts: frequent n-grams, loose groups, words that come again and again."""

import base64
import random
import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from lodestone.llm import bpe, fuzzy_lines, language_id, links, ngram_join


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def test_prefixes_avoid_a_passage_that_each_task_sees_once(spark):
    # 40 texts over 40 partitions share 60 words; no partition sees a shared n-gram twice
    draw = random.Random(3)
    passage = " ".join(f"shared{k}" for k in range(60))
    texts = [(d, " ".join(f"w{draw.randrange(10**9)}" for _ in range(300)) + " " + passage) for d in range(40)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(texts, 40), "doc_id long, text string")
    placed = ngram_join._described(docs, 5, 80).select("doc_id", F.explode("prefix").alias("bucket"))
    assert placed.groupBy("bucket").count().where("count > 1").count() == 0


def test_class_counts_are_sums_over_all_tasks(spark):
    rows = [("a b c d e",)] * 30 + [("f g h i j",), (None,), ("",)]
    texts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 33), "text string")
    counts = ngram_join.class_counts(texts, ngram_join.shingle_set, 1 << 14)
    assert sorted(counts[counts > 0].tolist()) == [1, 30]
    assert not ngram_join.class_counts(texts.limit(0), ngram_join.shingle_set, 1 << 14).any()


def test_loose_groups_are_not_compared_pair_by_pair(spark):
    # any two of 400 nodes in one bucket link by the toss of a coin
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0)

    members = spark.range(400).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"))
    found = links.linked_components(members, verify)
    assert {(r.node, r.root) for r in found.collect()} == {(n, 0) for n in range(400)}
    assert sum(compared) < 10_000


def test_words_in_use_stay_in_the_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 40)
    codec = bpe.Codec(ranks(), public_tokenizers.PATTERN)
    merged, encoded = codec.merged, []
    monkeypatch.setattr(codec, "merged", lambda words: encoded.extend(words) or merged(words))
    texts = [f"start qzxwvqj {' '.join(f'zq{a}xw{b}qj' for b in 'abcdefghij')}" for a in "klmnopqrstuv"]
    found = [codec.encode_all([t])[0] for t in texts]
    assert encoded.count(b" qzxwvqj") == 1
    assert [codec.decode(ids).decode() for ids in found] == texts


def test_bytes_without_a_rank_still_merge():
    codec = bpe.Codec({b"a": 0, b"bc": 1, b"abc": 2}, r"\w+")
    assert codec.encode_all(["abc", "bc", "b", "ab"]) == [b"\2\0\0\0", b"\1\0\0\0", b"", b"\0\0\0\0"]
    assert codec.decode(b"\2\0\0\0\0\0\0\0") == b"abca"


def test_counts_reach_the_driver_without_an_object_per_row(spark, monkeypatch):
    letters = np.random.default_rng(3).integers(97, 123, 60_000, dtype=np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, letters, "aa")], "doc_id long, text string, lang string")
    seen = {}

    def trees(languages, order, counts):
        seen.update(rows=len(counts), total=int(counts["n"].sum()), peak=tracemalloc.get_traced_memory()[1])

    monkeypatch.setattr(language_id, "ContextTrees", trees)
    arrow = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")  # Spark's own setting
    tracemalloc.start()
    try:
        language_id.train(docs)
    finally:
        tracemalloc.stop()
        spark.conf.set(arrow, before)
    assert seen["rows"] > 100_000 and seen["total"] == 5 * 60_000 - 10
    assert seen["peak"] < 20 << 20


def test_bands_of_one_line_are_not_stored(spark, monkeypatch):
    draw = random.Random(5)
    lines = ["".join(draw.choices("abcdefghijklmnop ", k=60)) for _ in range(3000)]
    lines += [line + "x" for line in lines[:40]]
    rows = []

    def counted(df, label, keep=links.stored):
        out = keep(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(fuzzy_lines, "stored", counted)
    monkeypatch.setattr(links, "stored", counted)
    docs = spark.createDataFrame([(d, "\n".join(lines[d::40])) for d in range(40)], "doc_id long, text string")
    found = fuzzy_lines.dedup_lines(docs)
    assert found.agg(F.sum("n_removed")).first()[0] == 40
    assert sum(rows) < 3 * len(lines)


def test_packed_rows_meet_by_bucket_and_spread_when_crowded(monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "PACKED", 500)
    draw = np.random.default_rng(2)
    bucket = np.concatenate([np.full(3000, 77), draw.integers(0, 900, 1500), np.arange(10_000, 12_000)])
    node = draw.integers(-(1 << 62), 1 << 62, len(bucket))
    order = draw.permutation(len(bucket))
    found = [(bucket[x], node[x]) for x in np.array_split(order, 40)]
    packed = pd.concat([*fuzzy_lines.packed_parts(iter(found), 16, 2)])
    assert len(packed) < 1000
    got, asked_of_crowd = set(), 0
    for _, part in packed.groupby("part"):
        (buckets, nodes), proven = fuzzy_lines.unpacked(part, 2)
        asked_of_crowd += int((buckets == 77).sum())
        several = fuzzy_lines.in_runs(buckets) > 1
        got |= {*zip(buckets[several].tolist(), nodes[several].tolist()), *zip(*(x.tolist() for x in proven))}
    many = {b for b, n in zip(*np.unique(bucket, return_counts=True)) if n > 1}
    assert got == {(b, n) for b, n in zip(bucket.tolist(), node.tolist()) if b in many}
    assert asked_of_crowd <= 2 * 14


def test_pairs_of_rare_shingles_are_those_of_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for k in range(120):  # bucket -1 is crowded
        prefix = [-1, *draw.sample(range(60), 6)]
        rows.append((k * 7 - 300, k % 50, 30 + k % 9, prefix))
    labelled = spark.createDataFrame(rows, "node long, label long, n long, prefix array<long>").repartition(5)
    pairs, crowded = fuzzy_lines.rare_pairs(labelled, 8, 80)
    members = {}
    for node, label, n, prefix in rows:
        for at, bucket in enumerate(prefix):
            members.setdefault(bucket, []).append((node, label, n, at))
    expected = set()
    for rows_of in members.values():
        for x in rows_of if len(rows_of) <= fuzzy_lines.SMALL else []:
            for y in rows_of:
                least = -(-80 * (x[2] + y[2]) // 180)
                if x[0] < y[0] and x[1] != y[1] and min(x[2] - x[3], y[2] - y[3]) >= least <= min(x[2], y[2]):
                    expected.add((x[0], y[0]))
    assert expected and {(r.a, r.b) for r in pairs.collect()} == expected
    more = {(b, m[0], m[2], m[3]) for b, ms in members.items() if len(ms) > fuzzy_lines.SMALL for m in ms}
    assert (-1, -300, 30, 0) in more and {tuple(r) for r in crowded.collect()} == more
