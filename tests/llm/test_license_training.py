"""Other text and the threshold of the license scan come from every paragraph, not from a sample."""

import random

from pyspark.sql import functions as F

from lodestone.llm import licenses


def prose(n):
    lots = random.Random(5)
    words = [*"the of this under any work file free project note terms use or is and".split(), *[f"w{k}" for k in range(300)]]
    return ["\n".join(" ".join(lots.choices(words, k=lots.randrange(3, 14))) for _ in range(20)) for _ in range(n)]


def test_ids_do_not_decide_what_is_learned(spark):
    texts = [*prose(500), "Released under the MIT License.", "w1 w2\nThis program is licensed under the Foo License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    found = []
    for shift in (0, 1_000_000):
        rows = licenses.license_scan(docs.withColumn("doc_id", F.col("doc_id") + shift)).collect()
        found.append({r.doc_id - shift: (r.licenses, r.n_licensed, r.n_unknown, round(r.best, 6)) for r in rows})
    assert found[0] == found[1]
    assert found[0][500][:3] == ("mit", 1, 0) and all(found[0][k][0] == "" for k in range(500))
    assert sum(found[0][k][2] for k in range(500)) <= 20  # of 10 000 paragraphs, as many as false alarms may be, and twice that


def test_all_paragraphs_are_counted(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(prose(400))], "doc_id long, text string")
    seen, own = [], licenses.train

    def spied(counted, *more):
        seen.append(counted.agg(F.sum("n")).head()[0])
        return own(counted, *more)

    monkeypatch.setattr(licenses, "train", spied)
    licenses.license_scan(docs)
    assert seen == [8_000]
