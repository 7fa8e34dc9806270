"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import max_sketches

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, top=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    count, total = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, own in held:
            tf, m = Counter(own), 25 + 75 * len(own) * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m))
                for x in terms(text) if tf[x]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if none else d, -score))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    lots = random.Random(12)
    words = [f"w{k}" for k in range(400)] + ["Été", "ÀB", "日本", "x9"]
    common = lots.choices(words, k=60)

    def text(n):
        body = [lots.choice(words[: lots.choice([5, 40, 404])]) for _ in range(n)]
        return lots.choice([" ", ", ", "\n", "_"]).join(body)

    docs = [(k, text(lots.randrange(1, 200))) for k in range(500)]
    docs += [(k, " ".join(common[: lots.choice([20, 60])]) + " " + text(lots.randrange(20))) for k in range(500, 560)]
    docs += [(600, None), (601, ""), (602, "., \t"), (None, "W1 w2 " * 40), (603, "w3 " * 9000 + "été"), (604, "w3 été " * 300)]
    docs += docs[3:9] + [(7, "another w5 text")]
    items = [(k, text(lots.randrange(1, 40))) for k in range(40)] + [(50, " ".join(common)), (51, "W1 w1 w1 w2"), (52, None), (53, "nowhere"), (None, "w3 été")]
    return docs, items + items[:2] + [(0, "w9")]


def given(spark, docs, items):
    documents = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, n int").repartition(6)
    return documents, spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("blocks", [1, 3])
def test_equal_to_scoring_all(spark, data, blocks, monkeypatch):
    if blocks > 1:
        monkeypatch.setattr(max_sketches, "BLOCK_QUERIES", 30)
    found = max_sketches.ranked_search(*given(spark, *data), probes=3 if blocks > 1 else max_sketches.PROBES)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(*data)


@pytest.mark.parametrize(("wide_from", "widths"), [(2048, (1 << 16, 1 << 24)), (30, (64, 256))])
def test_bounds_hold_and_prune(data, wide_from, widths, monkeypatch):
    monkeypatch.setattr(max_sketches, "WIDE_FROM", wide_from)
    monkeypatch.setattr(max_sketches, "WIDTHS", widths)
    monkeypatch.setattr(max_sketches, "CELLS", 1000)
    docs, items = data
    held = [t for _, t in docs if terms(t)]
    queries = max_sketches.Queries(*zip(*[(i, Counter(x.encode() for x in terms(t))) for i, t in items if terms(t)]))
    holding = Counter(queries.terms[x.encode()] for t in held for x in set(terms(t)) if x.encode() in queries.terms)
    queries.weigh(len(held), sum(len(terms(t)) for t in held), holding)
    counts = [Counter(x.encode() for x in terms(t)) for t in held]
    places, peaks = zip(*map(max_sketches.sketch, counts))
    wide = [len(c) >= max_sketches.WIDE_FROM for c in counts]
    batch = pa.record_batch({"n": [c.total() for c in counts], "wide": wide, "places": places, "peaks": peaks})
    scores = np.array([queries.scores(t) for t in held])
    bounds = queries.bounds(batch)
    assert (bounds >= scores).all()
    tenth = np.sort(scores, axis=0)[-10]
    reached = bounds >= np.maximum(tenth, 1)
    assert ((scores == 0) | (scores < tenth) | reached).all()
    passage = queries.ids.index(50)  # many documents hold it, few reach the score of the tenth
    assert widths[0] == 64 or reached.mean() < 0.15 and reached[:, passage].mean() < 0.05


def test_empty_tables(spark, data):
    docs, items = given(spark, *data)
    for one, other in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 600"), items)):
        found = max_sketches.ranked_search(one, other)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_terms_of_long_texts(data, monkeypatch):
    monkeypatch.setattr(max_sketches, "STEP", 7)
    for text in [t for _, t in data[0][:60]] + ["é" * 40, "a" * 9 + "_B" * 9, None, ""]:
        parts = list(max_sketches.split_terms(text))
        assert [t.decode() for part in parts for t in part] == terms(text)
