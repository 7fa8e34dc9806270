"""Small brute-force checks of the training-data operators, with nulls, repeated rows and empty tables."""

import base64
import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, fuzzy_lines, graph_search, iblt, language_id, licenses, links, mixing, ngram_join, pii
from lodestone.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
LINES = [f"a line of plain words number {w} which is long enough to count" for w in ("one", "two", "three", "four")]
BASE = " ".join(f"w{k}" for k in range(60))
TEXTS = [
    None, "", " ", "12 34", "That it.", BASE, BASE, BASE.replace("w30", "xx"), "\n".join(LINES), LINES[0] + "\n" + LINES[2],
    "mail a.b@c.de or 10.0.0.1, 4111 1111 1111 1111 +1 (212) 555-0100 300.1.1.1", "x" * 5000, "tab\tand  two   spaces \n\n end ",
    "Released under the MIT License.", "été à la mer\nnoël", "<|endoftext|> inside", LINES[1] + "s",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, 0, 0.5) for k, t in enumerate(TEXTS)]
    rows += [(None, BASE, None, None, None, None), rows[9]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def test_language(docs, empty):
    found = {r.doc_id: r._language for r in language_id.identify(docs).collect()}
    assert [found[k].lang_pred for k in (0, 1, 2, 3, 5)] == ["und"] * 4 + ["en"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.identify(empty).count() == 0


def test_code_lengths_are_exact():
    import pandas as pd

    data = b"abracadabra"
    rows = [(0, n, int.from_bytes(data[i : i + n], "big"), 1) for n in (1, 2) for i in range(len(data) - n + 1)]
    counts = pd.DataFrame(rows, columns=["lang", "size", "gram", "n"]).groupby(["lang", "size", "gram"]).n.sum().reset_index()
    trees = language_id.ContextTrees(["x"], 1, counts)

    def cost(before, byte):
        total = 0.0
        for context in ([before] if before is not None else []) + [None]:
            after = [b for a, b in zip(data, data[1:]) if a == context] if context is not None else list(data)
            if byte in after:
                return total + np.log2((len(after) + len(set(after))) / after.count(byte))
            total += np.log2((len(after) + len(set(after))) / len(set(after))) if after else 0
        return total + 8

    text = "bradxca"
    want = sum(cost(text.encode()[i - 1] if i else None, b) for i, b in enumerate(text.encode()))
    assert abs(trees.predict(text)[2] * len(text) - want) < 1e-3


def test_neighbours(spark):
    lots = np.random.default_rng(5)
    data = [(int(k), lots.normal(size=8).tolist()) for k in range(400)] + [(k, [1.0] * 8) for k in range(400, 440)]
    data += [(500, None), (600, [0.0] * 8), (700, [float("nan")] * 8), (800, [])]
    got = graph_search.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, shard_points=100).collect()
    hits = total = 0
    for q, v in data:
        if q % 100 == 0 and q < 500:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in data[:440] if i != q)[:10]
            own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
            hits, total = hits + len({i for _, i in near} & {i for _, i, _ in own}), total + 10
            if q == 400:
                assert [i for _, i, _ in own] == list(range(401, 411))
    assert hits / total >= 0.9 and {r.query_id for r in got} == {0, 100, 200, 300, 400}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def entities(text):
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, form in forms.items():
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}  # noqa: B023
            if good.get(kind, lambda: True)():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, docs, empty):
    lots = random.Random(3)
    parts = ["a", "1", "2", "@", ".", "-", " ", "+", "(", ")", "x_", "9", "45", "é", "\n", "😀", "00"]
    texts = ["".join(lots.choice(parts) for _ in range(50)) for _ in range(300)] + ["a@b.c_x@d.e", "1" * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.personal_data(rows)).collect():
        assert r.base_sha256 == hashlib.sha256(entities(texts[r.doc_id]).encode()).hexdigest()
    assert pii.digest(pii.personal_data(docs)).count() == len(TEXTS) + 2
    assert pii.digest(pii.personal_data(empty)).count() == 0


def test_context_discovers_identifiers(spark):
    seeded = [(k, f"please dial extension +1 212 555 01{k:02d} now") for k in range(40)]
    rows = spark.createDataFrame([*seeded, (99, "please dial extension 77-31 now")], "doc_id long, text string")
    found = {r.doc_id: r.found for r in pii.personal_data(rows).collect()}
    assert [(s.kind, s.start, s.end) for s in found[99]] == [(3, 22, 27)]


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for r in token_counts(docs, path, limit=512).where("doc_id is not null").collect():
        text = TEXTS[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(own.encode(text, add_special_tokens=False).ids), len(text.encode()))
    assert token_counts(empty, path).count() == 0


def test_bpe(docs, empty):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(), special_tokens={})
    for r in bpe.encode_decode(docs, path, pattern, with_ids=True).where("doc_id is not null").collect():
        text = TEXTS[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.encode_decode(empty, path, pattern).count() == 0


def test_licenses(docs, empty):
    found = {r.doc_id: r.licenses for r in licenses.license_scan(docs).collect()}
    assert found[13] == "mit" and not any(v for k, v in found.items() if k != 13)
    assert licenses.license_scan(empty).count() == 0


def test_mixing(docs, empty):
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.mix(sized).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.copies <= 3 for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets.values()) - sum(s for s, _ in targets.values())) < 1e-6
    assert rows and all(t <= 3 * s + 1e-9 for s, t in targets.values())
    assert mixing.mix(empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0


def test_lines(docs, empty):
    rows = {r.doc_id: r for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert rows[8].text == TEXTS[8] and rows[9].text == "" and rows[9].n_removed == 2
    assert rows[16].text == "" and rows[0].text is None and rows[4].text == "That it."
    assert rows[None].text == BASE and rows[5].text == ""  # null ids come first
    assert fuzzy_lines.dedup_lines(empty).count() == 0


def test_ngrams(docs, empty):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert rows[0] == (0, 0) and rows[3] == (1, 3) and rows[None] == (56, None)
    assert rows[5] == (56, 5) and rows[6] == (56, 5) and rows[7] == (56, 5)
    assert ngram_join.ngram_components(empty).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 100)]
    found = {r.node: r.root for r in links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in (100, 101, 102, 200)} == {100}


def test_fingerprints(docs, empty):
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in iblt.fingerprints(whole).collect()}
    texts = [t or "" for t in TEXTS]
    sets = lambda t: {p for p in t.split("\n") if p}
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert rows[k].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for got, other in ((rows[k].near_edited, changed), (rows[k].near_next, after)):
            a, b = sets(text), sets(other)
            assert abs(got - (1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-9
    assert rows[5].fingerprint == rows[6].fingerprint and iblt.fingerprints(empty).count() == 0


def test_large_differences_are_peeled(spark):
    rows = [(1, list(range(3000)), list(range(1000, 5000))), (2, [], [7]), (3, [], [])]
    found = iblt.differences(spark.createDataFrame(rows, "pair long, a array<long>, b array<long>")).collect()
    assert {r.pair: (r.n_left, r.n_right) for r in found} == {1: (1000, 2000), 2: (0, 1), 3: (0, 0)}


def test_pipeline(spark, docs, empty):
    import corpus_pipeline

    for rows in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert rows.columns == docs.columns
            rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == rows.count()
