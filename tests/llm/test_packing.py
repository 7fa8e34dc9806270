"""Packing against the tokenizer library, on texts of every kind, and its windows against a plain search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n", "Don't STOP, he'll say: it's 12th!! ...", "été À LA MER\tnoël x y", "éa H̱ ̈x ΑΣ ΣΑΣ. İI",
    "a <|startoftext|> b<|endoftext|>c <|STARTOFTEXT|>", "x" * 5000, "word " * 3000, "日本語 テキスト 😀😀", "ÿ µ ª ß×÷", "a\r\nb\x0bc d\x85e",
]


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


def held(rows, window):
    """Checks places and returns (padding, ids by document row)."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize(("window", "buffer"), [(2048, packing.BUFFER), (64, 2000), (128, 0)])
def test_every_id_in_one_piece(spark, own, window, buffer):
    lots = random.Random(window)
    alphabet = ["ab", "Cd", "é", "́", "'s", "'", " ", " ", " ", "\n", "1", "23", ".", "!?", "-", "😀", "ß", "<|endoftext|>", "Σ"]
    texts = ODD + ["".join(lots.choice(alphabet) for _ in range(lots.randrange(300))) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, start long").repartition(3)
    rows = packing.pack_documents(docs, PATH, window, slack=4, buffer=buffer, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for k, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        got = sorted(pieces[k], key=lambda r: r.start)
        assert [i for r in got for i in r.ids] == ids and {r.doc_tokens for r in got} == {len(ids)}
        assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got[:-1]]))
    total = sum(r.length for r in rows)
    assert held(rows, window) <= 4 * total / (window - 4)
    again = packing.pack_documents(docs, PATH, window, slack=4, buffer=buffer).drop("ids").collect()
    assert sorted(map(str, again)) == sorted(str(r).split(", ids=")[0] + ")" for r in rows)


def test_stretches_of_long_texts(own):
    encoder = packing.WordEncoder(open(PATH, encoding="utf-8").read())
    lots = random.Random(1)
    for text in [" ".join(lots.choice(["ab", "it's", "x.", "́", "\n"]) for _ in range(5000)), "y" * 9000, *ODD[1:]]:
        ids = b"".join(encoder.encode(list(packing.stretches(text, 100))))
        assert list(np.frombuffer(ids, "<u4")) == own.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_and_found_again(own):
    encoder = packing.WordEncoder(open(PATH, encoding="utf-8").read())
    encoder.pieces, encoder.words = packing.Cache(3), packing.Cache(2)
    text = "One two, three. Four five six one two Three four; five, Six " * 3
    for texts in ([text], ["two Two three", "", "one"], [""]):
        for part, ids in zip(texts, encoder.encode(texts), strict=True):
            assert list(np.frombuffer(ids, "<u4")) == own.encode(part, add_special_tokens=False).ids


def test_tightest_window_is_found():
    lots = random.Random(2)
    for capacity in (1, 7, 64, 2048):
        sizes = [lots.randint(1, capacity) for _ in range(300)]
        windows, left = [], []
        for k in sorted(range(300), key=lambda k: -sizes[k]):
            fitting = [w for w in range(len(windows)) if left[w] >= sizes[k]]
            if fitting:
                w = min(fitting, key=lambda w: left[w])
            else:
                w = len(windows)
                windows.append([])
                left.append(capacity)
            windows[w].append(k)
            left[w] -= sizes[k]
        mine = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(k for w in mine for k in w) == list(range(300))
        assert sorted(sum(sizes[k] for k in w) for w in mine) == sorted(sum(sizes[k] for k in w) for w in windows)


def test_empty_table_and_nulls(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string").coalesce(1), PATH).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens) for r in rows] == [(None, 0, 1, 1)] * 2
    assert len({r.sequence_id for r in rows}) == 1 and {r.offset for r in rows} == {0, 1}
