"""Token counts by a two-tier lookup on the map side.

A text is cut before single spaces, where no pre-token of a byte-level vocabulary can be cut in two. Lengths of the
most frequent pieces come from a broadcast table of fixed size; other pieces are encoded by the tokenizer once per
worker cache. Pieces are never shuffled: only each task's most frequent ones, a bounded list, are summed up.

Defined results: null text counts as empty and has 0 tokens; repeated rows are counted each; an empty table gives no
rows; a text of any length is worked through in bounded pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces in the broadcast table, and pieces that each task reports for it.
TABLE_SIZE = 65_536
PER_TASK = 8_192
#: Entries of a worker's cache and of a task's counter, and characters worked on at a time.
CACHE_SIZE = 400_000
COUNTER_SIZE = 200_000
STEP = 1 << 20
#: Longer pieces are encoded without being kept.
LONGEST_KEPT = 64

_BOUNDARY = re.compile(r"\S(?= )")
_WORKER: dict = {}


def stretches(text: str, step: int = STEP) -> Iterator[str]:
    """The text in stretches of about ``step`` characters, each cut before a space that follows a non-space."""
    at = 0
    while len(text) - at > step:
        cut = _BOUNDARY.search(text, at + step)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def apart(first: str, pieces) -> bool:
    """Whether every piece stands alone: single spaces only, none next to other white space."""
    return not first[-1:].isspace() and not any(p == "" or p[0].isspace() or p[-1].isspace() for p in pieces)


def _tokenizer(content: str):
    """The worker's tokenizer for this file content, its special strings and its cache."""
    if _WORKER.get("content") != content:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(content)
        special = [t.content for t in made.get_added_tokens_decoder().values()]
        _WORKER.update(content=content, made=made, special=special, known={}, table=None)
    return _WORKER


def _length(made, text: str) -> int:
    return len(made.encode(text, add_special_tokens=False).ids)


def _count_stretch(state: dict, table: dict[str, int], text: str) -> int:
    first, *rest = text.split(" ")
    known = state["known"]
    found = list(map(known.get, rest))
    total = 0
    if None in found:
        missing = {p for p, n in zip(rest, found) if n is None}
        if not apart(first, missing):
            return _length(state["made"], text)
        if len(known) > len(table) + CACHE_SIZE:
            known.clear()
            known.update(table)
            missing.update(p for p in rest if p not in known)
        order = list(missing)
        encoded = state["made"].encode_batch([" " + p for p in order], add_special_tokens=False)
        lengths = dict(zip(order, (len(e.ids) for e in encoded)))
        total += sum(lengths[p] if n is None or p in lengths else n for p, n in zip(rest, found))
        known.update((p, n) for p, n in lengths.items() if len(p) <= LONGEST_KEPT)
    elif first[-1:].isspace():
        return _length(state["made"], text)
    else:
        total += sum(found)
    return total + (_length(state["made"], first) if first else 0)


def frequent_pieces(docs: DataFrame, size: int = TABLE_SIZE, per_task: int = PER_TASK) -> list[str]:
    """The most frequent pieces over all texts. Each task counts with bounded memory and reports ``per_task`` of them."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.text:
                if text is not None:
                    for part in stretches(text):
                        seen.update(part.split(" ")[1:])
                if len(seen) > COUNTER_SIZE:
                    seen = Counter(dict(seen.most_common(COUNTER_SIZE // 2)))
        top = [(p, n) for p, n in seen.most_common(per_task) if 0 < len(p) <= LONGEST_KEPT and p.strip() == p]
        yield pd.DataFrame(top, columns=["piece", "n"])

    counted = docs.select("text").mapInPandas(count, "piece string, n long")
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    return [r.piece for r in top.collect()]


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int | None = None, table_size: int = TABLE_SIZE
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens[, over_limit]) of ``docs`` (doc_id, text) under the tokenizer file."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    state = _tokenizer(content)
    pieces = [p for p in frequent_pieces(docs, table_size) if not any(s in p for s in state["special"])]
    lengths = [len(e.ids) for e in state["made"].encode_batch([" " + p for p in pieces], add_special_tokens=False)]
    shared = spark.sparkContext.broadcast((content, dict(zip(pieces, lengths))))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        content, lengths = shared.value
        state = _tokenizer(content)
        if state["table"] is None:
            state["table"], state["known"] = lengths, dict(lengths)
        table, special = state["table"], state["special"]
        for texts in batches:
            out = []
            for text in texts:
                if not text:
                    out.append(0)
                elif any(s in text for s in special):
                    out.append(_length(state["made"], text))
                else:
                    out.append(sum(_count_stretch(state, table, part) for part in stretches(text)))
            yield pd.Series(out, dtype="int64")

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select("doc_id", n_bytes, n_tokens("text").alias("n_tokens"))
    return counted if limit is None else counted.withColumn("over_limit", F.col("n_tokens") > limit)
