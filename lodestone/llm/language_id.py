"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ``order`` bytes with the counts of the bytes that follow. A byte
costs the logarithm of its share in the longest known context, and each step to a shorter context the logarithm of
that context's escape probability (as many escape counts as it has different followers); the last resort is one of
256 equal bytes. Counts are frozen after training, so a byte's code length depends on the bytes before it alone, and
a text's code length under a language is an exact sum. The language with the shortest code wins.

Training reads a sample of whole labelled texts bounded by ``train_bytes`` per language: documents are taken by a hash
of their id, at the rate that gives this many bytes. The tree's size is bounded by the sample, and with it the
broadcast. All other work covers all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if there is no
training row; ties go to the language first in order; repeated rows are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
TRAIN_BYTES = 3_000_000
#: Bytes that are worked on at a time.
STEP = 1 << 20
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORKER: dict = {}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _grams(data: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1 to order + 1, every position's last so many bytes as one number."""
    out = [data.astype(np.uint64)]
    for _ in range(order):
        last = out[-1]
        longer = last[1:].copy()
        longer |= out[0][: len(longer)] << np.uint64(8 * len(out))
        out.append(longer)
    return out


def _byte_windows(text: str, order: int, step: int = STEP) -> Iterator[tuple[np.ndarray, int]]:
    """The text's bytes in windows that overlap by ``order``, each with the number of bytes seen before."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    at = 0
    while at < len(data):
        overlap = min(order, at)
        yield data[at - overlap : at + step], overlap
        at += step


def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open addressing of different keys: slots of key + 1 (0: free), slots of row numbers, shift of the hash."""
    bits = max(4, int(len(keys) * 3).bit_length())
    slots, rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
    place = ((keys * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        free = todo[slots[place[todo]] == 0]
        slots[place[free]] = keys[free] + np.uint64(1)
        rows[place[free]] = free
        todo = todo[slots[place[todo]] != keys[todo] + np.uint64(1)]
        place[todo] = (place[todo] + 1) & ((1 << bits) - 1)
    return slots, rows, bits


def _find(table: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    """Row number of each key, -1 where it is absent."""
    slots, rows, bits = table
    place = ((keys * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    wanted = keys + np.uint64(1)
    held = slots[place]
    out = np.where(held == wanted, rows[place], -1)
    todo = np.flatnonzero((held != wanted) & (held != 0))
    while len(todo):
        place[todo] = (place[todo] + 1) & ((1 << bits) - 1)
        held = slots[place[todo]]
        hit = held == wanted[todo]
        out[todo[hit]] = rows[place[todo[hit]]]
        todo = todo[~hit & (held != 0)]
    return out


class ContextTrees:
    """Code lengths in bits, for every language at once, of counted byte strings.

    ``counts``: rows (language number, length, byte string as a number, count). For each length there is a table of
    the strings known in any language, with the code length of the last byte after the others, and one of the
    contexts, with the cost of an escape from them.
    """

    def __init__(self, languages: list[str], order: int, counts: pd.DataFrame):
        self.languages, self.order = languages, order
        self.costs, self.escapes = [], []
        many = len(languages)
        below_keys, below_cost = None, None
        for size in range(1, order + 2):
            own = counts[counts["size"] == size]
            lang = own["lang"].to_numpy(np.int64)
            gram = own["gram"].to_numpy(np.int64).astype(np.uint64)
            n = own["n"].to_numpy(np.float64)
            keys, row = np.unique(gram, return_inverse=True)
            context_keys, context_row = np.unique(gram >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context_keys), many)), np.zeros((len(context_keys), many))
            np.add.at(total, (context_row, lang), n)
            np.add.at(kinds, (context_row, lang), 1)
            seen = kinds > 0
            safe = np.where(seen, kinds, 1)
            escape = np.where(seen, np.log2(np.where(seen, total + kinds, 1) / safe), 0.0)
            parent = np.searchsorted(context_keys, keys >> np.uint64(8))
            if size == 1:
                shorter = np.full((len(keys), many), 8.0)
            else:
                suffix = keys & np.uint64((1 << (8 * (size - 1))) - 1)
                shorter = below_cost[np.searchsorted(below_keys, suffix)]
            cost = escape[parent] + shorter
            cost[row, lang] = np.log2((total + kinds)[context_row, lang] / n)
            below_keys, below_cost = keys, cost
            self.costs.append((_table(keys), cost.astype(np.float32)))
            self.escapes.append((_table(context_keys), escape.astype(np.float32)))

    def bits(self, data: np.ndarray, skip: int) -> np.ndarray:
        """Code length under each language of the bytes after the first ``skip``, which serve as context only."""
        total = np.zeros(len(self.languages))
        grams = _grams(data, min(self.order, len(data) - 1))
        for start in range(skip, min(self.order, len(data))):
            total += self._cost(start, grams[start][:1])
        if len(data) > self.order:
            total += self._cost(self.order, grams[self.order][max(0, skip - self.order) :])
        return total

    def _cost(self, order: int, grams: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages))
        while len(grams):
            table, cost = self.costs[order]
            found = _find(table, grams)
            total += cost[found[found >= 0]].sum(axis=0, dtype=np.float64)
            grams = grams[found < 0]
            table, escape = self.escapes[order]
            context = _find(table, grams >> np.uint64(8))
            total += escape[context[context >= 0]].sum(axis=0, dtype=np.float64)
            if order == 0:
                return total + 8.0 * len(grams)
            order -= 1
            grams = grams & np.uint64((1 << (8 * (order + 1))) - 1)
        return total

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, its posterior probability under equal priors, and its code length per byte."""
        total, size = np.zeros(len(self.languages)), 0
        for data, skip in _byte_windows(text, self.order):
            total += self.bits(data, skip)
            size += len(data) - skip
        best = int(total.argmin())
        odds = np.exp2(np.maximum(total[best] - total, -1000.0)).sum()
        return self.languages[best], float(1.0 / odds), float(total[best] / max(size, 1))


def train(
    labelled: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES
) -> ContextTrees | None:
    """Context trees from ``labelled`` (doc_id, text, lang); None if no row has both text and language."""
    labelled = labelled.select("doc_id", "text", "lang").where(
        "doc_id is not null and lang is not null and text <> ''"
    )
    sizes = {
        r.lang: r.size
        for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text").cast("double")).alias("size")).collect()
    }
    languages = sorted(sizes)
    if not languages:
        return None
    number = F.lit(None).cast("int")
    wanted = F.lit(False)
    draw = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for k, lang in enumerate(languages):
        number = F.when(F.col("lang") == lang, F.lit(k)).otherwise(number)
        rate = train_bytes / max(sizes[lang], 1.0)
        wanted = wanted | ((F.col("lang") == lang) & (draw < F.lit(rate) if rate < 1 else F.lit(True)))
    sample = labelled.where(wanted).select(number.alias("lang"), "text")

    def count(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                grams: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
                for text in texts:
                    for data, skip in _byte_windows(text, order):
                        for k, found in enumerate(_grams(data, min(order, len(data) - 1))):
                            grams[k].append(found[max(0, skip - k) :])
                for k, found in enumerate(grams):
                    if found:
                        gram, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "size": k + 1, "gram": gram.astype(np.int64), "n": n})

    counts = (
        sample.mapInPandas(count, "lang int, size int, gram long, n long")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # whatever the session's settings: a Python object per row takes ten times the memory
        .to_pandas()
    )
    return ContextTrees(languages, order, counts)


def language_of(spark, trees: ContextTrees | None, text: Column) -> Column:
    """Struct (lang_pred, score, bits_per_byte) of a text column."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    if trees is None:
        return nothing
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            rows = [own.predict(t) if t else (UNKNOWN, 0.0, 0.0) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "bits_per_byte"])

    return predict(F.when(has_letter(text), text).otherwise(F.lit("")))


def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the ids, kept from training. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``docs`` with a struct column ``_language``, in place of any other of that name; trained on the rows not held out."""
    trees = train(docs.where(~held_out(F.col("doc_id"))), order, train_bytes)
    return docs.withColumn("_language", language_of(docs.sparkSession, trees, F.col("text")))
