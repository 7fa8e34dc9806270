"""Exact Jaccard join of word n-gram sets: rare-first prefixes, length, positional and suffix filters, one check per pair.

A set's n-grams are ordered by frequency, rare first. Two sets of similarity t share an n-gram among the first
n - ceil(t n) + 1 of each, so only these prefixes are joined. A shared n-gram links nothing if the sizes differ too
much (length filter), if too few n-grams can follow or precede it (positional filter), or if the parities of the
counts in 512 hash classes differ in more classes than the sets may differ in elements (suffix filter: a
lower bound of the Hamming distance from a partition of the elements). What remains is verified on the full sets.

Frequencies come from all documents: each task counts hash classes in a table of fixed size, and the tables are added
up. They only order the n-grams, so counts of whole classes give exact results too. Sets of equal content
are joined as one node. The result is components, so pairs within a known component are not compared
(see ``links``).

Defined results: words end at ASCII white space; A-Z are lower-cased; with fewer words than ``n`` the whole sequence
is one n-gram; a null text or one without words has an empty set and links with nothing; rows of one doc_id are one
node; a null doc_id has no component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored
from lodestone.llm.links import alike, compared, ends, first_common, linked_components, only, shortest_overlap

WORDS = 5
#: Similarity in hundredths.
SIMILARITY = 80
#: Hash classes of the frequency table, and of the suffix filter (times 64).
CLASSES = 1 << 22
SKETCH = 8
#: Classes whose counts are one row.
SLICE = 1 << 12
#: Bytes hashed at a time.
STEP = 1 << 18

_random = np.random.default_rng(20240131)
_ODD = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        base = int(_ODD[0])
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            factors = np.full(2 * STEP + 1, b, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word of the text: a polynomial over its bytes from prefix sums, worked out in stretches."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    up, down = _powers()
    out, at = [], 0
    while at < len(data):
        end = min(at + STEP, len(data))
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # one word fills the stretch: hash it whole
                later = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(later[0]) if len(later) else len(data)
        part = data[at:end]
        if len(part) > 2 * STEP:
            digest = hashlib.blake2b(part.tobytes().lower(), digest_size=8).digest()
            out.append(np.frombuffer(digest, np.uint64))
        else:
            inside = np.concatenate([[False], ~_SPACE[part], [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[::2], edges[1::2]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)])
            out.append(mixed((sums[ends] - sums[starts]) * down[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the text's word n-grams."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    many = max(len(words) - n + 1, 1) if len(words) else 0
    width = min(n, len(words))
    sums = np.full(many, width, np.uint64)
    for k in range(width):
        sums += words[k : k + many] * _ODD[1 + k]
    return np.unique(mixed(sums)) if many else sums


def class_counts(texts: DataFrame, grams, classes: int = CLASSES) -> np.ndarray:
    """Counts of hash classes of the ``grams`` of all ``texts`` (text), summed over all tasks.

    There are at most as many tasks as cores, so the tables that are added up do not grow with the texts. They travel
    in slices of SLICE classes.
    """

    def count(batches):
        table, waiting, size = np.zeros(classes, np.int64), [], 0
        for batch in batches:
            for text in batch.text:
                found = grams(text) & np.uint64(classes - 1)
                waiting.append(found.astype(np.int64))
                size += len(found)
                if size > classes // 2:
                    table += np.bincount(np.concatenate(waiting), minlength=classes)
                    waiting, size = [], 0
        if waiting:
            table += np.bincount(np.concatenate(waiting), minlength=classes)
        table = np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)
        for at in range(0, classes, SLICE):
            yield pd.DataFrame({"slice": [at], "counts": [table[at : at + SLICE].tobytes()]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for counts in part.counts:
            total += np.frombuffer(counts, np.int32)
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pd.DataFrame({"slice": [part["slice"].iloc[0]], "counts": [total.tobytes()]})

    cores = texts.sparkSession.sparkContext.defaultParallelism
    counted = texts.select("text").coalesce(cores).mapInPandas(count, "slice int, counts binary")
    table = np.zeros(classes, np.int32)
    for row in counted.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        table[row["slice"] : row["slice"] + SLICE] = np.frombuffer(row.counts, np.int32)
    return table


def rarest(found: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The rarest of the sorted hashes ``found``: so many that two similar sets have one in common."""
    if not len(found):
        return found
    order = np.argsort(count[(found & np.uint64(len(count) - 1)).astype(np.int64)], kind="stable")
    return found[order[: len(found) + percent * -len(found) // 100 + 1]]


def parities(found: np.ndarray) -> np.ndarray:
    """SKETCH words with a bit for each hash class: whether it holds an odd number of the hashes."""
    bits = np.bincount((found >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def _described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest, prefix, sketch) of every document."""
    frequency = docs.sparkSession.sparkContext.broadcast(class_counts(docs, lambda text: shingle_set(text, n)))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = frequency.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text):
                found = shingle_set(text, n)
                size = len(found)
                prefix = rarest(found, count, percent)
                sketch = parities(found)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if size else None
                rows.append((doc_id, size, digest, prefix.view(np.int64), sketch))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "prefix", "sketch"])

    schema = "doc_id long, n_shingles long, digest string, prefix array<long>, sketch array<long>"
    return stored(docs.mapInPandas(describe, schema), "shingles")


def ngram_components(docs: DataFrame, n: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text): the smallest doc_id reachable over links."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    described = _described(docs, n, percent)
    nodes = described.where("digest is not null and doc_id is not null")
    first = nodes.groupBy("digest").agg(F.min("doc_id").alias("node"))
    own = nodes.join(first, "digest").where("doc_id = node").select("node", "n_shingles", "prefix", "sketch")
    own = stored(own.dropDuplicates(["node", "n_shingles", "prefix"]), "nodes")
    placed = own.select("node", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("at", "bucket"))
    facts = own.select("node", F.col("n_shingles").alias("n"), "sketch")

    def verify(pairs: DataFrame) -> DataFrame:
        kept = stored(alike(pairs, facts, percent), "pairs")
        texts = docs.select(F.col("doc_id").alias("node"), "text")
        return compared(only(texts, ends(kept)), kept, lambda text: shingle_set(text, n), percent)

    most_before = "least(at_x, at_y) + 1 + least(n_x - at_x, n_y - at_y) - 1"
    least = shortest_overlap(percent, "n_x", "n_y")
    star = f"least(n_x, n_y) >= {least} and {most_before} >= {least}"
    linked = linked_components(placed, verify, ["n", "at"], star, first_common(percent))
    roots = first.join(linked, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    alone = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    by_row = described.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left")
    return by_row.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id")
    )
