"""Ranked lexical search over hashed max-sketches, with exact results.

Every term of a document is hashed to one of 65 536 coordinates (2**24 in documents of many terms), which keeps the
greatest term frequency there; only the coordinates in use are stored. For a fixed document the impact of a term grows
with its frequency, so the sketch holds the coordinatewise maxima of impacts whatever the statistics of the corpus turn
out to be. Looking up the terms of a query gives an upper bound of its score; a batch of documents looks up all queries
of a block at once.

The documents of highest bound are scored exactly first, which gives each query a threshold: the score of its last
place so far. Then every document is scored whose bound reaches the threshold of some query, within a task in the order
of falling bounds while these reach the last place found there. No other document can be among the results.

Scores are sums of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` over the terms of a query, repeats included, with
``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m = 25 + (75 * n * N) div L``.

Defined results: null and empty texts have no terms and are not counted; a query without terms, or whose terms no
document holds, has no rows; repeated documents are results of their own; equal scores go to the smaller doc_id, nulls
last, and equal rows in any order get ranks of their own; queries repeated with the same id and text are one; an empty
table gives no rows. Texts are read whole, in stretches of bounded size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_checked, stored

TOP = 10
#: Documents of highest bound that are scored first for each query.
PROBES = 16
#: Queries, and bytes of their texts, of a block that is broadcast.
BLOCK_QUERIES = 512
BLOCK_BYTES = 1 << 20
#: Widths of sketches, different terms from which on the greater one is taken, and the frequency that stands for any higher.
WIDTHS = (1 << 16, 1 << 24)
WIDE_FROM = 2048
MANY = 255
#: Bytes of a text that are split at a time, and coordinates of sketches looked up at a time.
STEP = 4 << 20
CELLS = 1 << 20

#: Only A to Z are lowered; all other ASCII characters but letters and digits end a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def split_terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text, as UTF-8, in lists of bounded size."""
    data = (text or "").encode().translate(_TERMS)
    at = 0
    while len(data) - at > STEP:
        cut = data.find(b" ", at + STEP)
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut + 1
    yield data[at:].split()


def sketch(counts: Counter) -> tuple[bytes, bytes]:
    """Coordinates in use, as 32-bit integers, and the greatest frequency (up to MANY) at each."""
    width = WIDTHS[len(counts) >= WIDE_FROM]
    places = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) & (width - 1)
    used, at = np.unique(places, return_inverse=True)
    peaks = np.zeros(len(used), np.int64)
    np.maximum.at(peaks, at, np.fromiter(counts.values(), np.int64, len(counts)))
    return used.astype("<u4").tobytes(), np.minimum(peaks, MANY).astype(np.uint8).tobytes()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m, 1)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n, wide, places, peaks) of the documents with terms; ``tie`` is a hash of the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                counts: Counter = Counter()
                for terms in split_terms(text.as_py()):
                    counts.update(terms)
                rows.append((counts.total(), len(counts) >= WIDE_FROM, *sketch(counts)))
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), *columns], names=["doc_id", "tie", "n", "wide", "places", "peaks"]
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    made = docs.mapInArrow(make, f"doc_id {key}, tie long, n long, wide boolean, places binary, peaks binary")
    return made.where("n > 0")


class Lookup:
    """Weights of the queries by key (a term's number, or a coordinate): per key a stretch of (query, weight)."""

    def __init__(self, keys: np.ndarray, queries: np.ndarray, weights: np.ndarray, many: int):
        order = np.argsort(keys, kind="stable")
        self.queries, self.weights, self.many = queries[order], weights[order], many
        self.keys, self.starts, self.counts = np.unique(keys[order], return_index=True, return_counts=True)

    def sums(self, rows: np.ndarray, keys: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
        """For ``count`` rows the sum per query of value times weight; whole numbers below 2**53 stay exact."""
        if not len(self.keys):
            return np.zeros((count, self.many))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        rows, at, values = rows[hit], at[hit], values[hit]
        each = self.counts[at]
        ends = np.cumsum(each)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + each, each)
        cells = np.repeat(rows, each) * self.many + self.queries[places]
        found = np.bincount(cells, np.repeat(values, each) * self.weights[places], count * self.many)
        return found.reshape(count, self.many)


class Queries:
    """A block of queries: weights by term and, per width of a sketch, by coordinate."""

    def __init__(self, ids: list, counts: list[Counter]):
        self.ids, self.counts = ids, counts
        self.terms = {t: k for k, t in enumerate(sorted(set().union(*counts)))}

    def weigh(self, documents: int, total: int, holding: dict[int, int]) -> Queries:
        self.documents, self.total = documents, total
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(k, 0) + 1))) for k in range(len(self.terms))]
        cells = [(self.terms[t], q, n * weight[self.terms[t]]) for q, counts in enumerate(self.counts) for t, n in counts.items()]
        keys, queries, weights = (np.array(c, np.int64) for c in zip(*cells))
        hashes = np.array([zlib.crc32(t) for t in self.terms], np.int64)
        self.by_term = Lookup(keys, queries, weights, len(self.ids))
        self.by_place = [Lookup(hashes[keys] & (w - 1), queries, weights, len(self.ids)) for w in WIDTHS]
        del self.counts
        return self

    def share(self, n: int) -> int:
        return 25 + 75 * n * self.documents // self.total

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        """Upper bound per document and query."""
        places, peaks = batch.column("places").to_pylist(), batch.column("peaks").to_pylist()
        m = np.array([self.share(n) for n in batch.column("n").to_pylist()], np.int64)
        wide = np.array(batch.column("wide").to_pylist(), bool)
        sizes = np.array([len(p) for p in peaks], np.int64)
        out = np.empty((len(sizes), len(self.ids)))
        for kind, lookup in enumerate(self.by_place):
            rows = np.flatnonzero(wide == kind)
            lots = np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // CELLS, prepend=0)) + 1
            for part in np.split(rows, lots):
                tf = np.frombuffer(b"".join(peaks[r] for r in part), np.uint8).astype(np.int64)
                keys = np.frombuffer(b"".join(places[r] for r in part), "<u4").astype(np.int64)
                most = np.where(tf == MANY, 1_000_000, impact(tf, np.repeat(m[part], sizes[part])))
                out[part] = lookup.sums(np.repeat(np.arange(len(part)), sizes[part]), keys, most, len(part))
        return out

    def scores(self, text: str | None) -> np.ndarray:
        """Exact scores of a text for all queries."""
        found: Counter = Counter()
        n = 0
        for terms in split_terms(text):
            n += len(terms)
            found.update(filter(self.terms.__contains__, terms))
        keys = np.array([self.terms[t] for t in found], np.int64)
        parts = impact(np.fromiter(found.values(), np.int64, len(found)), np.int64(self.share(n)))
        return self.by_term.sums(np.zeros(len(keys), np.int64), keys, parts, 1)[0].astype(np.int64)


def holding(docs: DataFrame, terms: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each of the ``terms``, counted per task and summed."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                own: set[bytes] = set()
                for part in split_terms(text.as_py()):
                    own.update(part)
                total.update(own & shared.value.keys())
        found = [pa.array([shared.value[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(found, names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return {r.term: r.n for r in rows}


def _probes(sketches: DataFrame, shared, probes: int) -> DataFrame:
    """(doc_id, tie) of the documents of highest bound for each query; each task reports as many."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        many = len(queries.ids)
        best, keys = np.zeros((0, many)), pa.table({"doc_id": pa.array([], pa.int64()), "tie": pa.array([], pa.int64())})
        places = np.zeros((0, many), np.int64)  # rows of keys
        for batch in batches:
            own = pa.Table.from_batches([batch]).select(["doc_id", "tie"])
            both = np.concatenate([best, queries.bounds(batch)])
            fresh = np.broadcast_to(np.arange(len(own))[:, None] + len(keys), (len(own), many))
            names = np.concatenate([places, fresh])
            if len(both) > probes:
                top = np.argpartition(-both, probes - 1, axis=0)[:probes]
                both, names = np.take_along_axis(both, top, 0), np.take_along_axis(names, top, 0)
            used, places = np.unique(names, return_inverse=True)
            best, places = both, places.reshape(both.shape)
            keys = pa.concat_tables([keys.cast(own.schema), own]).take(pa.array(used))
        rows, columns = np.nonzero(best > 0)
        found = keys.take(pa.array(places[rows, columns]))
        arrays = [pa.array(columns, pa.int32()), pa.array(best[rows, columns], pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [*arrays, *(c.combine_chunks() for c in found.columns)], names=["query", "bound", "doc_id", "tie"]
        )

    key = sketches.schema["doc_id"].dataType.simpleString()
    found = sketches.mapInArrow(highest, f"query int, bound double, doc_id {key}, tie long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "doc_id", "tie")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= probes)
    return found.select("doc_id", "tie").distinct()


def _reaching(sketches: DataFrame, shared, thresholds) -> DataFrame:
    """(doc_id, tie, bounds) of the documents whose bound reaches the threshold of some query."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = shared.value.bounds(batch) >= thresholds.value
            yield batch.filter(pa.array(over.any(axis=1))).select(["doc_id", "tie"])

    key = sketches.schema["doc_id"].dataType.simpleString()
    return sketches.mapInArrow(reach, f"doc_id {key}, tie long").distinct()


def _scored(docs: DataFrame, wanted: DataFrame, shared, thresholds, top: int) -> DataFrame:
    """(query, doc_id, tie, score) of the ``wanted`` documents, scores from 1 and from the threshold on; of each batch
    the best ``top`` of a query."""
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    chosen = docs.join(wanted, same, "left_semi")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value, 1 if thresholds is None else thresholds.value
        for batch in batches:
            scores = np.array([queries.scores(text.as_py()) for text in batch.column("text")]).reshape(-1, len(queries.ids))
            rows, columns = np.nonzero(scores >= least)
            values = scores[rows, columns]
            ids = batch.column("doc_id").to_pylist()
            by_id = np.argsort(np.array([math.inf if i is None else i for i in ids]), kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            order = np.lexsort((rank[rows], -values, columns))
            rows, columns, values = rows[order], columns[order], values[order]
            starts = np.flatnonzero(np.diff(columns, prepend=-1))
            place = np.arange(len(columns)) - np.repeat(starts, np.diff(np.append(starts, len(columns))))
            keep = place < top
            own = batch.select(["doc_id", "tie"]).take(pa.array(rows[keep]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[keep], pa.int32()), own.column(0), own.column(1), pa.array(values[keep], pa.int64())],
                names=["query", "doc_id", "tie", "score"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(score, f"query int, doc_id {key}, tie long, score long")


def _best(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tie")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _blocks(items: DataFrame) -> Iterator[Queries]:
    """The queries in blocks of bounded size, each with at least one term."""
    items = items.select("item_id", "text").where("text is not null").distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-2 * count // BLOCK_QUERIES) if count > BLOCK_QUERIES else 1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = items.where(block == k).orderBy("item_id", "text").collect()
        counts = [Counter(t for part in split_terms(r.text) for t in part) for r in rows]
        if any(counts):
            yield Queries(*zip(*((r.item_id, c) for r, c in zip(rows, counts) if c)))


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, probes: int = PROBES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs`` (doc_id, text) for each of ``items``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    key, item_key = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id")))
    nothing = spark.createDataFrame([], f"item_id {item_key}, rank int, doc_id {key}, score long")
    sketches = stored(sketched(docs), "sketches")
    documents, total = sketches.agg(F.count("*"), F.sum("n")).first()
    results = []
    for queries in _blocks(items) if documents else ():
        ids = queries.ids
        shared = spark.sparkContext.broadcast(queries.weigh(documents, total, holding(docs, queries.terms)))
        first = broadcast_checked(_probes(sketches, shared, max(top, probes)))
        lowest = _best(_scored(docs, first, shared, None, top), top).where(F.col("rank") == top)
        thresholds = np.ones(len(ids), np.int64)
        for r in lowest.select("query", "score").collect():
            thresholds[r.query] = r.score
        least = spark.sparkContext.broadcast(thresholds)
        wanted = stored(_reaching(sketches, shared, least), "reaching")
        best = _best(_scored(docs, broadcast_checked(wanted), shared, least, top), top)
        names = spark.createDataFrame(list(enumerate(ids)), f"query int, item_id {item_key}")
        found = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        results.append(stored(found, "ranked"))
        shared.destroy()
        least.destroy()
    return reduce(DataFrame.unionByName, results, nothing)
