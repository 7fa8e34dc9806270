"""A stored inverted index for BM25: built in one pass over the corpus, searched without reading a text again.

The index is one Parquet table, laid out by term. Chunks stay in blocks of up to ``BLOCK`` rows as they were read; a row
holds what one block has of one term: places, ids, counts and lengths of its chunks. Beside them stands the front: the
(count, length) pairs that no other chunk of the row beats on both. The largest share of the term in a score is one of
them for any k1, b and mean length, so a sum over the fronts bounds every score of the block.

A search reads the counts of its terms, then the fronts, and scores the most promising blocks of each query. Their k-th
score is a floor; blocks whose bound stays below it are skipped, all others are scored in full. No row is lost, as a
skipped block cannot hold a better chunk. Texts added later form a batch of their own; statistics are summed at search
time, so they need no rewriting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import matching
from lodestone.operators.ranking import top_k
from lodestone.session import small_enough, stored

BLOCK = 256
BUCKETS = 64
PROBES = 4  # blocks of a query that are scored for its floor
MAX_BATCH = 1 << 15
SLACK = 1e-6  # sums in another order differ in the last digits, and scores are rounded

ROWS = (
    "term string, block long, n long, words long, front_tf array<int>, front_length array<int>, "
    "slots array<int>, ids array<long>, tfs array<int>, lengths array<int>"
)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``block`` rows, the last one of the rest, whatever the borders of those given."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            held.append(batch.slice(start, block - rows))
            start, rows = start + held[-1].num_rows, rows + held[-1].num_rows
            if rows == block:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def _block_rows(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """One row per term of a block, and one of the empty term that lists all its chunks."""
    rows = batch.num_rows
    words = batch.column("tokens")
    length = np.asarray(pc.list_value_length(words).fill_null(0)).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, tf = np.unique(codes * rows + np.repeat(np.arange(rows), length), return_counts=True)
    names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])])
    term, slot = np.divmod(pair, rows)
    term = np.concatenate([term, np.full(rows, len(names) - 1)])
    slot = np.concatenate([slot, np.arange(rows)])
    tf = np.concatenate([tf, np.zeros(rows, np.int64)])
    order = np.lexsort((slot, length[slot], -tf, term))
    term, slot, tf = term[order], slot[order], tf[order]
    # Falling counts: a pair is in the front if it is shorter than all before it. The shift starts anew for each term.
    shifted = length[slot] - term * (length.max() + 1)
    front = np.ones(len(term), bool)
    front[1:] = shifted[1:] < np.minimum.accumulate(shifted)[:-1]
    offsets = np.searchsorted(term, np.arange(len(names) + 1))
    front_offsets = np.concatenate([[0], np.cumsum(front)])[offsets]
    places = pa.array(offsets, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            names,
            pa.array(np.full(len(names), block)),
            pa.array(np.diff(offsets)),
            pa.array(np.add.reduceat(length[slot], offsets[:-1])),
            _lists(tf[front], front_offsets),
            _lists(length[slot][front], front_offsets),
            _lists(slot, offsets),
            pa.ListArray.from_arrays(places, batch.column("chunk_id").take(pa.array(slot))),
            _lists(tf, offsets),
            _lists(length[slot], offsets),
        ],
        names=["term", "block", "n", "words", "front_tf", "front_length", "slots", "ids", "tfs", "lengths"],
    )


def _share(tf, length, mean: float, k1: float, b: float):
    """What one term adds to a score, but for its inverse frequency; columns or arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


class _Asked:
    """Queries of a slice as word numbers, with the statistics of their words."""

    def __init__(self, table: pa.Table, stats: pa.Table):
        known = dict(zip(stats.column("term").to_pylist(), stats.column("df").to_pylist(), strict=True))
        self.n = known.pop("", 0)
        words = pc.sum(stats.filter(pc.equal(stats.column("term"), "")).column("words")).as_py() or 0
        self.mean = words / self.n if self.n and words else 1.0
        names = sorted(known)
        place = {t: i for i, t in enumerate(names)}
        df = np.array([known[t] for t in names], dtype=float)
        self.names = pa.array(names, pa.string())
        self.weight = np.log((self.n - df + 0.5) / (df + 0.5) + 1)
        self.ids = table.column("query_id").to_numpy()
        self.words = [
            np.array([place[t] for t in terms or [] if t in place], dtype=np.int64)
            for terms in table.column("terms").to_pylist()
        ]
        self.flat = np.concatenate([*self.words, np.empty(0, np.int64)])
        self.owner = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])


def _bound_kernel(shared):
    """(term, block, share) of one block to the bound of each query that has a term there."""

    def kernel(rows: pa.Table) -> pa.Table:
        asked: _Asked = shared.value
        most = np.zeros(len(asked.names))
        at = pc.index_in(rows.column("term"), asked.names).to_numpy()
        most[at] = rows.column("share").to_numpy() * asked.weight[at]
        bound = np.bincount(asked.owner, most[asked.flat], minlength=len(asked.ids))
        hit = np.flatnonzero(bound > 0)
        block = np.full(len(hit), rows.column("block")[0].as_py())
        return pa.table({"query_id": pa.array(asked.ids[hit]), "block": pa.array(block), "bound": pa.array(bound[hit])})

    return kernel


def _score_kernel(shared, k: int, k1: float, b: float):
    """Postings of a block and the queries to score there; the k best of each query."""

    def kernel(rows: pa.Table, queries: pa.Table) -> pa.Table:
        asked: _Asked = shared.value
        schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = rows.combine_chunks()
        slots, ids, tfs, lengths = (
            rows.column(c).combine_chunks().flatten().to_numpy() for c in ("slots", "ids", "tfs", "lengths")
        )
        sizes = np.asarray(pc.list_value_length(rows.column("slots").combine_chunks()))
        term = np.repeat(pc.index_in(rows.column("term"), asked.names).to_numpy(), sizes)
        part = asked.weight[term] * _share(tfs, lengths, asked.mean, k1, b)
        chunks = np.zeros(int(slots.max()) + 1, np.int64)
        chunks[slots] = ids
        # a query id may stand in several rows of the query table
        wanted = np.flatnonzero(np.isin(asked.ids, queries.column("query_id").to_numpy()))
        best = matching.Best(asked.ids, k)
        words = [asked.words[q] for q in wanted]
        for lo, hi in matching._tiles(words):
            used, times = matching._wishes(words[lo:hi])
            place = np.full(len(asked.names), -1)
            place[used] = np.arange(len(used))
            hit = place[term] >= 0
            dense = np.zeros((len(chunks), len(used)))
            dense[slots[hit], place[term[hit]]] = part[hit]
            score = np.round(dense @ times, matching.DECIMALS)
            for i, q in enumerate(wanted[lo:hi]):
                best.offer(np.where(score[:, i : i + 1] > 0, -score[:, i : i + 1], np.inf), chunks, q)
        found = list(best.result(-1.0))
        return pa.Table.from_batches(found).cast(schema) if found else schema.empty_table()

    return kernel


class PostingsIndex:
    """The index below ``path``, a folder that all executors share.

    ``add`` takes chunk_id (long) and content; a null or empty text has no terms but counts as a chunk. Input that is not
    a stored table should be deterministic, as with any table that is written.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def add(self, chunks: DataFrame, batch: int = 0, block: int = BLOCK) -> PostingsIndex:
        """Index the chunks of a batch; a batch written again replaces what it held."""
        if not 0 <= batch < MAX_BATCH:
            raise ValueError(f"batch must be from 0 to {MAX_BATCH - 1}")

        def kernel(batches: Iterator[pa.RecordBatch]):
            number = (batch << 48) | (TaskContext.get().partitionId() << 24)
            for rows in _blocks(batches, block):
                yield _block_rows(rows, number)
                number += 1

        words = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), tokens(F.col("content")).alias("tokens"))
        rows = words.mapInArrow(kernel, ROWS).withColumn("bucket", self._bucket())
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        return self

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{ROWS}, batch int, bucket int").parquet(self.path)

    def _of(self, vocabulary: DataFrame) -> DataFrame:
        """Index rows of some terms: only their buckets are read, at most as many as there are."""
        buckets = [r[0] for r in vocabulary.select(self._bucket()).distinct().collect()]
        rows = self.rows().where(F.col("bucket").isin(buckets))
        side = F.broadcast(vocabulary) if small_enough(vocabulary) else vocabulary
        return rows.join(side, "term", "left_semi")

    def idf(self) -> DataFrame:
        """term, df, idf over all chunks, from the counts alone."""
        counts = self.rows().groupBy("term").agg(F.sum("n").alias("df"))
        n = counts.where("term = ''").select("df").scalar()
        return counts.where("term <> ''").select("term", "df", matching.inverse_frequency(n, F.col("df")).alias("idf"))

    def _plans(self, queries: DataFrame, k: int, k1: float, b: float, probes: int):
        """For each slice of queries: result and bounds with the floor of their query."""
        for part in matching.slices(queries):
            asks = part.select("query_id", tokens(F.col("text")).alias("terms"))
            blank = self.spark.range(1).select(F.lit("").alias("term"))
            vocabulary = asks.select(F.explode("terms").alias("term")).union(blank).distinct()
            rows = self._of(vocabulary)
            stats = rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum("words").alias("words")).toArrow()
            asked = _Asked(asks.toArrow(), stats)
            shared = self.spark.sparkContext.broadcast(asked)
            rows = rows.where("term <> ''")
            most = F.array_max(
                F.zip_with("front_tf", "front_length", lambda tf, length: _share(tf, length, asked.mean, k1, b))
            )
            at_most = (
                rows.select("term", "block", most.alias("share"))
                .groupBy("block")
                .applyInArrow(_bound_kernel(shared), "query_id long, block long, bound double")
            )
            # read four times below
            bounds = stored(at_most, "bounds")

            def scored(pairs: DataFrame, rows=rows, shared=shared) -> DataFrame:
                held = rows.select("block", "term", "slots", "ids", "tfs", "lengths")
                held = held.join(pairs.select("block").distinct(), "block", "left_semi")
                sides = held.groupBy("block").cogroup(pairs.select("block", "query_id").groupBy("block"))
                found = sides.applyInArrow(_score_kernel(shared, k, k1, b), matching.RESULT)
                return top_k(found, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], k)

            first = top_k(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], probes, "_place")
            floors = scored(first).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
            # one row per query of the slice at most
            judged = bounds.join(F.broadcast(floors), "query_id", "left")
            judged = judged.withColumn("kept", F.col("floor").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("floor")))
            yield scored(judged.where("kept")), judged

    def search(
        self, queries: DataFrame, *, k: int = 10, k1: float = 1.2, b: float = 0.75, probes: int = PROBES
    ) -> DataFrame:
        """query_id, chunk_id, score, rank: the rows ``bm25_corpus`` gives. ``queries`` has query_id and text.

        A chunk must share a term with the query. A term named twice counts twice; equal scores go by chunk_id.
        """
        parts = [found.select("query_id", "chunk_id", "score", "rank") for found, _ in self._plans(queries, k, k1, b, probes)]
        return matching._union(parts)

    def skipped(
        self, queries: DataFrame, *, k: int = 10, k1: float = 1.2, b: float = 0.75, probes: int = PROBES
    ) -> DataFrame:
        """query_id, blocks (with a term of the query), scored: how much of the index a search left out."""
        parts = [judged for _, judged in self._plans(queries, k, k1, b, probes)]
        return matching._union(parts).groupBy("query_id").agg(
            F.count("*").alias("blocks"), F.count_if("kept").alias("scored")
        )
