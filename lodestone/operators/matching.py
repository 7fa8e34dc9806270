"""Scoring kernels: many queries against a partitioned corpus, keeping only the best k per query.

Scoring every chunk for every query is what the operators ask for; emitting every pair is not. The
corpus stays where Spark put it. Each task walks its Arrow batches, scores a batch against a block
of queries with one matrix product, and keeps k rows per query. Only those leave the task; the
final cut is a window in Spark.

Queries are handed to the tasks in slices of at most ``QUERY_SLICE`` rows. A larger query table is
worked off slice by slice, each a separate pass over the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.ranking import top_k
from lodestone.session import bounded_batches, small_enough

QUERY_SLICE = 20_000
QUERY_TILE = 512
TILE_WORDS = 20_000  # words of the queries scored together, which bounds the matrix of a tile
ROW_BLOCK = 128
BATCH_WORDS = 200_000  # words of the texts scored together, which bounds the arrays of a batch
DECIMALS = 9  # scores are compared after rounding, so equal texts tie and the id decides

RESULT = "query_id long, chunk_id long, score double"


def slices(queries: DataFrame) -> Iterator[DataFrame]:
    if small_enough(queries, QUERY_SLICE):
        yield queries
        return
    parts = -(-queries.count() // (QUERY_SLICE // 2))
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)


class Scope:
    """Per-query conditions, evaluated as a mask over (rows of a batch, queries of a tile).

    Query columns used when present: ``projects`` (list, empty or NULL for all), ``date_after`` and
    ``date_before``, ``phrases`` and ``excluded``, ``decision_status``. The corpus then carries
    ``project``, ``source_date``, ``content`` and ``statuses``.
    """

    NEEDS = {
        "projects": "project",
        "date_after": "source_date",
        "date_before": "source_date",
        "phrases": "content",
        "excluded": "content",
        "decision_status": "statuses",
    }

    def __init__(self, table: pa.Table):
        def column(name: str) -> list | None:
            if name not in table.column_names:
                return None
            values = table.column(name).to_pylist()
            return values if any(values) else None

        self.projects = column("projects")
        self.after = column("date_after")
        self.before = column("date_before")
        self.phrases = column("phrases")
        self.excluded = column("excluded")
        self.status = column("decision_status")

    def mask(self, batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
        keep = np.ones((batch.num_rows, hi - lo), dtype=bool)
        if self.projects:
            codes = batch.column("project").dictionary_encode()
            names = codes.dictionary.to_pylist()
            at = codes.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
            for q, scope in enumerate(self.projects[lo:hi]):
                if scope:
                    keep[:, q] &= np.array([n in scope for n in names] + [False])[at]
        for bounds, compare in ((self.after, pc.greater_equal), (self.before, pc.less_equal)):
            for q, bound in enumerate(bounds[lo:hi] if bounds else []):
                if bound is not None:
                    dates = batch.column("source_date")
                    hit = compare(dates, pa.scalar(bound, dates.type)).fill_null(False)
                    keep[:, q] &= hit.to_numpy(zero_copy_only=False)
        if self.phrases or self.excluded:
            low = pc.utf8_lower(batch.column("content"))
            for terms, wanted in ((self.phrases, True), (self.excluded, False)):
                for q, wishes in enumerate(terms[lo:hi] if terms else []):
                    for term in wishes or []:
                        hit = pc.match_substring(low, term.lower()).fill_null(False)
                        keep[:, q] &= hit.to_numpy(zero_copy_only=False) == wanted
        if self.status:
            have = batch.column("statuses").to_pylist()
            for q, status in enumerate(self.status[lo:hi]):
                if status:
                    keep[:, q] &= np.array([status in (s or []) for s in have])
        return keep


class Best:
    """The k lowest (score, id) per query seen so far in a task."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, first_query: int) -> None:
        """``scores`` is (rows, queries), lower is better, inf means not eligible."""
        if scores.shape[0] > self.k:
            # Everything up to the k-th value, ties included, so ids can break them exactly.
            limit = np.partition(scores, self.k - 1, axis=0)[self.k - 1]
            row, col = np.nonzero((scores <= limit) & np.isfinite(scores))
        else:
            row, col = np.nonzero(np.isfinite(scores))
        if not len(row):
            return
        self.parts.append((col + first_query, scores[row, col], ids[row]))
        self.held += len(row)
        if self.held > 4 * self.k * len(self.query_ids) + 100_000:
            self._trim()

    def _trim(self) -> None:
        query, score, chunk = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        order = np.lexsort((chunk, score, query))
        query, score, chunk = query[order], score[order], chunk[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.parts = [(query[keep], score[keep], chunk[keep])]
        self.held = int(keep.sum())

    def result(self, sign: float = 1.0) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._trim()
        query, score, chunk = self.parts[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.query_ids[query]), pa.array(chunk), pa.array(score * sign)],
            names=["query_id", "chunk_id", "score"],
        )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as unit rows; a row is NaN where its vector is missing, of other width or zero."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(0))
    out = np.full((len(column), width), np.nan)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    fits = sizes == width
    if fits.all():
        out[:] = flat.reshape(-1, width)
    else:
        out[fits] = flat[np.repeat(fits, sizes)].reshape(-1, width)
    norm = np.sqrt((out * out).sum(axis=1))
    norm[norm == 0] = np.nan
    return out / norm[:, None]


def pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of up to ``limit`` in size together, at least one row each."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def cut(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to ``limit`` words or bytes in a column of lists or strings."""
    for batch in batches:
        values = batch.column(column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = np.asarray(measure(values).fill_null(0)).astype(np.int64)
        for lo, hi in pieces(sizes, limit):
            yield batch.slice(lo, hi - lo)


def _scan(corpus: DataFrame, kernel: Callable, k: int, order: Column, parts: list[DataFrame]):
    bounded_batches(corpus.sparkSession)
    found = corpus.mapInArrow(kernel, RESULT)
    parts.append(top_k(found, ["query_id"], [order, F.col("chunk_id").asc()], k))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def nearest(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine distance of every query to every eligible chunk, best k per query.

    ``corpus`` has chunk_id and embedding, ``queries`` has query_id and embedding; both carry the
    columns of ``Scope`` in use. Result: query_id, chunk_id, distance, rank.
    """
    spark = corpus.sparkSession
    parts: list[DataFrame] = []
    for part in slices(queries):
        table = part.toArrow()
        scope = Scope(table)
        ids = table.column("query_id").to_numpy()
        vectors = table.column("embedding").combine_chunks()
        width = pc.max(pc.list_value_length(vectors)).as_py() or 0
        shared = spark.sparkContext.broadcast((ids, _matrix(vectors, width), scope))

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared, width=width):
            query_ids, wanted, limits = shared.value
            best = Best(query_ids, k)
            for batch in batches:
                ids = batch.column("chunk_id").to_numpy()
                units = _matrix(batch.column("embedding"), width)
                for lo in range(0, len(query_ids), QUERY_TILE):
                    hi = min(lo + QUERY_TILE, len(query_ids))
                    far = np.round(1.0 - units @ wanted[lo:hi].T, DECIMALS)
                    ok = limits.mask(batch, lo, hi) & ~np.isnan(far)
                    best.offer(np.where(ok, far, np.inf), ids, lo)
            yield from best.result()

        needed = {c for q, c in Scope.NEEDS.items() if q in part.columns}
        columns = ["chunk_id", "embedding", *[c for c in corpus.columns if c in needed]]
        _scan(corpus.select(*columns), kernel, k, F.col("score").asc(), parts)
    return _union(parts).withColumnRenamed("score", "distance")


def term_statistics(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Document frequency per term, from rows of (chunk_id, tokens).

    The row with an empty term holds the number of chunks and the sum of their lengths, so corpus
    totals and frequencies come out of one scan. Counting is combined map-side; a vocabulary of
    checked size is applied before the shuffle, a larger one after it.
    """
    # A chunk without text has no terms, but counts as a chunk.
    marks = F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")))
    # The outer form keeps Catalyst from tokenising twice to test for an empty array.
    seen = docs.select(F.size("tokens").alias("length"), F.explode_outer(marks).alias("term"))
    counted = [
        F.count("*").alias("df"),
        F.sum(F.when(F.col("term") == "", F.col("length"))).alias("total_length"),
    ]
    if vocabulary is None:
        return seen.groupBy("term").agg(*counted)
    wanted = vocabulary.select("term").union(
        docs.sparkSession.range(1).select(F.lit("").alias("term"))
    )
    if small_enough(wanted):
        return seen.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(*counted)
    return seen.groupBy("term").agg(*counted).join(wanted, "term", "left_semi")


def inverse_frequency(n: Column, df: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5) + 1)."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _tiles(asks: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Consecutive queries of up to TILE_WORDS words and QUERY_TILE queries."""
    lo = words = 0
    for i, ask in enumerate(asks):
        if i > lo and (i - lo >= QUERY_TILE or words + len(ask) > TILE_WORDS):
            yield lo, i
            lo, words = i, 0
        words += len(ask)
    if asks:
        yield lo, len(asks)


def _wishes(tile: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a tile and how often each query names each of them."""
    everything = np.concatenate([*tile, np.empty(0, np.int64)])
    used, where = np.unique(everything, return_inverse=True)
    times = np.zeros((len(used), len(tile)))
    np.add.at(times, (where, np.repeat(np.arange(len(tile)), [len(a) for a in tile])), 1)
    return used, times


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 with corpus-wide statistics, best k per query among chunks sharing a term with it.

    ``corpus`` has chunk_id and content, ``queries`` has query_id and text. A term that occurs twice
    in a query counts twice. Result: query_id, chunk_id, score, rank.
    """
    spark = corpus.sparkSession
    docs = corpus.withColumn("tokens", tokens(F.col("content")))
    parts: list[DataFrame] = []
    for part in slices(queries):
        asked = part.select("query_id", F.explode_outer(tokens(F.col("text"))).alias("term"))
        stats = term_statistics(
            docs.select("chunk_id", "tokens"), asked.select("term").distinct()
        ).toArrow()
        known = dict(zip(stats.column("term").to_pylist(), stats.column("df").to_pylist(), strict=True))
        n = known.pop("", 0)
        total = pc.sum(stats.column("total_length")).as_py() or 0
        table = part.withColumn("terms", tokens(F.col("text"))).drop("text").toArrow()
        scope = Scope(table)
        vocab = {term: i for i, term in enumerate(sorted(known))}
        freq = np.array([known[t] for t in vocab], dtype=float)
        weight = np.log((n - freq + 0.5) / (freq + 0.5) + 1)
        asks = [
            np.array([vocab[t] for t in terms or [] if t in vocab], dtype=np.int64)
            for terms in table.column("terms").to_pylist()
        ]
        shared = spark.sparkContext.broadcast(
            (table.column("query_id").to_numpy(), list(vocab), weight, asks, scope)
        )
        mean = total / n if n else 1.0

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared, mean=mean):
            query_ids, terms, idf, asks, limits = shared.value
            best = Best(query_ids, k)
            names = pa.array(terms, pa.string())
            for batch in cut(batches, "tokens", BATCH_WORDS):
                words = batch.column("tokens")
                ids = batch.column("chunk_id").to_numpy()
                length = np.asarray(pc.list_value_length(words).fill_null(0)).astype(np.int64)
                at = pc.index_in(words.flatten(), names).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(length)), length)[at >= 0]
                pair, tf = np.unique(row * max(len(terms), 1) + at[at >= 0], return_counts=True)
                row, term = np.divmod(pair, max(len(terms), 1))
                damp = k1 * (1 - b + b * length / mean)
                part = idf[term] * tf * (k1 + 1) / (tf + damp[row])
                for lo, hi in _tiles(asks):
                    used, times = _wishes(asks[lo:hi])
                    place = np.full(len(terms), -1)
                    place[used] = np.arange(len(used))
                    hit = place[term] >= 0
                    rows, columns, values = row[hit], place[term[hit]], part[hit]
                    for start in range(0, len(length), ROW_BLOCK):
                        block = batch.slice(start, ROW_BLOCK)
                        a, z = np.searchsorted(rows, (start, start + block.num_rows))
                        dense = np.zeros((block.num_rows, len(used)))
                        dense[rows[a:z] - start, columns[a:z]] = values[a:z]
                        score = np.round(dense @ times, DECIMALS)
                        ok = limits.mask(block, lo, hi) & (score > 0)
                        best.offer(np.where(ok, -score, np.inf), ids[start : start + block.num_rows], lo)
            yield from best.result(-1.0)

        needed = {c for q, c in Scope.NEEDS.items() if q in part.columns}
        columns = ["chunk_id", "tokens", *[c for c in docs.columns if c in needed]]
        _scan(docs.select(*columns), kernel, k, F.col("score").desc(), parts)
    return _union(parts)
