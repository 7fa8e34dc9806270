"""Fuzzy line deduplication over all documents: MinHash of character shingles, banding, exact Jaccard, union-find.

A line's signature has one minimum per class of a hash of its character shingles. Classes that stay empty are filled
by further rounds with other hash functions, so short lines have signatures of full quality too. Lines that agree in
any band of the signature are candidates; those of a true shingle similarity of at least ``percent`` hundredths are
linked (see ``links``), and of each component of lines only the first occurrence is kept, by doc_id, then by place.
Lines of one frame share bands without being similar enough. Where a band still holds several components after the
first comparisons, its lines are compared only if they share one of their rarest shingles: of two lines similar
enough, the first fifth of each in a common rare-first order has one in common. Nor may sketches of their shingles
differ in more places than similar lines can. Neither loses a candidate link.
With 12 bands of 5, a pair of similarity 0.8 becomes a candidate with probability 0.99, one of 0.9 with 0.9999.

Lines are compared without white space at their ends and in lower case. All lines take part but blank ones. Lines
shorter than a shingle have no near copies, only exact ones: each class of equal lines is a component.

Defined results: a null text stays null; null doc_ids come first; rows equal in doc_id and text are one document and
keep the same lines; an empty table gives no rows; lines of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_checked, let, packed, stored
from lodestone.llm.links import BROADCAST_IDS, alike, compared, ends, first_common, linked_components, only
from lodestone.llm.ngram_join import class_counts, mixed, parities, rarest

SHINGLE = 8
PERCENT = 80
BANDS = 12
ROWS = 5
#: Lines a task remembers so as not to sign them twice.
REMEMBERED = 500_000
#: Rows of bands that a task packs at a time, and bytes of lines to a part of the bands.
PACKED = 1 << 19
PART = 4 << 20
PACKED_ROW = "part int, proven boolean, rows binary"
#: Rows of a bucket of rare shingles that are compared pair by pair in its part.
SMALL = 32
#: Bytes of places of removed lines that may be broadcast.
REMOVED_BYTES = 32 << 20
#: Characters signed at a time.
STEP = 1 << 16
#: Hash classes in which shingles of lines that share a band are counted, to know the rare ones.
CLASSES = 1 << 21

_random = np.random.default_rng(20240229)
_SEEDS = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = _SEEDS[:64] * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r\f\v\u00a0")))


def line_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of the lines, and the number of the line of each."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    h, width, k = points * _ODD[0], 1, 1
    while width < SHINGLE:  # doubles the width
        longer = h[:-width] * _ODD[k] + (h[width:] ^ (h[width:] >> np.uint64(31)))
        h, width, k = longer, 2 * width, k + 1
    owner = np.repeat(np.arange(len(lines)), lengths)
    starts = np.arange(len(h))
    inside = starts + SHINGLE <= np.cumsum(lengths)[owner[: len(h)]]
    return h[inside], owner[: len(h)][inside]


def line_set(line: str) -> np.ndarray:
    return np.unique(mixed(line_shingles([line])[0]))


def signatures(lines: list[str], size: int) -> np.ndarray:
    """One row of ``size`` minima per line; each line has at least one shingle."""
    hashes, owner = line_shingles(lines)
    out = np.full((len(lines), size), _FREE)
    flat = out.reshape(-1)
    still, open_lines = np.arange(len(lines)), np.empty(len(lines), bool)
    for seed in _SEEDS:
        h = mixed(hashes ^ seed)
        # the low half names the class, the high half decides the minimum
        place = owner * size + ((h & _LOW) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        if seed != _SEEDS[0]:  # only classes that are still empty
            free = flat[place] == _FREE
            place, h = place[free], h[free]
        np.minimum.at(flat, place, h)
        still = still[(out[still] == _FREE).any(axis=1)]
        if not len(still):
            break
        open_lines[:] = False
        open_lines[still] = True
        todo = open_lines[owner]
        hashes, owner = hashes[todo], owner[todo]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for row in range(rows):
        keys = mixed(keys * _ODD[2] + signature[:, row::rows][:, :bands])
    return mixed(keys + np.arange(bands, dtype=np.uint64) * _ODD[3]).view(np.int64)


def _groups(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Nodes and lines of a batch in groups of about STEP characters."""
    nodes, lines, size = [], [], 0
    for node, line in zip(batch.node, batch.line):
        nodes.append(node)
        lines.append(line)
        size += len(line)
        if size > STEP:
            yield np.array(nodes, np.int64), lines
            nodes, lines, size = [], [], 0
    if lines:
        yield np.array(nodes, np.int64), lines


def line_components(lines: DataFrame, size: float, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, root) of the ``lines`` (node, line) that are near copies of others with another text; ``size``: their bytes, roughly."""

    def sign(batches):
        seen: set[int] = set()
        for batch in batches:
            batch = batch.drop_duplicates("node")
            batch = batch[[n not in seen for n in batch.node]]
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(batch.node)
            for nodes, texts in _groups(batch):
                keys = band_keys(signatures(texts, bands * rows), bands, rows)
                yield keys.reshape(-1), np.repeat(nodes, bands)

    members = in_shared_bands(lines.select("node", "line"), sign, parts_of(size, PART))

    texts = lines.select("node", F.col("line").alias("text"))

    facts = None

    def verify(pairs: DataFrame) -> DataFrame:
        nonlocal texts
        kept = stored(pairs if facts is None else alike(pairs, facts, percent), "pairs")
        own = only(texts, ends(kept))
        if facts is None:  # every line of a shared band is in a pair with one of its centres
            texts = own
        return compared(own, kept, line_set, percent)

    def by_rare_shingles(nodes: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        nonlocal texts, facts
        texts = only(texts, nodes)
        frequency = lines.sparkSession.sparkContext.broadcast(class_counts(texts, line_set, CLASSES))

        def describe(batches):
            for batch in batches:
                sets = [line_set(text) for text in batch.text]
                yield pd.DataFrame(
                    {
                        "node": batch.node,
                        "n": [len(x) for x in sets],
                        "sketch": [parities(x) for x in sets],
                        "prefix": [rarest(x, frequency.value, percent).view(np.int64) for x in sets],
                    }
                )

        described = texts.mapInPandas(describe, "node long, n long, sketch array<long>, prefix array<long>")
        described = stored(described, "rare")
        facts = described.select("node", "n", "sketch")
        labelled = described.join(broadcast_checked(known, BROADCAST_IDS // 2), "node", "left").select(
            "node", F.coalesce("root", "node").alias("label"), "n", "prefix"
        )
        rows = described.select(F.sum(F.size("prefix").cast("double"))).first()[0] or 0.0
        return rare_pairs(labelled, parts_of(rows, PACKED // 4), percent)

    return linked_components(members, verify, pair=first_common(percent), finer=by_rare_shingles, all_shared=True)


def parts_of(size: float, each: int) -> int:
    return int(min(max(64, size // each), 1 << 20))


def in_shared_bands(lines: DataFrame, sign, parts: int) -> DataFrame:
    """(bucket, node) of the buckets of ``lines`` that several nodes share. Rows come twice at most where lines do.

    ``sign`` turns batches of ``lines`` into arrays of buckets and nodes. They are dealt by bucket in packed form, a row
    for each part of the buckets with the bytes of many: most bands are of one line, and go no further.
    """

    def unpack(part: pd.DataFrame) -> pd.DataFrame:
        asked, proven = unpacked(part, 2)
        bucket, node = asked
        several = in_runs(bucket) > 1
        return pd.DataFrame({
            "bucket": np.concatenate([bucket[several], proven[0]]),
            "node": np.concatenate([node[several], proven[1]]),
        })

    dealt = lines.mapInPandas(lambda batches: packed_parts(sign(batches), parts, 2), PACKED_ROW)
    return stored(dealt.groupBy("part").applyInPandas(unpack, "bucket long, node long"), "members")


def rare_pairs(labelled: DataFrame, parts: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``labelled`` (node, label, n, prefix) that meet in a bucket of the prefixes, and crowded buckets.

    Buckets of up to SMALL rows give their pairs of different label that meet ``first_common``; the others come as
    rows (bucket, node, n, at).
    """

    def explode(batches):
        for batch in batches:
            sizes = batch.prefix.map(len).to_numpy(np.int64)
            if sizes.sum():
                starts = np.cumsum(sizes) - sizes
                own = [np.repeat(batch[c].to_numpy(np.int64), sizes) for c in ("node", "label", "n")]
                yield np.concatenate(batch.prefix.to_list()), *own, np.arange(sizes.sum()) - np.repeat(starts, sizes)

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        asked, proven = unpacked(part, 5)
        rows = in_runs(asked[0])
        bucket, node, label, n, at = (x[rows <= SMALL] for x in asked)
        found = [np.zeros((0, 2), np.int64)]
        for far in range(1, min(SMALL, len(bucket))):
            x, y = slice(None, -far), slice(far, None)
            both = n[x] + n[y]
            least = -(-percent * both // (100 + percent))
            near = (bucket[x] == bucket[y]) & (label[x] != label[y]) & (np.minimum(n[x], n[y]) >= least)
            near &= np.minimum(n[x] - at[x], n[y] - at[y]) >= least
            found.append(np.sort(np.stack([node[x][near], node[y][near]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        crowd = [np.concatenate([x[rows > SMALL], more]) for x, more in zip(asked, proven)]
        none = np.zeros(len(pairs), np.int64)
        return pd.DataFrame({
            "bucket": np.concatenate([none, crowd[0]]),
            "a": np.concatenate([pairs[:, 0], crowd[1]]),
            "n": np.concatenate([none, crowd[3]]),
            "at": np.concatenate([none, crowd[4]]).astype(np.int32),
            "b": pd.Series(np.concatenate([pairs[:, 1], crowd[1]])),
        })

    dealt = labelled.mapInPandas(lambda batches: packed_parts(explode(batches), parts, SMALL + 1), PACKED_ROW)
    met = stored(dealt.groupBy("part").applyInPandas(meet, "bucket long, a long, n long, at int, b long"), "rare")
    crowded = met.where("a = b").select("bucket", F.col("a").alias("node"), "n", "at")
    return met.where("a <> b").select("a", "b").distinct(), crowded


def in_runs(bucket: np.ndarray) -> np.ndarray:
    """For each of the sorted values, how many there are of it."""
    _, row, many = np.unique(bucket, return_inverse=True, return_counts=True)
    return many[row]


def without_repeats(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of ``columns``, of which the first two are bucket and node, sorted by these, each of them once."""
    order = np.lexsort((columns[1], columns[0]))
    columns = [x[order] for x in columns]
    bucket, node = columns[:2]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])
    return [x[new] for x in columns]


def packed_parts(found, parts: int, enough: int) -> Iterator[pd.DataFrame]:
    """Rows of ``found``, tuples of arrays of which the first two are bucket and node, packed by part of the bucket.

    Of a bucket's rows, ``enough`` of each PACKED go to its part, so that this sees whether there are as many; the
    others are marked as proven and go to any part. So none gets a whole large bucket.
    """

    def pack(waiting):
        columns = without_repeats([np.concatenate(x) for x in zip(*waiting)])
        bucket, node = columns[:2]
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0))
        surplus = np.arange(len(bucket)) - start >= enough
        for proven in (False, True):
            own = [x[surplus == proven] for x in columns]
            if not len(own[0]):
                continue
            part = (own[1 if proven else 0].view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, own = part[order], np.stack([x[order] for x in own])
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            rows = [own[:, a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pd.DataFrame({"part": part[cuts[:-1]], "proven": proven, "rows": rows})

    waiting, count = [], 0
    for rows in found:
        waiting.append(rows)
        count += len(rows[0])
        if count > PACKED:
            yield from pack(waiting)
            waiting, count = [], 0
    if count:
        yield from pack(waiting)


def unpacked(part: pd.DataFrame, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns of a part's packed rows, sorted without repeats, and those of the proven ones."""
    out = []
    for proven in (False, True):
        rows = [np.frombuffer(x, np.int64).reshape(width, -1) for x in part.rows[part.proven == proven]]
        out.append(list(np.concatenate([np.zeros((width, 0), np.int64), *rows], axis=1)))
    return without_repeats(out[0]), out[1]


def dedup_lines(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with the text column cut down to its kept lines, and columns n_lines and n_removed.

    Other columns stay, but for those named like the two; n_chars, where there is one, is left as it was.
    """
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs, more = packed(docs, ["doc_id", "text"], ["n_lines", "n_removed"])
    tie = F.xxhash64("text")
    # as one array, and the outer form: else filters make the optimizer split and normalize again
    lined = docs.select("doc_id", tie.alias("tie"), F.transform(F.split("text", "\n"), normal).alias("lines"))
    lined = lined.select("doc_id", "tie", F.posexplode_outer("lines").alias("at", "line")).where(F.col("line") != "")
    lined = lined.withColumn("node", F.xxhash64("line"))
    size = docs.select(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
    roots = line_components(lined.where(F.length("line") >= SHINGLE), size, percent, bands, rows).select("node", "root")
    roots = broadcast_checked(roots, BROADCAST_IDS // 2)
    placed = lined.select("doc_id", "tie", "at", "node").join(roots, "node", "left")
    placed = placed.select("doc_id", "tie", "at", F.coalesce("root", "node").alias("class"))
    placed = stored(placed, "lines")
    place = F.struct("doc_id", "tie", "at")
    # null ids sort first in a struct
    first = placed.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    removed = placed.join(first.select("class", "first"), "class").where(place != F.col("first"))
    # rows that occur twice give a place twice
    removed = removed.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("at")).alias("_removed"))
    removed = stored(removed.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "_removed"), "removed")
    if (removed.select(F.sum(F.size("_removed").cast("double") * 4 + 64)).first()[0] or 0.0) <= REMOVED_BYTES:
        removed = F.broadcast(removed)
    joined = docs.withColumn("_t", tie).join(
        removed, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("_t")), "left"
    )
    cut = let(F.split("text", "\n"), lambda lines: F.array_join(_without(lines, F.col("_removed")), "\n"))
    found = joined.select(
        "doc_id",
        F.when(F.col("_removed").isNull(), docs["text"]).otherwise(cut).alias("text"),
        *[docs["_more"] for _ in more],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"),
        F.coalesce(F.when(F.col("_removed").isNotNull(), F.size("_removed")), F.lit(0)).alias("n_removed"),
    )
    places = {c: F.col(c if c in ("doc_id", "text") else f"_more.`{c}`") for c in order}
    return found.select(*[places[c].alias(c) for c in order], "n_lines", "n_removed")


def _without(lines: Column, removed: Column) -> Column:
    """The lines but those at the sorted places ``removed``: the stretches between them, each sliced once."""
    starts = F.concat(F.array(F.lit(-1)), removed)
    ends = F.concat(removed, F.array(F.size(lines)))
    return F.flatten(
        F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))))
    )
