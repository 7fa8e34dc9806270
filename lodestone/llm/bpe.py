"""Byte-level BPE encoding and decoding with a rank queue of hierarchical bitmaps.

Every merge rank has a bucket of positions in a linked list of symbols. Three levels of 64-bit words mark the ranks
whose bucket holds something, so the next rank is found by three find-first-set steps whatever the list's length.
Entries whose symbols have changed meanwhile are skipped when they come up. A very long pre-token costs a constant
number of queue steps per byte, and no scan of the whole list per merge.

One list holds all new pre-tokens of a group of texts, with a barrier between them that no merge crosses. Merges of
different pre-tokens don't depend on each other, so a whole bucket is worked off at a time.

Defined results: null text is empty and has no tokens; repeated rows are encoded each; an empty table gives no rows;
long texts are encoded in bounded stretches and their digests built up piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.token_counts import apart, stretches

#: Entries of a worker's caches, and the longest piece that is kept there.
CACHE_SIZE = 300_000
LONGEST_KEPT = 64
#: Characters of texts whose new pre-tokens are encoded together, and bytes of pre-tokens in one queue.
GROUP = 1 << 21
STEP = 1 << 18
NO_RANK = -1

_WORKER: dict = {}


def _lowest(word: int) -> int:
    return (word & -word).bit_length() - 1


class RankQueue:
    """Positions by rank; ``pop`` gives the smallest rank and all its positions from left to right."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.middle = [0] * ((words >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Gives a rank that has no bucket one with these positions."""
        self.buckets[rank] = positions
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]]:
        part = _lowest(self.top)
        word = part << 6 | _lowest(self.middle[part])
        rank = word << 6 | _lowest(self.low[word])
        self.low[word] &= self.low[word] - 1
        if not self.low[word]:
            self.middle[part] &= self.middle[part] - 1
            if not self.middle[part]:
                self.top &= self.top - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Codec:
    """Encoder and decoder for ranks of byte strings, with bounded caches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        # symbols are numbers: ranks, then bytes without a rank, then the barrier, with which nothing merges
        self.unranked = max(ranks.values(), default=0) + 1
        self.barrier = self.unranked + 256
        self.first = np.arange(256) + self.unranked
        self.pairs = np.full(1 << 16, NO_RANK, np.int64)
        for symbol, rank in ranks.items():
            if len(symbol) == 1:
                self.first[symbol[0]] = rank
            elif len(symbol) == 2:
                self.pairs[symbol[0] << 8 | symbol[1]] = rank
        numbers = {bytes([i]): n for i, n in enumerate(self.first.tolist())} | ranks
        #: Rank by left symbol times ``base`` plus right symbol, for all ways to put a symbol together from two.
        self.base = self.barrier + 1
        self.into: dict[int, int] = {}
        for symbol, rank in ranks.items():
            for cut in range(1, len(symbol)):
                left, right = numbers.get(symbol[:cut]), numbers.get(symbol[cut:])
                if left is not None and right is not None:
                    self.into[left * self.base + right] = rank
        by_rank = sorted((rank, symbol) for symbol, rank in ranks.items())
        self.letters = np.frombuffer(b"".join(symbol for _, symbol in by_rank), np.uint8)
        self.lengths = np.zeros(self.unranked, np.int64)
        self.lengths[[rank for rank, _ in by_rank]] = [len(symbol) for _, symbol in by_rank]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pretokens: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pretokens: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token, from one queue over all of them."""
        data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        bars = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        barred = np.zeros(len(data), bool)
        barred[bars] = True
        symbols = np.where(barred, self.barrier, self.first[data]).tolist()
        ranks = np.where(barred[:-1] | barred[1:], NO_RANK, self.pairs[data[:-1] << 8 | data[1:]])
        at = np.flatnonzero(ranks != NO_RANK)
        at = at[np.argsort(ranks[at], kind="stable")]
        if len(at):
            borders = np.flatnonzero(np.diff(ranks[at])) + 1
            for part in np.split(at, borders):
                self.queue.open(int(ranks[part[0]]), part.tolist())
        self._merge(symbols)
        kept = np.array(symbols, np.int64)
        live = (kept != NO_RANK) & (kept < self.unranked)
        ends = (np.cumsum(live) * 4)[bars].tolist()
        packed = kept[live].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def _merge(self, symbols: list[int]) -> None:
        """Works the queue off; symbols that went into others become NO_RANK."""
        rank_of, base, queue = self.into.get, self.base, self.queue
        buckets = queue.buckets
        following = list(range(1, len(symbols) + 1))
        preceding = list(range(-1, len(symbols) - 1))
        while queue.top:
            rank, positions = queue.pop()
            for turn, i in enumerate(positions):
                j = following[i]
                # NO_RANK makes a negative number, which is never found
                if rank_of(symbols[i] * base + symbols[j]) != rank:
                    continue
                symbols[i], symbols[j] = rank, NO_RANK
                after = following[i] = following[j]
                preceding[after] = i
                before = preceding[i]
                lowest = rank
                right = rank_of(rank * base + symbols[after])
                if right is not None:
                    if right in buckets:
                        buckets[right].append(i)
                    else:
                        queue.open(right, [i])
                    if right < lowest:
                        lowest = right
                left = rank_of(symbols[before] * base + rank)
                if left is not None:
                    if left in buckets:
                        buckets[left].append(before)
                    else:
                        queue.open(left, [before])
                    if left < lowest:
                        lowest = left
                if lowest < rank and turn + 1 < len(positions):
                    # a smaller rank comes first; a new symbol is longer than this one, so this rank has no bucket
                    queue.open(rank, positions[turn + 1 :])
                    break

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens that no cache holds."""
        known, todo = {}, []
        for word in words:
            data = word.encode("utf-8")
            rank = self.ranks.get(data)
            if rank is None:
                todo.append((word, data))
            else:
                known[word] = rank.to_bytes(4, "little")
        for step in _steps(todo):
            known.update(zip((w for w, _ in step), self.merged([d for _, d in step])))
        return known

    def _matches(self, text: str) -> list[str]:
        """All matches of the pattern; ``findall`` gives groups where the pattern has any."""
        if self.split.groups:
            return [m.group() for m in self.split.finditer(text)]
        return self.split.findall(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text: little-endian, 32 bits each; every match of the pattern is encoded separately.

        Texts go by way of pieces cut before single spaces, which are looked up first. Texts with other white space
        next to such a space, or at the ends of pieces, are matched whole.
        """
        # what was not used since the cache was last half full goes
        if len(self.pieces) > CACHE_SIZE // 2:
            self.pieces, self.old_pieces = {}, self.pieces
        if len(self.pretokens) > CACHE_SIZE // 2:
            self.pretokens, self.old_pretokens = {}, self.pretokens
        cut, missing, whole = [], set(), {}
        for text in texts:
            first, *rest = text.split(" ")
            strange = {p for p in rest if p not in self.pieces}
            if apart(first, strange):
                missing |= strange
                cut.append((first, rest))
                whole.setdefault(first)
            else:
                cut.append((text, []))
                whole.setdefault(text)
        found = [p for p in missing if p in self.old_pieces]
        self.pieces.update((p, self.old_pieces.pop(p)) for p in found)
        missing.difference_update(found)
        matches = {p: self._matches(" " + p) for p in missing}
        heads = {t: self._matches(t) for t in whole}
        wanted = {w for words in matches.values() for w in words}
        wanted.update(w for words in heads.values() for w in words)
        wanted.difference_update(self.pretokens)
        found = [w for w in wanted if w in self.old_pretokens]
        self.pretokens.update((w, self.old_pretokens.pop(w)) for w in found)
        wanted.difference_update(found)
        fresh = self._words(wanted)
        self.pretokens.update(fresh)
        ids_of = self.pretokens.__getitem__
        self.pieces.update((p, b"".join(map(ids_of, words))) for p, words in matches.items())
        of_heads = {t: b"".join(map(ids_of, words)) for t, words in heads.items()}
        out = [of_heads[first] + b"".join(map(self.pieces.__getitem__, rest)) for first, rest in cut]
        # very long ones aren't kept beyond their group
        for kept, new in ((self.pretokens, fresh), (self.pieces, matches)):
            for word in new:
                if len(word) > LONGEST_KEPT:
                    del kept[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids."""
        ids = np.frombuffer(ids, "<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.letters[places + np.arange(len(places))].tobytes()


def _steps(todo: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    """The pre-tokens in steps of about STEP bytes; one that is longer makes a step of its own."""
    step, size = [], 0
    for word, data in todo:
        if step and size + len(data) > STEP:
            yield step
            step, size = [], 0
        step.append((word, data))
        size += len(data)
    if step:
        yield step


def _groups(texts: Iterable[str]) -> Iterator[list[tuple[int, str]]]:
    """(place of the text, stretch) in groups of about GROUP characters."""
    group, size = [], 0
    for place, text in enumerate(texts):
        for part in stretches(text or ""):
            group.append((place, part))
            size += len(part)
            if size > GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


def codec(content: bytes, pattern: str) -> Codec:
    """The worker's codec for the content of a rank file: lines of base64 bytes and rank."""
    if _WORKER.get("of") != (content, pattern):
        pairs = map(bytes.split, content.splitlines())
        _WORKER.update(of=(content, pattern), codec=Codec({base64.b64decode(a): int(b) for a, b in pairs}, pattern))
    return _WORKER["codec"]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of ``docs`` (doc_id, text).

    The rank file reaches the tasks as a broadcast of fixed size. ``with_ids`` adds the ids themselves.
    """
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), pattern))
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(*shared.value)
        for texts in batches:
            states = [[0, hashlib.sha256(), hashlib.sha256(), []] for _ in range(len(texts))]
            for group in _groups(texts):
                for (place, _), ids in zip(group, own.encode_all([part for _, part in group])):
                    state = states[place]
                    state[0] += len(ids) // 4
                    state[1].update(ids)
                    state[2].update(own.decode(ids))
                    if with_ids:
                        state[3].append(np.frombuffer(ids, "<i4"))
            rows = [[n, packed.hexdigest(), decoded.hexdigest()] for n, packed, decoded, _ in states]
            if with_ids:
                rows = [[*row, np.concatenate(state[3])] for row, state in zip(rows, states)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + with_ids])

    return docs.select("doc_id", run("text").alias("_r")).select("doc_id", "_r.*")
