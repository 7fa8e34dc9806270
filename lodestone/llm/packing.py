"""Packing of tokenized documents into windows by best-fit decreasing.

Each task encodes its own documents and packs them, so nothing is shuffled. A document of at least one window is first
cut into full windows; what is left of each document waits in a buffer of bounded size. When the buffer is full, its
pieces go, longest first, each into the tightest open window that still holds it, found in a segment tree indexed by
remaining capacity. Windows that stay too empty are dissolved: their pieces wait for the next buffer, and after the last
one they are laid end to end and cut at window borders, the final stretch at powers of two, which need no padding.

Defined results: null text counts as empty, so such a document is its end mark alone; repeated rows are documents of
their own; equal lengths keep the order in which they came; an empty table gives no rows; a text of any length is
encoded in stretches cut at white space (one without any is a single stretch). Reruns over the same files agree.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Ids of a window, id that ends a document, and unused ids that a window may keep.
WINDOW = 2048
END_ID = 1
SLACK = 32
#: Bytes of ids that wait in a buffer.
BUFFER = 32 << 20
#: Characters of a stretch and of the texts encoded together, and entries of each half of a worker's caches.
STEP = 1 << 20
GROUP = 8 << 20
CACHE_SIZE = 500_000
#: Longer pieces are encoded without being kept.
LONGEST_KEPT = 48

#: Words of letters without combining marks, then marks that the vocabulary's pattern keeps apart from letters, as one
#: pre-token; neither holds an apostrophe, which may start one with letters, nor the start of a special string.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
_BREAK = re.compile(r"[ \n]")
_WORKER: dict = {}

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Cache:
    """A map that forgets what was not asked for since it was last half full."""

    def __init__(self, size: int):
        self.young, self.old, self.size = {}, {}, size

    def get(self, key):
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordEncoder:
    """Ids of texts, as little-endian 32-bit integers, by a vocabulary that never joins over white space."""

    def __init__(self, content: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_str(content)
        self.pieces, self.words = Cache(CACHE_SIZE), Cache(CACHE_SIZE)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.made.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one pre-token each: one call for all of them, cut where the pre-token changes."""
        if not words:
            return []
        found = self.made.encode(" ".join(words), add_special_tokens=False)
        cuts = 4 * (np.flatnonzero(np.diff(np.array(found.word_ids))) + 1)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = [*cuts.tolist(), len(ids)]
        if len(ends) != len(words):
            return self._encoded(words)
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces between white space: plain ones by their lower-case word and their marks, others whole."""
        parts, other = {}, []
        for piece in missing:
            plain = _PLAIN.fullmatch(piece)
            if plain:
                parts[piece] = plain[1].lower(), plain[2]
            else:
                other.append(piece)
        known, young = {"": b""}, self.words.young
        for word in dict.fromkeys(w for pair in parts.values() for w in pair):
            if word:
                known[word] = young.get(word) or self.words.get(word)
        order = [word for word, ids in known.items() if ids is None]
        for word, ids in zip(order, self._words(order)):
            known[word] = ids
            if len(word) <= LONGEST_KEPT:
                self.words.put(word, ids)
        found = {piece: known[word] + known[marks] for piece, (word, marks) in parts.items()}
        found.update(zip(other, self._encoded(other)))
        return found

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, from the caches where these have them."""
        found = list(map(self.pieces.young.get, pieces))
        late = {p: self.pieces.get(p) for p, ids in zip(pieces, found) if ids is None}
        new = self._learn([p for p, ids in late.items() if ids is None and p])
        for piece, ids in new.items():
            if len(piece) <= LONGEST_KEPT:
                self.pieces.put(piece, ids)
        late.update(new)
        return [(late[p] or b"") if ids is None else ids for p, ids in zip(pieces, found)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Each different piece between white space is looked up once for all of them."""
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        known = self._ids(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, code = np.cumsum(lengths) - lengths, coded.indices.to_numpy()
        each = lengths[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.arange(ends[-1]) + np.repeat(starts[code] - ends[:-1], each)
        ids = np.frombuffer(b"".join(known), "<u4")[at].tobytes()
        cuts = (4 * ends[parts.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def stretches(text: str, step: int = STEP) -> Iterator[str]:
    """The text in stretches of about ``step`` characters, cut at spaces or line ends."""
    at = 0
    while len(text) - at > step:
        cut = _BREAK.search(text, at + step)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


class OpenWindows:
    """Segment tree over remaining capacities 0 to ``capacity``: how many open windows lie below each node."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, change: int) -> None:
        node = self.leaves + left
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, left: int, window: int) -> None:
        self.windows[left].append(window)
        self._add(left, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out an open window of the smallest remaining capacity that is at least ``need``."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        left = node - self.leaves
        self._add(left, -1)
        return left, self.windows[left].pop()


def best_fit_decreasing(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows as lists of positions in ``sizes``, each size from 1 to ``capacity``."""
    windows: list[list[int]] = []
    tree = OpenWindows(capacity)
    for at in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.tightest(sizes[at])
        if found is None:
            left, window = capacity, len(windows)
            windows.append([])
        else:
            left, window = found
        windows[window].append(at)
        if left > sizes[at]:
            tree.put(left - sizes[at], window)
    return windows


class Packer:
    """Takes the ids of one document after another and yields rows of pieces with their places in sequences."""

    def __init__(self, window: int, slack: int, first_sequence: int, buffer: int = BUFFER):
        self.window, self.slack, self.sequence, self.buffer = window, slack, first_sequence, buffer
        self.waiting: list[tuple] = []  # (document, start, ids, tokens of the document)
        self.size = self.carried = 0

    def _row(self, piece: tuple, offset: int) -> tuple:
        document, start, ids, total = piece
        return document, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset, ids

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield self._row(piece, offset)
            offset += len(piece[2]) // 4
        self.sequence += 1

    def document(self, document, parts: Iterator[bytes]) -> Iterator[tuple]:
        """Full windows of a document at once; the rest waits."""
        width, total, full, rest = 4 * self.window, 0, [], b""
        for part in parts:
            rest += part
            total += len(part) // 4
            cut = len(rest) - len(rest) % width
            for at in range(0, cut, width):
                full.append(rest[at : at + width])
            rest = rest[cut:]
        for k, ids in enumerate(full):
            yield from self._sequence([(document, k * self.window, ids, total)])
        if rest:
            self.waiting.append((document, total - len(rest) // 4, rest, total))
            self.size += len(rest)
            if self.size - self.carried > self.buffer:
                yield from self._pack()

    def _pack(self) -> Iterator[tuple]:
        pieces, again = self.waiting, []
        for window in best_fit_decreasing([len(p[2]) // 4 for p in pieces], self.window):
            chosen = [pieces[k] for k in window]
            if sum(len(p[2]) for p in chosen) >= 4 * (self.window - self.slack):
                yield from self._sequence(chosen)
            else:
                again += chosen
        self.waiting = again
        self.size = self.carried = sum(len(p[2]) for p in again)
        if self.size > self.buffer:  # pieces that hardly ever share a window
            yield from self._cut(last=False)

    def _cut(self, last: bool) -> Iterator[tuple]:
        """The waiting pieces end to end, cut at window borders; the last stretch waits or is cut at powers of two."""
        room, chosen, left = self.window, [], sum(len(p[2]) for p in self.waiting) // 4
        queue, self.waiting = self.waiting[::-1], []
        while queue:
            if not chosen and left < self.window:
                if not last:
                    self.waiting = queue[::-1]
                    break
                room = left if left >= self.window - self.slack else 1 << left.bit_length() - 1
            document, start, ids, total = queue.pop()
            taken = min(room, len(ids) // 4)
            chosen.append((document, start, ids[: 4 * taken], total))
            if 4 * taken < len(ids):
                queue.append((document, start + taken, ids[4 * taken :], total))
            room, left = room - taken, left - taken
            if not room:
                yield from self._sequence(chosen)
                room, chosen = self.window, []
        self.size = self.carried = sum(len(p[2]) for p in self.waiting)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack()
        yield from self._cut(last=True)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, slack: int = SLACK, end_id: int = END_ID,
    buffer: int = BUFFER, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece of ``docs`` (doc_id, text).

    The file is one of the tokenizers library; its pre-tokens must not reach over spaces or line ends.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    end = np.array([end_id], "<u4").tobytes()
    key = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _WORKER.get("content") != shared.value:
            _WORKER.update(content=shared.value, encoder=WordEncoder(shared.value))
        encoder = _WORKER["encoder"]
        packer = Packer(window, slack, TaskContext.get().partitionId() << 40, buffer)

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple]:
            """Documents with the ids of their stretches; short texts are encoded together."""
            names, group, size = [], [], 0
            for document, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                if len(text) > STEP:
                    yield document, (encoder.encode([part])[0] for part in stretches(text))
                    continue
                names.append(document)
                group.append(text)
                size += len(text)
                if size > GROUP:
                    yield from zip(names, ([ids] for ids in encoder.encode(group)))
                    names, group, size = [], [], 0
            if group:
                yield from zip(names, ([ids] for ids in encoder.encode(group)))

        kind = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(ids, "<u4").astype("int32") for ids in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                for document, parts in encoded(batch):
                    yield from packer.document(document, chain(parts, [end]))
            if kind is not None:
                yield from packer.finish()

        out: list[tuple] = []
        for row in rows():
            out.append(row if with_ids else row[:7])
            if len(out) == 4096:
                yield table(out)
                out = []
        if out:
            yield table(out)

    schema = f"doc_id {key}, {SCHEMA}" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(pack, schema)
