"""Repair of the order of roles in conversations by a grammar-compressed dynamic program.

A conversation is a sequence of role/fault symbols, one per row. Re-Pair turns the sequences of a batch into rules that
replace the most frequent pairs, and rules are kept by their pair of symbols, so conversations share them. Each rule has
one min-plus transfer matrix over the states of the accepted form ``(s?(ua)+)?``: from state to state the least cost
of edits and, as a rope over the ropes of its two parts, the ASCII-least audit of edits that has this cost. Rules are
evaluated bottom-up, a conversation by the product of what is left of its sequence.

Audits of equal cost over the same rows are never prefixes of each other, as the longer one would hold more insertions;
so the least audit of a product is made of least audits of its parts.

Conversations of up to LONG_ROWS rows and LONG_BYTES of text are each repaired in one task; tasks hold one at a time.
Longer ones are cut into blocks by a range-partitioned sort: repeated rows are found by a grouped minimum of positions,
each block has its own matrix, and the matrices of a conversation are multiplied. Only the hash of a repaired
conversation, which is sequential by nature, streams through one task, in bounded memory.

Defined results: nulls in role and text count as one space, in the key of the damage too; a null conv_id is a
conversation of its own; null turns come first; rows of the same turn follow in the order of role, then text; a
conversation without rows has zeros, an empty audit and the hash of the empty string; an empty table gives no rows.
Texts and roles are compared by code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_checked, stored

#: Longer conversations are cut into blocks.
LONG_ROWS = 20_000
LONG_BYTES = 32 << 20
#: Symbols and characters of the conversations that share a run of Re-Pair, least count of a replaced pair, and rules that a worker keeps.
BATCH_SYMBOLS = 1 << 15
BATCH_CHARS = 16 << 20
LEAST_PAIRS = 4
RULES = 20_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
STATES = 4  # nothing yet; after s; after u; after a
#: Symbols: must go; then role initial s, u, a, other, whole and truncated.
SYMBOLS = ["x", "s", "u", "a", "o", "S", "U", "A", "O"]
LEGAL = {"su", "ua", "au"}

RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def compare(a, b) -> int:
    """Order of two ropes (a letter, or a pair of ropes); parts that both share are skipped."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, tuple):
            right.append(y)
            left += [x[1], x[0]]
        elif isinstance(y, tuple):
            left.append(x)
            right += [y[1], y[0]]
        elif not x:
            right.append(y)
        elif not y:
            left.append(x)
        elif x[0] != y[0]:
            return -1 if x[0] < y[0] else 1
        else:
            left.append(x[1:])
            right.append(y[1:])
    return bool(left) - bool(right)


def flat(rope) -> str:
    out, rest = [], [rope]
    while rest:
        part = rest.pop()
        if isinstance(part, tuple):
            rest += [part[1], part[0]]
        else:
            out.append(part)
    return "".join(out)


def better(a, b):
    """The cheaper of two entries (cost, rope) or None; of equal ones the one of least audit."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if compare(a[1], b[1]) <= 0 else b


def joined(a, b):
    if not a[1] or not b[1]:
        return a[0] + b[0], a[1] or b[1]
    return a[0] + b[0], (a[1], b[1])


def product(a: list, b: list) -> list:
    """Min-plus product of two matrices, or of a row and a matrix, given as lists of rows."""
    out = []
    for row in a:
        line = [None] * STATES
        for k, left in enumerate(row):
            if left is not None:
                for j, right in enumerate(b[k]):
                    if right is not None and (line[j] is None or left[0] + right[0] <= line[j][0]):
                        line[j] = better(joined(left, right), line[j])
        out.append(line)
    return out


def _matrix(entries: dict) -> list:
    return [[entries.get((i, j)) for j in range(STATES)] for i in range(STATES)]


#: No row: any insertions that help; two lead from before u to after a.
INSERTIONS = _matrix(
    {(i, i): (0, "") for i in range(STATES)}
    | {(i, 2): (INSERT, "I") for i in (0, 1, 3)}
    | {(i, 3): (2 * INSERT, "II") for i in (0, 1)}
    | {(2, 3): (INSERT, "I")}
)
_STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}


def symbol_matrix(symbol: str) -> list:
    """One row, after any insertions before it."""
    entries = {(i, i): (DELETE, "D") for i in range(STATES)}
    if symbol != "x":
        more = TRUNCATED * symbol.isupper()
        for letter in "ua":
            for step in _STEPS[letter]:
                entries[step] = better(entries.get(step), (REROLE + more, "R"))
        for step in _STEPS.get(symbol.lower(), []):
            entries[step] = better(entries.get(step), (KEEP + more, "K"))
    return product(INSERTIONS, _matrix(entries))


class Grammar:
    """Rules shared by all sequences that a worker meets: a matrix per symbol, rules by their pair of symbols."""

    def __init__(self):
        self.matrices = [symbol_matrix(s) for s in SYMBOLS]
        self.rules: dict[tuple[int, int], int] = {}

    def rule(self, pair: tuple[int, int]) -> int:
        found = self.rules.get(pair)
        if found is None:
            found = self.rules[pair] = len(self.matrices)
            self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))
        return found

    def compress(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The sequences by Re-Pair: while a pair is frequent, its occurrences become one symbol."""
        if len(self.rules) > RULES:
            self.__init__()
        line = np.concatenate([np.append(s, -1) for s in sequences])
        while True:
            inside = (line[:-1] >= 0) & (line[1:] >= 0)
            if not inside.any():
                break
            pairs, counts = np.unique(line[:-1][inside] << 32 | line[1:][inside], return_counts=True)
            if counts.max() < LEAST_PAIRS:
                break
            top = int(pairs[counts.argmax()])
            a, b = top >> 32, top & 0xFFFFFFFF
            at = np.flatnonzero((line[:-1] == a) & (line[1:] == b))
            if a == b:  # runs: every other place of each
                starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                lengths = np.diff(np.append(starts, len(at)))
                at = at[(np.arange(len(at)) - np.repeat(starts, lengths)) % 2 == 0]
            line[at] = self.rule((a, b))
            line = np.delete(line, at + 1)
        ends = np.flatnonzero(line == -1)
        return np.split(np.delete(line, ends), ends[:-1] - np.arange(len(ends) - 1))

    def block(self, sequence: np.ndarray) -> list:
        """Transfer matrix of a compressed sequence."""
        out = _matrix({(i, i): (0, "") for i in range(STATES)})
        for symbol in sequence:
            out = product(out, self.matrices[symbol])
        return out

    def repair(self, sequence: np.ndarray):
        """(cost, audit) of the cheapest edits of a compressed sequence."""
        row = [[(0, ""), None, None, None]]
        for symbol in sequence:
            row = product(row, self.matrices[symbol])
        return finished(row)


def finished(row: list) -> tuple[int, str]:
    """The best end: nothing, or after an assistant, insertions included."""
    last = product(row, INSERTIONS)[0]
    cost, rope = better(last[0], last[3])
    return cost, flat(rope)


def symbols_of(rows: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """Symbols of rows (role, text) and the numbers of blank, duplicate and truncated ones."""
    out, faults, seen = [], [0, 0, 0], set()
    for role, text in rows:
        kept = text.rstrip(SPACES)
        again = (role, text) in seen
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not kept:
            faults[0] += 1
            out.append("x")
        elif again:
            faults[1] += 1
            out.append("x")
        elif kept[-1] not in ".!?":
            faults[2] += 1
            out.append(initial.upper())
        else:
            out.append(initial)
    return "".join(out), faults


_CODE = {s: k for k, s in enumerate(SYMBOLS)}


def edited(audit: str, rows: Iterator[tuple[str, str]], state: int = 0) -> Iterator[str]:
    """Lines ``role:text`` of the rows after the edits of an audit."""
    for letter in audit:
        if letter == "I":
            role, text = "", ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
        if letter == "K" and role[:1] == "s":
            state = 1
        else:
            state = 3 if state == 2 else 2
            if letter != "K":
                role = "user" if state == 2 else "assistant"
        yield f"{role}:{text}"


def illegal_steps(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


def missing_turns(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


_WORKER: dict = {}


def _grammar() -> Grammar:
    return _WORKER.setdefault("grammar", Grammar())


def repaired_groups(conversations: list[tuple]) -> list[tuple]:
    """Results of whole conversations (conv_id, turns, rows)."""
    grammar, found = _grammar(), [symbols_of(rows) for _, _, rows in conversations]
    different = list(dict.fromkeys(symbols for symbols, _ in found if symbols))
    best = {"": (0, "")}
    if different:
        coded = [np.array([_CODE[c] for c in s], np.int64) for s in different]
        best.update(zip(different, map(grammar.repair, grammar.compress(coded))))
    out = []
    for (conv_id, turns, rows), (symbols, faults) in zip(conversations, found):
        cost, audit = best[symbols]
        text = "\n".join(edited(audit, iter(rows)))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append((conv_id, missing_turns(turns), *faults, illegal_steps([r for r, _ in rows]), cost, audit, digest))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the rows after damage; a dropped row has no copies."""
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)
    )
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_RESULT = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in RESULT.split(", ")])


def _repair_short(rows: DataFrame) -> DataFrame:
    """Results of conversations that fit a task; ``rows`` as of damaged()."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, chars, current, group = [], 0, 0, None, []

        def whole():
            group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
            return current[0], [r[0] for r in group], [r[1:] for r in group]

        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (conv_id,):
                    if current is not None:
                        waiting.append(whole())
                        size += len(group)
                        if size > BATCH_SYMBOLS or chars > BATCH_CHARS:
                            yield _batch(repaired_groups(waiting), _RESULT)
                            waiting, size, chars = [], 0, 0
                    current, group = (conv_id,), []
                group += [(turn, role, text)] * copies
                chars += len(text)
        if current is not None:
            waiting.append(whole())
            yield _batch(repaired_groups(waiting), _RESULT)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(repair, RESULT)


def _same(column: str) -> Column:
    return F.col("conv_id").eqNullSafe(F.col(column))


def _placed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at, block): rows in order; a block is what one partition of the sort holds."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # equal rows may lie in any order, and in several blocks
    single = single.withColumn("spread", F.xxhash64(F.monotonically_increasing_id(), "copy"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "spread")]
    single = single.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    single = single.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))
    return stored(single.withColumn("block", F.shiftright("at", 33)), "turns")


def _symbols(placed: DataFrame) -> DataFrame:
    """(conv_id, block, at, turn, initial, symbol); b and d stand for blank and duplicate rows."""
    filled = f"[^{SPACES}]"
    facts = placed.select(
        "conv_id",
        "block",
        "at",
        "turn",
        F.left("role", F.lit(1)).alias("initial"),
        F.col("text").rlike(filled).alias("filled"),
        F.col("text").rlike(f"[.!?][{SPACES}]*\\z").alias("whole"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
    )
    first = facts.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), "first")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = (
        F.when(~F.col("filled"), "b")
        .when(F.col("at") != F.col("first"), "d")
        .when(F.col("whole"), letter)
        .otherwise(F.upper(letter))
    )
    joined = facts.join(first, _same("_c") & (F.col("digest") == F.col("_d")), "left")
    return joined.select("conv_id", "block", "at", "turn", "initial", symbol.alias("symbol"))


def _evaluated(symbols: DataFrame) -> DataFrame:
    """(conv_id, block, costs, audits, counts of faults, first and last role initial): the matrix of each block."""
    blocks = symbols.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "symbol", "initial"))).alias("rows")
    )
    blocks = blocks.select(
        F.col("conv_id").cast("string"),  # pandas would make floats of long ids beside a null
        "block",
        F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"),
        F.transform("rows", lambda r: r["initial"]).alias("initials"),
    )
    schema = (
        "conv_id string, block long, costs array<long>, audits array<string>, blank long, duplicate long, "
        "truncated long, illegal long, first string, last string"
    )

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv_id, block, symbols, initials in zip(batch.conv_id, batch.block, batch.symbols, batch.initials):
                codes = np.array([_CODE["x" if s in "bd" else s] for s in symbols], np.int64)
                grammar = _grammar()
                entries = [e for row in grammar.block(grammar.compress([codes])[0]) for e in row]
                costs = [-1 if e is None else e[0] for e in entries]
                audits = ["" if e is None else flat(e[1]) for e in entries]
                faults = symbols.count("b"), symbols.count("d"), sum(s.isupper() for s in symbols)
                initials = list(initials)
                out.append((conv_id, block, costs, audits, *faults, illegal_steps(initials), initials[0], initials[-1]))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return stored(blocks.mapInPandas(evaluate, schema), "blocks")


def _cheapest_way(matrices: list[list]) -> tuple[int, list[tuple[int, str]]]:
    """Least cost through a sequence of matrices, and the state before and the edits of each."""
    row, ways = [(0, ""), None, None, None], [(), None, None, None]
    for matrix in [*matrices, INSERTIONS]:
        line, via = [None] * STATES, [None] * STATES
        for k, left in enumerate(row):
            for j, right in enumerate(matrix[k] if left is not None else ()):
                if right is not None:
                    new = joined(left, right)
                    if better(new, line[j]) is new:
                        line[j], via[j] = new, (ways[k], k, right[1])
        row, ways = line, via
    end = 0 if better(row[0], row[3]) is row[0] else 3
    steps, way = [], ways[end]
    while way:
        steps.append(way[1:])
        way = way[0]
    *steps, (_, tail) = steps[::-1]
    return row[end][0], [*steps[:-1], (steps[-1][0], steps[-1][1] + tail)]


def _ways(evaluated: DataFrame) -> DataFrame:
    """(conv_id, block, state, edits, cost, illegal, audit); what belongs to a conversation stands in its first block."""

    def multiply(group: pd.DataFrame) -> pd.DataFrame:  # of one conversation: at most a row per partition of the sort
        group = group.sort_values("block")
        matrices = []
        for costs, audits in zip(group.costs, group.audits):
            entries = [None if c < 0 else (int(c), a) for c, a in zip(costs, audits)]
            matrices.append([entries[i : i + STATES] for i in range(0, STATES * STATES, STATES)])
        cost, steps = _cheapest_way(matrices)
        between = sum(a + b not in LEGAL for a, b in zip(group["last"], group["first"].iloc[1:]))
        states, edits = zip(*steps)
        whole = ["".join(edits)] + [None] * (len(steps) - 1)
        return pd.DataFrame(
            {
                "conv_id": group.conv_id, "block": group.block, "state": states, "edits": edits,
                "cost": cost, "illegal": group.illegal.sum() + between, "audit": whole,
            }
        )

    schema = "conv_id string, block long, state int, edits string, cost long, illegal long, audit string"
    named = evaluated.select("conv_id", "block", "costs", "audits", "illegal", "first", "last")
    return stored(named.groupBy("conv_id").applyInPandas(multiply, schema), "ways")


def _hashes(placed: DataFrame, ways: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the edits of each block go before its rows, and the lines stream into the hash."""
    edits = ways.select(F.col("conv_id").cast("long"), "block", F.lit(-1).alias("at"), F.lit("").alias("role"), F.col("edits").alias("text"), "state")
    rows = placed.select("conv_id", "block", "at", "role", "text", F.lit(None).cast("int").alias("state"))
    line = edits.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "block", "at")
    out = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running, lines, done = None, None, 0, []

        def take(rows) -> None:
            nonlocal lines, state, at
            start = at
            while at < len(audit) and audit[at] == "I":
                at += 1
            for text in edited(audit[start:at], iter(()), state):
                running.update(("\n" * (lines > 0) + text).encode())
                lines += 1
                state = 3 if state == 2 else 2
            if rows:
                for text in edited(audit[at], iter(rows), state):
                    running.update(("\n" * (lines > 0) + text).encode())
                    lines += 1
                    state = 1 if audit[at] == "K" and rows[0][0][:1] == "s" else 3 if state == 2 else 2
                at += 1

        audit, at, state = "", 0, 0
        for batch in batches:
            for conv_id, _, place, role, text, before in zip(*(c.to_pylist() for c in batch.columns)):
                if place < 0:
                    if current is not None:
                        take(None)
                    if current != (conv_id,):
                        if current is not None:
                            done.append((*current, running.hexdigest()))
                        current, running, lines = (conv_id,), hashlib.sha256(), 0
                    audit, at, state = text, 0, before
                else:
                    take([(role, text)])
            if done:
                yield _batch(done, out)
                done = []
        if current is not None:
            take(None)
            yield _batch([(*current, running.hexdigest())], out)

    return line.mapInArrow(stream, "conv_id long, repaired_sha256 string")


def _repair_long(rows: DataFrame) -> DataFrame:
    """The same results for conversations of any length, cut into blocks."""
    placed = _placed(rows)
    evaluated = _evaluated(_symbols(placed))
    ways = _ways(evaluated)
    counts = evaluated.groupBy(F.col("conv_id").cast("long").alias("_n")).agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    turns = placed.select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("_t"))
    turns = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    whole = ways.where("audit is not null").select(F.col("conv_id").cast("long"), "cost", "illegal", "audit")
    hashes = _hashes(placed, ways).withColumnRenamed("conv_id", "_h")
    return (
        whole.join(counts, _same("_n"))
        .join(turns, _same("_t"))
        .join(hashes, _same("_h"))
        .select(
            "conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
            "cost", "audit", "repaired_sha256",
        )
    )


def repair_conversations(
    conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, damage: bool = True
) -> DataFrame:
    """Damage report and cheapest repair of each conversation of (conv_id, turn, role, text).

    With ``damage`` the rows are first damaged by the checksum of their place, as a test of the repair.
    """
    blank = F.lit(" ")
    own = conversations.select("conv_id", "turn", "role", "text")
    rows = (
        damaged(own)
        if damage
        else own.withColumns({"role": F.coalesce("role", blank), "text": F.coalesce("text", blank), "copies": F.lit(1)})
    )
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes))
    long = stored(long.select(F.col("conv_id").alias("_long")), "long")
    if long.isEmpty():
        return _repair_short(rows)
    listed = broadcast_checked(long)
    short = _repair_short(rows.join(listed, _same("_long"), "left_anti"))
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    found = _repair_long(rows.join(listed, _same("_long"), "left_semi"))
    found = long.join(found, _same("_long"), "left").select(
        F.col("_long").alias("conv_id"),
        *[F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]],
    )
    return short.unionByName(found)
