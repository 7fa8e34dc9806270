"""Repair of conversations against an exhaustive search, and long ones against short ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from lodestone.llm import turns

COST = {"K": 0, "R": 2, "D": 3, "I": 2}
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """Rows (turn, role, text) per conversation after damage."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = WORD.findall(text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, found):
    """(cost, audit, roles and texts) over all edits with few insertions in a gap."""
    best = None
    options = [[("D", None)] if f in ("blank", "duplicate") else [("K", 0), ("R", "user"), ("R", "assistant"), ("D", None)] for f in found]
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*options):
        cost = sum(COST[e] + (f == "truncated" and e != "D") for (e, _), f in zip(edits, found))
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit, lines = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(inserts[k])
                lines += [(r, "") for r in inserts[k]]
                if k < len(rows):
                    e, role = edits[k]
                    audit += e
                    if e != "D":
                        lines.append((role or rows[k][1], rows[k][2]))
            total = cost + 2 * sum(map(len, inserts))
            if (best is None or (total, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = total, audit, lines
    return best


def recursive(rows, found):
    """The same by recursion over rows and the initial before, for longer conversations."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def rest(k, last, inserted):
        best = (0, "", ()) if k == len(rows) and last in ("", "a") else None
        ways = []
        if inserted < 2:
            ways += [(2, "I", r, "", k, inserted + 1) for r in ("user", "assistant") if r[0] in after[last]]
        if k < len(rows):
            _, role, text = rows[k]
            ways.append((3, "D", None, None, k + 1, 0))
            if found[k] not in ("blank", "duplicate"):
                more = found[k] == "truncated"
                ways += [(2 + more, "R", r, text, k + 1, 0) for r in ("user", "assistant") if r[0] in after[last]]
                if role[:1] and role[:1] in after[last]:
                    ways.append((more, "K", role, text, k + 1, 0))
        for cost, letter, role, text, to, n in ways:
            end = rest(to, last if role is None else role[:1], n)
            if end is not None:
                new = (cost + end[0], letter + end[1], (((role, text),) if role is not None else ()) + end[2])
                best = new if best is None or new[:2] < best[:2] else best
        return best

    return rest(0, "", 0)


def expected(rows):
    out = {}
    data = damage(rows)
    for conv in {r[0] for r in rows}:
        own = data.get(conv, [])
        found = faults(own)
        cost, audit, lines = recursive(tuple(own), tuple(found))
        if len(own) <= 3:
            again = exhaustive(own, found)
            assert (again[0], again[1], [*again[2]]) == (cost, audit, [*lines])
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def conversations(seed, many, longest):
    lots = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]
    texts = ["Hi.", "What?", "no end", "", " \n", "Yes!  ", None, "é.", "a: b\nc!", "x . y"]
    rows = []
    for conv in range(many):
        for turn in range(lots.randint(1, longest)):
            place = lots.choice([turn, turn, turn, turn + 1, None])
            rows.append((None if conv == 7 else conv, place, lots.choice(roles[: lots.choice([4, 9])]), lots.choice(texts) if lots.random() < 0.6 else f"say {lots.random()}."))
    return rows + rows[:3]


def given(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, cost long").repartition(5)


def compared(found, rows):
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(found) == len(want) and got == want


@pytest.mark.parametrize(("many", "longest"), [(120, 3), (40, 30)])
def test_short_conversations(spark, many, longest):
    rows = conversations(many, many, longest)
    compared(turns.repair_conversations(given(spark, rows)).collect(), rows)


def test_long_conversations_in_blocks(spark):
    rows = conversations(3, 6, 60) + [(9, t, "user", "same again.") for t in (None, None, 4, 4, 4, 8)] + [(None, None, "user", None)]
    compared(turns.repair_conversations(given(spark, rows), long_rows=8).collect(), rows)
    compared(turns.repair_conversations(given(spark, rows), long_rows=0).collect(), rows)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    for limit in (turns.LONG_ROWS, 0):
        rows = [(gone, 0, "user", "Hi.")]
        compared(turns.repair_conversations(given(spark, rows), long_rows=limit).collect(), rows)
    assert turns.repair_conversations(given(spark, [])).count() == 0


def test_grammar_shares_rules():
    import numpy as np

    grammar, lots = turns.Grammar(), random.Random(4)
    pieces = [[lots.randrange(9) for _ in range(lots.randint(1, 12))] for _ in range(20)]
    sequences = [np.array(sum((lots.choice(pieces) for _ in range(8)), []), np.int64) for _ in range(50)] + [np.ones(1000, np.int64)]
    packed = grammar.compress(sequences)
    assert sum(map(len, packed)) < 0.4 * sum(map(len, sequences)) and len(packed[-1]) < 40
    plain = turns.Grammar()
    for short, long in zip(packed, sequences, strict=True):
        assert grammar.repair(short) == plain.repair(long)
        whole = [[e and (e[0], turns.flat(e[1])) for e in row] for row in grammar.block(short)]
        assert whole == [[e and (e[0], turns.flat(e[1])) for e in row] for row in plain.block(long)]
