"""Supersession chains against following the links one by one, with cycles, and along a very long chain."""

import random

from lodestone.operators import decisions

SCHEMA = "decision_id long, superseded_by long"


def followed(links, depth=None):
    out = set()
    for root in links:
        path, at = [], root
        while at in links and at not in path and (depth is None or len(path) < depth):
            path.append(at)
            at = links[at]
        out |= {(root, place, x) for place, x in enumerate(path)}
    return out


def test_random_forests_and_cycles(spark):
    lots = random.Random(8)
    for n, loops in ((14, True), (50, True), (60, False)):
        links = {
            k: lots.choice([None, 9999, k, *range(n)] if loops else [None, *range(k)]) if lots.random() < 0.3 else k + 1 if loops or k % 7 else None
            for k in range(n)
        }
        table = spark.createDataFrame(list(links.items()), SCHEMA)
        for depth in (None, 3):
            rows = decisions.supersession_chain(table, max_depth=depth).collect()
            assert len(rows) == len({tuple(r) for r in rows}) and {tuple(r) for r in rows} == followed(links, depth)
        some = spark.createDataFrame([(0,), (n - 1,), (12345,)], "decision_id long")
        found = {tuple(r) for r in decisions.supersession_chain(table, roots=some).collect()}
        assert found == {r for r in followed(links) if r[0] in (0, n - 1)}


def test_one_ring(spark):
    table = spark.createDataFrame([(k, (k + 1) % 33) for k in range(33)], SCHEMA)
    assert {tuple(r) for r in decisions.supersession_chain(table).collect()} == {(r, p, (r + p) % 33) for r in range(33) for p in range(33)}


def test_empty(spark):
    assert decisions.supersession_chain(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_chain(spark):
    """Steps and memory per row stay small: the jumps over a chain of 100 000 decisions take nine tables."""
    n = 100_000
    table = spark.range(n).selectExpr("id AS decision_id", f"CASE WHEN id < {n - 1} THEN id + 1 END AS superseded_by")
    some = spark.createDataFrame([(0,), (n - 10,)], "decision_id long")
    found = decisions.supersession_chain(table, roots=some).where("decision_id = root_id + position").groupBy("root_id").count()
    assert {r.root_id: r["count"] for r in found.collect()} == {0: n, n - 10: 10}
