"""Links between nodes that share buckets, and their connected components, without pairs within known components.

``members`` has rows (bucket, node): nodes that share a bucket may link. Comparing all pairs of a bucket grows with
the square of a group of near copies, so the search takes three steps. First each bucket names one of its nodes by
lot as its centre, and every node is compared with the centres of its buckets: as many pairs as rows at most. The
links found join most groups. Then the nodes outside a bucket's most frequent component are compared with a sample of
that component, about the square root of its rows there: loose groups, whose members link to some of the others
only, are joined by it. Last, only pairs of a bucket whose nodes lie in different components are compared: all
nodes outside the bucket's most frequent component with all others. Every pair that shares a bucket is thus either
compared or known to lie in one component, so the components are those of all links.

Buckets that say little of similarity can hold many nodes that do not link. The later steps may then deal the nodes
of mixed buckets into finer buckets, of which any two that link share one. Finer buckets of a few rows give their pairs
at once; only the crowded ones take the later steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_checked, stored

#: Rows of one 64-bit column that may be broadcast: at most 16 bytes each, 32 MB in all.
BROADCAST_IDS = 2_000_000

#: Ways in which lots fall: a group of nodes that share all their buckets has so many centres.
CENTRES = 3

#: Hashes and characters of the texts that a task remembers while it compares pairs.
REMEMBERED = 2_000_000

Verify = Callable[[DataFrame], DataFrame]


def shortest_overlap(percent: int, a: str = "na", b: str = "nb") -> str:
    """SQL of the smallest intersection of sets of ``a`` and ``b`` elements that links them."""
    return f"cast(ceil({percent} * ({a} + {b}) / {100 + percent}) as long)"


def first_common(percent: int) -> str:
    """SQL that any linked pair meets in its first common element in one order of all: n elements, this one at ``at``."""
    least = shortest_overlap(percent, "n_x", "n_y")
    return f"least(n_x, n_y) >= {least} and least(n_x - at_x, n_y - at_y) >= {least}"


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); root is the smallest node of the component.

    Distributed union-find: per round every node hooks to its neighbour of lowest lot, if that is lower than its
    own, and the edges are drawn anew between the hooks. Lots are hashes, so they fall alike whatever the order of
    ids; a node keeps its lot, so a star of any size takes two rounds, and chains shorten by a constant factor on
    average. The node of highest lot in a component always goes, so the tables of edges shrink until none is left.
    """
    hooks: list[DataFrame] = []
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        lot = F.xxhash64("other")
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        best = both.groupBy("node").agg(F.min(F.struct(lot.alias("lot"), F.col("other"))).alias("best"))
        lower = F.col("best.lot") < F.xxhash64("node")
        hook = stored(
            best.select("node", F.when(lower, F.col("best.other")).otherwise(F.col("node")).alias("hook")), "hooks"
        )
        hooks.append(hook)
        a, b = hook.toDF("a", "_a"), hook.toDF("b", "_b")
        drawn = edges.join(a, "a").join(b, "b").where("_a <> _b")
        edges = stored(drawn.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = hooks[0].toDF("node", "label")
    for hook in hooks[1:]:
        label = label.join(hook.toDF("label", "_hook"), "label", "left").select(
            "node", F.coalesce("_hook", "label").alias("label")
        )
    label = stored(label, "labels")
    roots = label.groupBy("label").agg(F.min("node").alias("root"))
    return stored(label.join(roots, "label").select("node", "root"), "components")


def only(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The different rows of ``texts`` whose node is one of ``nodes`` (node)."""
    wanted = stored(nodes.distinct(), "wanted")
    return stored(texts.join(broadcast_checked(wanted, BROADCAST_IDS), "node", "left_semi").distinct(), "texts")


def ends(pairs: DataFrame) -> DataFrame:
    """The nodes (node) of the ``pairs`` (a, b), with repeats."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def compared(own: DataFrame, pairs: DataFrame, grams, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sets are similar: percent hundredths of their union is common to both.

    The texts ``own`` (node, text) are joined to the pairs, and ``grams`` makes a text's sorted set of hashes in the
    task: texts are a fraction of the size of their sets. The sets last made are remembered up to a
    bounded size, as a text may be in many pairs.
    """

    def check(batches):
        last: dict[int, tuple[str, np.ndarray]] = {}
        elements = 0

        def found(node: int, text: str) -> np.ndarray:
            nonlocal elements
            if node not in last or last[node][0] != text:
                if elements > REMEMBERED:
                    last.clear()
                    elements = 0
                last[node] = (text, grams(text))
                elements += len(last[node][1]) + len(text)
            return last[node][1]

        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(batch.a, batch.b, batch.text_a, batch.text_b):
                x, y = found(a, text_a), found(b, text_b)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * (100 + percent) >= percent * (len(x) + len(y)) and common > 0)
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(own.toDF("a", "text_a"), "a").join(own.toDF("b", "text_b"), "b")
    return both.mapInPandas(check, "a long, b long").distinct()


def alike(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that may link by their ``facts`` (node, n, sketch).

    A sketch has the parities of the counts of elements in hash classes: linked sets differ in few of them.
    """
    differ = "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    least = shortest_overlap(percent)
    return (
        pairs.join(facts.toDF("a", "na", "sketch_a"), "a")
        .join(facts.toDF("b", "nb", "sketch_b"), "b")
        .where(f"least(na, nb) >= {least}")
        .where(f"{differ} <= na + nb - 2 * {least}")
        .select("a", "b")
    )


def linked_components(
    members: DataFrame,
    verify: Verify,
    facts: list[str] | None = None,
    star: str = "true",
    pair: str = "true",
    finer: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    all_shared: bool = False,
) -> DataFrame:
    """(node, root) of the nodes that link to any other. ``verify`` keeps those of the pairs (a, b) that link.

    ``facts`` are further columns of the members. ``star`` and ``pair`` are conditions on them, with the suffixes _x
    and _y, that any linked pair meets: ``star`` in each bucket that it shares, ``pair`` in one of them at least.
    ``finer`` gets the nodes of mixed buckets and the components known so far, and returns the pairs (a, b) of small
    finer buckets that may link, and the members of the others. ``all_shared``: members are stored already, and each
    of their buckets has several nodes.
    """
    facts = facts or []
    if not all_shared:
        shared = members.groupBy("bucket").agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
        shared = stored(shared.where("_low <> _high").select("bucket"), "shared")
        members = members.join(broadcast_checked(shared, BROADCAST_IDS), "bucket")
        members = stored(members.select("bucket", "node", *facts), "members")

    def sided(df: DataFrame, side: str) -> DataFrame:
        return df.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "bucket"])

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()

    lot = F.xxhash64(F.pmod("bucket", F.lit(CENTRES)), "node")
    centres = members.groupBy("bucket").agg(F.min_by(F.struct("node", *facts), lot).alias("_c")).select("bucket", "_c.*")
    stars = sided(members, "x").join(sided(centres, "y"), "bucket").where(f"node_x <> node_y and ({star})")
    links = stored(verify(ordered(stars)).select("a", "b"), "links")
    known = components(links)

    def of_mixed(members: DataFrame, known: DataFrame) -> DataFrame:
        labelled = members.join(known, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
        return stored(labelled.join(mixed.where("_low <> _high").select("bucket"), "bucket"), "labelled")

    labelled = of_mixed(members, known)
    if finer:
        pairs, members = finer(labelled.select("node"), known)
        found = stored(verify(pairs).select("a", "b"), "links")
        if not found.isEmpty():
            links = links.union(found)
            known = components(links)
        labelled = of_mixed(members, known)

    def with_most(labelled: DataFrame) -> DataFrame:
        """``labelled`` with the label that most rows of the bucket have, and their number."""
        counted = labelled.groupBy("bucket", "label").count().groupBy("bucket")
        most = F.max_by("label", F.struct("count", "label")).alias("most")
        return labelled.join(counted.agg(most, F.max("count").alias("rows")), "bucket")

    # what the centres missed
    placed = with_most(labelled)
    draw = F.pmod(F.xxhash64(F.lit("hub"), "node"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    hubs = placed.where("label = most").where(draw * draw * F.col("rows") < 1).drop("most", "rows")
    near = sided(placed.where("label <> most").drop("most", "rows"), "x").join(sided(hubs, "y"), "bucket")
    found = stored(verify(ordered(near.where(f"({star}) and ({pair})"))).select("a", "b"), "links")
    if not found.isEmpty():
        links = links.union(found)
        known = components(links)
        labelled = of_mixed(labelled.drop("label"), known)
    rest = sided(with_most(labelled).where("label <> most").drop("most", "rows"), "x")
    pairs = rest.join(sided(labelled, "y"), "bucket").where(f"label_x <> label_y and ({pair})")
    more = stored(verify(ordered(pairs)).select("a", "b"), "links")
    return known if more.isEmpty() else components(links.union(more))
