"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs (lines that are not empty) are hashed to 64-bit digests. Its sketch has three tables of cells;
each digest falls into one cell of each and adds itself there: a count, the xor of the digests, and the xor of their
check values. The difference of two sketches is that of the sets: digests of both cancel out. Cells left with one
digest give it away; taking it out of its other cells frees further ones, until all are empty: then the differing
digests are known. If peeling sticks, the pair is tried again with digests spread over blocks that have a sketch
each, twice as many at every try. No sketch ever has more than a fixed number of cells, however long a text is.

Likeness of two sets: 1 - differing / (digests of both); 1 if both are empty.

Defined results: null text is empty; repeated paragraphs count once; null doc_ids come first; rows of one doc_id are
ordered by a hash of the text; equal texts have equal fingerprints; an empty table gives no rows; a single document
follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, stored

TABLES = 3
WIDTH = 12
CELLS = TABLES * WIDTH
ROUNDS = 12
#: Digests per block when a pair is tried again.
PER_BLOCK = 8
TRIES = 24


def paragraph_digests(text: Column) -> Column:
    """Different 64-bit digests of the text's paragraphs."""
    return F.array_distinct(
        F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.xxhash64(p))
    )


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _falls(key: Column, cell: Column) -> Column:
    """Whether a digest falls into a cell: one per table, by other bits of the digest."""
    shifted = F.call_function("shiftright", key, (F.floor(cell / WIDTH) * 16).cast("int"))
    return F.pmod(shifted, F.lit(WIDTH)) == cell % WIDTH


def _xor(values: Column, of=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(of(v)))


def sketch(keys: Column) -> Column:
    """Cells (n, key, chk) of an array of digests."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(CELLS - 1)),
        lambda cell: let(
            F.filter(keys, lambda k: _falls(k, cell)),
            lambda own: F.struct(F.size(own).alias("n"), _xor(own).alias("key"), _xor(own, _check).alias("chk")),
        ),
    )


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda x, y: F.struct(
            (x["n"] - y["n"]).alias("n"),
            x["key"].bitwiseXOR(y["key"]).alias("key"),
            x["chk"].bitwiseXOR(y["chk"]).alias("chk"),
        ),
    )


def _pure(cells: Column) -> Column:
    found = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"])))
    return F.array_distinct(F.transform(found, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"))))


def _take_out(cells: Column, pure: Column) -> Column:
    return F.transform(
        cells,
        lambda c, i: let(
            F.filter(pure, lambda p: _falls(p["key"], i)),
            lambda hit: F.when(F.size(hit) == 0, c).otherwise(
                F.struct(
                    (c["n"] - F.aggregate(hit, F.lit(0), lambda s, p: s + p["n"])).alias("n"),
                    c["key"].bitwiseXOR(_xor(hit, lambda p: p["key"])).alias("key"),
                    c["chk"].bitwiseXOR(_xor(hit, lambda p: _check(p["key"]))).alias("chk"),
                )
            ),
        ),
    )


def peel(cells: Column) -> Column:
    """(complete, left, right) of a difference of sketches: the digests that only one side has."""
    empty = F.array().cast("array<struct<key:bigint,n:int>>")
    start = F.struct(cells.alias("cells"), empty.alias("found"), empty.alias("pure"))
    start = let(start, lambda s: s.withField("pure", _pure(s["cells"])))

    def step(state, _):
        # taking out and looking anew are worth the work only while something is pure
        going = let(
            _take_out(state["cells"], state["pure"]),
            lambda left: F.struct(
                left.alias("cells"), F.concat(state["found"], state["pure"]).alias("found"), _pure(left).alias("pure")
            ),
        )
        return F.when(F.size(state["pure"]) == 0, state).otherwise(going)

    def result(state):
        blank = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0))
        side = lambda n: F.transform(F.filter(state["found"], lambda p: p["n"] == n), lambda p: p["key"])
        return F.struct(blank.alias("complete"), side(1).alias("left"), side(-1).alias("right"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, result)


def written(cells: Column) -> Column:
    """A sketch as text: its cells in order; an empty one is an empty field."""
    shown = F.transform(
        cells,
        lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(
            F.concat_ws(":", c["n"].cast("string"), F.lower(F.hex(c["key"])), F.lower(F.hex(c["chk"])))
        ),
    )
    return F.array_join(shown, ",")


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, n_left, n_right) of ``pairs`` (pair, a, b): how many digests only array a has, and only b.

    The first try compares one sketch of each side; pairs that it doesn't decode are tried over more and more blocks.
    """
    tried = pairs.select("pair", peel(subtract(sketch(F.col("a")), sketch(F.col("b")))).alias("r"))
    tried = stored(
        tried.select("pair", "r.complete", F.size("r.left").alias("n_left"), F.size("r.right").alias("n_right")), "peeled"
    )
    done = [tried.where("complete").select("pair", "n_left", "n_right")]
    failed = tried.where("not complete").select("pair")
    for attempt in range(TRIES):
        if failed.isEmpty():
            break
        blocks = F.ceil((F.size("a") + F.size("b")) / F.lit(float(PER_BLOCK))) * (1 << attempt)
        again = pairs.join(failed, "pair").withColumn("blocks", blocks)
        keys = again.select("pair", "blocks", F.lit(0).alias("side"), F.explode("a").alias("key")).union(
            again.select("pair", "blocks", F.lit(1), F.explode("b"))
        )
        keys = keys.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")))
        held = keys.groupBy("pair", "block").agg(
            F.collect_list(F.when(F.col("side") == 0, F.col("key"))).alias("a"),
            F.collect_list(F.when(F.col("side") == 1, F.col("key"))).alias("b"),
        )
        held = held.select("pair", peel(subtract(sketch(F.col("a")), sketch(F.col("b")))).alias("r"))
        tried = stored(
            held.groupBy("pair").agg(
                F.min("r.complete").alias("complete"),
                F.sum(F.size("r.left")).alias("n_left"),
                F.sum(F.size("r.right")).alias("n_right"),
            ),
            "peeled",
        )
        done.append(tried.where("complete").select("pair", "n_left", "n_right"))
        failed = tried.where("not complete").select("pair")
    else:
        if not failed.isEmpty():
            raise RuntimeError(f"sketches could not be peeled in {TRIES} tries")
    out = done[0]
    for more in done[1:]:
        out = out.union(more.select("pair", F.col("n_left").cast("int"), F.col("n_right").cast("int")))
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with next_text: the text of the next doc_id, for the last one that of the first.

    Ids are dealt to stretches by quantiles, and each stretch is sorted on its own. The first row of a stretch also
    goes to the end of the stretch before, so every row finds its follower where it is: texts are shuffled once.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [(k + 1) / parts for k in range(parts - 1)]
    found = docs.select(F.percentile_approx("doc_id", shares, 100 * parts).alias("q")).head()["q"]
    bounds = sorted(set(found or []))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    doc_id = F.col("doc_id")
    if groups:
        longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
        below = lambda values: F.size(F.filter(values, lambda b: b < doc_id))
        fine = F.array(*[longs(g) for g in groups])
        coarse = F.greatest(below(longs([g[0] for g in groups])), F.lit(1))
        stretch = let(coarse, lambda c: (c - 1) * step + below(F.element_at(fine, c)))
    else:
        stretch = F.lit(0)
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.withColumn("stretch", stretch).withColumn("tie", F.xxhash64("text"))
    heads = dealt.groupBy("stretch").agg(F.min(F.struct("doc_id", "tie")).alias("head")).orderBy("stretch").collect()
    if not heads:
        return docs.select("doc_id", "text", F.lit("").alias("next_text"))
    places = [h["stretch"] for h in heads]
    before = [places[-1], *places[:-1]]
    rows = [(h["head"]["doc_id"], h["head"]["tie"], p) for h, p in zip(heads, before)]
    # one row per stretch: bounded by the number of partitions
    firsts = F.broadcast(docs.sparkSession.createDataFrame(rows, "_id long, _tie long, before int"))
    dealt = dealt.join(firsts, F.col("_id").eqNullSafe(doc_id) & (F.col("_tie") == F.col("tie")), "left")
    own = F.struct(F.col("stretch").cast("int").alias("s"), F.lit(0).alias("extra"))
    extra = F.struct(F.col("before").alias("s"), F.lit(1).alias("extra"))
    dealt = dealt.select(
        "doc_id",
        "text",
        "tie",
        F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("_p"),
    )
    order = Window.partitionBy("_p.s").orderBy("_p.extra", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("_p.extra = 0").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the first characters, as many or all, of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (doc_id, text)."""
    both = with_next(docs.select("doc_id", "text"))
    both = both.withColumn("changed", edited(F.col("text"), F.col("next_text")))
    hashed = both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("changed", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("changed")).alias("other"),
        paragraph_digests(F.col("next_text")).alias("next"),
    )
    hashed = stored(hashed.withColumn("row", F.monotonically_increasing_id()), "digests")
    pairs = hashed.select((F.col("row") * 2).alias("pair"), F.col("own").alias("a"), F.col("other").alias("b")).union(
        hashed.select(F.col("row") * 2 + 1, "own", "next")
    )
    differing = differences(pairs).select("pair", (F.col("n_left") + F.col("n_right")).alias("d"))
    differing = differing.groupBy(F.shiftright("pair", 1).alias("row")).agg(
        F.max(F.when(F.col("pair") % 2 == 0, F.col("d"))).alias("d_edited"),
        F.max(F.when(F.col("pair") % 2 == 1, F.col("d"))).alias("d_next"),
    )

    def likeness(d: str, other: str) -> Column:
        total = F.size("own") + F.size(other)
        return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - F.col(d) / total)

    return hashed.join(differing, "row").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(sketch(F.col("own"))).alias("fingerprint"),
        written(sketch(F.col("other"))).alias("edited_fingerprint"),
        likeness("d_edited", "other").alias("near_edited"),
        likeness("d_next", "next").alias("near_next"),
    )
