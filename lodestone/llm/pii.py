"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the e-mail addresses, IP addresses, card and phone numbers that fixed patterns find. The words left of an
entity are a lexical pattern; every token with a digit or an at sign that stands behind the same words is an instance
of the pattern. Patterns and instances score each other in turn: a pattern by the share of its instances that are
entities of a kind, an instance by the patterns it stands behind. Tokens behind high-confidence patterns become
spans of the pattern's kind; the seeds' spans stay as they are.

Defined results: null text is empty; rows are judged each, repeated ones alike; an empty table gives no rows. Texts
of any length are searched whole; the patterns are written so that matching takes time in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone")

# The same matches as the plain forms: a match begins where a run of its first characters begins, or right after the
# match before it, and nothing that follows a run can ask for less of it.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens with a digit or an at sign.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
#: Characters left of an entity in which its context is sought.
REACH = 60
#: Different seeds that a pattern must have, the score it must reach, and the rounds of scoring.
SUPPORT = 5
CONFIDENCE = 0.8
ROUNDS = 3


def _before(sizes: Column) -> Column:
    """Sums of all earlier elements, in blocks, so that long arrays are not copied once per element."""
    block = 256
    one = lambda values, start: F.aggregate(
        values,
        F.struct(start.cast("int").alias("sum"), F.array().cast("array<int>").alias("out")),
        lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.array_append(s["out"], s["sum"]).alias("out")),
        lambda s: s["out"],
    )

    def summed(sizes: Column) -> Column:
        many = F.floor((F.size(sizes) + block - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))

    total = lambda values: F.aggregate(values, F.lit(0), lambda s, v: s + v)
    return let(
        let(sizes, summed),
        lambda bs: F.flatten(F.zip_with(bs, one(F.transform(bs, total), F.lit(0)), lambda b, start: one(b, start))),
    )


_FOUND = "array<struct<start:int,end:int,value:string,left:string>>"


def found(text: Column, pattern: str) -> Column:
    """Matches (start, end, value, left) in order, in code points; left holds what stands before a match."""

    def located(both: Column) -> Column:
        values, pieces = both["values"], F.slice(both["pieces"], 1, F.size(both["values"]))
        sizes = F.zip_with(pieces, values, lambda p, v: F.length(p) + F.length(v))
        starts = F.zip_with(_before(sizes), pieces, lambda b, p: b + F.length(p))
        earlier = F.slice(F.concat(F.array(F.lit("")), values), 1, F.size(values))
        lefts = F.zip_with(pieces, earlier, lambda p, v: F.right(F.concat(v, p), F.lit(REACH)))
        placed = F.zip_with(
            starts,
            values,
            lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")),
        )
        return F.zip_with(placed, lefts, lambda m, left: m.withField("left", left))

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("pieces")
    )
    return F.when(text.rlike(pattern), let(both, located)).otherwise(F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part_ok = lambda p: let(
            F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.concat(F.lit("0"), F.substring(q, 1, 3)).cast("int") <= 255)
        )
        return F.forall(F.split(value, r"\."), part_ok)
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_entities(text: Column) -> Column:
    """Entities (kind, start, end, value, left) by kind as listed, then start; kind is its number."""
    def of_kind(number: int, kind: str) -> Column:
        matches = F.filter(found(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        if kind == "email":
            matches = F.when(F.contains(text, F.lit("@")), matches).otherwise(F.array().cast(_FOUND))
        return F.transform(
            matches,
            lambda m: F.struct(
                F.lit(number).alias("kind"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                m["value"].alias("value"),
                m["left"].alias("left"),
            ),
        )

    return F.concat(*[of_kind(number, kind) for number, kind in enumerate(KINDS)])


def candidates(text: Column, base: Column) -> Column:
    """Tokens (start, end, value, left) with a digit or an at sign, without marks at their ends, outside the entities."""

    def bare(m: Column) -> Column:
        head = F.length(F.regexp_extract(m["value"], r"^[^\p{L}\p{N}@+]*+", 0))
        tail = F.length(F.regexp_extract(m["value"], r"[^\p{L}\p{N}@]*+$", 0))
        return F.struct(
            (m["start"] + head).alias("start"),
            (m["end"] - tail).alias("end"),
            F.lower(F.substring(m["value"], head + 1, F.length(m["value"]) - head - tail)).alias("value"),
            m["left"].alias("left"),
        )

    outside = lambda m: (m["start"] < m["end"]) & ~F.exists(
        base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
    )
    return F.filter(F.transform(found(text, TOKEN), bare), outside)


def patterns_of(left: Column) -> Column:
    """Lexical patterns of what stands left of an instance: its last word and its last two words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(left), "[0-9]", "9"), r"\s+"), lambda w: w != "")
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>"))
        .when(F.size(w) == 1, F.array(w[0]))
        .otherwise(F.array(F.element_at(w, -1), F.concat_ws(" ", F.element_at(w, -2), F.element_at(w, -1)))),
    )


def pattern_scores(
    edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS
) -> DataFrame:
    """(pattern, kind, score) of the high-confidence patterns among ``edges`` (pattern, value, kind or null)."""
    edges = edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    seeded = edges.where("kind is not null").groupBy("pattern", "kind").count().where(F.col("count") >= support)
    edges = stored(edges.join(seeded.select("pattern").distinct(), "pattern"), "patterns")
    degree = edges.groupBy("pattern").agg(F.count("*").alias("degree"))
    seeds = edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("s")).distinct()
    scores, result = seeds, None
    for _ in range(rounds):
        result = (
            edges.select("pattern", "value")
            .join(scores, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("s").alias("mass"))
            .join(degree, "pattern")
            .select("pattern", "kind", (F.col("mass") / (F.col("degree") + 1)).alias("score"))
            .join(seeded.select("pattern", "kind"), ["pattern", "kind"])
        )
        miss = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
        unknown = edges.where("kind is null").select("pattern", "value")
        gained = unknown.join(result, "pattern").groupBy("value", "kind").agg((1 - F.exp(miss)).alias("s"))
        scores = seeds.union(gained.select("value", "kind", "s"))
    return stored(result.where(F.col("score") >= confidence), "confident")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def personal_data(
    docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, entities, found) of ``docs`` (doc_id, text): spans (kind, start, end) of seeds, and those discovered."""
    searched = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shown = lambda a: F.transform(
        a, lambda m: m.dropFields("left").withField("patterns", patterns_of(m["left"]))
    )
    text = F.col("text")
    both = let(
        base_entities(text),
        lambda base: F.struct(shown(base).alias("base"), shown(candidates(text, base)).alias("tokens")),
    )
    searched = searched.select("doc_id", both.alias("_b")).select("doc_id", "_b.*")
    searched = stored(searched.withColumn("row", F.monotonically_increasing_id()), "entities")
    tokens = searched.select("row", F.explode("tokens").alias("t")).select(
        "row", "t.start", "t.end", "t.value", F.explode("t.patterns").alias("pattern")
    )
    seeds = searched.select(F.explode("base").alias("t")).select(
        F.explode("t.patterns").alias("pattern"), F.lower("t.value").alias("value"), "t.kind"
    )
    edges = seeds.union(tokens.select("pattern", "value", F.lit(None).cast("int")))
    sure = pattern_scores(edges, support, confidence, rounds)
    best = F.max_by("kind", F.struct("score", -F.col("kind")))
    spotted = tokens.join(sure, "pattern").groupBy("row", "start", "end").agg(best.alias("kind"))
    spotted = spotted.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    bare = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return searched.join(spotted, "row", "left").select(
        "doc_id", bare.alias("entities"), F.coalesce("found", nothing).alias("found")
    )


def digest(spotted: DataFrame) -> DataFrame:
    """Counts and digests of the entities, and all spans as text."""
    counts = [
        F.size(F.filter(F.transform("entities", lambda s: s["kind"] == number), lambda same: same))
        .cast("long")
        .alias(f"n_{kind}")
        for number, kind in enumerate(KINDS)
    ]
    return spotted.select(
        "doc_id",
        *counts,
        F.size("found").cast("long").alias("n_found"),
        F.sha2(_listed(F.col("entities")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("entities", "found"))).alias("spans"),
    )
