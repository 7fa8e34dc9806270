"""Decision mining and supersession."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import dates
from lodestone.functions.text import strip
from lodestone.operators.ranking import first_per
from lodestone.schemas import DECISION_MATCH
from lodestone.session import stored

# Name, pattern, confidence and type of decision phrases, most explicit first.
DECISION_PATTERNS = [
    ("adr_decision", r"(?is)(?:^|\n)##?\s*Decision\s*\n+(.+?)(?=\n##|\n\*\*Status|\Z)", 0.95, "architecture"),
    ("adr_header", r"(?is)(?:^|\n)#\s*ADR[- ]?\d*[:\s]+(.+?)(?=\n#|\Z)", 0.95, "architecture"),
    (
        "explicit_decision",
        r"(?is)(?:^|\n)\s*\*?\*?Decision[:\s]*\*?\*?\s*(.+?)(?=\n\n|\n\s*\*\*|\Z)",
        0.90,
        None,
    ),
    ("agreed_statement", r"(?is)(?:^|\n)\s*\*?\*?Agreed[:\s]*\*?\*?\s*(.+?)(?=\n\n|\Z)", 0.85, None),
    ("we_decided", r"(?s)[Ww]e (?:have )?decided (?:to |that )(.+?)(?:\.|$)", 0.80, None),
    (
        "decision_was_made",
        r"(?s)[Tt]he decision (?:was|has been) made (?:to |that )(.+?)(?:\.|$)",
        0.80,
        None,
    ),
    ("decided_on", r"(?s)[Dd]ecided (?:on|upon)[:\s]+(.+?)(?:\.|$)", 0.75, None),
    ("we_agreed", r"(?s)[Ww]e (?:have )?agreed (?:to |that |on )(.+?)(?:\.|$)", 0.75, None),
    ("will_use", r"(?s)[Ww]e (?:will|shall|are going to) use (.+?) (?:for|as|because|since)", 0.70, None),
    (
        "team_chose",
        r"(?s)(?:[Tt]he team|[Ww]e) (?:chose|choose|have chosen|has chosen) (.+?)(?:\.|$)",
        0.70,
        None,
    ),
    ("chose_to", r"(?s)[Ww]e (?:chose|choose|have chosen) (?:to )(.+?)(?:\.|$)", 0.70, None),
    ("going_forward", r"(?s)[Gg]oing forward,? (?:we (?:will|shall) )?(.+?)(?:\.|$)", 0.60, None),
    ("from_now_on", r"(?s)[Ff]rom now on,? (?:we (?:will|shall) )?(.+?)(?:\.|$)", 0.60, None),
    ("selected", r"(?s)[Ss]elected (.+?) (?:for|as|over|instead)", 0.55, None),
]

# Every pattern above contains one of these words; texts without any never leave the JVM.
DECISION_HINT = r"(?i)decision|adr|agreed|decided| use |chose|choose|going forward|from now on|selected"

# Patterns of rejected alternatives (flag d: only \n ends a line, as in the originals).
REJECTED_PATTERNS = [
    r"(?sd)[Rr]ejected[:\s]+(.+?)(?:\.|$)",
    r"(?sd)[Cc]onsidered (.+?) but (?:decided against|rejected|chose not to)",
    r"(?sd)(?:chose|selected|decided on|use) .+? instead of (.+?)(?:\.|$)",
    r"(?sd)(?:use|chose|selected|prefer) .+? rather than (.+?)(?:\.|$)",
    r"(?sd)(?:use|chose|decided to|selected) .+?, not (.+?)(?:\.|$)",
]

# Key words per decision type, first match wins, searched as substrings.
DECISION_TYPES = [
    ("architecture", "architecture|design|system|infrastructure|database|api|schema"),
    ("process", "process|workflow|procedure|methodology|approach"),
    ("technology", "framework|library|tool|language|stack|platform"),
    ("feature", "feature|functionality|capability|requirement"),
    ("policy", "policy|rule|guideline|standard|convention"),
]

MIN_DECISION_CHARS = 10
MIN_REJECTED_CHARS = 5
CONTEXT_CHARS = 100


def decision_type(text: Column) -> Column:
    found = None
    for name, keys in DECISION_TYPES:
        hit = text.rlike(f"(?i){keys}")
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def rejected_alternatives(content: Column) -> Column:
    """Captured texts of all rejection patterns, pattern by pattern."""
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in REJECTED_PATTERNS])
    return F.filter(F.transform(found, strip), lambda t: F.length(t) >= MIN_REJECTED_CHARS)


def with_matches(
    chunks: DataFrame, *, patterns=None, min_confidence: float = 0.5, hint: str | None = None
) -> DataFrame:
    """Chunks that have a decision phrase, with an array of all matches and their positions.

    Spark's regex functions do not report positions, so the patterns run in an Arrow kernel; the
    other columns travel along, which saves joining the matches back.
    """
    wanted = [p for p in (patterns or DECISION_PATTERNS) if p[2] >= min_confidence]
    hint = hint if patterns else DECISION_HINT
    likely = chunks.where(F.col("content").rlike(hint)) if hint else chunks
    schema = T.StructType([*chunks.schema.fields, T.StructField("matches", DECISION_MATCH)])
    match_type = pa.list_(
        pa.struct(
            [
                ("pattern", pa.string()),
                ("start", pa.int32()),
                ("end", pa.int32()),
                ("text", pa.string()),
                ("confidence", pa.float64()),
                ("pattern_type", pa.string()),
                ("seq", pa.int32()),
            ]
        )
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(n, re.compile(p), c, t) for n, p, c, t in wanted]

        def matches(content: str | None) -> list[dict] | None:
            found = [
                (name, m.start(), m.end(), m.group(1).strip(), confidence, kind)
                for name, pattern, confidence, kind in compiled
                for m in pattern.finditer(content or "")
            ]
            rows = [m for m in found if len(m[3]) >= MIN_DECISION_CHARS]
            names = ("pattern", "start", "end", "text", "confidence", "pattern_type")
            return [dict(zip(names, m, strict=True), seq=i) for i, m in enumerate(rows)] or None

        for batch in batches:
            found = pa.array([matches(c) for c in batch.column("content").to_pylist()], match_type)
            out = pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "matches"])
            yield out.filter(found.is_valid())

    return likely.mapInArrow(scan, schema)


def decision_matches(chunks: DataFrame, **options) -> DataFrame:
    """One row per match: chunk_id, pattern, start, end, text, confidence, type."""
    rows = with_matches(chunks, **options).select("chunk_id", F.inline("matches"))
    kind = F.coalesce("pattern_type", decision_type(F.col("text")))
    return rows.withColumn("decision_type", kind).drop("pattern_type")


def resolve_overlaps(matches: Column) -> Column:
    """Keep matches greedily by confidence, dropping those that overlap a kept one."""
    keyed = F.transform(
        matches, lambda m: F.struct((-m["confidence"]).alias("order"), m["seq"].alias("place"), m.alias("match"))
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["match"])

    def keep(kept: Column, match: Column) -> Column:
        clash = F.exists(kept, lambda k: (match["start"] < k["end"]) & (match["end"] > k["start"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, match))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), keep)


def extract_decisions(
    chunks: DataFrame, *, patterns=None, min_confidence: float = 0.6, hint: str | None = None
) -> DataFrame:
    """Decisions of all chunks: text, type, context, date of the document, rejected alternatives.

    ``chunks`` has chunk_id, content and source_date.
    """
    needed = chunks.select("chunk_id", "content", "source_date")
    found = with_matches(needed, patterns=patterns, min_confidence=min_confidence, hint=hint)
    rows = found.withColumn("rejected_alternatives", rejected_alternatives(F.col("content"))).select(
        "chunk_id", "content", "source_date", "rejected_alternatives", F.inline(resolve_overlaps(F.col("matches")))
    )
    begin = F.greatest(F.lit(0), F.col("start") - CONTEXT_CHARS)
    context = F.substring(F.col("content"), begin + 1, F.col("end") + CONTEXT_CHARS - begin)
    return rows.select(
        "chunk_id",
        F.col("text").alias("decision_text"),
        strip(context).alias("context"),
        F.coalesce("pattern_type", decision_type(F.col("text"))).alias("decision_type"),
        F.lit("active").alias("status"),
        F.col("source_date").alias("decision_date"),
        "confidence",
        "rejected_alternatives",
    )


def list_decisions(
    decisions: DataFrame,
    *,
    now=None,
    project: str | None = None,
    status: str | None = None,
    older_than_days: int | None = None,
    limit: int = 100,
) -> DataFrame:
    """Filtered decisions, most confident first, then newest extraction, then id."""
    rows = decisions
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if older_than_days is not None:
        rows = rows.where(
            F.coalesce("decision_date", "extracted_at") <= dates.before(now, days=older_than_days)
        )
    return rows.orderBy(F.desc("confidence"), F.desc("extracted_at"), "decision_id").limit(limit)


def review_queue(decisions: DataFrame, *, older_than: str, now, **conditions) -> DataFrame:
    """Decisions older than a duration such as ``90d`` or ``1y``."""
    match = re.fullmatch(r"(\d+)\s*([dwmy]?)", older_than.strip().lower())
    if not match or int(match[1]) <= 0:
        raise ValueError("duration like 90d, 6w, 6m or 1y expected")
    days = int(match[1]) * {"": 1, "d": 1, "w": 7, "m": 30, "y": 365}[match[2]]
    return list_decisions(decisions, now=now, older_than_days=days, **conditions)


def superseded_by(decisions: DataFrame) -> DataFrame:
    """Direct predecessors of every decision, oldest first.

    Ordered in blocks of one day each, so a decision that replaced very many others is spread over
    tasks: the position is the number of earlier days' predecessors plus the place in the day.
    """
    from pyspark.sql import Window

    when = F.coalesce("o.decision_date", "o.extracted_at")
    pairs = (
        decisions.alias("o")
        .join(decisions.select("decision_id").alias("n"), F.col("o.superseded_by") == F.col("n.decision_id"))
        .select(F.col("n.decision_id"), F.col("o.decision_id").alias("predecessor"), when.alias("_when"))
        .withColumn("_day", F.to_date("_when"))
    )
    earlier = Window.partitionBy("decision_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        pairs.groupBy("decision_id", "_day")
        .agg(F.count("*").alias("_n"))
        .select("decision_id", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("decision_id", "_day").orderBy("_when", "predecessor")
    return (
        pairs.join(days, ["decision_id", "_day"])
        .withColumn("position", (F.row_number().over(inside) + F.col("_offset")).cast("int"))
        .select("decision_id", "predecessor", "position")
    )


def supersede(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Apply (old_id, new_id, seq) pairs whose decisions both exist; the latest pair per old wins."""
    ids = decisions.select("decision_id")
    valid = pairs.join(ids.withColumnRenamed("decision_id", "old_id"), "old_id", "left_semi").join(
        ids.withColumnRenamed("decision_id", "new_id"), "new_id", "left_semi"
    )
    last = first_per(valid, ["old_id"], [F.desc("seq")]).select(
        F.col("old_id").alias("decision_id"), F.col("new_id").alias("_new")
    )
    return (
        decisions.join(last, "decision_id", "left")
        .withColumn("status", F.when(F.col("_new").isNotNull(), "superseded").otherwise(F.col("status")))
        .withColumn("superseded_by", F.coalesce("_new", "superseded_by"))
        .drop("_new")
    )


def supersession_chain(decisions: DataFrame, *, max_depth: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """root_id, position, decision_id along superseded_by, for every decision, or those of ``roots``, as a root.

    A chain stops at a cycle, at a missing decision, and with ``max_depth`` at that many rows. Tables of jumps over one to
    four times 1, 4, 16, ... decisions hold a few ids per row and only the decisions from which a jump that long exists.
    From the longest jumps down, each row of a path adds the rows that lie one to three jumps behind it, so all steps
    together make hardly more rows than the result. Ids are unique in a table of jumps, so a decision that many paths
    meet is a skewed left side that AQE can split. Where 4**k exceeds the number of links, only decisions that lead into
    a cycle have a jump left; just for these the length of the path up to its first repetition is worked out.
    """
    tables, endless = _jumps(decisions)
    ids = (decisions if roots is None else roots.join(decisions.select("decision_id"), "decision_id", "left_semi")).select(
        F.col("decision_id").alias("root_id")
    )
    paths = ids.select("root_id", F.lit(0).alias("position"), F.col("root_id").alias("decision_id"))
    limit = F.lit(max_depth if max_depth is not None else 2**31 - 1)
    if endless is None:
        paths = paths.withColumn("_limit", limit)
    else:
        lengths = _path_lengths(tables, endless)
        paths = paths.join(lengths, F.col("root_id") == F.col("_id"), "left").select(
            *paths.columns, F.least("_length", limit).cast("int").alias("_limit")
        )
    for k, ahead in reversed(list(enumerate(tables))):
        if max_depth is not None and 4**k >= max_depth:
            continue
        ways = [
            F.struct((F.col("position") + n * 4**k).alias("position"), F.col(to).alias("decision_id"))
            for n, to in enumerate(("decision_id", "_to", "_to2", "_to3"))
        ]
        there = F.filter(F.array(*ways), lambda w: w["decision_id"].isNotNull() & (w["position"] < F.col("_limit")))
        paths = paths.join(ahead.drop("_to4"), F.col("decision_id") == F.col("_id"), "left").select("root_id", F.inline(there), "_limit")
    return paths.select("root_id", "position", "decision_id")


def _jumps(decisions: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (_id, _to, _to2, _to3, _to4) of one to four jumps over 4**k decisions; what goes on for ever as (_id, _to)."""
    ids = decisions.select(F.col("decision_id").alias("_known"))
    links = decisions.select(F.col("decision_id").alias("_id"), F.col("superseded_by").alias("_to"))
    jump = stored(links.join(ids, F.col("_to") == F.col("_known"), "left_semi"), "jumps")
    count, tables = jump.count(), []
    while not jump.isEmpty():
        if 4 ** len(tables) > count:
            return tables, jump
        ahead = jump
        for before, to in (("_to", "_to2"), ("_to2", "_to3"), ("_to3", "_to4")):
            on = jump.select(F.col("_id").alias("_via"), F.col("_to").alias(to))
            ahead = ahead.join(on, F.col(before) == F.col("_via"), "left").drop("_via")
        tables.append(stored(ahead, "jumps"))
        jump = tables[-1].where("_to4 IS NOT NULL").select("_id", F.col("_to4").alias("_to"))
    return tables, None


def _path_lengths(tables: list[DataFrame], endless: DataFrame) -> DataFrame:
    """(_id, _length) of the decisions of ``endless``: how many come before the first repetition."""
    jumps = []  # over 1, 2, 4, 8, ... decisions
    for ahead in tables:
        jumps += [ahead.select("_id", F.col(to).alias("_to")).where("_to IS NOT NULL") for to in ("_to", "_to2")]
    ring = endless.select(F.col("_to").alias("_ring")).distinct()
    # the least id of a cycle names it: over 1, 2, 4, ... decisions ahead
    least = ring.select("_ring", F.col("_ring").alias("_least"))
    for jump in jumps:
        on = least.select(F.col("_ring").alias("_at"), F.col("_least").alias("_other"))
        least = least.join(jump, F.col("_ring") == F.col("_id")).join(on, F.col("_to") == F.col("_at"))
        least = stored(least.select("_ring", F.least("_least", "_other").alias("_least")), "rings")
    sizes = least.groupBy("_least").agg(F.count("*").alias("_size"))
    sizes = stored(least.join(sizes, "_least").select("_ring", "_size"), "rings")
    # the tail: as many steps as stay outside of any cycle, then one more
    walk = endless.select(F.col("_id").alias("_start"), F.col("_id").alias("_now"), F.lit(0).alias("_steps"))
    for k, jump in reversed(list(enumerate(jumps))):
        outside = jump.join(ring, F.col("_to") == F.col("_ring"), "left_anti")
        walk = walk.join(outside, F.col("_now") == F.col("_id"), "left").select(
            "_start",
            F.coalesce("_to", "_now").alias("_now"),
            (F.col("_steps") + F.when(F.col("_to").isNotNull(), 2**k).otherwise(0)).alias("_steps"),
        )
    walk = walk.join(sizes, F.col("_now") == F.col("_ring"), "left")
    entry = jumps[0].join(sizes.select(F.col("_ring").alias("_entry"), F.col("_size").alias("_around")), F.col("_to") == F.col("_entry"))
    walk = walk.join(entry.select("_id", "_around"), F.col("_now") == F.col("_id"), "left")
    length = F.col("_steps") + F.when(F.col("_size").isNotNull(), F.col("_size")).otherwise(1 + F.col("_around"))
    return stored(walk.select(F.col("_start").alias("_id"), length.alias("_length")), "lengths")


def decision_history(decisions: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """decision_id, relation (predecessor or successor), other_id, distance.

    Every decision has at most one successor, so the forward chains hold the predecessors too:
    whoever reaches a decision is its predecessor.
    """
    steps = supersession_chain(decisions, max_depth=max_depth).where("position > 0")
    both = F.array(
        F.struct(
            F.col("root_id").alias("decision_id"),
            F.lit("successor").alias("relation"),
            F.col("decision_id").alias("other_id"),
            F.col("position").alias("distance"),
        ),
        F.struct(
            F.col("decision_id").alias("decision_id"),
            F.lit("predecessor").alias("relation"),
            F.col("root_id").alias("other_id"),
            F.col("position").alias("distance"),
        ),
    )
    return steps.select(F.inline(both))


def clear_decisions(decisions: DataFrame, chunks: DataFrame, project: str | None = None) -> DataFrame:
    """Decisions left after those of a project (or all) are removed."""
    if project is None:
        return decisions.limit(0)
    return decisions.join(chunks.where(F.col("project") == project).select("chunk_id"), "chunk_id", "left_anti")
