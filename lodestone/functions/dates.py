"""Date functions. None of them reads the clock: ``now`` is always passed in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let, strip

# Age limits in days and the recency floor.
HIGH_MAX_DAYS = 30
MEDIUM_MAX_DAYS = 90
OUTDATED_DAYS = 180
RECENCY_FLOOR = 0.1

# Order of date confidence levels, lowest first.
CONFIDENCE_LEVELS = ["UNKNOWN", "LOW", "MEDIUM", "HIGH"]

# Front-matter keys, in order of preference, and words that mark a dating line.
FRONT_MATTER_KEYS = ["date", "updated", "last_updated", "last_modified", "modified"]
DATING_WORDS = [
    "as of",
    "updated",
    "last updated",
    "last modified",
    "modified",
    "dated",
    "date",
    "published",
]

# Date notations searched for, in order.
MONTH_NAMES = (
    "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|"
    "aug|august|sep|sept|september|oct|october|nov|november|dec|december"
)
ISO_RE = (
    r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?\b"
)
SLASH_RE = r"\b\d{4}/\d{2}/\d{2}\b"
DOT_RE = r"\b\d{4}\.\d{2}\.\d{2}\b"
MONTH_DAY_RE = rf"(?i)\b({MONTH_NAMES})\s+(\d{{1,2}}),\s+(\d{{4}})\b"
DAY_MONTH_RE = rf"(?i)\b(\d{{1,2}})\s+({MONTH_NAMES})\s+(\d{{4}})\b"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
HEAD_LINES = 40


def ts(value: datetime | str | Column) -> Column:
    """Timestamp without time zone from a datetime, an ISO string or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def before(now, *, days: float = 0, hours: float = 0) -> Column:
    """``now`` minus a fixed span."""
    seconds = days * 86400 + hours * 3600
    return ts(now) - F.make_dt_interval(secs=F.lit(float(seconds)))


def age_seconds(date: Column, now) -> Column:
    return F.timestamp_diff("MICROSECOND", date, ts(now)) / 1e6


def recency(date: Column, now, half_life_days: int = 180) -> Column:
    """0.5 ** (whole days / half life), not below the floor; undated or future gives 1."""
    days = F.floor(age_seconds(date, now) / 86400)
    return (
        F.when(date.isNull() | (days <= 0), F.lit(1.0))
        .otherwise(F.greatest(F.lit(RECENCY_FLOOR), F.pow(F.lit(0.5), days / half_life_days)))
    )


def confidence(date: Column, now) -> Column:
    return (
        F.when(date.isNull(), "UNKNOWN")
        .when(date >= before(now, days=HIGH_MAX_DAYS), "HIGH")
        .when(date >= before(now, days=MEDIUM_MAX_DAYS), "MEDIUM")
        .otherwise("LOW")
    )


def confidence_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE_LEVELS]), level) - 1


def confidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE_LEVELS]), rank.cast("int") + 1)


def outdated(date: Column, now) -> Column:
    return F.coalesce(date < before(now, days=OUTDATED_DAYS), F.lit(False))


def duration_days(text: Column) -> Column:
    """Days of ``90d``, ``6w``, ``6m``, ``1y`` or a bare number; NULL when invalid or not positive."""
    shape = r"(?i)^(\d+)\s*([dwmy])?$"
    trimmed = strip(text)
    number = F.regexp_extract(trimmed, shape, 1).try_cast("long")
    unit = F.lower(F.regexp_extract(trimmed, shape, 2))
    factor = F.when(unit == "w", 7).when(unit == "m", 30).when(unit == "y", 365).otherwise(1)
    return F.when(number > 0, number * factor)


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def front_matter(body: Column) -> Column:
    """Lines between a leading ``---`` and the next one; empty when there is no such block."""

    def block(rest: Column) -> Column:
        end = F.array_position(F.transform(rest, strip), F.lit("---"))
        opened = (strip(F.element_at(body, 1)) == "---") & (end > 0)
        return F.when(opened, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(
            F.array().cast("array<string>")
        )

    return let(F.slice(body, F.lit(2), F.size(body)), block)


def front_matter_value(block: Column, key: str) -> Column:
    """Value of a flat ``key: value`` line, the last one winning; NULL when absent, null or blank."""
    found = F.filter(block, lambda line: line.rlike(rf"^{key}\s*:(\s|$)"))
    raw = strip(F.regexp_replace(F.get(found, F.size(found) - 1), rf"^{key}\s*:", ""))
    raw = strip(F.regexp_replace(raw, r"(^|\s)#.*$", ""))
    value = F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")
    return F.when(~raw.isin("", "~", "null", "Null", "NULL") & (strip(value) != ""), value)


def front_matter_has(block: Column, key: str) -> Column:
    """Whether a key has a value: one on its line, or a list or mapping on the lines below it."""
    below = F.transform(
        block, lambda line, i: line.rlike(rf"^{key}\s*:\s*(#.*)?$") & F.get(block, i + 1).rlike(r"^(\s*-(\s|$)|\s+[^\s#])")
    )
    return front_matter_value(block, key).isNotNull() | F.coalesce(F.exists(below, lambda x: x), F.lit(False))


def _iso(found: Column) -> Column:
    """Wall-clock part of an ISO match, moved to UTC when it names an offset."""
    offset_re = r"([+-])(\d{2}):(\d{2})$"
    clock = F.regexp_replace(found, r"(?:Z|[+-]\d{2}:\d{2})$", "").try_cast("timestamp_ntz")
    sign = F.when(F.regexp_extract(found, offset_re, 1) == "-", -60).otherwise(60)
    minutes = F.regexp_extract(found, offset_re, 2).try_cast("int") * 60 + F.regexp_extract(
        found, offset_re, 3
    ).try_cast("int")
    return clock - F.make_dt_interval(secs=F.coalesce(sign * minutes, F.lit(0)).cast("double"))


def _named(found: Column, pattern: str, month: int, day: int) -> Column:
    """Date with a month name. "sept" is found but is no month name, so it gives no date."""
    name = F.lower(F.regexp_extract(found, pattern, month))
    number = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(name, 1, 3)) + 2) / 3
    iso = F.format_string(
        "%s-%02d-%02d",
        F.regexp_extract(found, pattern, 3),
        number.cast("int"),
        F.regexp_extract(found, pattern, day).try_cast("int"),
    )
    return F.when(name != "sept", iso.try_cast("timestamp_ntz"))


def first_date(text: Column) -> Column:
    """First date by notation: ISO, slashes, dots, ``Month d, yyyy``, ``d Month yyyy``."""

    def numeric(separator: str):
        return lambda found: F.replace(found, F.lit(separator), F.lit("-")).try_cast("timestamp_ntz")

    def attempt(pattern: str, parse) -> Column:
        return let(F.regexp_extract(text, pattern, 0), lambda found: F.when(found != "", parse(found)))

    return F.coalesce(
        attempt(ISO_RE, _iso),
        attempt(SLASH_RE, numeric("/")),
        attempt(DOT_RE, numeric(".")),
        attempt(MONTH_DAY_RE, lambda found: _named(found, MONTH_DAY_RE, 1, 2)),
        attempt(DAY_MONTH_RE, lambda found: _named(found, DAY_MONTH_RE, 2, 1)),
    )


def extract_date(text: Column, head_lines: int | None = HEAD_LINES) -> Column:
    """Date of a document: front matter first, then its first ``head_lines`` lines (None: all), dating lines preferred."""

    def candidates(body: Column) -> Column:
        head = body if head_lines is None else F.slice(body, 1, head_lines)
        marked = F.filter(head, lambda line: F.lower(line).rlike("|".join(DATING_WORDS)))
        values = let(
            front_matter(body),
            lambda block: F.array(*[front_matter_value(block, key) for key in FRONT_MATTER_KEYS]),
        )
        return F.concat(values, marked, F.array(F.array_join(head, "\n")))

    # The fold stops looking once a date is found.
    return F.aggregate(
        let(lines(text), candidates),
        F.lit(None).cast("timestamp_ntz"),
        lambda found, candidate: F.coalesce(found, first_date(candidate)),
    )
