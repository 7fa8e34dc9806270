"""String functions: tokens, hashes, slugs, snippets, quality checks, query syntax, highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, and the characters that make up a word.
SPACES = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Their complement. The class within the class keeps ASCII letters from being tested against one range after another.
VISIBLE = (
    r"[!-~[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}"
    r"\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]]"
)
SPACE_CHARACTERS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"

# Lines that carry no content when a whole chunk consists of them.
BOILERPLATE = [
    r"copyright\s+\d{4}",
    r"all\s+rights\s+reserved",
    r"table\s+of\s+contents?",
    r"page\s+\d+\s*(of\s+\d+)?$",
    r"\d+\s*/\s*\d+$",
    r"(chapter|section|part)\s+\d+$",
    r"-{3,}$",
    r"[_=]{3,}$",
    r"\s*\.{3,}\s*$",
    r"(click|tap|select)\s+here",
    r"back\s+to\s+top$",
    r"(next|previous|continue)$",
]
BOILERPLATE_RE = "^(?:" + "|".join(BOILERPLATE) + ")"

# Thresholds of a meaningful chunk.
MIN_WORDS = 10
MIN_DISTINCT_WORDS = 5
MIN_LETTER_SHARE = 0.5
MIN_TOKENS = 5

# Statuses accepted by ``decision:``, and words that are never highlighted.
DECISION_STATUSES = ["active", "superseded", "deprecated"]
HIGHLIGHT_STOP_WORDS = ["the", "and", "for", "with", "how", "what", "why"]


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode white space; looks at the two ends only."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def words(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_extract_all(text, F.lit(f"{VISIBLE}+"), F.lit(0))


def collapse(text: Column) -> Column:
    """Trim and squeeze every run of white space to one blank."""
    return strip(F.regexp_replace(text, f"[{SPACES}]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric words of two or more characters.

    Accented letters are word characters, so a word holding one gives no token at all. The
    look-arounds spell that out instead of relying on the meaning of ``\\b`` in the running JDK.
    """
    return F.regexp_extract_all(
        F.lower(text), F.lit(f"(?<![{WORD}])[a-z0-9]{{2,}}+(?![{WORD}])"), F.lit(0)
    )


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 10)


def fingerprint(kind: Column, text: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit(":"), collapse(F.lower(text))), 256)


def slugify(value: Column, fallback: str = "") -> Column:
    dashed = F.regexp_replace(F.lower(strip(value)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def snippet(text: Column, size: int = 500) -> Column:
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))
    ).otherwise(text)


def is_boilerplate(text: Column) -> Column:
    return strip(F.lower(text)).rlike(BOILERPLATE_RE)


def has_minimal_content(text: Column) -> Column:
    def enough_words(found: Column) -> Column:
        distinct = F.array_distinct(
            F.transform(F.filter(found, lambda w: F.length(w) > 1), lambda w: F.lower(w))
        )
        return (F.size(found) >= MIN_WORDS) & (F.size(distinct) >= MIN_DISTINCT_WORDS)

    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    visible = F.length(F.replace(text, F.lit(" "), F.lit("")))
    return let(words(text), enough_words) & (letters >= visible * MIN_LETTER_SHARE)


def validate_chunk(text: Column, token_count: Column) -> Column:
    def good(body: Column) -> Column:
        return (body != "") & ~is_boilerplate(body) & has_minimal_content(body)

    return (token_count >= MIN_TOKENS) & let(strip(text), good)


def parse_query(raw: Column) -> Column:
    """Struct of text, phrases, excluded, project and decision_status for a query string.

    Order of removal: phrases, project, decision status (only when valid), exclusions.
    """
    phrase_re, project_re, status_re = (
        '"([^"]+)"',
        rf"(?i)\bproject:([^{SPACES}]+)",
        rf"(?i)\bdecision:([^{SPACES}]+)",
    )
    exclude_re = rf"(?:^|[{SPACES}])-([^{SPACES}]+)"
    phrases = F.filter(
        F.transform(F.regexp_extract_all(raw, F.lit(phrase_re), F.lit(1)), strip),
        lambda p: p != "",
    )
    no_phrases = F.regexp_replace(raw, phrase_re, " ")
    project = F.nullif(F.regexp_extract(no_phrases, project_re, 1), F.lit(""))
    no_project = F.regexp_replace(no_phrases, project_re, " ")
    candidate = F.lower(F.regexp_extract(no_project, status_re, 1))
    valid = candidate.isin(DECISION_STATUSES)
    no_status = F.when(valid, F.regexp_replace(no_project, status_re, " ")).otherwise(no_project)
    excluded = F.transform(
        F.filter(
            F.regexp_extract_all(no_status, F.lit(exclude_re), F.lit(1)),
            lambda t: ~F.startswith(t, F.lit("-")),
        ),
        lambda t: F.lower(t),
    )
    rest = collapse(F.regexp_replace(no_status, exclude_re, " "))
    text = F.when((rest == "") & (F.size(phrases) > 0), F.array_join(phrases, " ")).otherwise(rest)
    return F.struct(
        text.alias("text"),
        phrases.alias("phrases"),
        excluded.alias("excluded"),
        project.alias("project"),
        F.when(valid, candidate).alias("decision_status"),
    )


def _beside(content: Column, values: Column) -> Column:
    """Each value with the lower-cased content beside it.

    The lambdas below then use nothing but their own variable: a lambda over an outer column may be
    moved below a join, where that column does not exist.
    """
    return F.arrays_zip(values.alias("value"), F.array_repeat(F.lower(content), F.size(values)).alias("low"))


def has_all_phrases(content: Column, phrases: Column) -> Column:
    """Every phrase is a case-insensitive substring (true for an empty list)."""
    return F.forall(_beside(content, phrases), lambda z: F.contains(z["low"], F.lower(z["value"])))


def has_any_term(content: Column, terms: Column) -> Column:
    return F.exists(_beside(content, terms), lambda z: F.contains(z["low"], z["value"]))


def highlight_words(query: Column) -> Column:
    """Words of a query worth marking: no syntax, three or more characters, no stop word."""
    plain = F.regexp_replace(query, '"[^"]*"', " ")
    plain = F.regexp_replace(plain, rf"project:[^{SPACES}]+", " ")
    plain = F.regexp_replace(plain, rf"-[^{SPACES}]+", " ")
    return F.filter(
        words(F.lower(plain)),
        lambda w: (F.length(w) >= 3) & ~w.isin(HIGHLIGHT_STOP_WORDS),
    )


def highlight_pattern(terms: Column) -> Column:
    """Case-insensitive whole-word alternation of the terms; NULL when there is none."""
    quoted = F.transform(terms, lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}_])", r"\\$1"))
    return F.when(
        F.size(terms) > 0, F.concat(F.lit(r"(?iU)\b("), F.array_join(quoted, "|"), F.lit(r")\b"))
    )


def audit_text(answer: Column) -> Column:
    """Answer without citation markers and ellipses, white space collapsed."""
    bare = F.regexp_replace(F.replace(answer, F.lit("..."), F.lit("")), r"\[\d+\]", "")
    return collapse(bare)
