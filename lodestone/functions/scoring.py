"""Priorities and locator text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priorities run from 1 (first) to 5 (last).
TOP, BOTTOM = 1, 5


def priority_from_count(value: Column) -> Column:
    clamped = F.greatest(F.lit(TOP), F.least(F.lit(BOTTOM), value))
    return (F.lit(TOP + BOTTOM) - clamped).cast("int")


def priority_from_ratio(value: Column, scale: int = 10) -> Column:
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return priority_from_count(F.floor(ratio * scale))


def smallest_bucket(buckets: Column) -> Column:
    """Count in the smallest age bucket of ``array<struct<days,count>>``; 0 when empty."""
    return F.coalesce(F.get(F.array_sort(buckets), F.lit(0))["count"], F.lit(0))


def format_locator(kind: Column, loc: Column) -> Column:
    """Readable text of a locator struct."""

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(loc[name].cast("string"), F.lit(default))

    git = F.coalesce(loc["git_file"], F.lit(""))
    commit = text("git_commit")
    span = F.concat(F.lit(" (lines "), text("start_line", "0"), F.lit("-"), text("end_line", "0"), F.lit(")"))
    heading = F.concat(F.lit('heading: "'), text("heading"), F.lit('"'), span)
    under = F.coalesce(F.nullif(loc["parent_heading"], F.lit("")), loc["heading"], F.lit(""))
    paragraph = F.concat(F.lit("paragraph "), text("paragraph_index", "0"))
    first_line = F.coalesce(F.nullif(loc["start_line"], F.lit(0)), loc["line"]).cast("string")
    line_span = F.concat(
        F.coalesce(first_line, F.lit("None")),
        F.when(loc["end_line"] != 0, F.concat(F.lit("-"), text("end_line"))).otherwise(""),
    )
    return (
        F.when(
            kind == "heading",
            F.when(git != "", F.concat(git, F.lit(":"), commit, F.lit(" "), heading)).otherwise(heading),
        )
        .when(kind == "page", F.concat(F.lit("page "), text("page", "0"), F.lit("/"), text("total_pages", "0")))
        .when(
            kind == "paragraph",
            F.when(under != "", F.concat(paragraph, F.lit(' under "'), under, F.lit('"'))).otherwise(paragraph),
        )
        .when(
            kind == "sheet",
            F.concat(F.lit('sheet "'), text("sheet_name"), F.lit('" ('), text("row_count", "0"), F.lit(" rows)")),
        )
        .when(kind == "section", F.concat(F.lit("section: "), text("section")))
        .when(
            kind == "line",
            F.when(
                git != "",
                F.concat(
                    git,
                    F.when(commit != "", F.concat(F.lit(":"), commit)).otherwise(""),
                    F.lit(" lines "),
                    line_span,
                ),
            ).otherwise(F.concat(F.lit("lines "), line_span)),
        )
        .otherwise(F.to_json(loc))
    )
