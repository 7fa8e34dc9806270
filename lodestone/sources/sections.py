"""Sectioning of texts. Sections are an array in the document's own row, so no shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import SPACES, let, strip
from lodestone.schemas import LOCATOR, SECTION

# ATX heading, title of the part before the first one.
HEADING_RE = rf"(?d)^(#{{1,6}})[{SPACES}]+(.+)$"
DOCUMENT_START = "(document start)"

NO_BOOKMARKS = "No bookmark entries found."
BROKEN_RECIPE = "Invalid recipe JSON."

# Keys of the metadata section of a recipe, in order.
RECIPE_METADATA = ["prep_time", "cook_time", "servings", "difficulty", "cuisine"]


def locator(**fields: Column) -> Column:
    """Locator struct with the given fields, NULL elsewhere."""
    return F.struct(
        *[
            fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOCATOR.fields
        ]
    )


def section(content: Column, kind: str, where: Column, extra: Column | None = None) -> Column:
    return F.struct(
        content.alias("content"),
        F.lit(kind).alias("locator_type"),
        where.alias("locator"),
        (extra if extra is not None else F.lit(None).cast("map<string,string>")).alias("extra"),
    )


def markdown_section_array(content: Column) -> Column:
    """One section per ATX heading, with heading, level and line range.

    The lines are split once and bound; every section is a slice of them.
    """

    def build(body: Column, starts: Column):
        def one(start: Column, place: Column) -> Column:
            first = F.get(body, start - 1)
            end = F.coalesce(F.get(starts, place + 1) - 1, F.size(body))
            heading = F.nullif(strip(F.regexp_extract(first, HEADING_RE, 2)), F.lit(""))
            return section(
                strip(F.array_join(F.slice(body, start, end - start + 1), "\n")),
                "heading",
                locator(
                    heading=F.coalesce(heading, F.lit(DOCUMENT_START)),
                    heading_level=F.length(F.regexp_extract(first, HEADING_RE, 1)),
                    start_line=start,
                    end_line=end,
                ),
            )

        return one

    def cut(body: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(body)), lambda i: (i == 1) | F.get(body, i - 1).rlike(HEADING_RE)
        )
        return let(starts, lambda found: F.transform(found, build(body, found)))

    return let(F.split(content, "\n"), cut)


def markdown_sections(documents: DataFrame) -> DataFrame:
    """Adds ``sections`` of Markdown texts."""
    return documents.withColumn("sections", markdown_section_array(F.col("content")))


def section_windows(lines: DataFrame, *, by: str = "document_id") -> DataFrame:
    """Number of headings seen so far per document, for tables that hold one row per line."""
    from lodestone.operators.ranking import running_total

    is_heading = F.when(F.col("line").rlike(HEADING_RE), 1).otherwise(0)
    return running_total(lines, [by], "line_no", is_heading, "section_no")


def document_title(sections: Column, path: Column) -> Column:
    """First level-1 heading, or the file name without its extension."""
    top = F.filter(sections, lambda s: s["locator"]["heading_level"] == 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.get(top, F.lit(0))["locator"]["heading"], stem)


def unescape(text: Column) -> Column:
    """The common HTML character references."""
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


LINK_RE = r"""(?is)<a\s[^>]*?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)[^>]*>.*?</a\s*>"""
HREF_RE = r"""(?is)^<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""


def _link(tag: Column) -> Column:
    """title, url and added_at of one anchor element."""
    url = unescape(F.concat(*[F.regexp_extract(tag, HREF_RE, i) for i in (1, 2, 3)]))
    title = strip(unescape(F.regexp_replace(F.regexp_replace(tag, r"(?is)^<a\s[^>]*>|</a\s*>$", ""), r"<[^>]*>", "")))
    added = F.regexp_extract(tag, r"""(?is)^<a\s[^>]*?add_date\s*=\s*["']?(\d+)""", 1).try_cast("long")
    return F.struct(
        F.when(title == "", url).otherwise(title).alias("title"),
        url.alias("url"),
        F.timestamp_seconds(added).cast("timestamp_ntz").alias("added_at"),
    )


def html_links(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """One row per anchor with a target: position, title (the URL when blank), url, added_at."""
    tags = F.regexp_extract_all(html, F.lit(LINK_RE), F.lit(0))
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(*keep, F.posexplode_outer(tags).alias("position", "_tag")).where("_tag IS NOT NULL")
    return rows.select(*keep, "position", _link(F.col("_tag")).alias("_l")).select(
        *keep, "position", "_l.*"
    ).where("url <> ''")


def bookmark_entries(html: Column) -> Column:
    """Array of (folder, title, url, added_at) of one bookmark export.

    A fold over its tags keeps the stack of open lists. A list pushes the folder named by the
    heading before it, or an empty mark when there is none.
    """
    tags_re = rf"(?is)<h3[^>]*>.*?</h3\s*>|<dl\b|</dl\s*>|{LINK_RE[5:]}"
    link_type = "array<struct<folder:string,title:string,url:string,added_at:timestamp_ntz>>"

    def state(open_: Column, pending: Column, links: Column) -> Column:
        return F.struct(open_.alias("open"), pending.alias("pending"), links.alias("links"))

    def step(acc: Column, tag: Column) -> Column:
        low = F.lower(tag)
        name = strip(unescape(F.regexp_replace(tag, r"<[^>]*>", "")))
        link = _link(tag)
        folder = F.array_join(F.filter(acc["open"], lambda f: f != ""), " / ")
        row = F.struct(
            folder.alias("folder"),
            link["title"].alias("title"),
            link["url"].alias("url"),
            link["added_at"].alias("added_at"),
        )
        shorter = F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        named = F.when(name == "", acc["pending"]).otherwise(name)
        return (
            F.when(low.startswith("<h3"), state(acc["open"], named, acc["links"]))
            .when(low.startswith("<dl"), state(F.array_append(acc["open"], acc["pending"]), F.lit(""), acc["links"]))
            .when(low.startswith("</dl"), state(shorter, acc["pending"], acc["links"]))
            .when(link["url"] == "", acc)
            .otherwise(state(acc["open"], acc["pending"], F.array_append(acc["links"], row)))
        )

    none = F.array().cast("array<string>")
    start = state(none, F.lit(""), F.array().cast(link_type))
    tags = F.regexp_extract_all(html, F.lit(tags_re), F.lit(0))
    return F.aggregate(tags, start, step, lambda acc: acc["links"])


def bookmark_links(exports: DataFrame, *, html: str = "html") -> DataFrame:
    """One row per link of bookmark exports, with the path of folders it sits in."""
    keep = [c for c in exports.columns if c != html]
    entries = bookmark_entries(F.col(html))
    rows = exports.select(*keep, F.posexplode_outer(entries).alias("position", "_l")).where("_l IS NOT NULL")
    return rows.select(*keep, "position", "_l.*")


def bookmark_section(entry: Column) -> Column:
    """Section of a bookmark entry: ``[title](url)`` and the folder line."""
    folder = F.when(entry["folder"] == "", "Unfiled").otherwise(entry["folder"])
    extra = F.map_filter(
        F.create_map(
            F.lit("folder"),
            F.nullif(entry["folder"], F.lit("")),
            F.lit("added_at"),
            F.date_format(entry["added_at"], "yyyy-MM-dd'T'HH:mm:ss"),
        ),
        lambda _, v: v.isNotNull(),
    )
    content = F.concat(F.lit("["), entry["title"], F.lit("]("), entry["url"], F.lit(")\nFolder: "), folder)
    return section(content, "section", locator(section=entry["title"]), extra)


def bookmark_section_array(content: Column) -> Column:
    return F.transform(bookmark_entries(content), bookmark_section)


def bookmark_sections(documents: DataFrame) -> DataFrame:
    """Adds ``sections`` of bookmark exports, and ``error`` where there is no link."""
    return documents.withColumn("sections", bookmark_section_array(F.col("content"))).withColumn(
        "error", F.when(F.size("sections") == 0, NO_BOOKMARKS)
    )


RECIPE = T.StructType(
    [T.StructField(k, T.StringType()) for k in ("name", "description", "notes", *RECIPE_METADATA)]
    + [T.StructField(k, T.ArrayType(T.StringType())) for k in ("ingredients", "instructions")]
)


def recipe_section_array(json: Column) -> Column:
    """Description, metadata, ingredients, instructions and notes; NULL when the JSON is broken."""

    def ingredient(item: Column) -> Column:
        both = F.concat_ws(
            " ",
            F.coalesce(F.get_json_object(item, "$.amount"), F.lit("")),
            F.coalesce(F.get_json_object(item, "$.item"), F.lit("")),
        )
        return F.when(item.startswith("{"), strip(F.concat(F.lit("- "), both))).otherwise(
            F.concat(F.lit("- "), item)
        )

    def listed(heading: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"## {heading}\n"), F.array_join(items, "\n")))

    def build(r: Column) -> Column:
        metadata = F.array_compact(
            F.array(*[F.concat(F.lit(f"{k.replace('_', ' ').title()}: "), r[k]) for k in RECIPE_METADATA])
        )
        steps = F.transform(
            r["instructions"], lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)
        )
        title = F.concat(F.lit("# "), r["name"], F.lit("\n\n"), r["description"])
        parts = {
            "description": F.when(r["description"] != "", title),
            "metadata": F.when(F.size(metadata) > 0, F.array_join(metadata, "\n")),
            "ingredients": listed("Ingredients", F.transform(r["ingredients"], ingredient)),
            "instructions": listed("Instructions", steps),
            "notes": F.when(r["notes"] != "", F.concat(F.lit("## Notes\n\n"), r["notes"])),
        }
        found = [
            F.when(c.isNotNull(), section(c, "section", locator(section=F.lit(n)))) for n, c in parts.items()
        ]
        names = F.array(*[r[f.name].isNull() for f in RECIPE.fields])
        return F.when(~F.forall(names, lambda missing: missing), F.array_compact(F.array(*found)))

    return let(F.from_json(json, RECIPE), build)


def recipe_sections(recipes: DataFrame, *, column: str = "json") -> DataFrame:
    """Adds ``sections`` of JSON recipes, and ``error`` where the JSON is broken."""
    return recipes.withColumn("sections", recipe_section_array(F.col(column))).withColumn(
        "error", F.when(F.col("sections").isNull(), BROKEN_RECIPE)
    )


def git_locator(documents: DataFrame, *, url: str, commit: str) -> DataFrame:
    """Documents of a checked-out tree: ``url#path`` as path, file and short commit in locators."""

    def place(s: Column) -> Column:
        where = s["locator"].withField("git_file", F.col("relative_path")).withField("git_commit", F.lit(commit[:8]))
        return s.withField("locator", where)

    return (
        documents.withColumn("sections", F.transform("sections", place))
        .withColumn("source_path", F.concat(F.lit(f"{url}#"), "relative_path"))
        .withColumn("source_type", F.lit("git"))
        .withColumn("git_repo", F.lit(url))
        .withColumn("git_commit", F.lit(commit))
    )


Sectioner = Callable[[str, str], list[dict]]
ByteSectioner = Callable[[str, bytes], list[dict]]

#: Error rows that are no failure of a sectioner start with this.
UNSUPPORTED = "No sectioner for "


def custom_sections(documents: DataFrame, sectioner: Sectioner | ByteSectioner, column: str = "content") -> DataFrame:
    """Sections from a Python callable, for formats Spark has no functions for.

    ``sectioner(path, content)``, which gets what ``column`` holds, returns dicts with content, locator_type, locator (dict of known
    keys) and optionally extra. A failure fills ``error`` for that document only.
    """
    schema = T.StructType(
        [*documents.schema.fields, T.StructField("sections", T.ArrayType(SECTION)), T.StructField("error", T.StringType())]
    )
    arrow_type = to_arrow_type(T.ArrayType(SECTION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column("source_path").to_pylist(), batch.column(column).to_pylist()
            sections, errors = [], []
            for path, content in zip(paths, texts, strict=True):
                try:
                    sections.append(sectioner(path, content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    sections.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sections, arrow_type), pa.array(errors, pa.string())],
                names=[*batch.schema.names, "sections", "error"],
            )

    return documents.mapInArrow(run, schema)


def parse_locators(rows: DataFrame, column: str) -> DataFrame:
    """JSON locator text to the struct of known keys and a map of the others."""
    known = [f.name for f in LOCATOR.fields]
    everything = F.from_json(column, "map<string,string>")
    return rows.withColumn("locator", F.from_json(column, LOCATOR)).withColumn(
        "extra", F.map_filter(everything, lambda k, _: ~k.isin(known))
    )


def sections_by_type(
    documents: DataFrame,
    sectioners: dict[str, Sectioner] | None = None,
    byte_sectioners: dict[str, ByteSectioner] | None = None,
) -> DataFrame:
    """Adds ``sections`` and ``error`` by source type; every document comes out with one of them.

    Markdown, bookmarks and JSON recipes are built in and share one pass over the texts; ``sectioners`` adds or replaces
    types. ``byte_sectioners`` get the file's bytes, from a column ``bytes``; the content of such a document is that of
    its sections. A document of another type, or a recipe in YAML, gets an error that names the type.
    """
    sectioners, byte_sectioners = sectioners or {}, byte_sectioners or {}
    own = {*sectioners, *byte_sectioners}
    built_in = {
        "markdown": (markdown_section_array, None),
        "bookmarks": (bookmark_section_array, NO_BOOKMARKS),
        "recipe": (recipe_section_array, BROKEN_RECIPE),
    }
    kind, content = F.col("source_type"), F.col("content")
    sections = error = F.lit(None)
    for name, (fn, message) in built_in.items():
        if name not in own:
            sections = F.when(kind == name, fn(content)).otherwise(sections)
            empty = F.coalesce(F.size("sections"), F.lit(0)) <= 0
            error = F.when((kind == name) & empty, F.lit(message)).otherwise(error)
    known = kind.isin([n for n in built_in if n not in own])
    if "recipe" not in own and "source_path" in documents.columns:
        known = known & ~((kind == "recipe") & F.lower("source_path").endswith(".yaml"))
    sections = F.when(known, sections)
    error = F.when(F.coalesce(known, F.lit(False)), error).otherwise(
        F.concat(F.lit(UNSUPPORTED), F.coalesce(kind, F.lit("unknown type")), F.when(kind == "recipe", " in YAML").otherwise(""))
    )
    others = documents.where(F.coalesce(~kind.isin(list(own)), F.lit(True))) if own else documents
    result = others.withColumn("sections", sections).withColumn("error", error.cast("string"))
    for name, fn in sectioners.items():
        result = result.unionByName(custom_sections(documents.where(kind == name), fn))
    for name, fn in byte_sectioners.items():
        found = custom_sections(documents.where(kind == name), fn, "bytes")
        joined = F.array_join(F.transform("sections", lambda s: s["content"]), "\n\n")
        result = result.unionByName(found.withColumn("content", F.when(F.col("error").isNull(), joined)))
    return result.drop("bytes")
