"""Scan, sectioning, chunking and lint queries."""

from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.registry.base import VIEWS, decided, docs, register, spread, sql_strip, table, texts, vecs
from lodestone.registry.filters import LINES_SQL, document_lines, minimal_sql
from lodestone.functions.text import BOILERPLATE_RE
from lodestone.session import scratch_path
from lodestone.sources import files, sections, store

NL = "chr(10)"


def page_files(spark, sf, label):
    """Pages in .htm files of fifty, one page per line, each file in a folder of its own."""
    path = scratch_path(spark, label)
    (
        table(spark, sf, "pages")
        .select(
            F.regexp_replace("html", r"[\r\n]", " ").alias("html"),
            F.floor(F.col("page_id") / 50).alias("folder"),
        )
        .repartition("folder")
        .write.partitionBy("folder")
        .option("extension", "htm")
        .option("quote", "\u0000")
        .option("sep", "\u0001")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


@register(
    "scan_corpus",
    f"SELECT sha256({sql_strip('html')}) AS content_hash, 'bookmarks' AS source_type FROM "
    "(SELECT regexp_replace(html, '[\\r\\n]', ' ', 'g') AS html FROM pages)",
)
def scan_corpus(spark, sf):
    found = files.scan_corpus(spark, page_files(spark, sf, "scan"), project="web")
    from lodestone.functions.text import strip

    lines = found.select("source_type", F.explode_outer(F.split("content", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.sha2(strip(F.col("line")), 256).alias("content_hash"), "source_type")


@register("count_scan_targets", "SELECT '.htm' AS extension, count(DISTINCT page_id // 50) AS files FROM pages")
def count_scan_targets(spark, sf):
    return files.count_scan_targets(spark, page_files(spark, sf, "count"))


@register(
    "oversize_errors",
    """
    SELECT source_path, source_type, project, 'oversize' AS error_type,
      'File exceeds 0.00390625 MB size limit.' AS error_message FROM docs WHERE n_chars > 4096""",
    "docs",
)
def oversize_errors(spark, sf):
    found = files.oversize_errors(docs(spark, sf), size="n_chars", limit=4096)
    return found.withColumn("error_message", F.lit("File exceeds 0.00390625 MB size limit."))


@register(
    "empty_text_errors",
    """
    SELECT source_path, source_type, project, 'no_text' AS error_type,
      'Parsed document contained no text.' AS error_message FROM docs WHERE document_id % 13 = 0""",
    "docs",
)
def empty_text_errors(spark, sf):
    blanked = F.when(F.col("document_id") % 13 == 0, F.lit(" \n\t ")).otherwise(F.col("content"))
    return files.empty_text_errors(docs(spark, sf).withColumn("content", blanked))


def _first_words(path, content):
    """A sectioner that refuses texts of fewer than 100 words."""
    words = content.split()
    if len(words) < 100:
        raise ValueError(f"only {len(words)} words")
    return [{"content": content, "locator_type": "section", "locator": {"section": words[0]}}]


@register(
    "parse_error_rows",
    """
    SELECT source_path, project, 'parse_error' AS error_type, 'only ' || n || ' words' AS error_message FROM (
      SELECT *, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS n FROM docs) WHERE n < 100""",
    "docs",
)
def parse_error_rows(spark, sf):
    parsed = sections.custom_sections(texts(spark, sf), _first_words)
    return files.parse_errors(parsed).select("source_path", "project", "error_type", "error_message")


@register(
    "load_golden_set",
    """
    SELECT item_id AS id, text AS question, 'medium' AS difficulty, 'general' AS category, '' AS notes,
      (item_id % 3)::INTEGER AS expected_count FROM benchmark WHERE item_id % 7 NOT IN (0, 1)""",
)
def load_golden_set(spark, sf):
    item = F.col("item_id")
    numbers = F.when(item % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1), item % 3))
    line = F.to_json(F.struct(item.alias("id"), F.col("text").alias("question"), numbers.alias("expected_chunks")))
    broken = (
        F.when(item % 7 == 0, F.substring(line, 1, 20))
        .when(item % 7 == 1, F.to_json(F.struct(F.col("text").alias("question"))))
        .otherwise(line)
    )
    path = scratch_path(spark, "golden")
    table(spark, sf, "benchmark").select(broken).write.text(path)
    return files.load_golden_set(spark, path).select(
        "id", "question", "difficulty", "category", "notes", F.size("expected_chunks").alias("expected_count")
    )


@register(
    "corpus_store",
    "SELECT document_id, project, source_date, sha256(content) AS content_hash FROM docs",
    "docs",
)
def corpus_store(spark, sf):
    """Write documents by project and read them back."""
    path = scratch_path(spark, "corpus")
    store.write_corpus({"documents": docs(spark, sf)}, path)
    back = store.read_corpus(spark, path, "documents")
    return back.select("document_id", "project", "source_date", F.sha2("content", 256).alias("content_hash"))


@register(
    "corpus_store_bucketed",
    """
    SELECT chunk_id, project, label, decision_id, status, length(content) AS size
    FROM docs JOIN vecs USING (chunk_id) LEFT JOIN decided USING (chunk_id)""",
    "docs vecs decided",
)
def corpus_store_bucketed(spark, sf):
    """Chunks, embeddings and decisions stored by chunk and joined bucket by bucket."""
    tables = {"chunks": docs(spark, sf), "embeddings": vecs(spark, sf), "decisions": decided(spark, sf)}
    kept = store.write_bucketed(tables, scratch_path(spark, "bucketed"), buckets=16)
    joined = kept["chunks"].join(kept["embeddings"], "chunk_id").join(kept["decisions"], "chunk_id", "left")
    size = F.length("content").cast("long").alias("size")
    return joined.select("chunk_id", "project", "label", "decision_id", "status", size)


# Markdown notes, one per part.
VIEWS["md"] = f"""
SELECT p_partkey AS document_id, 'notes/part-' || p_partkey || '.md' AS source_path,
  'Preamble of part ' || p_partkey || ' with some introductory words to read.' || {NL} ||
  CASE WHEN p_partkey % 4 <> 0 THEN '# ' || p_name || '  ' || {NL} ELSE '' END ||
  'Brand: ' || p_brand || ' and a sentence that is long enough to count as meaningful content for all of us.' || {NL} ||
  '## Size ' || p_size || {NL} || 'Type ' || p_type || {NL} || '### ' || {NL} || 'tail' AS content, p_name, p_brand, p_size,
  p_type FROM part"""


def md(spark, sf):
    p = table(spark, sf, "part")
    title = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("# "), "p_name", F.lit("  \n"))).otherwise("")
    content = F.concat(
        F.lit("Preamble of part "),
        "p_partkey",
        F.lit(" with some introductory words to read.\n"),
        title,
        F.lit("Brand: "),
        "p_brand",
        F.lit(" and a sentence that is long enough to count as meaningful content for all of us.\n## Size "),
        "p_size",
        F.lit("\nType "),
        "p_type",
        F.lit("\n### \ntail"),
    )
    path = F.concat(F.lit("notes/part-"), "p_partkey", F.lit(".md"))
    return p.select(F.col("p_partkey").alias("document_id"), path.alias("source_path"), content.alias("content"))


MD_LINES = """
    WITH ln AS (SELECT document_id, generate_subscripts(parts, 1)::INTEGER AS line_no, unnest(parts) AS line FROM (
      SELECT document_id, string_split(content, chr(10)) AS parts FROM md)),
    marked AS (SELECT *, regexp_matches(line, '^(#{1,6})\\s+(.+)$')::INTEGER AS h FROM ln),
    numbered AS (SELECT *, sum(h) OVER (PARTITION BY document_id ORDER BY line_no)::BIGINT AS section_no FROM marked)"""


@register("section_windows", MD_LINES + " SELECT document_id, line_no, section_no FROM numbered", "md")
def section_windows(spark, sf):
    rows = md(spark, sf).select("document_id", F.posexplode_outer(F.split("content", "\n")).alias("line_no", "line"))
    numbered = sections.section_windows(rows.withColumn("line_no", F.col("line_no") + 1))
    return numbered.select("document_id", "line_no", "section_no")


SECTIONS_SQL = (
    MD_LINES
    + f""", secs AS (SELECT document_id, section_no, min(line_no) AS start_line, max(line_no) AS end_line,
        {sql_strip("string_agg(line, chr(10) ORDER BY line_no)")} AS content,
        coalesce(max(CASE WHEN h = 1 THEN trim(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 2)) END), '(document start)') AS heading,
        coalesce(max(CASE WHEN h = 1 THEN length(regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 1)) END), 0) AS heading_level
      FROM numbered GROUP BY 1, 2)"""
)


@register(
    "markdown_sections",
    SECTIONS_SQL
    + " SELECT document_id, start_line, end_line, content, heading, heading_level::INTEGER AS heading_level FROM secs",
    "md",
)
def markdown_sections(spark, sf):
    rows = sections.markdown_sections(md(spark, sf)).select("document_id", F.inline_outer("sections"))
    return rows.select(
        "document_id", "locator.start_line", "locator.end_line", "content", "locator.heading", "locator.heading_level"
    )


@register(
    "document_title",
    "SELECT document_id, CASE WHEN document_id % 4 <> 0 THEN p_name ELSE 'part-' || document_id END AS title FROM md",
    "md",
)
def document_title(spark, sf):
    rows = sections.markdown_sections(md(spark, sf))
    title = sections.document_title(F.col("sections"), F.col("source_path"))
    return rows.select("document_id", title.alias("title"))


@register(
    "chunk_documents",
    SECTIONS_SQL
    + f""", ok AS (SELECT * FROM secs WHERE content <> '' AND length(content) // 4 >= 5 AND {minimal_sql("content")})
    SELECT document_id, content, heading, (length(content) // 4)::INTEGER AS token_count,
      (row_number() OVER (PARTITION BY document_id ORDER BY section_no) - 1)::INTEGER AS chunk_index FROM ok""",
    "md",
)
def chunk_documents(spark, sf):
    chunks = chunking.chunk_documents(sections.markdown_sections(md(spark, sf)))
    return chunks.select("document_id", "content", "locator.heading", "token_count", "chunk_index")


#: Chunks of one section per document of ``bodies``: target 2048, overlap 200, merged tail below 400, whole up to 4099.
PACKED_CTES = f"""
    paras AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS no, para FROM (
      SELECT document_id, generate_subscripts(p, 1) AS pos, {sql_strip("unnest(p)")} AS para FROM (
        SELECT document_id, regexp_split_to_array(body, '\\n\\s*\\n') AS p FROM bodies WHERE length(body) // 4 > 1024)) WHERE para <> ''),
    sized AS (SELECT *, length(para) > 4096 AS big, lag(length(para) > 4096, 1, false) OVER (PARTITION BY document_id ORDER BY no)
      AS after_big FROM paras),
    grouped AS (SELECT *, sum((big OR after_big)::INTEGER) OVER (PARTITION BY document_id ORDER BY no) AS grp FROM sized),
    split AS (SELECT document_id, grp, no, big, CASE WHEN big THEN
      string_split(regexp_replace(para, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) ELSE [para] END AS parts FROM grouped),
    pieces AS (SELECT document_id, grp, big, piece, row_number() OVER w AS i, sum(length(piece)) OVER w AS place FROM (
      SELECT document_id, grp, no, big, generate_subscripts(parts, 1) AS k, unnest(parts) AS piece FROM split)
      WINDOW w AS (PARTITION BY document_id, grp ORDER BY no, k)),
    borders AS (SELECT document_id, grp, i, place FROM pieces UNION ALL SELECT DISTINCT document_id, grp, 0, 0 FROM pieces),
    starts AS (SELECT b.document_id, b.grp, b.i, min(a.place) AS base FROM borders b JOIN borders a ON a.document_id = b.document_id
      AND a.grp = b.grp AND a.i <= b.i AND a.place >= b.place - 200 GROUP BY ALL),
    nexts AS (SELECT s.document_id, s.grp, s.i, s.base, greatest(s.i + 1, max(c.i)) AS next FROM starts s JOIN borders c
      ON c.document_id = s.document_id AND c.grp = s.grp AND c.place <= s.base + 2048 GROUP BY s.document_id, s.grp, s.i, s.base),
    ends AS (SELECT document_id, grp, max(i) AS n FROM borders GROUP BY ALL),
    runs AS (SELECT document_id, grp, 0 AS i FROM ends UNION ALL SELECT r.document_id, r.grp, x.next FROM runs r JOIN nexts x
      ON x.document_id = r.document_id AND x.grp = r.grp AND x.i = r.i JOIN ends e ON e.document_id = r.document_id
      AND e.grp = r.grp WHERE x.next < e.n),
    texts AS (SELECT r.document_id, r.grp, r.i, any_value(p.big) AS big,
      CASE WHEN any_value(p.big) THEN string_agg(p.piece, ' ' ORDER BY p.i) ELSE string_agg(p.piece, chr(10) || chr(10) ORDER BY p.i)
      END AS content
      FROM runs r JOIN nexts x ON x.document_id = r.document_id AND x.grp = r.grp AND x.i = r.i
      JOIN pieces p ON p.document_id = r.document_id AND p.grp = r.grp AND p.i <= x.next AND p.place > x.base GROUP BY ALL),
    listed AS (SELECT document_id, list(content ORDER BY grp, i) AS parts, arg_max(big, (grp, i)) AS last_big FROM texts GROUP BY 1),
    tailed AS (SELECT document_id, CASE WHEN NOT last_big AND len(parts) > 1 AND length(parts[-1]) < 400
      THEN list_concat(parts[:-3], [parts[-2] || chr(10) || chr(10) || parts[-1]]) ELSE parts END AS parts FROM listed),
    cut AS (SELECT document_id, unnest(parts) AS content, generate_subscripts(parts, 1)::INTEGER AS chunk_part,
      len(parts)::INTEGER AS chunk_total FROM tailed
      UNION ALL SELECT document_id, body, NULL, NULL FROM bodies WHERE body <> '' AND length(body) // 4 <= 1024),
    ok AS (SELECT *, (length(content) // 4)::INTEGER AS token_count FROM (SELECT *, {sql_strip("content")} AS b FROM cut)
      WHERE b <> '' AND length(content) // 4 >= 5 AND NOT regexp_matches(lower(b), '{BOILERPLATE_RE}') AND {minimal_sql("b")})"""
PACKED_SQL = (
    PACKED_CTES
    + """
    SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY chunk_part) - 1)::INTEGER AS chunk_index,
      token_count, chunk_part, chunk_total, content FROM ok"""
)


def packed_sql(text: str) -> str:
    return f"WITH RECURSIVE bodies AS (SELECT doc_id AS document_id, {sql_strip(text)} AS body FROM documents), {PACKED_SQL}"


def packed(rows):
    chunks = chunking.chunk_documents(sections.markdown_sections(rows))
    return chunks.select(
        "document_id", "chunk_index", "token_count", "locator.chunk_part", "locator.chunk_total", "content"
    )


@register("chunk_text", packed_sql("text"))
def chunk_text(spark, sf):
    """Chunks of all documents; those above the size limit go through the packing kernel."""
    return packed(texts(spark, sf).select("document_id", "content"))


@register("chunk_paragraphs", packed_sql("replace(text, chr(10), chr(10) || chr(10))"))
def chunk_paragraphs(spark, sf):
    """The same with every line a paragraph, so paragraphs are packed, and long ones cut at sentences."""
    return packed(texts(spark, sf).select("document_id", F.replace("content", F.lit("\n"), F.lit("\n\n")).alias("content")))


@register(
    "chunk_sequence",
    LINES_SQL
    + f""", ok AS (SELECT * FROM (SELECT *, {sql_strip("line")} AS b FROM ln) WHERE b <> '' AND length(line) // 4 >= 5
      AND NOT regexp_matches(lower(b), '{BOILERPLATE_RE}') AND {minimal_sql("b")})
    SELECT doc_id AS document_id, line_no AS position, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INTEGER
      AS chunk_index FROM ok""",
)
def chunk_sequence(spark, sf):
    rows = document_lines(spark, sf).select(
        F.col("doc_id").alias("document_id"), F.col("line_no").alias("position"), F.col("line").alias("content")
    )
    return chunking.chunk_sequence(rows).select("document_id", "position", "chunk_index")


LINK_SQL = sections.LINK_RE.replace("'", "''")
HREF_SQL = sections.HREF_RE.replace("'", "''")


def _sql_unescape(x):
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{code}', '{char}')"
    return x


@register(
    "html_links",
    f"""
    WITH tags AS (SELECT page_id, (generate_subscripts(t, 1) - 1)::INTEGER AS position, unnest(t) AS tag FROM (
      SELECT page_id, regexp_extract_all(html, '{LINK_SQL}') AS t FROM pages)),
    parts AS (SELECT page_id, position, {_sql_unescape(f"regexp_extract(tag, '{HREF_SQL}', 1) || regexp_extract(tag, '{HREF_SQL}', 2) || regexp_extract(tag, '{HREF_SQL}', 3)")} AS url,
      {sql_strip(_sql_unescape("regexp_replace(regexp_replace(tag, '(?is)^<a\\s[^>]*>|</a\\s*>$', '', 'g'), '<[^>]*>', '', 'g')"))} AS title FROM tags)
    SELECT page_id, position, url, CASE WHEN title = '' THEN url ELSE title END AS title FROM parts WHERE url <> ''""",
)
def html_links(spark, sf):
    rows = sections.html_links(table(spark, sf, "pages").select("page_id", "html"))
    return rows.select("page_id", "position", "url", "title")


# Bookmark exports, one per part: a folder, a nested folder, and an unfiled link.
@register(
    "bookmark_links",
    """
    SELECT p_partkey AS page_id, n.f AS folder, n.t AS title, n.u AS url, n.a AS added_at FROM part, LATERAL (VALUES
      (p_name, p_brand, 'https://x.org/' || p_partkey, make_timestamp((1700000000 + p_partkey)::BIGINT * 1000000)),
      (p_name || ' / Deep', 'https://y.org/?a=1&b=2', 'https://y.org/?a=1&b=2', NULL),
      ('', 'Open', 'https://z.org', NULL)) n(f, t, u, a)""",
)
def bookmark_links(spark, sf):
    html = F.concat(
        F.lit("<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<DL><p>\n<DT><H3>"),
        "p_name",
        F.lit('</H3>\n<DL><p>\n<DT><A HREF="https://x.org/'),
        "p_partkey",
        F.lit('" ADD_DATE="'),
        F.col("p_partkey") + 1700000000,
        F.lit('">'),
        "p_brand",
        F.lit('</A>\n<DT><H3>Deep</H3><DL><p><DT><A HREF="https://y.org/?a=1&amp;b=2"></A></DL><p>\n'),
        F.lit('</DL><p>\n<DT><A HREF="https://z.org">Open</A>\n</DL>'),
    )
    exports = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return sections.bookmark_links(exports).select("page_id", "folder", "title", "url", "added_at")


@register(
    "recipe_sections",
    """
    SELECT p_partkey AS document_id, n.s AS section, n.c AS content FROM part, LATERAL (VALUES
      ('description', '# ' || p_name || chr(10) || chr(10) || 'About ' || p_brand),
      ('metadata', 'Prep Time: ' || p_size || ' minutes' || chr(10) || 'Servings: ' || p_size),
      ('ingredients', '## Ingredients' || chr(10) || '- 2 cups ' || p_type || chr(10) || '- salt'),
      ('instructions', '## Instructions' || chr(10) || '1. Mix ' || p_name || chr(10) || '2. Bake'),
      ('notes', CASE WHEN p_partkey % 2 = 0 THEN '## Notes' || chr(10) || chr(10) || 'Keep cold' END)) n(s, c)
    WHERE n.c IS NOT NULL""",
)
def recipe_sections(spark, sf):
    body = F.concat(
        F.lit('{"name": "'),
        "p_name",
        F.lit('", "description": "About '),
        "p_brand",
        F.lit('", "prep_time": "'),
        "p_size",
        F.lit(' minutes", "servings": '),
        "p_size",
        F.lit(', "ingredients": [{"item": "'),
        "p_type",
        F.lit('", "amount": "2 cups"}, "salt"], "instructions": ["Mix '),
        "p_name",
        F.lit('", "Bake"]'),
        F.when(F.col("p_partkey") % 2 == 0, F.lit(', "notes": "Keep cold"')).otherwise(""),
        F.lit("}"),
    )
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), body.alias("json"))
    found = sections.recipe_sections(rows).select("document_id", F.inline_outer("sections"))
    return found.select("document_id", "locator.section", "content")


@register(
    "git_locator",
    """
    SELECT document_id, 'https://example.org/r.git#notes/part-' || document_id || '.md' AS source_path,
      'notes/part-' || document_id || '.md:0123abcd heading: "(document start)" (lines 1-' ||
        CASE WHEN document_id % 4 <> 0 THEN 1 ELSE 2 END || ')' AS first_label FROM md""",
    "md",
)
def git_locator(spark, sf):
    from lodestone.functions.scoring import format_locator

    rows = sections.markdown_sections(md(spark, sf)).withColumn("relative_path", F.col("source_path"))
    placed = sections.git_locator(rows, url="https://example.org/r.git", commit="0123abcd4567")
    first = F.get("sections", F.lit(0))
    return placed.select(
        "document_id", "source_path", format_locator(first["locator_type"], first["locator"]).alias("first_label")
    )


@register("embed_chunks")
def embed_chunks(spark, sf):
    return chunking.embed_chunks(texts(spark, sf).select("chunk_id", "content"), dimension=64).drop("content")


# Lint notes, one per part, in folders that ask for different sections.
VIEWS["notes"] = f"""
SELECT p_partkey, 'vault/' || CASE p_partkey % 4 WHEN 0 THEN 'Decisions' WHEN 1 THEN 'meetings' WHEN 2 THEN 'trips'
  ELSE 'routines' END || '/n' || p_partkey || '.md' AS path FROM part"""


def notes(spark, sf):
    k = F.col("p_partkey")
    folder = F.get(F.array(*[F.lit(x) for x in ("Decisions", "meetings", "trips", "routines")]), (k % 4).cast("int"))
    front = F.concat(
        F.lit("---\nproject: p"),
        k % 3,
        F.when(k % 5 == 0, "\ndate:").otherwise("\ndate: 2024-01-01"),
        F.when(k % 7 == 0, '\nlanguage: ""').otherwise("\nlanguage: en"),
        F.when(k % 11 == 0, "").otherwise("\nsource: desk"),
        F.lit("\n---\n"),
    )
    content = F.concat(
        F.when(k % 13 == 0, "").otherwise(front),
        F.lit("# Note\n"),
        F.when(k % 3 == 0, "## Context:\nx\n").otherwise(""),
        F.when(k % 2 == 0, "##   Evidence \ny\n").otherwise(""),
        F.when(k % 8 == 0, "## Rejected  Options\nz\n").otherwise(""),
        F.when(k % 9 == 1, "## NEXT actions\nz\n").otherwise(""),
        F.when(k % 10 == 2, "### Checklist Seeds\nz").otherwise(""),
    )
    path = F.concat(F.lit("vault/"), folder, F.lit("/n"), k, F.lit(".md"))
    return spread(table(spark, sf, "part")).select(path.alias("path"), content.alias("content"))


LINT_SQL = """
    WITH miss AS (SELECT p_partkey AS k, path, CASE WHEN p_partkey % 13 = 0 THEN 'project, date, language, source' ELSE
      array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'date' END, CASE WHEN p_partkey % 7 = 0 THEN 'language' END,
        CASE WHEN p_partkey % 11 = 0 THEN 'source' END], lambda x: x IS NOT NULL), ', ') END AS fields FROM notes),
    issues AS (
      SELECT path, 'missing_metadata' AS code, 'Missing metadata fields: ' || fields AS message, 3 AS priority
        FROM miss WHERE fields <> ''
      UNION ALL SELECT path, 'missing_rationale', 'Decision capture missing ' || array_to_string(list_filter([
        CASE WHEN k % 3 <> 0 THEN 'Context' END, CASE WHEN k % 2 <> 0 THEN 'Evidence' END], lambda x: x IS NOT NULL), ' / ')
        || ' section(s).', 2 FROM miss WHERE k % 4 = 0 AND (k % 3 <> 0 OR k % 2 <> 0)
      UNION ALL SELECT path, 'missing_rejected_options', 'Decision capture missing Rejected Options section.', 2
        FROM miss WHERE k % 4 = 0 AND k % 8 <> 0
      UNION ALL SELECT path, 'missing_next_actions', 'Meeting capture missing Next Actions section.', 3
        FROM miss WHERE k % 4 = 1 AND k % 9 <> 1
      UNION ALL SELECT path, 'missing_next_actions', 'Trip debrief missing Checklist Seeds section.', 3
        FROM miss WHERE k % 4 = 2 AND k % 10 <> 2)"""


@register("capture_lint", LINT_SQL + " SELECT * FROM issues", "notes")
def capture_lint(spark, sf):
    return chunking.capture_lint(notes(spark, sf)).drop("position")


@register(
    "index_run_stats",
    f"""
    WITH RECURSIVE docs AS ({VIEWS["docs"]}),
    ch AS (SELECT document_id, content, CASE WHEN document_id % 4 = 3 THEN 'new' WHEN document_id % 5 = 0
      THEN 'changed' ELSE 'unchanged' END AS change FROM docs WHERE document_id % 4 <> 1 AND n_chars <= 16000),
    bodies AS (SELECT document_id, {sql_strip("content")} AS body FROM ch WHERE change <> 'unchanged'), {PACKED_CTES}
    SELECT count(*) FILTER (WHERE change <> 'unchanged') AS documents, count(*) FILTER (WHERE change = 'unchanged') AS skipped,
      (SELECT count(*) FROM ok) AS chunks, (SELECT count(*) FROM docs WHERE n_chars > 16000) AS errors FROM ch""",
)
def index_run_stats(spark, sf):
    from lodestone.operators.corpus import changed_documents
    from lodestone.registry.joins import stored

    base = docs(spark, sf)
    readable = base.where("n_chars <= 16000")
    changes = changed_documents(stored(spark, sf), readable.where("document_id % 4 <> 1"))
    fresh = changes.where("change <> 'unchanged'").select("source_path", "content")
    chunks = chunking.chunk_documents(sections.markdown_sections(fresh))
    errors = files.oversize_errors(base, size="n_chars", limit=16000)
    return chunking.index_run_stats(changes, chunks, errors)
