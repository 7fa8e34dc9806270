"""Hand-checked expectations on small inputs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates, scoring, text
from lodestone.operators import chunking, corpus, decisions, metrics, ranking, search
from lodestone.plans import answers, coach, evaluation, health
from lodestone.plans.answers import highlight
from lodestone.sources import files, sections
from lodestone.sources.sections import parse_locators

NOW = datetime(2024, 1, 31)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}")


def apply(spark, values, fn, kind="string"):
    rows = column(spark, values, kind).select("id", fn(F.col("v")).alias("out")).orderBy("id").collect()
    return [r["out"] for r in rows]


def test_tokens(spark):
    got = apply(spark, ["étion a1 fooé b Straße x9 über_ness 2024", "", "A-B cc"], text.tokens)
    assert got == [["a1", "x9", "2024"], [], ["cc"]]


def test_minmax(spark):
    rows = [("a", 10.0), ("a", 50.0), ("a", 30.0), ("b", 5.0), ("b", 5.0)]
    df = spark.createDataFrame(rows, "q string, s double")
    got = ranking.minmax_normalize(df, "q", "s", "n").collect()
    assert sorted((r.q, r.s, r.n) for r in got) == [
        ("a", 10.0, 0.0),
        ("a", 30.0, 0.5),
        ("a", 50.0, 1.0),
        ("b", 5.0, 1.0),
        ("b", 5.0, 1.0),
    ]


@pytest.fixture(scope="module")
def candidates(spark):
    texts = ["Python is a programming language", "Java is also a programming language", "The cat sat on the mat"]
    rows = [
        (1, "python programming", i, t, s, i, "p", "en", None, [], None)
        for i, (t, s) in enumerate(zip(texts, (0.8, 0.6, 0.3), strict=True), 1)
    ]
    return spark.createDataFrame(
        rows,
        "query_id long, query_text string, chunk_id long, content string, vector_score double, position int, "
        "project string, language string, source_date timestamp_ntz, query_projects array<string>, query_language string",
    )


def test_bm25_candidates(candidates):
    got = {r.chunk_id: round(r.bm25, 6) for r in search.bm25_candidates(candidates).collect()}
    assert got == {1: 1.580115, 2: 0.470004, 3: 0.0}


def test_hybrid_score(candidates):
    rows = search.hybrid_score(candidates, search.ScoringConfig(), now=NOW, k=5).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.final_score, 6)) for r in rows] == [(1, 1.0), (2, 0.509235), (3, 0.0)]


def test_recency(spark):
    ages = [0, 180, 360, 3650, -5]
    values = [NOW - timedelta(days=a) for a in ages] + [None]
    got = apply(spark, values, lambda c: dates.recency(c, NOW), "timestamp_ntz")
    assert got == [1.0, 0.5, 0.25, 0.1, 1.0, 1.0]


def test_date_confidence_and_outdated(spark):
    values = [
        NOW - timedelta(days=30),
        NOW - timedelta(days=30, seconds=1),
        NOW - timedelta(days=91),
        None,
        NOW - timedelta(days=180, seconds=1),
    ]
    assert apply(spark, values, lambda c: dates.confidence(c, NOW), "timestamp_ntz") == [
        "HIGH",
        "MEDIUM",
        "LOW",
        "UNKNOWN",
        "LOW",
    ]
    assert apply(spark, values, lambda c: dates.outdated(c, NOW), "timestamp_ntz") == [False, False, False, False, True]


def test_metrics_of_one_query(spark):
    golden = spark.createDataFrame([(1, "q", [1, 2, 3]), (2, "n", []), (3, "e", [9])], evaluation_schema())
    retrieved = spark.createDataFrame(
        [(1, c, r) for r, c in enumerate([1, 4, 2, 5, 6], 1)] + [(2, 1, 1)], "id long, chunk_id long, rank int"
    )
    rows = {r.id: r for r in evaluation.evaluate_queries(golden, retrieved, k=5).collect()}
    assert (rows[1].recall, rows[1].precision, rows[1].mrr, rows[1].f1) == pytest.approx((2 / 3, 2 / 5, 1, 0.5))
    assert (rows[2].recall, rows[2].precision, rows[2].mrr, rows[2].passed) == (0, 0, 0, True)
    assert (rows[3].recall, rows[3].mrr, rows[3].passed) == (0, 0, False)
    ap = evaluation.average_precision(evaluation.expected_rows(golden), retrieved).collect()
    assert {r.id: r.average_precision for r in ap} == pytest.approx({1: 5 / 9, 3: 0.0})


def evaluation_schema():
    return "id long, question string, expected_chunks array<bigint>"


def test_mrr_later_hit_and_single_query_std(spark):
    golden = spark.createDataFrame([(1, "q", [1, 2, 3])], evaluation_schema())
    retrieved = spark.createDataFrame(
        [(1, c, r) for r, c in enumerate([4, 1, 5, 2, 3], 1)], "id long, chunk_id long, rank int"
    )
    per_query, summary = evaluation.evaluate(golden, retrieved)
    assert per_query.first().mrr == 0.5
    assert summary.first().mrr_std == 0.0
    same = evaluation.compare(summary, summary).first()
    assert same.overall_passed and same.recall_delta == 0


def test_query_syntax(spark):
    got = apply(
        spark,
        [
            '"exact match" -exclude project:docs',
            "decision:maybe logging",
            "Decision:ACTIVE PROJECT:a b -C --d",
            'how "" to',
        ],
        text.parse_query,
    )
    assert got[0].asDict() == {
        "text": "exact match",
        "phrases": ["exact match"],
        "excluded": ["exclude"],
        "project": "docs",
        "decision_status": None,
    }
    assert (got[1].decision_status, got[1].text) == (None, "decision:maybe logging")
    assert (got[2].decision_status, got[2].project, got[2].text, got[2].excluded) == ("active", "a", "b", ["c"])
    assert (got[3].text, got[3].phrases) == ('how "" to', [])


def test_phrase_filter(spark):
    rows = [(1, "Python basics"), (2, "Java"), (3, "advanced PYTHON"), (4, "none")]
    df = spark.createDataFrame(rows, "id long, content string")
    kept = df.where(text.has_all_phrases(F.col("content"), F.array(F.lit("Python"))))
    assert sorted(r.id for r in kept.collect()) == [1, 3]


def test_hit_rate(spark):
    rows = [("docs", 0, NOW), ("docs", 2, NOW - timedelta(hours=1)), ("docs", 2, NOW - timedelta(days=30)), (None, 0, NOW)]
    log = spark.createDataFrame(rows, "project string, results_count int, searched_at timestamp_ntz")
    got = {r.project: (r.total, r.not_found, r.hit_rate) for r in metrics.search_hit_rate(log, now=NOW).collect()}
    assert got == {"docs": (2, 1, 0.5), "all": (1, 1, 0.0)}


def test_repeats_are_windowed_but_totals_are_not(spark):
    rows = [("q", "p", "didnt_answer", NOW), ("q", "p", "helpful", NOW - timedelta(hours=3))]
    log = spark.createDataFrame(rows, "question string, project string, feedback_reason string, created_at timestamp_ntz")
    assert metrics.repeated_questions(log, now=NOW, window_hours=1).count() == 0
    assert metrics.repeated_questions(log, now=NOW, window_hours=4).first().repeat_count == 2
    assert metrics.feedback_metrics(log).first().total == 2


def test_stale_buckets(spark):
    docs = spark.createDataFrame(
        [(NOW - timedelta(days=200),), (NOW - timedelta(days=10),), (None,)], "source_date timestamp_ntz"
    )
    got = metrics.stale_document_buckets(docs, now=NOW, days=[180, 90, 90, 0]).collect()
    assert [(r.days, r.stale_count) for r in got] == [(90, 1), (180, 1)]


def test_priorities(spark):
    assert apply(spark, [0.0, 0.05, 0.3, 0.5, 1.0], scoring.priority_from_ratio, "double") == [5, 5, 3, 1, 1]
    assert apply(spark, [0, 1, 3, 9], scoring.priority_from_count, "long") == [5, 5, 3, 1]


def matches(spark, *contents):
    df = spark.createDataFrame(list(enumerate(contents)), "chunk_id long, content string")
    return df.withColumn("source_date", F.lit(NOW).cast("timestamp_ntz"))


def test_decision_marker(spark):
    row = decisions.extract_decisions(matches(spark, "Decision: We will use React for the frontend.")).collect()
    assert [(r.decision_text, r.confidence) for r in row] == [("We will use React for the frontend.", 0.9)]


def test_rejected_alternatives(spark):
    got = apply(
        spark, ["We chose PostgreSQL instead of MongoDB for ACID compliance."], decisions.rejected_alternatives
    )
    assert got == [["MongoDB for ACID compliance"]]


def test_overlap_keeps_most_confident(spark):
    rows = decisions.extract_decisions(matches(spark, "Decision: we decided to use Kafka for events.")).collect()
    assert [r.confidence for r in rows] == [0.9]


def test_kept_matches_never_overlap(spark):
    body = (
        "We decided to go forward. Going forward, we will use Kafka for events. The team chose plan B.\n\n"
        "Agreed: we agreed to use Spark for all of it because it scales."
    )
    found = decisions.with_matches(matches(spark, body))
    kept = found.select(decisions.resolve_overlaps(F.col("matches")).alias("m")).first().m
    spans = sorted((m.start, m.end) for m in kept)
    assert len(spans) >= 3
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_positions_are_characters(spark):
    row = decisions.with_matches(matches(spark, "Ünïcödé 😀 first. We decided to keep the emoji 😀 support.")).first()
    m = row.matches[0]
    assert row.content[m.start : m.end] == "We decided to keep the emoji 😀 support."


def test_chain_stops_at_cycle_and_missing(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 99), (-1, None)]
    df = spark.createDataFrame(rows, "decision_id long, superseded_by long")
    chains: dict = {}
    for r in decisions.supersession_chain(df).orderBy("root_id", "position").collect():
        chains.setdefault(r.root_id, []).append(r.decision_id)
    assert chains == {1: [1, 2, 3], 2: [2, 3], 3: [3], 4: [4, 5], 5: [5, 4], 6: [6], -1: [-1]}


def test_chain_depth(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(30)], "decision_id long, superseded_by long")
    assert decisions.supersession_chain(df).where("root_id = 0").count() == 30
    assert decisions.supersession_chain(df, max_depth=10).where("root_id = 0").count() == 10


LINT = [
    ("vault/decisions/a.md", "---\nproject: p\ndate: 2024-01-01\nlanguage: en\nsource: s\n---\n# D\n## Context\n## Evidence\n## Rejected Options\n"),
    ("vault/decisions/b.md", "---\nproject: p\ndate: 2024-01-01\nlanguage: en\nsource: s\n---\n# D\n"),
    ("vault/meetings/m.md", "---\nproject: p\ndate: 2024-01-01\nlanguage: en\nsource: s\n---\n# M\n"),
    ("vault/trips/t.md", "---\nproject: p\ndate: 2024-01-01\nlanguage: en\nsource: s\n---\n# T\n"),
    ("vault/routines/r.md", "# no front matter\n"),
]


def test_lint(spark):
    notes = spark.createDataFrame(LINT, "path string, content string")
    codes = sorted(r.code for r in chunking.capture_lint(notes).collect())
    assert codes == sorted(
        ["missing_rationale", "missing_rejected_options", "missing_next_actions", "missing_next_actions", "missing_metadata"]
    )


def test_bookmarks(spark):
    html = (
        "<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<DL><p>\n<DT><H3>Folder One</H3>\n<DL><p>\n"
        '<DT><A HREF="https://example.com" ADD_DATE="1700000001">Example</A>\n</DL><p>\n'
        '<DT><A HREF="https://openai.com">OpenAI</A>\n</DL><p>'
    )
    links = sections.bookmark_links(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("position")
    got = [(r.folder, r.title, r.url, r.added_at and int(r.added_at.timestamp())) for r in links.collect()]
    assert got == [
        ("Folder One", "Example", "https://example.com", 1700000001),
        ("", "OpenAI", "https://openai.com", None),
    ]
    page = spark.createDataFrame([(html,), ("<p>nothing</p>",)], "content string")
    sectioned = sections.bookmark_sections(page).orderBy("error").collect()
    assert sectioned[1].error == "No bookmark entries found."
    first = sectioned[0].sections[0]
    assert first.content == "[Example](https://example.com)\nFolder: Folder One"
    assert first.extra == {"folder": "Folder One", "added_at": "2023-11-14T22:13:21"}


def test_dates_in_text(spark):
    got = apply(
        spark,
        [
            "Created 2024-01-01\nUpdated 2024-06-15",
            "03/04/2025",
            "---\ntitle: Test\ndate: 2024-06-01\n---\n# H\nBody",
            "Published on January 15, 2025.",
            "Dated 15 January 2025.",
            "2025-01-15T10:00:00Z",
            "As of January 5, 2025 the plan was updated.",
            "at 2025-01-15T10:00:00+02:00",
            "2024-13-45 then 2024/02/03",
            "Sept 3, 2024",
            "x\n" * 45 + "2024-01-01",
            None,
        ],
        dates.extract_date,
    )
    d = datetime
    assert got == [
        d(2024, 6, 15),
        None,
        d(2024, 6, 1),
        d(2025, 1, 15),
        d(2025, 1, 15),
        d(2025, 1, 15, 10),
        d(2025, 1, 5),
        d(2025, 1, 15, 8),
        d(2024, 2, 3),
        None,
        None,
        None,
    ]


def test_slug(spark):
    assert apply(spark, ["API v2.0 -- Beta", "   "], lambda c: text.slugify(c, "untitled")) == ["api-v2-0-beta", "untitled"]


def test_boilerplate(spark):
    values = ["Page 3 of 10", "1/10", "Copyright 2024 X", "Normal text", "----", "  Back to top\n"]
    assert apply(spark, values, text.is_boilerplate) == [True, True, True, False, True, True]


def test_durations(spark):
    got = apply(spark, ["90d", "6w", "6m", "1y", "7", "0d", "x", "5 W"], dates.duration_days)
    assert got == [90, 42, 180, 365, 7, None, None, 35]


def test_chunking_keeps_small_sections_and_numbers_parts(spark):
    sentence = "This sentence number {} talks about something quite different every time. "
    long = "".join(sentence.format(i) for i in range(200)).strip()
    docs = spark.createDataFrame([(1, "# A\n" + "word soup with many different words in it ok fine. " * 10), (2, long)], "document_id long, content string")
    rows = chunking.chunk_documents(sections.markdown_sections(docs)).orderBy("document_id", "chunk_index").collect()
    small = [r for r in rows if r.document_id == 1]
    assert len(small) == 1 and small[0].locator.chunk_part is None
    parts = [r for r in rows if r.document_id == 2]
    assert [r.locator.chunk_part for r in parts] == list(range(1, len(parts) + 1))
    assert {r.locator.chunk_total for r in parts} == {len(parts)}
    assert all(len(r.content) <= 2048 + 100 for r in parts)
    seen = set()
    for r in parts:
        seen |= {s for s in r.content.split(". ") if s}
    assert {f"number {i} " in " ".join(seen) for i in range(200)} == {True}


def test_chunk_tail_is_merged():
    body = "\n\n".join(["a" * 2000, "b" * 100])
    assert chunking.split_text(body) == ["a" * 2000 + "\n\n" + "b" * 100]
    body = "\n\n".join(["a" * 2000, "c" * 1900, "b" * 160])
    assert chunking.split_text(body) == ["a" * 2000, "c" * 1900 + "\n\n" + "b" * 160]


def test_recipe(spark):
    body = '{"name": "Soup", "description": "Warm", "servings": 4, "ingredients": [{"item": "salt", "amount": "1 tsp"}, "water"], "instructions": ["Boil"]}'
    rows = sections.recipe_sections(spark.createDataFrame([(1, body)], "id long, json string")).first().sections
    assert [(s.locator.section, s.content) for s in rows] == [
        ("description", "# Soup\n\nWarm"),
        ("metadata", "Servings: 4"),
        ("ingredients", "## Ingredients\n- 1 tsp salt\n- water"),
        ("instructions", "## Instructions\n1. Boil"),
    ]


def test_scan_ignores_and_decodes(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules" / "x.md").write_text("no")
    (tmp_path / "sub" / "a.md").write_bytes("Grüße".encode("latin-1"))
    (tmp_path / "b.recipe.json").write_text("{}")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "d.pyc").write_text("no")
    rows = files.scan_corpus(spark, str(tmp_path), project="p").collect()
    assert {(r.relative_path, r.source_type, r.content) for r in rows} == {
        ("sub/a.md", "markdown", "Grüße"),
        ("b.recipe.json", "recipe", "{}"),
    }
    counts = {r.extension: r.files for r in files.count_scan_targets(spark, str(tmp_path)).collect()}
    assert counts == {".md": 1, ".recipe.json": 1}


def test_golden_set_skips_bad_lines(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"id": 1, "question": "q"}\n\nnot json\n{"id": 2}\n{"id": 3, "question": "r", "expected_chunks": [5], "difficulty": "hard"}\n')
    rows = {r.id: r for r in files.load_golden_set(spark, str(path)).collect()}
    assert set(rows) == {1, 3}
    assert (rows[1].difficulty, rows[1].category, rows[1].expected_chunks) == ("medium", "general", [])
    assert (rows[3].difficulty, rows[3].expected_chunks) == ("hard", [5])


def test_upsert_keeps_language_and_type(spark):
    schema = "document_id long, source_path string, source_type string, project string, language string, source_date timestamp_ntz, content_hash string, updated_at timestamp_ntz"
    old = spark.createDataFrame([(1, "a", "markdown", "p", "de", None, "h1", datetime(2020, 1, 1))], schema)
    new = spark.createDataFrame(
        [("a", "pdf", "p", "en", NOW, "h2"), ("a", "pdf", "q", "en", None, "h3")],
        "source_path string, source_type string, project string, language string, source_date timestamp_ntz, content_hash string",
    )
    rows = {r.project: r for r in corpus.upsert_documents(old, new, now=NOW).collect()}
    assert (rows["p"].language, rows["p"].source_type, rows["p"].content_hash, rows["p"].source_date) == ("de", "markdown", "h2", NOW)
    assert (rows["q"].document_id, rows["q"].language) == (None, "en")


def test_grounding(spark):
    rows = [
        (1, "some   text... [1]", "there is some text here"),
        (2, "made up", "there is some text here"),
        (3, "[2]", "x"),
        (4, None, "x"),
        (5, "alone", None),
    ]
    df = spark.createDataFrame(rows, "query_id long, answer string, used_chunk string")
    assert sorted(r.query_id for r in answers.grounding_audit(df).collect()) == [2, 5]


def test_highlight_and_locator_extras(spark):
    df = spark.createDataFrame([("how to Log -x logging", "Log the logging, logger log"), ("the -a", "text")], "query string, content string")
    rows = highlight(df).collect()
    assert (rows[0].terms, rows[0].marked) == (["Log", "logging", "log"], "**Log** the **logging**, logger **log**")
    assert (rows[1].terms, rows[1].marked) == ([], "text")
    loc = parse_locators(spark.createDataFrame([('{"heading": "H", "start_line": 3, "odd": "x"}',)], "j string"), "j").first()
    assert (loc.locator.heading, loc.locator.start_line, loc.extra) == ("H", 3, {"odd": "x"})


def test_coach_gates_and_dedupe(spark):
    requests = spark.createDataFrame(
        [(1, "p", True, False), (2, "p", True, False), (3, "p", True, False), (4, "p", False, False), (5, "p", True, True)],
        "request_id long, project string, coach_enabled boolean, override_cooldown boolean",
    )
    sources = spark.createDataFrame(
        [(r, i, "Decision: x", level, level == "LOW") for r, level in ((2, "LOW"), (3, "HIGH"), (5, "HIGH")) for i in (1, 2)],
        "request_id long, rank int, snippet string, date_confidence string, may_be_outdated boolean",
    )
    columns = "scope string, priority int, position int, suggestion_type string, text string, why string, hypothesis boolean, project string, routine_action string, action string, target string"
    candidates = spark.createDataFrame(
        [
            ("p", 2, 1, "health_not_found", "t1", "w", True, "p", "daily-checkin", None, None),
            ("p", 1, 7, "health_staleness", "t2", "w", True, "p", "weekly-review", None, None),
            ("p", 3, 8, "health_other", "t3", "w", True, "p", "weekly-review", None, None),
        ],
        columns,
    )
    log = spark.createDataFrame(
        [("p", "health_not_found", NOW - timedelta(days=1))], "project string, suggestion_type string, logged_at timestamp_ntz"
    )
    facts = coach.answer_facts(requests, sources)
    got: dict = {}
    for r in coach.coach_suggestions(facts, candidates, log, now=NOW).orderBy("request_id", "place").collect():
        got.setdefault(r.request_id, []).append(r.suggestion_type)
    assert got == {
        1: ["coverage_gaps"],
        2: ["staleness"],
        3: ["capture_hygiene", "health_staleness"],
        5: ["capture_hygiene", "health_staleness", "health_not_found"],
    }


def test_signals_cover_all_names(spark):
    from conftest import SMALL

    from lodestone.registry.health import health_tables

    rows = health.failure_signals(health_tables(spark, SMALL), now=NOW).collect()
    per_scope: dict = {}
    for r in rows:
        per_scope.setdefault(r.scope, []).append(r.name)
    assert health.GLOBAL in per_scope
    assert all(names and sorted(names) == sorted(health.SIGNALS) for names in per_scope.values())
