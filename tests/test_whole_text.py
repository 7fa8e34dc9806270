"""Dates and files beyond the default limits."""

from datetime import datetime

from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.sources import files


def test_dates_of_the_whole_text(spark):
    texts = ["x\n" * 500 + "Updated: 2024-03-04\n", "x\n" * 45 + "2024-01-01", "2023-01-01\n" + "x\n" * 90 + "Dated 2024-05-06", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = rows.select("k", dates.extract_date(F.col("t"), head_lines=None).alias("d")).orderBy("k").collect()
    assert [r.d for r in found] == [datetime(2024, 3, 4), datetime(2024, 1, 1), datetime(2024, 5, 6), None]


def test_every_file_has_a_document_or_an_error(spark, tmp_path):
    (tmp_path / "small.md").write_text("text")
    (tmp_path / "large.md").write_text("t" * 5000)
    root = str(tmp_path)

    def seen(max_mb):
        documents = files.scan_corpus(spark, root, project="p", max_mb=max_mb)
        errors = files.scan_errors(spark, root, project="p", max_mb=max_mb)
        return tuple(
            sorted(r.source_path.rsplit("/", 1)[1] for r in rows.select("source_path").collect())
            for rows in (documents, errors)
        )

    assert seen(4096 / 1024 / 1024) == (["small.md"], ["large.md"])
    assert seen(None) == seen(50) == (["large.md", "small.md"], [])


def test_runs_of_pieces():
    """Each run is as long as the target allows and starts as far back as the overlap allows."""
    import random

    from lodestone.operators.chunking import _runs

    lots = random.Random(6)
    for _ in range(300):
        sizes = [lots.choice([1, 5, 20, 60]) for _ in range(lots.randrange(25))]
        target, overlap = lots.choice([1, 30, 90]), lots.choice([0, 10, 70])
        runs, done = _runs(sizes, target, overlap), 0
        for start, end in runs:
            assert start <= done < end and sum(sizes[start:done]) <= overlap
            assert start == 0 or sum(sizes[start - 1 : done]) > overlap
            assert end == done + 1 or sum(sizes[start:end]) <= target
            assert end == len(sizes) or sum(sizes[start : end + 1]) > target
            done = end
        assert done == len(sizes)


def test_files_of_every_type_end_as_a_document_or_an_error(spark, tmp_path):
    from lodestone.plans.indexing import index_folder

    def pages(path, data):
        """A made-up format: pages between form feeds, after a magic byte that is no UTF-8."""
        if data[:1] != b"\xff":
            raise ValueError("no such file")
        return [
            {"content": p.decode("latin-1"), "locator_type": "page", "locator": {"page": n}}
            for n, p in enumerate(data[1:].split(b"\x0c"), 1)
        ]

    body = "A page with a good number of different words, enough of them to be kept as one chunk of text"
    (tmp_path / "a.md").write_text(f"# Title\n{body} one.")
    (tmp_path / "b.pdf").write_bytes(b"\xff" + f"{body} two.".encode() + b"\x0c" + f"{body} drei für é.".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"else")
    (tmp_path / "d.docx").write_bytes(b"\x00\x01")
    (tmp_path / "e.xlsx").write_bytes(b"x")
    (tmp_path / "f.recipe.yaml").write_text("name: Soup\n")
    (tmp_path / "g.recipe.json").write_text('{"name": "Soup", "description": "Warm"}')
    (tmp_path / "h.html").write_text("nothing")
    existing = spark.createDataFrame([], "source_path string, project string, source_type string, language string, source_date timestamp_ntz, content_hash string")
    run = index_folder(spark, str(tmp_path), existing, project="p", now="2024-01-31", byte_sectioners={"pdf": pages})
    name = F.regexp_extract("source_path", "[^/]*$", 0)
    documents = {r[0] for r in run.documents.select(name).collect()}
    errors = {(r[0], r.error_type, r.error_message) for r in run.errors.select(name, "error_type", "error_message").collect()}
    assert documents == {"a.md", "b.pdf", "g.recipe.json"}
    assert errors == {
        ("c.pdf", "parse_error", "no such file"),
        ("d.docx", "unsupported_type", "No sectioner for word"),
        ("e.xlsx", "unsupported_type", "No sectioner for excel"),
        ("f.recipe.yaml", "unsupported_type", "No sectioner for recipe in YAML"),
        ("h.html", "parse_error", "No bookmark entries found."),
    }
    chunks = {(r[0], r.content.split()[-1], r.locator.page) for r in run.chunks.select(name, "content", "locator").collect() if r[0] == "b.pdf"}
    assert chunks == {("b.pdf", "two.", 1), ("b.pdf", "é.", 2)}


def test_lint_accepts_lists_in_front_matter(spark):
    from lodestone.operators.chunking import capture_lint

    front = {
        "lists": "project: p\ndate:\n  - 2024-01-01\nlanguage: [en, de]\nsource:\n- desk\n- mail",
        "mapping": "project:\n  name: p\ndate: 2024-01-01\nlanguage: en\nsource: # where from\n  kind: desk",
        "blank": "project: p\ndate:\nlanguage: en\nsource:\n",
        "next": "date:\n\nproject: p\nsource: # none\nlanguage: en",
    }
    notes = spark.createDataFrame([(f"notes/{k}.md", f"---\n{v}\n---\n# Note\n") for k, v in front.items()], "path string, content string")
    found = {r.path: r.message for r in capture_lint(notes).collect()}
    assert found == {
        "notes/blank.md": "Missing metadata fields: date, source",
        "notes/next.md": "Missing metadata fields: date, source",
    }
