"""Whole plans on small folders and tables."""

from datetime import datetime

from lodestone import schemas
from lodestone.operators import search
from lodestone.operators.chunking import embed_chunks
from lodestone.plans.answers import answer_queries
from lodestone.plans.indexing import index_folder

NOW = datetime(2024, 1, 31)
BODY = "This note explains number {} with more than ten different words so that it is kept."


def test_index_folder_twice(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    for i in range(3):
        (root / f"n{i}.md").write_text(f"# Note {i}\n\nUpdated 2024-01-0{i + 1}\n" + BODY.format(i))
    (root / "broken.recipe.json").write_text("{not json")
    (root / "empty.md").write_text("  \n")
    (root / "b.html").write_text('<DL><DT><A HREF="https://e.org">E</A></DL>')
    (root / "odd.pdf").write_text("one|two")

    def pipes(path, content):
        if "|" not in content:
            raise ValueError("no pipe")
        return [{"content": BODY.format(content), "locator_type": "page", "locator": {"page": 1, "total_pages": 1}}]

    none = spark.createDataFrame([], schemas.DOCUMENTS)
    run = index_folder(spark, str(root), none, project="p", now=NOW, sectioners={"pdf": pipes})
    assert run.stats.first().asDict() == {"documents": 6, "skipped": 0, "chunks": 4, "errors": 1}
    assert sorted(r.error_type for r in run.errors.collect()) == ["no_text", "parse_error"]
    documents = run.documents.collect()
    dates = {r.source_path.rsplit("/", 1)[-1]: r.source_date for r in documents}
    assert dates["n1.md"] == datetime(2024, 1, 2)
    stored = spark.createDataFrame(documents, schemas.DOCUMENTS)
    (root / "n1.md").write_text("# Note 1\n\nchanged " + BODY.format(1))
    again = index_folder(spark, str(root), stored, project="p", now=NOW, sectioners={"pdf": pipes})
    assert again.stats.first().asDict() == {"documents": 1, "skipped": 5, "chunks": 1, "errors": 1}
    assert again.documents.count() == 6


def test_search_with_the_hashing_encoder_and_answers(spark):
    texts = ["apple banana cherry fruit salad", "linear algebra and matrices", "banana bread with apple sauce"]
    chunks = spark.createDataFrame(
        [(i, t, "p", "markdown", "en", NOW, f"f{i}.md") for i, t in enumerate(texts)],
        "chunk_id long, content string, project string, source_type string, language string, source_date timestamp_ntz, source_path string",
    )
    vectors = embed_chunks(chunks.select("chunk_id", "content"), dimension=256)
    raw = [(1, "apple banana", None), (2, "matrices project:p", None), (3, "apple project:none", None)]
    queries = spark.createDataFrame(raw, "query_id long, raw string, project string")
    prepared = search.prepare_queries(queries, dimension=256)
    results = search.hybrid_search(chunks, vectors, queries, now=NOW, k=2, dimension=256)
    best = {r.query_id: r.chunk_id for r in results.where("rank = 1").collect()}
    assert best[2] == 1 and best[1] in (0, 2) and 3 not in best
    done = answer_queries(prepared, results, now=NOW)
    footer = {r.query_id: r for r in done.footer.collect()}
    assert footer[3].not_found and footer[1].source_count == 2 and footer[1].date_confidence == "HIGH"
    assert done.audit.count() == 0
    history = {r.query_id: (r.project, r.results_count, r.not_found) for r in done.history.collect()}
    assert history == {1: (None, 2, 0), 2: ("p", 2, 0), 3: ("none", 0, 1)}
    assert {r.query_id: r.answer for r in done.answers.collect()}[2] == "linear algebra and matrices [1]"
