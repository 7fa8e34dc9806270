"""Retrieval queries."""

from pyspark.sql import functions as F

from lodestone.operators import ranking, search
from lodestone.operators.pivots import PivotIndex
from lodestone.operators.postings import PostingsIndex
from lodestone.registry.base import (
    NOW,
    VIEWS,
    asked,
    decided,
    docs,
    register,
    sql_recency,
    sql_tokens,
    table,
    texts,
    vecs,
)
from lodestone.session import scratch_path

CORPUS = "docs vecs asked"


def _corpus(spark, sf):
    return docs(spark, sf).join(vecs(spark, sf).select("chunk_id", "embedding"), "chunk_id")


def first_vector(spark, sf):
    """Vector 0 as a literal: one row by key."""
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


@register(
    "vector_search",
    """
    SELECT chunk_id, round(d, 6) AS distance FROM (
      SELECT chunk_id, round(list_cosine_distance(embedding, (SELECT embedding FROM vecs WHERE chunk_id = 0)), 9) AS d
      FROM docs JOIN vecs USING (chunk_id)
      WHERE language = 'en' AND source_date >= TIMESTAMP '2022-06-01 00:00:00')
    ORDER BY d, chunk_id LIMIT 5""",
    "docs vecs",
)
def vector_search(spark, sf):
    from lodestone.operators.filters import filter_metadata

    kept = filter_metadata(docs(spark, sf), language="en", date_after="2022-06-01 00:00:00")
    corpus = kept.select("chunk_id").join(vecs(spark, sf), "chunk_id")
    found = search.vector_search(corpus, first_vector(spark, sf), k=5)
    return found.select("chunk_id", F.round("distance", 6).alias("distance"))


@register(
    "vector_topk",
    """
    SELECT chunk_id, label, round(d, 6) AS distance FROM (
      SELECT chunk_id, label, round(list_cosine_distance(embedding,
        (SELECT embedding FROM vecs WHERE chunk_id = 0)), 9) AS d FROM vecs)
    ORDER BY d, chunk_id LIMIT 20""",
    "vecs",
)
def vector_topk(spark, sf):
    found = search.vector_search(vecs(spark, sf), first_vector(spark, sf), k=20)
    return found.select("chunk_id", "label", F.round("distance", 6).alias("distance"))


NEAREST_SQL = """
    SELECT query_id, chunk_id, round(d, 6) AS distance, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (
        SELECT q.query_id, v.chunk_id, round(list_cosine_distance(q.embedding, v.embedding), 9) AS d
        FROM asked q, vecs v JOIN docs USING (chunk_id)))
    WHERE rank <= 5"""


@register(
    "batch_vector_search",
    NEAREST_SQL,
    CORPUS,
)
def batch_vector_search(spark, sf):
    found = search.batch_vector_search(_corpus(spark, sf), asked(spark, sf).select("query_id", "embedding"), k=5)
    return found.withColumn("distance", F.round("distance", 6))


@register("ann_vector_search", NEAREST_SQL, CORPUS)
def ann_vector_search(spark, sf):
    """Blocks beyond reach are skipped by the triangle inequality, so the rows are those of the full scan."""
    corpus = _corpus(spark, sf)
    index = PivotIndex(spark, scratch_path(spark, "pivots")).build(corpus, width=len(first_vector(spark, sf)))
    found = index.search(asked(spark, sf).select("query_id", "embedding"), k=5)
    return found.withColumn("distance", F.round("distance", 6))


@register(
    "idf",
    f"""
    WITH toks AS (SELECT chunk_id, {sql_tokens("content")} AS t FROM docs),
    freq AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM toks) GROUP BY 1)
    SELECT term, df, round(ln(((SELECT count(*) FROM toks) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM freq""",
    "docs",
)
def idf(spark, sf):
    return search.idf(texts(spark, sf)).withColumn("idf", F.round("idf", 6))


BM25_SQL = f"""
    WITH toks AS (SELECT chunk_id, {sql_tokens("content")} AS t FROM docs),
    stats AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS mean FROM toks),
    post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM toks) GROUP BY 1, 2),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    ask AS (SELECT query_id, term, count(*) AS times FROM
      (SELECT query_id, unnest({sql_tokens("text")}) AS term FROM asked) GROUP BY 1, 2),
    scored AS (SELECT query_id, chunk_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1)
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))), 9) AS score
      FROM ask JOIN post USING (term) JOIN freq USING (term) JOIN toks USING (chunk_id), stats
      GROUP BY query_id, chunk_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM scored WHERE score > 0)"""


@register(
    "bm25_corpus",
    BM25_SQL + " SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10",
    "docs asked",
)
def bm25_corpus(spark, sf):
    found = search.bm25_corpus(texts(spark, sf), asked(spark, sf).select("query_id", "text"), k=10)
    return found.withColumn("score", F.round("score", 6))


@register(
    "bm25_postings",
    BM25_SQL + " SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10",
    "docs asked",
)
def bm25_postings(spark, sf):
    index = PostingsIndex(spark, scratch_path(spark, "postings")).add(texts(spark, sf))
    found = index.search(asked(spark, sf).select("query_id", "text"), k=10)
    return found.withColumn("score", F.round("score", 6))


# Candidate lists: the nearest chunks of every query, over all chunks.
CANDIDATES = 40
CANDIDATES_SQL = f"""
    WITH near AS (SELECT q.query_id, v.chunk_id, round(list_cosine_distance(q.embedding, v.embedding), 9) AS d
      FROM asked q, vecs v JOIN docs USING (chunk_id)),
    cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS place FROM near)
      WHERE place <= {CANDIDATES}),
    cand AS (SELECT query_id, chunk_id, {sql_tokens("content")} AS t FROM cut JOIN docs USING (chunk_id)),
    stats AS (SELECT query_id, count(*) AS n, sum(len(t)) / count(*) AS mean FROM cand GROUP BY 1),
    post AS (SELECT query_id, chunk_id, term, count(*) AS tf FROM
      (SELECT query_id, chunk_id, unnest(t) AS term FROM cand) GROUP BY 1, 2, 3),
    freq AS (SELECT query_id, term, count(*) AS df FROM post GROUP BY 1, 2),
    ask AS (SELECT query_id, unnest({sql_tokens("text")}) AS term FROM asked),
    scored AS (SELECT query_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1)
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))) AS s
      FROM ask JOIN post USING (query_id, term) JOIN freq USING (query_id, term) JOIN cand USING (query_id, chunk_id)
        JOIN stats USING (query_id) GROUP BY 1, 2),
    bm AS (SELECT query_id, chunk_id, coalesce(s, 0) AS bm25 FROM cand LEFT JOIN scored USING (query_id, chunk_id))"""


def _candidates(spark, sf):
    asks = asked(spark, sf)
    found = search.batch_vector_search(_corpus(spark, sf), asks.select("query_id", "embedding"), k=CANDIDATES)
    found = found.select("query_id", "chunk_id").join(asks.select("query_id", F.col("text").alias("query_text")), "query_id")
    return texts(spark, sf).join(found, "chunk_id")


@register(
    "bm25_candidates",
    CANDIDATES_SQL + " SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM bm",
    CORPUS,
)
def bm25_candidates(spark, sf):
    scored = search.bm25_candidates(_candidates(spark, sf))
    return scored.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


@register(
    "minmax_normalize",
    """
    SELECT event_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (value - lo) / (hi - lo) END, 6) AS scaled
    FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo,
      max(value) OVER (PARTITION BY user_id) AS hi FROM events)""",
)
def minmax_normalize(spark, sf):
    scaled = ranking.minmax_normalize(table(spark, sf, "events"), "user_id", "value", "scaled")
    return scaled.select("event_id", F.round("scaled", 6).alias("scaled"))


@register(
    "rank_per_query",
    """
    SELECT query, event_id, rank::INTEGER AS rank FROM (
      SELECT query, event_id, row_number() OVER (PARTITION BY query ORDER BY results_count DESC, searched_at,
        event_id) AS rank FROM searches) WHERE rank <= 7""",
    "ev searches",
)
def rank_per_query(spark, sf):
    from lodestone.registry.base import searches

    order = [F.desc("results_count"), F.asc("searched_at"), F.asc("event_id")]
    return ranking.top_k(searches(spark, sf), ["query"], order, 7).select("query", "event_id", "rank")


@register(
    "metadata_boost",
    """
    SELECT chunk_id, round((CASE WHEN project = 'src3' THEN 1.1 ELSE 1.0 END)
      * (CASE WHEN language = 'en' THEN 1.05 ELSE 1.0 END), 6)::DOUBLE AS boost FROM docs""",
    "docs",
)
def metadata_boost(spark, sf):
    boost = search.metadata_boost(
        F.col("project"),
        F.col("language"),
        F.array(F.lit("src3"), F.lit("")),
        F.lit("en"),
        search.ScoringConfig(),
    )
    return docs(spark, sf).select("chunk_id", F.round(boost, 6).alias("boost"))


# Scoring of given candidate lists; the list position is the tie-break.
SCORED_SQL = f"""
    sc AS (SELECT *, CASE WHEN max(vs) OVER w = min(vs) OVER w THEN 1.0 ELSE
        (vs - min(vs) OVER w) / (max(vs) OVER w - min(vs) OVER w) END AS v,
      CASE WHEN max(kb) OVER w = min(kb) OVER w THEN 1.0 ELSE
        (kb - min(kb) OVER w) / (max(kb) OVER w - min(kb) OVER w) END AS kw,
      {sql_recency("source_date")} AS recency FROM inp WINDOW w AS (PARTITION BY query_id)),
    fin AS (SELECT *, round(least(1.0, (0.7 * v + 0.3 * kw) * recency * boost), 9) AS final FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, boost DESC, position) AS rank
      FROM fin)"""


@register(
    "hybrid_score",
    CANDIDATES_SQL
    + f""", inp AS (SELECT query_id, chunk_id, source_date, (chunk_id * 37 % 101) / 100.0::DOUBLE AS vs,
        round(bm25, 9) AS kb, CASE WHEN language = 'en' THEN 1.05 ELSE 1.0 END::DOUBLE AS boost,
        chunk_id AS position FROM bm JOIN docs USING (chunk_id)), {SCORED_SQL}
    SELECT query_id, chunk_id, rank::INTEGER AS rank, round(v, 6) AS vector_part, round(kw, 6) AS keyword_part,
      round(recency, 6) AS recency, round(boost, 6) AS boost, round(final, 6) AS final_score FROM rk WHERE rank <= 10""",
    CORPUS,
)
def hybrid_score(spark, sf):
    rows = (
        _candidates(spark, sf)
        .withColumn("vector_score", F.col("chunk_id") * 37 % 101 / 100.0)
        .withColumn("position", F.col("chunk_id"))
        .withColumn("query_projects", F.array().cast("array<string>"))
        .withColumn("query_language", F.lit("en"))
    )
    config = search.ScoringConfig(recency=True)
    scored = search.hybrid_score(rows, config, now=NOW, k=10)
    return _rounded(scored)


def _rounded(scored):
    return scored.select(
        "query_id",
        "chunk_id",
        "rank",
        *[F.round(c, 6).alias(c) for c in ("vector_part", "keyword_part", "recency", "boost", "final_score")],
    )


HYBRID_SQL = f"""
    WITH near AS (SELECT q.query_id, q.text AS query_text, q.scope, v.chunk_id,
        round(list_cosine_distance(q.embedding, v.embedding), 9) AS d
      FROM asked q, vecs v JOIN docs USING (chunk_id) WHERE scope IS NULL OR project = scope),
    cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS position
      FROM near) WHERE position <= CASE WHEN query_id % 3 = 0 THEN 15 ELSE 25 END),
    cand AS (SELECT query_id, chunk_id, d, scope, position, source_date, language, project,
        {sql_tokens("content")} AS t FROM cut JOIN docs USING (chunk_id)),
    stats AS (SELECT query_id, count(*) AS n, sum(len(t)) / count(*) AS mean FROM cand GROUP BY 1),
    post AS (SELECT query_id, chunk_id, term, count(*) AS tf FROM
      (SELECT query_id, chunk_id, unnest(t) AS term FROM cand) GROUP BY 1, 2, 3),
    freq AS (SELECT query_id, term, count(*) AS df FROM post GROUP BY 1, 2),
    ask AS (SELECT query_id, unnest({sql_tokens("text")}) AS term FROM asked),
    bm AS (SELECT query_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1)
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))) AS s
      FROM ask JOIN post USING (query_id, term) JOIN freq USING (query_id, term) JOIN cand USING (query_id, chunk_id)
        JOIN stats USING (query_id) GROUP BY 1, 2),
    inp AS (SELECT query_id, chunk_id, source_date, position, greatest(0.0, 1 - d) AS vs,
        round(coalesce(s, 0), 9) AS kb, (CASE WHEN scope = project THEN 1.1 ELSE 1.0 END)::DOUBLE AS boost
      FROM cand LEFT JOIN bm USING (query_id, chunk_id)), {SCORED_SQL}"""


@register(
    "hybrid_search",
    HYBRID_SQL
    + """ SELECT query_id, chunk_id, rank::INTEGER AS rank, round(v, 6) AS vector_part, round(kw, 6) AS keyword_part,
      round(recency, 6) AS recency, round(boost, 6) AS boost, round(final, 6) AS final_score FROM rk WHERE rank <= 5""",
    CORPUS,
)
def hybrid_search(spark, sf):
    return _rounded(hybrid_results(spark, sf))


def hybrid_results(spark, sf, k=5):
    return search.hybrid_search(
        texts(spark, sf),
        vecs(spark, sf),
        asked(spark, sf).drop("text"),
        now=NOW,
        k=k,
        config=search.ScoringConfig(recency=True),
        mode="candidate",
    )


@register(
    "vector_only_search",
    """
    SELECT query_id, chunk_id, rank::INTEGER AS rank, round(greatest(0.0, 1 - d), 6) AS final_score FROM (
      SELECT q.query_id, chunk_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (
        SELECT q.query_id, v.chunk_id, round(list_cosine_distance(q.embedding, v.embedding), 9) AS d
        FROM asked q, vecs v JOIN docs USING (chunk_id) WHERE scope IS NULL OR project = scope) q)
    WHERE rank <= 5""",
    CORPUS,
)
def vector_only_search(spark, sf):
    found = vector_only_results(spark, sf)
    return found.select("query_id", "chunk_id", "rank", F.round("final_score", 6).alias("final_score"))


def vector_only_results(spark, sf, k=5):
    return search.vector_only_search(docs(spark, sf), vecs(spark, sf), asked(spark, sf).drop("text"), k=k, mode="candidate")


# Queries with phrases, exclusions that hit and a decision status, over some source types and dates.
VIEWS["sought"] = """
SELECT query_id, text, embedding, NULL::VARCHAR AS scope, CASE WHEN query_id % 4 IN (0, 3) THEN 'an' END AS phrase,
  CASE query_id % 4 WHEN 1 THEN 'qu' WHEN 3 THEN 'ch' END AS excluded, query_id % 4 = 2 AS decided_only FROM asked"""
SOUGHT_NEAR = """
    WITH near AS (SELECT q.query_id, q.text AS query_text, q.scope, v.chunk_id,
        round(list_cosine_distance(q.embedding, v.embedding), 9) AS d
      FROM sought q, vecs v JOIN docs USING (chunk_id)
      WHERE source_type IN ('markdown', 'pdf', 'word') AND source_date >= TIMESTAMP '2022-06-01'
        AND (phrase IS NULL OR contains(lower(content), phrase)) AND (excluded IS NULL OR NOT contains(lower(content), excluded))
        AND (NOT decided_only OR v.chunk_id IN (SELECT chunk_id FROM decided WHERE status = 'active'))),"""
SOUGHT_FILTERS = dict(source_types=["markdown", "pdf", "word"], date_after="2022-06-01")


def sought(spark, sf):
    n = F.col("query_id") % 4
    raw = F.concat(
        "text",
        F.when(n.isin(0, 3), ' "An"').otherwise(""),
        F.when(n == 1, " -QU").when(n == 3, " -ch").when(n == 2, " decision:active").otherwise(""),
    )
    return asked(spark, sf).select("query_id", raw.alias("raw"), "embedding")


@register(
    "hybrid_search_filtered",
    SOUGHT_NEAR
    + HYBRID_SQL[HYBRID_SQL.index("\n    cut AS") :]
    .replace("CASE WHEN query_id % 3 = 0 THEN 15 ELSE 25 END", "25")
    .replace("FROM asked)", "FROM sought)")
    + """ SELECT query_id, chunk_id, rank::INTEGER AS rank, round(v, 6) AS vector_part, round(kw, 6) AS keyword_part,
      round(recency, 6) AS recency, round(boost, 6) AS boost, round(final, 6) AS final_score FROM rk WHERE rank <= 5""",
    CORPUS + " sought decided",
)
def hybrid_search_filtered(spark, sf):
    """The exhaustive mode: all filters hold before the nearest chunks are taken."""
    found = search.hybrid_search(
        texts(spark, sf), vecs(spark, sf), sought(spark, sf), now=NOW, config=search.ScoringConfig(recency=True),
        decisions=decided(spark, sf), **SOUGHT_FILTERS,
    )
    return _rounded(found)


@register(
    "vector_only_filtered",
    SOUGHT_NEAR
    + """ ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank
      FROM near JOIN docs USING (chunk_id) WHERE language = 'en')
    SELECT query_id, chunk_id, rank::INTEGER AS rank, round(greatest(0.0, 1 - d), 6) AS final_score FROM ranked WHERE rank <= 5""",
    CORPUS + " sought decided",
)
def vector_only_filtered(spark, sf):
    found = search.vector_only_search(
        texts(spark, sf), vecs(spark, sf), sought(spark, sf), decisions=decided(spark, sf), language="en", **SOUGHT_FILTERS
    )
    return found.select("query_id", "chunk_id", "rank", F.round("final_score", 6).alias("final_score"))
