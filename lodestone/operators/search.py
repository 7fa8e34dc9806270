"""Vector, keyword and hybrid retrieval for a table of queries."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import dates, text
from lodestone.operators import matching
from lodestone.operators.chunking import embed_chunks
from lodestone.operators.filters import filter_metadata, resolve_scope
from lodestone.operators.ranking import minmax_normalize, scale, top_k
from lodestone.session import BROADCAST_ROW_LIMIT, small_enough


@dataclass(frozen=True)
class ScoringConfig:
    """Default weights, BM25 parameters and boosts."""

    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    k1: float = 1.2
    b: float = 0.75
    recency: bool = False
    half_life_days: int = 180
    project_boost: float = 1.1
    language_boost: float = 1.05


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cosine in double precision; NULL when a vector is zero."""
    norms = F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right))
    return F.lit(1.0) - _dot(left, right) / F.nullif(norms, F.lit(0.0))


def vector_search(corpus: DataFrame, vector: list[float], *, k: int = 5) -> DataFrame:
    """The k chunks nearest to one vector: a projection and TakeOrderedAndProject.

    The query vector becomes a unit literal, so a row costs two passes over its own vector.
    """
    size = math.sqrt(sum(float(x) ** 2 for x in vector))
    # A zero vector has no direction: NULL distances. One expression text is cheaper to build than a literal per number.
    unit = "array(" + ", ".join(f"{float(x) / size!r}D" for x in vector) + ")" if size else "CAST(NULL AS array<double>)"
    cosine = F.expr(
        f"aggregate(zip_with(embedding, {unit}, (x, y) -> CAST(x AS double) * y), 0.0D, (s, x) -> s + x)"
        " / nullif(sqrt(aggregate(embedding, 0.0D, (s, x) -> s + CAST(x AS double) * CAST(x AS double))), 0.0D)"
    )
    return (
        corpus.withColumn("distance", F.round(1.0 - cosine, matching.DECIMALS))
        .orderBy(F.col("distance").asc_nulls_last(), "chunk_id")
        .limit(k)
    )


def batch_vector_search(corpus: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """query_id, chunk_id, distance, rank for every query of a table."""
    return matching.nearest(corpus, queries, k).select("query_id", "chunk_id", "distance", "rank")


def idf(chunks: DataFrame) -> DataFrame:
    """term, df, idf over all chunks."""
    stats = matching.term_statistics(chunks.select(text.tokens(F.col("content")).alias("tokens")))
    n = stats.where("term = ''").select("df").scalar()
    return stats.where("term <> ''").select(
        "term", "df", matching.inverse_frequency(n, F.col("df")).alias("idf")
    )


def bm25_corpus(
    chunks: DataFrame, queries: DataFrame, *, k: int = 10, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """query_id, chunk_id, score, rank with corpus-wide statistics."""
    return matching.bm25(chunks, queries, k, k1, b).select("query_id", "chunk_id", "score", "rank")


def _term_counts(query_terms: Column, words: Column) -> Column:
    """Occurrences of every query term in a list of words, in query order.

    Counted by removal: array_remove loops natively, a nested lambda would be called per word.
    """
    return F.transform(query_terms, lambda t: F.size(words) - F.size(F.array_remove(words, t)))


def _bm25_sum(tfs: Column, dfs: Column, n: Column, length: Column, mean: Column, k1: float, b: float):
    def one(tf: Column, df: Column) -> Column:
        damp = k1 * (1 - b + b * length / F.nullif(mean, F.lit(0.0)))
        return F.when(tf > 0, matching.inverse_frequency(n, df) * tf * (k1 + 1) / (tf + damp)).otherwise(0.0)

    return F.aggregate(F.zip_with(tfs, dfs, one), F.lit(0.0), lambda acc, x: acc + x)


def bm25_candidates(candidates: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Adds ``bm25`` with statistics taken from the candidate list of each query.

    Input: query_id, query_text, chunk_id, content. Frequencies are aggregated per (query, term
    position) with map-side combine and joined back as one short array per query, so a query with
    very many candidates is neither windowed nor collected.
    """
    rows = candidates.withColumn("_ask", text.tokens(F.col("query_text"))).withColumn(
        "_words", text.tokens(F.col("content"))
    )
    rows = rows.withColumn("_len", F.size("_words")).withColumn(
        "_tf", _term_counts(F.col("_ask"), F.col("_words"))
    )
    # Position 0 carries the length, the others the counts, so one scan gives all statistics. The
    # outer form keeps Catalyst from copying the whole array expression into a size filter.
    marks = F.concat(F.array("_len"), F.col("_tf"))
    per_place = (
        rows.select("query_id", F.posexplode_outer(marks).alias("_pos", "_count"))
        .groupBy("query_id", "_pos")
        .agg(
            F.count("*").alias("_n"),
            F.sum("_count").alias("_sum"),
            F.count_if(F.col("_count") > 0).alias("_df"),
        )
    )
    # One entry per word of the query text, and the leading one.
    entries = F.array_sort(F.collect_list(F.struct("_pos", "_n", "_sum", "_df")))
    lists = per_place.groupBy("query_id").agg(entries.alias("_all")).select(
        "query_id",
        F.get("_all", F.lit(0))["_n"].alias("_n"),
        (F.get("_all", F.lit(0))["_sum"] / F.get("_all", F.lit(0))["_n"]).alias("_mean"),
        F.transform(F.slice("_all", F.lit(2), F.size("_all")), lambda s: s["_df"]).alias("_dfs"),
    )
    score = _bm25_sum(F.col("_tf"), F.col("_dfs"), F.col("_n"), F.col("_len"), F.col("_mean"), k1, b)
    return (
        rows.join(lists, "query_id")
        .withColumn("bm25", F.coalesce(score, F.lit(0.0)))
        .drop("_ask", "_words", "_len", "_tf", "_n", "_mean", "_dfs")
    )


def metadata_boost(
    project: Column, language: Column, query_projects: Column, query_language: Column, config: ScoringConfig
) -> Column:
    """Boost for the single project asked for, and for the language asked for."""
    named = F.filter(query_projects, lambda p: p != "")
    one_project = (F.size(named) == 1) & (F.get(named, F.lit(0)) == project)
    return F.when(one_project, F.lit(config.project_boost)).otherwise(1.0) * F.when(
        language == query_language, F.lit(config.language_boost)
    ).otherwise(1.0)


def _combined(rows: DataFrame, config: ScoringConfig, now, vector_part: Column, keyword_part: Column, k: int) -> DataFrame:
    """Weighted, decayed and boosted score of scaled parts, best k per query."""
    boost = metadata_boost(
        F.col("project"), F.col("language"), F.col("query_projects"), F.col("query_language"), config
    )
    recency = dates.recency(F.col("source_date"), now, config.half_life_days) if config.recency else F.lit(1.0)
    rows = (
        rows.withColumn("vector_part", vector_part)
        .withColumn("keyword_part", keyword_part)
        .withColumn("recency", recency)
        .withColumn("boost", boost)
    )
    base = config.vector_weight * F.col("vector_part") + config.keyword_weight * F.col("keyword_part")
    final = F.least(F.lit(1.0), base * F.col("recency") * F.col("boost"))
    rows = rows.withColumn("final_score", F.round(final, matching.DECIMALS))
    return top_k(rows, ["query_id"], [F.desc("final_score"), F.desc("boost"), F.asc("position")], k)


def hybrid_score(candidates: DataFrame, config: ScoringConfig, *, now, k: int) -> DataFrame:
    """Hybrid score and rank of candidate lists of any length.

    Input: query_id, query_text, query_projects, query_language, chunk_id, content, vector_score,
    position (order of the candidate list, the last tie-break), project, language, source_date.
    Statistics and bounds are aggregates joined back, so no list has to fit into a task.
    """
    rows = bm25_candidates(candidates, k1=config.k1, b=config.b)
    rows = rows.withColumn("bm25", F.round("bm25", matching.DECIMALS))
    bounds = rows.groupBy("query_id").agg(
        F.min("vector_score").alias("_v0"),
        F.max("vector_score").alias("_v1"),
        F.min("bm25").alias("_k0"),
        F.max("bm25").alias("_k1"),
    )
    rows = rows.join(bounds, "query_id")
    vector_part = scale(F.col("vector_score"), F.col("_v0"), F.col("_v1"))
    keyword_part = scale(F.col("bm25"), F.col("_k0"), F.col("_k1"))
    return _combined(rows, config, now, vector_part, keyword_part, k).drop("_v0", "_v1", "_k0", "_k1")


def _score_fetched(candidates: DataFrame, config: ScoringConfig, *, now, k: int) -> DataFrame:
    """The same for lists already cut to a fetch limit of a few times k rows.

    Such lists are tiny, so one shuffle on query_id serves statistics, scaling and rank.
    """
    group = Window.partitionBy("query_id")
    rows = candidates.withColumn("_words", text.tokens(F.col("content"))).withColumn(
        "_tf", _term_counts(text.tokens(F.col("query_text")), F.col("_words"))
    )
    rows = (
        rows.withColumn("_len", F.size("_words"))
        .drop("_words")
        .withColumn("_n", F.count("*").over(group))
        .withColumn("_mean", F.sum("_len").over(group) / F.col("_n"))
        .withColumn("_all", F.collect_list("_tf").over(group))
    )
    dfs = F.transform(
        F.col("_tf"), lambda _, i: F.size(F.filter(F.col("_all"), lambda other: F.get(other, i) > 0))
    )
    raw = _bm25_sum(F.col("_tf"), dfs, F.col("_n"), F.col("_len"), F.col("_mean"), config.k1, config.b)
    rows = rows.withColumn("bm25", F.round(raw, matching.DECIMALS)).drop("_tf", "_all", "_len", "_n", "_mean")

    def scaled(column: str) -> Column:
        return scale(F.col(column), F.min(column).over(group), F.max(column).over(group))

    return _combined(rows, config, now, scaled("vector_score"), scaled("bm25"), k)


def prepare_queries(
    queries: DataFrame, *, raw_text_scoring: bool = False, encoder=None, dimension: int | None = None
) -> DataFrame:
    """Parse the query strings and resolve scopes.

    Input: query_id, raw and optionally embedding, project, projects, language. Queries without an
    embedding get one of their text when an encoder or a dimension is given. Output adds text,
    query_text (for BM25; the raw string when ``raw_text_scoring``), phrases, excluded,
    decision_status, the scope as ``projects`` and has_filters.
    """
    have = set(queries.columns)
    none = F.lit(None).cast("array<string>")
    parsed = queries.withColumn("_q", text.parse_query(F.col("raw")))
    scope = resolve_scope(
        F.col("projects") if "projects" in have else none,
        F.col("project") if "project" in have else F.lit(None).cast("string"),
        F.col("_q.project"),
    )
    parsed = parsed.select(
        "query_id",
        "raw",
        *[c for c in ("embedding",) if c in have],
        (F.col("language") if "language" in have else F.lit(None).cast("string")).alias("query_language"),
        F.coalesce(F.nullif(F.col("_q.text"), F.lit("")), F.col("raw")).alias("text"),
        F.col("_q.phrases").alias("phrases"),
        F.col("_q.excluded").alias("excluded"),
        F.col("_q.decision_status").alias("decision_status"),
        scope.alias("projects"),
        (
            (F.size("_q.phrases") > 0)
            | (F.size("_q.excluded") > 0)
            | F.col("_q.project").isNotNull()
            | F.col("_q.decision_status").isNotNull()
        ).alias("has_filters"),
    )
    if "embedding" not in have and (encoder is not None or dimension is not None):
        parsed = embed_chunks(parsed, column="text", dimension=dimension or 384, encoder=encoder)
    scored = F.col("raw") if raw_text_scoring else F.col("text")
    return parsed.withColumn("query_text", scored)


def _scoped(queries: DataFrame, projects: list[str] | None) -> DataFrame:
    """``queries`` with the projects asked for in a call, where a query names none in its own column."""
    if projects is None:
        return queries
    given = F.array(*[F.lit(p) for p in projects]).cast("array<string>")
    own = F.col("projects") if "projects" in queries.columns else F.lit(None).cast("array<string>")
    return queries.withColumn("projects", F.coalesce(own, given))


def chunk_statuses(decisions: DataFrame) -> DataFrame:
    """chunk_id and the set of statuses its decisions have (a handful of values)."""
    return decisions.groupBy("chunk_id").agg(F.collect_set("status").alias("statuses"))


def _candidates(
    chunks: DataFrame,
    embeddings: DataFrame,
    asked: DataFrame,
    decisions: DataFrame | None,
    *,
    k: int,
    multiplier: int,
    mode: str,
    filters: dict,
) -> DataFrame:
    """Nearest chunks per query after all filters, with a ``position`` in order of distance."""
    eligible = filter_metadata(chunks, **filters)
    if decisions is not None:
        eligible = eligible.join(chunk_statuses(decisions), "chunk_id", "left")
    else:
        eligible = eligible.withColumn("statuses", F.lit(None).cast("array<string>"))
    corpus = eligible.join(embeddings.select("chunk_id", "embedding"), "chunk_id")
    limit_columns = ["projects"]
    if mode == "exhaustive":
        limit_columns += ["phrases", "excluded", "decision_status"]
    elif mode != "candidate":
        raise ValueError("mode is 'candidate' or 'exhaustive'")
    wide = max(multiplier, 5)
    fetch = F.lit(k) * F.when(
        F.lit(any(v is not None for v in filters.values())) | F.col("has_filters"), wide
    ).otherwise(multiplier)
    hits = matching.nearest(corpus, asked.select("query_id", "embedding", *limit_columns), k * wide)
    asked = asked.drop("embedding").withColumn("_fetch", fetch)
    small = small_enough(asked, BROADCAST_ROW_LIMIT // (k * wide))
    hits = hits.join(F.broadcast(asked) if small else asked, "query_id").where(F.col("rank") <= F.col("_fetch"))
    # k * wide rows per query: broadcast them to the chunk scan when the query table is small.
    rows = eligible.join(F.broadcast(hits) if small else hits, "chunk_id")
    kept = (
        text.has_all_phrases(F.col("content"), F.col("phrases"))
        & ~text.has_any_term(F.col("content"), F.col("excluded"))
        & (
            F.col("decision_status").isNull()
            | F.coalesce(F.array_contains("statuses", F.col("decision_status")), F.lit(False))
        )
    )
    return (
        rows.where(kept)
        .withColumn("vector_score", F.greatest(F.lit(0.0), 1 - F.col("distance")))
        .withColumnRenamed("rank", "position")
        .withColumnRenamed("projects", "query_projects")
        .drop("_fetch", "statuses")
    )


def hybrid_search(
    chunks: DataFrame,
    embeddings: DataFrame,
    queries: DataFrame,
    *,
    now,
    k: int = 5,
    config: ScoringConfig | None = None,
    mode: str = "exhaustive",
    decisions: DataFrame | None = None,
    raw_text_scoring: bool = False,
    encoder=None,
    dimension: int | None = None,
    projects: list[str] | None = None,
    source_types: list[str] | None = None,
    date_after=None,
    date_before=None,
    language: str | None = None,
) -> DataFrame:
    """Vector candidates re-ranked with keywords, recency and metadata boosts.

    ``mode='exhaustive'`` filters phrases, exclusions and decision status before the fetch limit;
    ``'candidate'`` filters them afterwards, so fewer than k rows may come back. ``projects`` and a
    query's own ``project:`` form one scope, in which either suffices.
    """
    queries = _scoped(queries, projects)
    filters = dict(
        source_types=source_types,
        date_after=date_after,
        date_before=date_before,
        language=language,
    )
    asked = prepare_queries(
        queries, raw_text_scoring=raw_text_scoring, encoder=encoder, dimension=dimension
    )
    if language is not None:
        asked = asked.withColumn("query_language", F.lit(language))
    rows = _candidates(
        chunks, embeddings, asked, decisions, k=k, multiplier=3, mode=mode, filters=filters
    )
    return _score_fetched(rows, config or ScoringConfig(), now=now, k=k)


def vector_only_search(
    chunks: DataFrame,
    embeddings: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    mode: str = "exhaustive",
    decisions: DataFrame | None = None,
    encoder=None,
    dimension: int | None = None,
    projects: list[str] | None = None,
    **filters,
) -> DataFrame:
    """The same retrieval ranked by max(0, 1 - distance) alone."""
    queries = _scoped(queries, projects)
    asked = prepare_queries(queries, encoder=encoder, dimension=dimension)
    rows = _candidates(
        chunks, embeddings, asked, decisions, k=k, multiplier=1, mode=mode, filters=filters
    )
    ranked = top_k(rows, ["query_id"], [F.asc("position")], k)
    return ranked.withColumn("final_score", F.col("vector_score"))


__all__ = [
    "ScoringConfig",
    "batch_vector_search",
    "bm25_candidates",
    "bm25_corpus",
    "chunk_statuses",
    "cosine_distance",
    "hybrid_search",
    "idf",
    "metadata_boost",
    "minmax_normalize",
    "prepare_queries",
    "hybrid_score",
    "vector_only_search",
    "vector_search",
]
