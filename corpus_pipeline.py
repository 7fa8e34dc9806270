"""A training-data pipeline over ``documents``: language ID, line dedup, near-duplicate removal, mixing, tokenizing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of ``docs``. Rows travel as one struct beside the few columns that an operator reads, so further columns of
any name pass through unharmed.

Defined results, for every stage: null doc_ids are documents of their own; an empty table gives no rows. Texts
without a letter are rejected by the first stage; a document that loses all its words to line dedup goes; of the rows
of one doc_id, and of each group of near copies, one stays; a mixed document may occur up to three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import encode_decode
from lodestone.llm.common import WORD, stored
from lodestone.llm.fuzzy_lines import dedup_lines
from lodestone.llm.language_id import UNKNOWN, held_out, language_of, train
from lodestone.llm.mixing import emitted, mix, word_count
from lodestone.llm.ngram_join import ngram_components


def _packed(docs: DataFrame, *more) -> DataFrame:
    return docs.select("doc_id", "text", F.struct("*").alias("row"), *more)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject: those in which it finds a language."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    trees = train(docs.where(~held_out(F.col("doc_id"))))
    found = _packed(docs, language_of(spark, trees, F.col("text")).alias("found"))
    return found.where(F.col("found.lang_pred") != UNKNOWN).select("row.*")


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones, exactly or nearly; n_chars follows the text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    cut = dedup_lines(_packed(docs)).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text"))
        row = row.withField("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return cut.select(row.alias("row")).select("row.*")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    found = ngram_components(docs)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    joined = _packed(docs).join(kept, F.col("doc_id") == F.col("_kept"))
    once = Window.partitionBy("_kept").orderBy(F.xxhash64("text"))
    joined = joined.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("row.*")
    return joined.union(docs.where("doc_id is null"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources to their target weights takes it."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    return emitted(mix(sized).select("row", "copies")).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest and that of the decoded text."""
    import public_tokenizers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("ngram_join", distinct_documents),
    ("mix_sources", mixed_sources),
    ("bpe_encode", token_ids),
]

#: Context-tree codes and MinHash bands have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents; each result is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
