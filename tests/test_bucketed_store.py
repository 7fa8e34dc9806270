"""Corpus tables in buckets of chunks: joins and counts per chunk without a shuffle."""

from pyspark.sql import functions as F

from lodestone.sources import store


def tables(spark, n=200):
    base = spark.range(n).withColumnRenamed("id", "chunk_id")
    hot = F.when(F.col("chunk_id") % 3 == 0, F.lit(5)).otherwise(F.col("chunk_id"))
    return {
        "chunks": base.select("chunk_id", F.concat(F.lit("text "), "chunk_id").alias("content"), F.lit(1).alias("odd name")),
        "embeddings": base.select("chunk_id", F.array(F.col("chunk_id") * 1.0).alias("embedding")),
        "decisions": base.select(F.nullif(hot, F.lit(7)).alias("chunk_id"), F.col("chunk_id").alias("decision_id")),
    }


def joined(kept):
    both = kept["chunks"].join(kept["embeddings"], "chunk_id").join(kept["decisions"], "chunk_id")
    return both.groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("content").alias("content"))


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_joins_on_the_key_have_no_exchange(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain = tables(session)
    kept = store.write_bucketed(plain, str(tmp_path), buckets=8)
    assert sorted(joined(kept).collect()) == sorted(joined(plain).collect())
    assert exchanges(joined(kept)) == 0 and exchanges(joined(plain)) > 0
    assert kept["decisions"].where("chunk_id IS NULL").count() == 1


def test_tables_are_found_again_and_replaced(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    base = str(tmp_path)
    store.write_bucketed(tables(session), base, buckets=8)
    names = ("chunks", "embeddings", "decisions")
    for name in names:  # as in a session with a catalog of its own
        session.sql(f"DROP TABLE {store._table(base, name)}")
    found = {name: store.read_bucketed(session, base, name) for name in names}
    assert found["chunks"].columns == ["chunk_id", "content", "odd name"] and found["chunks"].count() == 200
    assert exchanges(joined(found)) == 0
    session.sql(f"DROP TABLE {store._table(base, 'chunks')}")
    again = store.write_bucketed({"chunks": tables(session, 50)["chunks"]}, base, buckets=4)
    assert again["chunks"].count() == 50


def test_empty_tables(spark, tmp_path):
    none = {name: df.limit(0) for name, df in tables(spark).items()}
    kept = store.write_bucketed(none, str(tmp_path), buckets=4)
    assert joined(kept).collect() == [] and kept["chunks"].columns == none["chunks"].columns
