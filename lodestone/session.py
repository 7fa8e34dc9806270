"""Session settings and the two helpers every operator may need: a size check and a scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows a side may have before an explicit broadcast is ruled out.
BROADCAST_ROW_LIMIT = 200_000

# Bytes of an Arrow batch on its way to a Python kernel over texts.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts travel to Arrow kernels; keep one batch small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "lodestone", **conf: str) -> SparkSession:
    """Session for local runs; on a cluster pass the same SETTINGS to spark-submit."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_enough(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than that many."""
    return df.limit(limit + 1).count() <= limit


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from here on; a lower setting stays.

    Spark's own bound is 64 MB or 10 000 rows, of which a Python worker holds several forms at once.
    """
    size = str(spark.conf.get(BATCH_SETTING)).rstrip("bB")
    if not size.lstrip("-").isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def scratch_path(spark: SparkSession, label: str) -> str:
    """New folder under the shared checkpoint directory of the cluster.

    A machine-local temporary folder is used only in local mode where no directory is configured, as in tests; on a
    cluster executors would not see each other's files there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the scratch folder and read back: computed once, without its lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
