"""A keyed table on shared storage: a compacted base and the deltas written since, both in buckets of keys.

``delta/batch=N`` holds what batch N wrote, ``base/upto=N`` what the touched buckets held after batch N; a folder counts
once its job has finished. For each bucket the newest base is read, and the deltas after it. Rewriting a batch replaces
its folder, so a retry changes nothing; compaction rewrites only buckets that have deltas; a lookup of some keys reads
only their buckets. Rows of a key are replaced as a whole by those of a later batch; a tombstone removes them.

Nulls in keys are equal to each other. One writer at a time.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType | str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._held = StructType(list(self.schema.fields)).add("_batch", "long").add("_deleted", "boolean")

    def _folders(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        return [s.getPath().getName() for s in files.listStatus(at)]

    def _finished(self, kind: str) -> dict[int, set[int]]:
        """Buckets by batch of the finished folders ``delta/batch=N`` or ``base/upto=N``."""
        out = {}
        for name in self._folders(f"{self.path}/{kind}"):
            inside = self._folders(f"{self.path}/{kind}/{name}")
            if "_SUCCESS" in inside:
                out[int(name.split("=")[1])] = {int(n.split("=")[1]) for n in inside if n.startswith("_bucket=")}
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _parts(self, before: int | None = None) -> tuple[dict[int, int], dict[int, list[int]]]:
        """The base of each bucket and the batches of deltas after it."""
        base: dict[int, int] = {}
        for upto, buckets in sorted(self._finished("base").items()):
            base |= dict.fromkeys(buckets, upto)
        deltas = defaultdict(list)
        for batch, buckets in self._finished("delta").items():
            for bucket in buckets:
                if batch > base.get(bucket, -1) and (before is None or batch < before):
                    deltas[bucket].append(batch)
        return base, deltas

    def _load(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._held)
        return self.spark.read.schema(self._held).parquet(*paths)

    def _latest(self, base: dict[int, int], deltas: dict[int, list[int]], buckets) -> DataFrame:
        """Current rows of ``buckets``, tombstones included where they are the latest."""
        paths = [f"{self.path}/base/upto={base[b]}/_bucket={b}" for b in buckets if b in base]
        paths += [f"{self.path}/delta/batch={n}/_bucket={b}" for b in buckets for n in deltas.get(b, ())]
        last = F.max("_batch").over(Window.partitionBy(*self.keys))
        return self._load(paths).withColumn("_last", last).where(F.col("_batch") == F.col("_last")).drop("_last")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Store the rows of a batch. A column ``_deleted``, where there is one, marks tombstones."""
        if "_deleted" not in rows.columns:
            rows = rows.withColumn("_deleted", F.lit(False))
        rows = rows.select(*self.schema.names, F.lit(batch).cast("long").alias("_batch"), "_deleted")
        self._store(rows, f"{self.path}/delta/batch={batch}")

    def _store(self, rows: DataFrame, path: str) -> None:
        dealt = rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(path)

    def read(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Current rows, with the batch of each as ``_batch``: those before a batch, those in the buckets of keys ``of``."""
        base, deltas = self._parts(before)
        wanted = base.keys() | deltas.keys()
        if of is not None:
            wanted &= {r[0] for r in of.select(self._bucket()).distinct().collect()}  # at most as many as there are buckets
        quiet = [f"{self.path}/base/upto={base[b]}/_bucket={b}" for b in sorted(wanted) if b not in deltas]
        rows = self._latest(base, deltas, sorted(b for b in wanted if b in deltas))
        if quiet:
            rows = rows.unionByName(self._load(quiet))
        return rows.where(~F.col("_deleted")).drop("_deleted")

    def compact(self) -> list[int]:
        """Fold the deltas of each touched bucket into its base; returns these buckets."""
        base, deltas = self._parts()
        touched = sorted(deltas)
        if touched:
            newest = max(n for batches in deltas.values() for n in batches)
            # a bucket whose rows are all gone keeps its tombstones, which hide the base before
            self._store(self._latest(base, deltas, touched), f"{self.path}/base/upto={newest}")
        return touched

    def vacuum(self) -> int:
        """Delete folders that no reader needs any more; readers of an older state must have finished."""
        base, _ = self._parts()
        old = [
            f"{self.path}/base/upto={n}/_bucket={b}"
            for n, buckets in self._finished("base").items() for b in buckets if base[b] > n
        ]
        old += [
            f"{self.path}/delta/batch={n}/_bucket={b}"
            for n, buckets in self._finished("delta").items() for b in buckets if base.get(b, -1) >= n
        ]
        for name in old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return len(old)
