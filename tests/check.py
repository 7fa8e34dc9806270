"""python tests/check.py [sf] [name ...] compares registered queries with DuckDB."""

import os
import sys
import time
import traceback

sys.path[:0] = [".", "tests"]

from compare import TIMES, connect, differences  # noqa: E402

from pyspark.sql import SparkSession  # noqa: E402

from lodestone import build_session  # noqa: E402
from lodestone.registry import ORACLE, QUERIES  # noqa: E402

sf, names = sys.argv[1], sys.argv[2:]
if os.environ.get("PLAIN"):  # a session without this package's settings
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
else:
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
path = f"/root/testdata/sf{sf}"
con = connect(path)
bad = 0
for name in names or QUERIES:
    began = time.time()
    TIMES.clear()
    try:
        if name in ORACLE:
            found = differences(QUERIES[name](spark, path), con, ORACLE[name])
        else:
            rows = QUERIES[name](spark, path).count()
            found = [] if rows else ["no rows"]
    except Exception as e:  # noqa: BLE001
        text = str(e) if names else str(e)[:600]
        found = [f"{type(e).__name__}: {text[:3000]}"]
        if "-v" in sys.argv:
            traceback.print_exc()
    bad += bool(found)
    print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - began:.1f}s {[round(t, 1) for t in TIMES]}", *found, sep="\n     " if found else " ")
print("failures:", bad)
spark.stop()
