"""Runs a registered query in Spark and its SQL in DuckDB and compares rows, types and values."""

from __future__ import annotations

import math
import time

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


TIMES: list[float] = []


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _cell(v)) for k, v in value.items()))
    return value


def _rows(data: pa.Table) -> list[tuple]:
    names = sorted(data.column_names)
    columns = [data.column(n).to_pylist() for n in names]
    rows = [tuple(_cell(v) for v in row) for row in zip(*columns, strict=True)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def kind(t: pa.DataType) -> str:
    return str(t).replace("large_", "").replace("[ns]", "[us]").replace("list<item:", "list<element:")


def differences(spark_df, con, sql: str) -> list[str]:
    began = time.time()
    mine = spark_df.toArrow()
    middle = time.time()
    theirs = con.sql(sql).to_arrow_table()
    TIMES[:] = [middle - began, time.time() - middle]
    problems = []
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(mine.column_names)} vs {sorted(theirs.column_names)}"]
    for name in mine.column_names:
        a, b = kind(mine.schema.field(name).type), kind(theirs.schema.field(name).type)
        if a != b and not a.startswith("list"):
            problems.append(f"type of {name}: {a} vs {b}")
    if mine.num_rows != theirs.num_rows:
        problems.append(f"rows {mine.num_rows} vs {theirs.num_rows}")
    left, right = _rows(mine), _rows(theirs)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        problems.append(f"values ({sorted(mine.column_names)}): {only_left} vs {only_right}")
    if mine.num_rows == 0:
        problems.append("no rows")
    return problems
