"""Streams against batch results over all rows, in several micro-batches, out of order, and with windows left open."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.sources.keyed import KeyedTable
from lodestone.streaming import current, logs

DAY = datetime(2024, 1, 1)


def streamed(spark, folder, schema, deliveries):
    """A stream that meets each delivery in a micro-batch of its own."""
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def shuffled(rows, time, batches, late_hours, seed=1):
    """Rows dealt to batches by time, each up to ``late_hours`` late."""
    lots = random.Random(seed)
    arrival = sorted(rows, key=lambda r: time(r) + timedelta(hours=lots.uniform(0, late_hours)))
    size = -(-len(arrival) // batches)
    return [arrival[k : k + size] for k in range(0, len(arrival), size)]


def test_open_windows_and_late_rows_are_counted(spark, tmp_path):
    lots = random.Random(3)
    rows = [(lots.choice(["a", "b", "", None]), DAY + timedelta(minutes=lots.randrange(9000))) for _ in range(300)]
    stream = streamed(spark, tmp_path / "in", "error_type string, created_at timestamp_ntz", shuffled(rows, lambda r: r[1], 4, 30))
    counted = logs.stream_error_counts(stream, delay="40 hours")
    table = current.keep_current(counted, str(tmp_path / "out"), ["window_start", "window_end", "error_type"], compact_every=2)
    got = {(r.window_start, r.error_type): r.row_count for r in current.current(table).collect()}
    assert got == Counter((t.replace(hour=0, minute=0), e or "unknown") for e, t in rows)


def sessions_of(rows, gap):
    out = []
    for user in {r[0] for r in rows}:
        own, start = sorted(r for r in rows if r[0] == user), None
        for _, at, reason in own:
            if start is None or at - end >= gap:  # noqa: F821
                if start is not None:
                    out.append((user, start, end + gap, total, missed))
                start, total, missed = at, 0, 0
            end, total, missed = at, total + 1, missed + (reason == "didnt_answer")
        out.append((user, start, end + gap, total, missed))
    return sorted(out)


def test_sessions_join_when_late_rows_fill_a_gap(spark, tmp_path):
    lots = random.Random(5)
    rows = [(lots.randrange(4), DAY + timedelta(minutes=lots.randrange(12_000)), lots.choice(["didnt_answer", "helpful", None])) for _ in range(150)]
    rows += [(9, DAY, "helpful"), (9, DAY + timedelta(hours=6), "helpful"), (9, DAY + timedelta(hours=11, minutes=59), "didnt_answer")]
    stream = streamed(spark, tmp_path / "in", "user_id long, created_at timestamp_ntz, feedback_reason string", shuffled(rows, lambda r: r[1], 5, 40))
    table = current.keep_current(current.session_changes(stream, delay="50 hours"), str(tmp_path / "out"), ["user_id", "window_start"], compact_every=3)
    got = [(r.user_id, r.window_start, r.window_end, r.total, r.didnt_answer) for r in current.current(table).collect()]
    assert sorted(got) == sessions_of(rows, timedelta(hours=6))


@pytest.mark.parametrize("batches", [1, 4])
def test_cooldown_does_not_depend_on_batches(spark, tmp_path, batches):
    lots = random.Random(7)
    rows = [(k, lots.choice("pq"), "staleness", DAY + timedelta(hours=lots.randrange(2000)), lots.random() < 0.2) for k in range(120)]
    expected = {}
    for key in "pq":
        last = None
        for k, _, _, at, gone in sorted((r for r in rows if r[1] == key), key=lambda r: (r[3], r[0])):
            show = not gone and (last is None or last < at - timedelta(days=7))
            last = at if show or gone else last
            expected |= {} if gone else {k: show}
    schema = "event_id long, project string, suggestion_type string, logged_at timestamp_ntz, gone boolean"
    stream = streamed(spark, tmp_path / "in", schema, shuffled(rows, lambda r: r[3], batches, 200))
    changes = current.cooldown_changes(stream.where("not gone"), stream.where("gone"), cooldown_days=7, delay="300 hours")
    table = current.keep_current(changes, str(tmp_path / "out"), ["event_id"])
    assert {r.event_id: r.shown for r in current.current(table).collect()} == expected
    assert 5 < sum(expected.values()) < len(expected)


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "p"], "k long, p string, v long", buckets=4)
    lots, want = random.Random(2), {}
    assert table.read().count() == 0
    for batch in range(7):
        rows = {(lots.choice([None, *range(12)]), lots.choice([None, "x"])): (lots.randrange(99), lots.random() < 0.3) for _ in range(6 if batch % 3 else 1)}
        data = spark.createDataFrame([(*key, v, gone) for key, (v, gone) in rows.items()], "k long, p string, v long, _deleted boolean")
        table.write(data, batch)
        table.write(data, batch)  # a repeated batch changes nothing
        for key, (v, gone) in rows.items():
            want.pop(key, None)
            if not gone:
                want[key] = (v, batch)
        if batch in (2, 5):
            touched = table.compact()
            assert touched and table.compact() == []
            if batch == 5:
                assert table.vacuum() > 0
        got = {(r.k, r.p): (r.v, r["_batch"]) for r in table.read().collect()}
        assert got == want
    before = table.read(before=6)
    assert before.where(F.col("_batch") >= 6).count() == 0
    some = spark.createDataFrame([(3, "x"), (None, None)], "k long, p string")
    found = {(r.k, r.p): r.v for r in table.read(of=some).collect()}
    assert all(found.get(key) == want[key][0] for key in ((3, "x"), (None, None)) if key in want)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", buckets=8)
    table.write(spark.range(200).selectExpr("id AS k", "id AS v"), 0)
    assert table.compact() == list(range(8))
    table.write(spark.createDataFrame([(5, 50)], "k long, v long"), 1)
    assert len(table.compact()) == 1
    assert {r.k: r.v for r in table.read().collect()} == {k: 50 if k == 5 else k for k in range(200)}
    files = table.read(of=spark.createDataFrame([(5,)], "k long")).inputFiles()
    assert len({f.split("_bucket=")[1].split("/")[0] for f in files}) == 1


def test_rows_of_a_key_are_replaced_together(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", buckets=2)
    table.write(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k long, v long"), 0)
    table.write(spark.createDataFrame([(1, 9)], "k long, v long"), 1)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, 9), (2, 3)]
