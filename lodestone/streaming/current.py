"""Streams whose results are right at any time: changed rows go into a keyed table, batch by batch.

Windows come in update mode, each with its count so far. Sessions and cooldowns keep their own state per key: what can
still change is held until the watermark has passed it, and every change is written at once. So the table equals the
batch result over all rows that were not later than the watermark allows, also for windows that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.keyed import BUCKETS, KeyedTable
from lodestone.streaming.logs import DELAY, on_event_time


def keep_current(
    changes: DataFrame, path: str, keys: list[str], *, compact_every: int = 20, buckets: int = BUCKETS, available_now: bool = True
):
    """Write a stream of changed rows into a keyed table; returns the table, or the running query with it.

    A column ``_deleted``, where there is one, marks rows that no longer hold.
    """
    names = [c for c in changes.columns if c != "_deleted"]
    table = KeyedTable(changes.sparkSession, f"{path}/table", keys, changes.select(names).schema, buckets)

    def store(rows: DataFrame, batch: int) -> None:
        table.write(rows, batch)
        if batch % compact_every == compact_every - 1:
            table.compact()

    writer = changes.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{path}/_checkpoint")
    if not available_now:
        return writer.start(), table
    writer.trigger(availableNow=True).start().awaitTermination()
    return table


def current(table: KeyedTable) -> DataFrame:
    return table.read().drop("_batch")


def _time(micros: str):
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def merged_sessions(sessions: np.ndarray, gap: int) -> np.ndarray:
    """Rows (start, end, total, counted) with overlapping ones joined; an end is the last time plus the gap."""
    sessions = sessions[np.argsort(sessions[:, 0], kind="stable")]
    reach = np.maximum.accumulate(sessions[:, 1])
    firsts = np.flatnonzero(np.append(True, sessions[1:, 0] >= reach[:-1]))
    sums = np.add.reduceat(sessions[:, 2:], firsts, axis=0)
    return np.column_stack([sessions[firsts, 0], np.maximum.reduceat(sessions[:, 1], firsts), sums])


def session_changes(feedback: DataFrame, *, gap_seconds: int = 21_600, delay: str = DELAY) -> DataFrame:
    """New, grown and joined sessions per user, with tombstones of those that went into another.

    The state of a user is one row per session that a row not later than the watermark can still reach.
    """
    gap = gap_seconds * 1_000_000
    rows = on_event_time(feedback, "created_at", delay).select(
        "user_id", "created_at", F.unix_micros("created_at").alias("at"), (F.col("feedback_reason") == "didnt_answer").cast("long").alias("missed")
    )

    def change(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0], np.int64).reshape(-1, 4) if state.exists else np.empty((0, 4), np.int64)
        after = held
        if not state.hasTimedOut:
            for batch in batches:
                at = batch["at"].to_numpy(np.int64)
                fresh = np.column_stack([at, at + gap, np.ones(len(at), np.int64), batch["missed"].fillna(0).to_numpy(np.int64)])
                after = merged_sessions(np.concatenate([after, fresh]), gap)
        before, now = set(map(tuple, held.tolist())), set(map(tuple, after.tolist()))
        changed = [(*s, False) for s in sorted(now - before)]
        starts = {s[0] for s in now}
        changed += [(*s, True) for s in sorted(before) if s[0] not in starts]
        watermark = state.getCurrentWatermarkMs() * 1000
        still = after[after[:, 1] > watermark]
        if len(still):
            state.update((still.reshape(-1).tolist(),))
            state.setTimeoutTimestamp(int(still[:, 1].min() // 1000 + 1))
        elif state.exists:
            state.remove()
        if changed:
            out = pd.DataFrame(changed, columns=["start", "end", "total", "didnt_answer", "_deleted"])
            out.insert(0, "user_id", key[0])
            yield out

    user = feedback.schema["user_id"].dataType.simpleString()
    changes = rows.groupBy("user_id").applyInPandasWithState(
        change,
        f"user_id {user}, start long, end long, total long, didnt_answer long, _deleted boolean",
        "sessions array<long>",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )
    return changes.select(
        _time("start").alias("window_start"), _time("end").alias("window_end"), "user_id", "total", "didnt_answer", "_deleted"
    )


def decide(times, dismissed, last: int | None, cooldown: int) -> tuple[list[bool], list[int | None]]:
    """Whether each suggestion, in order of time, is shown, and the last log time after it.

    One is shown unless a row was logged within the cooldown before it. Shown suggestions and dismissals are logged.
    """
    shown, after = [], []
    for at, gone in zip(times, dismissed):
        show = not gone and (last is None or last < at - cooldown)
        if show or gone:
            last = at
        shown.append(show)
        after.append(last)
    return shown, after


def cooldown_changes(
    suggestions: DataFrame, dismissals: DataFrame | None = None, *, cooldown_days: float = 7, delay: str = DELAY
) -> DataFrame:
    """(event_id, project, suggestion_type, logged_at, shown) of suggestions whose decision is new or has changed.

    Both inputs have event_id, project, suggestion_type and logged_at. Rows of a key that the watermark has not passed
    stay in the state and are decided anew when an earlier row arrives; of the others only the last log time is kept,
    for as long as the cooldown lasts. So the decisions don't depend on how rows fall into batches.
    """
    cooldown = int(cooldown_days * 86_400_000_000)
    columns = ["event_id", "project", "suggestion_type", "logged_at"]
    rows = suggestions.select(*columns, F.lit(False).alias("gone"))
    if dismissals is not None:
        rows = rows.unionByName(dismissals.select(*columns, F.lit(True).alias("gone")))
    rows = on_event_time(rows, "logged_at", delay).withColumn("at", F.unix_micros("logged_at"))

    def change(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = None, []  # held: (time, id, gone, shown before or None)
        if state.exists:
            last, times, ids, gone, shown = state.get
            held = list(zip(times, ids, gone, shown))
        if not state.hasTimedOut:
            for batch in batches:
                held += [(int(a), int(i), bool(g), None) for a, i, g in zip(batch["at"], batch["event_id"], batch["gone"])]
        held.sort(key=lambda r: r[:2])
        shown, after = decide([r[0] for r in held], [r[2] for r in held], last, cooldown)
        changed = [(r[1], r[0], s) for r, s in zip(held, shown) if not r[2] and s is not r[3]]
        watermark = state.getCurrentWatermarkMs() * 1000
        final = sum(r[0] < watermark for r in held)
        if final:
            last = after[final - 1]
        rest = [(r[0], r[1], r[2], s) for r, s in zip(held[final:], shown[final:])]
        if rest or (last is not None and last + cooldown >= watermark):
            times, ids, gone, known = (list(c) for c in zip(*rest)) if rest else ([], [], [], [])
            state.update((last, times, ids, gone, known))
            state.setTimeoutTimestamp(max(rest[0][0] if rest else last + cooldown, watermark) // 1000 + 1)
        elif state.exists:
            state.remove()
        if changed:
            out = pd.DataFrame(changed, columns=["event_id", "at", "shown"])
            out.insert(1, "project", key[0])
            out.insert(2, "suggestion_type", key[1])
            yield out

    changes = rows.groupBy("project", "suggestion_type").applyInPandasWithState(
        change,
        "event_id long, project string, suggestion_type string, at long, shown boolean",
        "last long, times array<long>, ids array<long>, gone array<boolean>, shown array<boolean>",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )
    return changes.select("event_id", "project", "suggestion_type", _time("at").alias("logged_at"), "shown")
