"""Keyed sessions on a stream: state with event-time timers, each session emitted once, late rows kept apart.

A session of a key ends when ``gap`` goes by without a row of it.  The state of a
key is its open sessions; a timer wakes the key when the watermark passes the
end of its earliest one, which is then emitted and forgotten.  Rows that the
watermark has passed when they arrive change no session and come out as late
rows, so nothing is dropped: every row is counted in exactly one output row.

Spark drops late rows of a column that has a watermark before any function sees
them.  So each row goes in twice: with its time but no clock, and, without
anything else, as a tick of the clock that the watermark follows.  Ticks have the
key of their row, so they are dealt out as the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.staging import scratch

OUT = "kind string, key string, start timestamp, end timestamp, n bigint, total double"
STATE = "first array<bigint>, last array<bigint>, n array<bigint>, total array<double>"
_MICROS = "unix_micros(ts)"


def fold_sessions(open_: list[list], rows: list[tuple[int, float]], gap: int) -> list[list]:
    """Sessions [first, last, n, total], in order and parted by ``gap`` or more, with (time, value) rows taken in."""
    parts = sorted([*open_, *([t, t, 1, v] for t, v in rows)], key=lambda s: (s[0], s[1]))
    out: list[list] = []
    for first, last, n, total in parts:
        if out and first - out[-1][1] < gap:
            old = out[-1]
            old[1], old[2], old[3] = max(old[1], last), old[2] + n, old[3] + total
        else:
            out.append([first, last, n, total])
    return out


def _stepper(gap: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        sessions = [list(s) for s in zip(*state.get, strict=True)] if state.exists else []
        rows, out = [], []
        for b in batches:
            b = b[b["micros"].notna()]
            for t, v in zip(b["micros"].astype("int64"), b["value"].fillna(0.0), strict=True):
                if t < mark:
                    out.append(("late", key[0], t, t, 1, v))
                else:
                    rows.append((t, v))
        sessions = fold_sessions(sessions, rows, gap)
        out += [("session", key[0], *s) for s in sessions if s[1] + gap <= mark]
        sessions = [s for s in sessions if s[1] + gap > mark]
        if sessions:
            state.update(tuple(list(c) for c in zip(*sessions, strict=True)))
            state.setTimeoutTimestamp(max(min(s[1] for s in sessions) + gap, mark + 1000) // 1000)
        elif state.exists:
            state.remove()
        if not out:
            return
        frame = pd.DataFrame(out, columns=["kind", "key", "start", "end", "n", "total"])
        frame["start"], frame["end"] = (pd.to_datetime(frame[c].astype("int64"), unit="us", utc=True) for c in ("start", "end"))
        yield frame

    return step


def sessions_once(events: DataFrame, *, key: str = "user_id", ts: str = "ts", value: str = "value", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(kind, key, start, end, n, total) in append mode: a row for each session once it is over, and one for each late row.

    Rows without a key or a time belong to no session and are left out; a row
    without a value counts as 0 in the total.
    """
    t = F.col(ts).cast("timestamp")
    rows = events.where(F.col(key).isNotNull() & t.isNotNull()).select(F.col(key).cast("string").alias("key"), t.alias("t"), F.col(value).cast("double").alias("value"))
    real = F.struct("key", F.unix_micros("t").alias("micros"), "value", F.lit(None).cast("timestamp").alias("clock"))
    tick = F.struct("key", F.lit(None).cast("long").alias("micros"), F.lit(None).cast("double").alias("value"), F.col("t").alias("clock"))
    both = rows.select(F.explode(F.array(real, tick)).alias("r")).select("r.*").withWatermark("clock", late)
    length = int(pd.Timedelta(gap) / pd.Timedelta(microseconds=1))
    return both.groupBy("key").applyInPandasWithState(_stepper(length), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def closing_row(spark: SparkSession, last, *, schema, key: str = "user_id", ts: str = "ts", after: str = "400 days") -> DataFrame:
    """A row of its own key, far behind ``last``: written behind the data of a finite run, it closes every session before it."""
    cols = {key: F.lit(-1), ts: F.lit(last) + F.expr(f"interval {after}")}
    return spark.range(1).select(*(cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def run_sessions(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run over all that is there now; returns the table of sessions and the table of late rows, written once each."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, "quillspark-stream")
    out = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    out.format("parquet").option("path", f"{path}/out").partitionBy("kind").start().awaitTermination()
    table = spark.read.schema(stream.schema).parquet(f"{path}/out")
    return tuple(table.where(F.col("kind") == kind).drop("kind") for kind in ("session", "late"))
