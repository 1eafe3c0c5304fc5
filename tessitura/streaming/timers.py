"""Job progress with timers: state of a row for each job, freed by event time.

A job's events of one trigger are taken in order of (ts, id). Timers lie in event time: one that the watermark has passed fires without
a further event, and its state goes. State is kept in RocksDB; a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import inactivity as sessions

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timed(StatefulProcessor):
    """One value for each job, and one timer that stands `seconds` behind its last event."""

    schema = ""

    def __init__(self, seconds: int):
        self.ms = 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def put(self, value: tuple, at: int) -> None:
        """The value, and its timer at `at` in place of an earlier one."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.value.update(value)
        self.handle.registerTimer(at)

    def events(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        df = pd.concat(list(rows), ignore_index=True)
        df["ms"] = df["ts"].astype("datetime64[ms]").astype("int64")
        return df.sort_values(["ms", "id"], kind="stable")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Changes(_Timed):
    """State: the last step and progress, and their time."""

    schema = "step string, progress long, last long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.value.get() if self.value.exists() else None
        out = []
        df = self.events(rows)
        for ms, i, step, at in zip(df["ms"].tolist(), df["id"].tolist(), df["step"], df["progress"].tolist(), strict=True):
            if not now or (step, at) != tuple(now[:2]) or ms - now[2] >= self.ms:
                out.append((key[0], i, step, at))
            now = (step, int(at), int(ms))
        self.put(now, now[2] + self.ms)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "id", "step", "progress"])


class _Ends(_Timed):
    """State: when the job ended."""

    schema = "last long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.value.get()[0] if self.value.exists() else None
        df = self.events(rows)
        ends = df[df["status"].isin(["completed", "failed"])]
        out, before = [], now
        for ms, i, status in zip(ends["ms"].tolist(), ends["id"].tolist(), ends["status"], strict=True):
            if now is None or ms - now >= self.ms:
                out.append((key[0], i, status))
                now = int(ms)
        if now != before:
            self.put((now,), now + self.ms)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "id", "status"])


def _timed(progress: DataFrame, processor: _Timed, schema: str, late: str) -> DataFrame:
    spark = progress.sparkSession
    spark.conf.set(*STORE)  # the only store that timers work with
    rows = progress.withWatermark("ts", late).groupBy("job_id")
    return rows.transformWithStateInPandas(processor, schema, "append", "eventTime")


def inactivity(progress: DataFrame, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """A stream of a row for each stretch of a job's events that none followed for `seconds`: job_id, started, timed_out, n. It comes as soon as the
    watermark, in whole milliseconds, has passed the time-out, and the job's state goes. A stretch is a session of the state store: no Python runs for it."""
    progress.sparkSession.conf.set(*STORE)  # stretches lie on disk, not in the heap
    return sessions(progress, seconds, f"{late} 1 millisecond")  # a session that ends at the watermark is through: the time-out must lie before


def emit_on_change(progress: DataFrame, keep: int = 7 * 86400, late: str = "0 seconds") -> DataFrame:
    """A stream of the events whose step or progress differs from the job's last one, or that come `keep` seconds behind it: then the
    job is forgotten."""
    return _timed(progress, _Changes(keep), "job_id long, id long, step string, progress long", late)


def terminal_events(progress: DataFrame, keep: int = 7 * 86400, late: str = "0 seconds") -> DataFrame:
    """A stream of each job's first completed or failed event; what follows it within `keep` seconds is ignored, then the job is forgotten."""
    return _timed(progress, _Ends(keep), "job_id long, id long, status string", late)


def changes(progress: DataFrame, keep: int = 7 * 86400) -> DataFrame:
    """What emit_on_change() gives, of a table."""
    order = W.Window.partitionBy("job_id").orderBy("ts", "id")
    same = F.lag("step").over(order).eqNullSafe(F.col("step")) & F.lag("progress").over(order).eqNullSafe(F.col("progress"))
    near = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(order)) < 1000 * keep
    return progress.withColumn("_seen", F.coalesce(same & near, F.lit(False))).filter("NOT _seen").select("job_id", "id", "step", "progress")
