"""Progress feeds as a service pushes them: a snapshot first, then every change, and a sign of life when nothing happens.

Rows are keyed by the job that reports (init, batch, yolo). Each job's last status is state, so a feed that is started anew, or
that a subscriber joins late, begins with it. Time is the rows' own: a keepalive is due `wait` after a job's last row, and again
after as long, up to the watermark; so a feed gives the same lines whenever it is run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATUS = "job string, ts timestamp, status string"
FEED = "job string, ts timestamp, kind string, line string"
# Milliseconds without a row after which a feed tells that it lives, by job.
WAIT_MS = {"init": 15_000, "batch": 15_000, "yolo": 5_000}


class Feed(StatefulProcessor):
    """kind: snapshot, data or keepalive; line: what is sent."""

    def __init__(self, wait_ms: dict[str, int]):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, told boolean, at long")

    def _wait(self, job: str) -> int:
        return self.wait_ms.get(job, 15_000)

    def _wake(self, job: str, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms + self._wait(job))

    def _rows(self, job: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(job, pd.Timestamp(ms, unit="ms"), kind, f"data: {text}\n\n" if text is not None else ": keepalive\n\n") for ms, kind, text in rows], columns=["job", "ts", "kind", "line"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803  the API's names
        self.last.update((initialState["status"].iloc[-1], False, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (job,), own = key, pd.concat(list(rows)).sort_values("ts", kind="stable")
        times = [int(t.timestamp() * 1000) for t in own["ts"]]
        status, told, at = self.last.get() if self.last.exists() else (None, True, None)
        out = [] if told else [(times[0], "snapshot", status)]
        for ms, text in zip(times, own["status"], strict=True):
            if at is not None:
                out += [(k, "keepalive", None) for k in range(at + self._wait(job), ms, self._wait(job))]  # due before the row came
            out.append((ms, "data", text))
            at = max(ms, at or ms)
        self.last.update((own["status"].iloc[-1], True, at))
        self._wake(job, at)
        yield self._rows(job, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        status, told, _ = self.last.get()
        self.last.update((status, told, due))
        self._wake(key[0], due)
        yield self._rows(key[0], [(due, "keepalive", None)])

    def close(self) -> None:
        pass


def feed(statuses: DataFrame, snapshot: DataFrame | None = None, wait_ms: dict[str, int] | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of STATUS rows as a stream of FEED rows. snapshot: job and status that subscribers begin with. The session's
    state store has to be RocksDB's, as Spark asks for timers."""
    own = statuses.select("job", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", late)
    first = None if snapshot is None else snapshot.select("job", "status").groupBy("job")
    return own.groupBy("job").transformWithStateInPandas(Feed(WAIT_MS | (wait_ms or {})), FEED, "Append", "EventTime", initialState=first)


def counters(results: DataFrame) -> DataFrame:
    """processed, succeeded and failed of each job so far, from rows (job, ok), batch or stream."""
    ok = F.coalesce("ok", F.lit(False))
    return results.groupBy("job").agg(F.count("*").alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
