"""Keyed state: a rate limiter whose window starts at each key's first event, and throttled progress."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.sources.shared import scratch

VERDICT = "key string, ts long, id string, count long, allowed boolean, retry_after long"


def step(state: tuple[int, int] | None, ts: int, window: int, most: int) -> tuple[tuple[int, int], bool, int | None]:
    """state: (end of the window, events in it). Every event counts, rejected ones too."""
    end, n = state if state and ts < state[0] else (ts + window, 0)
    n += 1
    ok = n <= most
    return (end, n), ok, None if ok else -(-(end - ts) // 1000)


def _walk(rows: pd.DataFrame, state, window: int, most: int):
    out = []
    for ts, id_ in sorted(zip(rows["ts"], rows["id"], strict=True)):
        state, ok, retry = step(state, int(ts), window, most)
        out.append((int(ts), id_, state[1], ok, retry))
    return out, state


# batch: sorted partitions, and the window that is open at their bounds ------------------------------------------------------
#
# A window begins at a key's first event, and then at the first event at or after the end of the one before, or at a forced
# event. Events are dealt out by range of key, time and id, so a key of any size lies in consecutive partitions. The window that
# a partition leaves open is a step function of the one it was entered with, and only ends within one width of its first event
# can occur; so a partition gives a few steps, which are followed from bound to bound, and then all partitions are walked at once.

#: Rows of one partition, about.
ROWS = 1 << 20
_NEVER = 1 << 62


def steps(ts: np.ndarray, forced: np.ndarray | None, width: int, known: bool) -> list[tuple[int, int, int]]:
    """(until, start, row) of a key's rows in one partition: if the window before them ends at or before `until`, the one they leave
    open began at `start`, and its first row is `row`. known: the key begins here, and no window is before."""
    t, first = np.unique(ts, return_index=True)
    m, at = len(t), np.arange(len(t))
    following, stop = np.searchsorted(t, t + width), m
    if forced is not None and forced.any():
        marks = np.unique(np.searchsorted(t, ts[forced]))
        following, stop = np.minimum(following, np.append(marks, m)[np.searchsorted(marks, at + 1)]), int(marks[0])
    last = np.where(following < m, following, at)
    while (last[last] != last).any():
        last = last[last]
    if known:
        return [(_NEVER, int(t[last[0]]), int(first[last[0]]))]
    most = min(int(np.searchsorted(t, t[0] + width)), m - 1, stop)
    enter = np.flatnonzero(np.append(last[1 : most + 1] != last[:most], True))  # the last of those that lead to one window
    out = [(int(t[i]), int(t[last[i]]), int(first[last[i]])) for i in enter.tolist()]
    return [*out[:-1], (_NEVER, *out[-1][1:])] if most == stop else out


def firsts(ts: np.ndarray, forced: np.ndarray | None, width: int, end: int | None) -> list[int]:
    """Rows that begin a window; end: of the one that is open before them."""
    times, marks, out = ts.tolist(), [] if forced is None else np.flatnonzero(forced).tolist(), []
    at, mark = 0 if end is None else bisect_left(times, end), 0
    while True:
        if mark < len(marks) and marks[mark] <= at:
            at = marks[mark]
        if at >= len(times):
            return out
        out.append(at)
        mark = bisect_left(marks, at + 1)
        at = bisect_left(times, times[at] + width, at + 1)


class _Windows:
    """Events (key, ts, id and maybe done, which forces a window) in sorted partitions."""

    def __init__(self, events: DataFrame, width: int, forced: bool = False):
        if width < 1:
            raise ValueError("a window is 1 ms wide at least")
        self.width, self.done = width, ["done"] if forced else []
        own = events.select(F.col("key").cast("string"), F.col("ts").cast("long"), F.col("id").cast("string"), *self.done).filter("ts is not null")
        self.parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // ROWS))
        self.events = scratch(own.repartitionByRange(self.parts, "key", "ts", "id").withColumn("part", F.spark_partition_id()), "events")
        ends = F.count("*").alias("n"), F.min(F.struct("key")).alias("a"), F.max(F.struct("key")).alias("z")
        self.before, self.open = {}, {}
        self._hand_over(self.events.groupBy("part").agg(*ends).orderBy("part").collect())  # a row for each partition

    def _hand_over(self, parts: list) -> None:
        """Fills before (rows ahead of a partition) and open (end and first row of the window that its first key has open)."""
        asked, total, chain = [], 0, None
        for k, r in enumerate(parts):
            self.before[r.part], total = total, total + r.n
            goes_on = k > 0 and parts[k - 1].z == r.a
            known = not goes_on or r.a != r.z
            chain = r.part if known else chain
            if k + 1 < len(parts) and parts[k + 1].a == r.z:
                asked.append((r.part, r.z.key, chain, known, parts[k + 1].part, total))
        if not asked:
            return
        spark, width, forced = self.events.sparkSession, self.width, bool(self.done)
        bound = spark.createDataFrame(asked, "p int, k string, chain int, known boolean, next int, total long")
        last = self.events.join(F.broadcast(bound), (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k")))  # a row for each partition
        shape = "chain int, next int, until long, start long, row long"

        def summary(table: pa.Table) -> pa.Table:
            """One key's rows in one partition."""
            table = table.sort_by("ts")
            one = {c: table.column(c)[0].as_py() for c in ("chain", "next", "known", "total")}
            done = table.column("done").to_numpy().astype(bool) if forced else None
            found = steps(table.column("ts").to_numpy(), done, width, one["known"])
            rows = [(one["chain"], one["next"], until, start, one["total"] - len(table) + row) for until, start, row in found]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in shape.split(", ")])

        done = [F.coalesce("done", F.lit(False)).alias("done")] if forced else []
        table = last.select("part", "chain", "next", "known", "total", "ts", *done).groupBy("part").applyInArrow(summary, shape)

        def follow(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The steps of a chain of partitions, in order; of each partition the first that holds is taken."""
            own, end, row, taken = None, 0, 0, None
            for batch in frames:
                out = []
                for chain, following, until, start, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if chain != own:
                        own, end, row, taken = chain, -_NEVER, 0, None
                    if taken != following and end <= until:
                        end, row, taken = start + width, first, following
                    out.append((following, end, row))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "end", "row"])

        ordered = table.repartition("chain").sortWithinPartitions("chain", "next", "until")
        states = ordered.mapInArrow(follow, "part int, end long, row long").groupBy("part").agg(F.max(F.struct("row", "end")).alias("s"))  # the last that was reached
        self.open = {r.part: (r.s.end, r.s.row) for r in states.collect()}  # a row for each partition

    def walk(self, emit: Callable, schema: str) -> DataFrame:
        """emit(batch, rank, first rank of the window, end of the window, whether the row begins one) for runs of rows of one key."""
        before, open_, width = self.before, self.open, self.width

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = key = state = None
            rank = 0
            for batch in frames:
                parts, keys, ts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                done = batch.column(4).fill_null(False).to_numpy(zero_copy_only=False) if batch.num_columns > 4 else None
                cut = np.flatnonzero((parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1])) + 1
                first_rank, end, begins = np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
                ranks = np.zeros(len(ts), np.int64)
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(ts)], strict=True) if len(ts) else ():
                    if parts[lo] != part:
                        part, key = int(parts[lo]), keys[lo]
                        rank, state = before[part], open_.get(part)
                    elif keys[lo] != key:
                        key, state = keys[lo], None
                    at = np.array(firsts(ts[lo:hi], None if done is None else done[lo:hi], width, state and state[0]), np.int64)
                    mine = np.searchsorted(at, np.arange(hi - lo), "right")
                    first_rank[lo:hi] = np.append(state[1] if state else 0, rank + at)[mine]
                    end[lo:hi] = np.append(state[0] if state else 0, ts[lo:hi][at] + width)[mine]
                    begins[lo:hi][at] = True
                    ranks[lo:hi] = rank + np.arange(hi - lo)
                    state, rank = (int(end[hi - 1]), int(first_rank[hi - 1])), rank + hi - lo
                yield emit(batch, ranks, first_rank, end, begins)

        dealt = self.events.select("part", "key", "ts", "id", *self.done).repartition(self.parts, "part")
        return dealt.sortWithinPartitions("part", "key", "ts", "id").mapInArrow(run, schema)


def rate_limit(events: DataFrame, window_ms: int = 60_000, most: int = 100) -> DataFrame:
    """Batch: events (key, ts in ms, id) with a verdict each. Events without a time are left out; a null key is a key."""

    def emit(batch: pa.RecordBatch, rank: np.ndarray, first: np.ndarray, end: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
        count = rank - first + 1
        over = count > most
        wait = -(-(end - batch.column(2).to_numpy()) // 1000)
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(count), pa.array(~over), pa.array(wait, mask=~over)], [c.split()[0] for c in VERDICT.split(", ")])

    return _Windows(events, window_ms).walk(emit, VERDICT)


def rate_limit_stream(events: DataFrame, window_ms: int = 60_000, most: int = 100, ttl_ms: int = 600_000) -> DataFrame:
    """The same over a stream; state that sees no event for ttl_ms is dropped."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames))
        out, held = _walk(rows, held, window_ms, most)
        state.update(held)
        state.setTimeoutDuration(ttl_ms)
        frame = pd.DataFrame(out, columns=["ts", "id", "count", "allowed", "retry_after"])
        frame.insert(0, "key", key[0])
        frame["retry_after"] = frame["retry_after"].astype("Int64")
        yield frame

    own = events.select(F.col("key").cast("string"), F.col("ts").cast("long"), F.col("id").cast("string"))
    return own.groupBy("key").applyInPandasWithState(run, VERDICT, "end long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def throttle(events: DataFrame, gap_ms: int = 500) -> DataFrame:
    """Progress rows (key, ts, id, done) of which one is kept if gap_ms have passed since the last kept one, or it is done. Rows
    without a time are left out."""

    def emit(batch: pa.RecordBatch, rank: np.ndarray, first: np.ndarray, end: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(batch.columns[1:], ["key", "ts", "id", "done"]).filter(pa.array(begins))

    return _Windows(events, gap_ms, forced=True).walk(emit, "key string, ts long, id string, done boolean")


def request_log(requests: DataFrame, slow_ms: int = 2000) -> DataFrame:
    """duration, slow and not_found for (start, end, status) rows."""
    ms = F.col("end") - F.col("start")
    return requests.select("*", ms.alias("duration"), (ms > slow_ms).alias("slow"), (F.col("status") == 404).alias("not_found"))


def publish(stream: DataFrame, listeners: list[Callable[[list], None]], checkpoint: str, snapshot: list | None = None):
    """Progress rows to listeners: a snapshot first, then every batch; a failing listener does not stop the others."""
    for f in listeners:
        f(snapshot or [])

    def send(batch: DataFrame, _: int) -> None:
        rows = batch.collect()  # progress events of one trigger
        for f in listeners:
            try:
                f(rows)
            except Exception:  # noqa: BLE001, PERF203  one listener's failure is its own
                continue

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enrich_stream(stream: DataFrame, save: Callable[[DataFrame], None], checkpoint: str):
    """Runs save over everything new until nothing is left; the checkpoint remembers what was done."""
    return stream.writeStream.foreachBatch(lambda batch, _: save(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
