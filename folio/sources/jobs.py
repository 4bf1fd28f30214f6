"""Jobs of which one runs at a time and that can be stopped: leases in a store's manifest, and Spark's own job tags.

A lease is taken by the commit that writes it, so of two starts one is refused, on whatever drivers they are. It runs out, so a
driver that dies blocks nothing for longer. A stop is written beside it: the runner sees it between batches, keeps what is done
and cancels what is at work, if that is its own session.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from folio.sources.store import Store, Transaction


class Busy(RuntimeError):
    pass


class Job:
    def __init__(self, store: Store, name: str, owner: str):
        self.store, self.name, self.owner = store, name, owner
        self.tag = f"folio-{name}-{owner}"

    def stopped(self) -> bool:
        held = self.store.snapshot().values.get(f"lease {self.name}")
        return held is None or held["owner"] != self.owner or held["stop"]


@contextmanager
def single(store: Store, name: str, ttl_s: float = 3600, clock: Callable[[], float] = time.time) -> Iterator[Job]:
    """Runs the block under the lease `name`; Busy if another holds it. All Spark jobs of the block bear the job's tag."""
    job = Job(store, name, uuid.uuid4().hex)

    def take(tx: Transaction) -> None:
        held = tx.next.values.get(f"lease {name}")
        if held and clock() < held["until"]:
            raise Busy(f"{name} is in progress already")
        tx.next.values[f"lease {name}"] = {"owner": job.owner, "until": clock() + ttl_s, "stop": False}

    def release(tx: Transaction) -> None:
        if tx.next.values.get(f"lease {name}", {}).get("owner") == job.owner:
            del tx.next.values[f"lease {name}"]

    store.run(take)
    store.spark.sparkContext.addJobTag(job.tag)
    try:
        yield job
    finally:
        store.spark.sparkContext.removeJobTag(job.tag)
        store.run(release)


def stop(store: Store, name: str) -> bool:
    """Asks the holder of a lease to stop, and cancels its Spark jobs that run in this session; whether there was one."""
    asked = []

    def mark(tx: Transaction) -> None:
        asked.clear()
        if held := tx.next.values.get(f"lease {name}"):
            tx.next.values[f"lease {name}"] = held | {"stop": True}
            asked.append(held["owner"])

    store.run(mark)
    for owner in asked:
        store.spark.sparkContext.cancelJobsWithTag(f"folio-{name}-{owner}")
    return bool(asked)


def in_batches(job: Job, batches: list, run: Callable[[object], dict]) -> dict:
    """run(batch) for each in turn until all are done or the job is stopped; its counts summed. What finished batches have
    written stays; a batch that is cancelled counts for nothing."""
    total: dict = {}
    for batch in batches:
        if job.stopped():
            return total | {"stopped": True}
        try:
            counts = run(batch)
        except Exception:
            if job.stopped():
                return total | {"stopped": True}
            raise
        total = {k: total.get(k, 0) + v for k, v in counts.items()}
    return total | {"stopped": False}
