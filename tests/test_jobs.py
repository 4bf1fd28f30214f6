"""Migrations up and down, and jobs of which one runs at a time."""

import threading
import time

import pytest

from folio.sources import jobs, migrations
from folio.sources.library import Library
from folio.sources.store import Store


def filled(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), parts=2, shards=2)
    assert migrations.version(library) == 0 and migrations.migrate(library, 1) == 1
    rows = [("b", "B", "x", "txt", "b", '{"platform":"NES","tags":["t","u","t"]}'), ("a", "A", "y", "txt", "a", None), ("c", "C", "z", "txt", "c", '{"platform":"NES","tags":["t"]}')]
    new = spark.createDataFrame(rows, "id string, title string, content string, format string, file_path string, metadata string")
    library.store.run(lambda tx: tx.insert("guides", new, 5))
    return library


def test_up_and_down(spark, tmp_path):
    library = filled(spark, tmp_path)
    assert "guide_tags" not in library.store.snapshot().tables
    assert migrations.migrate(library) == 4 == migrations.version(library)
    want = {("b", "t"), ("b", "u"), ("c", "t")}
    assert {tuple(r) for r in library.table("guide_tags").collect()} == want and [r.platform for r in library.table("guide_platforms").collect()] == ["NES"]
    at = library.store.snapshot()
    assert migrations.migrate(library) == 4 and library.store.snapshot() == at  # nothing to do
    assert at.tables["guides"]["order"] == "updated_at" and at.tables["games"]["order"] == "platform"
    assert migrations.migrate(library, 1) == 1 and "guide_platforms" not in library.store.snapshot().tables and library.table("guides").count() == 3
    assert library.store.snapshot().tables["guides"]["order"] is None
    assert migrations.migrate(library, 4) == 4 and {tuple(r) for r in library.table("guide_tags").collect()} == want
    assert library.table("guides", at.version).count() == 3
    assert migrations.migrate(library, 0) == 0 and library.store.snapshot().tables == {}
    with pytest.raises(ValueError, match="no version"):
        migrations.migrate(library, 5)
    library.store.run(lambda tx: tx.next.values.update({"schema version": 9}))
    with pytest.raises(migrations.NewerStore):
        migrations.migrate(library)


def test_lookup_plan(spark, tmp_path):
    """One parent's children and one id: the parts that may hold them, pushed filters, no exchange."""
    library = Library(spark, str(tmp_path / "lib"), parts=8).create()
    guides = spark.createDataFrame([(str(i), "T", "c", "txt", "p") for i in range(60)], "id string, title string, content string, format string, file_path string")
    notes = spark.createDataFrame([(f"n{i}", str(i % 60), f"note {i}") for i in range(300)], "id string, guide_id string, content string")
    library.store.run(lambda tx: (tx.insert("guides", guides, 1), tx.insert("notes", notes, 1)))
    own = library.table("notes", keys=["7"])
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert own.count() == 5 and "Exchange" not in plan and "PushedFilters: [IsNotNull(guide_id), EqualTo(guide_id,7)]" in plan
    assert len(own.inputFiles()) == 1 < len(library.table("notes").inputFiles())
    assert library.table("guides", keys=["7", "9", "none"]).count() == 2


def test_one_at_a_time(spark, tmp_path):
    store, now = Store(spark, str(tmp_path / "s")), [1000.0]
    with jobs.single(store, "batch", 60, lambda: now[0]) as job:
        assert not job.stopped()
        with pytest.raises(jobs.Busy), jobs.single(store, "batch", 60, lambda: now[0]):
            pass
        with jobs.single(store, "another"):
            pass
        now[0] += 61  # as if its driver had died
        with jobs.single(store, "batch", 60, lambda: now[0]) as heir:
            assert job.stopped() and not heir.stopped()
    assert not jobs.stop(store, "batch")
    with pytest.raises(ZeroDivisionError), jobs.single(store, "batch"):
        1 / 0  # noqa: B018
    with jobs.single(store, "batch"):
        assert jobs.stop(store, "batch")


def test_stop_keeps_what_is_done(spark, tmp_path):
    store, done = Store(spark, str(tmp_path / "s")), []
    with store.begin() as tx:
        tx.create("t", "id string", "id", 1)

    def run(k):
        if k == 2:
            threading.Timer(1.0, lambda: jobs.stop(store, "batch")).start()
            spark.range(4).rdd.foreach(lambda _: time.sleep(20))
        store.run(lambda tx: tx.append("t", spark.createDataFrame([(str(k),)], "id string")))
        done.append(k)
        return {"processed": 1}

    began = time.time()
    with jobs.single(store, "batch") as job:
        assert jobs.in_batches(job, [0, 1, 2, 3], run) == {"processed": 2, "stopped": True}
    assert done == [0, 1] and store.table("t").count() == 2 and time.time() - began < 60
    with jobs.single(store, "batch") as job:
        assert jobs.in_batches(job, [3], run) == {"processed": 1, "stopped": False}
