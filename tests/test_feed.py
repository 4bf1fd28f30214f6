"""Progress feeds over a clock of their rows' own."""

from datetime import UTC, datetime

import pytest

from folio.streaming import feed

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(s):
    return datetime.fromtimestamp(1_700_000_000 + s, UTC).replace(tzinfo=None)


def test_feed(rocks, tmp_path):
    """Snapshot, changes in order, keepalives when nothing came; a feed that is started again goes on."""
    spark, n = rocks, [0]

    def arrive(*rows):
        n[0] += 1
        spark.createDataFrame([(j, at(t), s) for j, t, s in rows], feed.STATUS).coalesce(1).write.parquet(str(tmp_path / f"in/{n[0]:03d}"))

    def run():
        source = spark.readStream.schema(feed.STATUS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        known = spark.createDataFrame([("init", "idle"), ("yolo", "off")], "job string, status string")
        out = feed.feed(source, known).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        out.trigger(availableNow=True).start().awaitTermination(240)
        rows = spark.read.schema(feed.FEED).parquet(str(tmp_path / "out")).collect()
        return sorted((r.job, int(r.ts.replace(tzinfo=UTC).timestamp()) - 1_700_000_000, r.kind, r.line) for r in rows)

    arrive(("init", 2, "importing"), ("init", 1, "downloading"))
    arrive(("yolo", 6, "on"))
    first = run()
    said = lambda s: f"data: {s}\n\n"
    assert first == [("init", 1, "data", said("downloading")), ("init", 1, "snapshot", said("idle")), ("init", 2, "data", said("importing")), ("yolo", 6, "data", said("on")), ("yolo", 6, "snapshot", said("off"))]
    arrive(("init", 40, "complete"))
    arrive(("init", 41, "complete"))
    later = run()
    alive = [r[:3] for r in later if r[2] == "keepalive"]
    assert ("init", 17, "keepalive") in alive and ("yolo", 11, "keepalive") in alive and set(first) < set(later)
    assert ("init", 40, "data", said("complete")) in later and sum(r[2] == "snapshot" for r in later) == 2
    assert all(r[3] == ": keepalive\n\n" for r in later if r[2] == "keepalive")


def test_counters(spark):
    rows = spark.createDataFrame([("batch", True), ("batch", False), ("batch", None), ("yolo", True)], "job string, ok boolean")
    assert {tuple(r) for r in feed.counters(rows).collect()} == {("batch", 3, 1, 2), ("yolo", 1, 1, 0)}
