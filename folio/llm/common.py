"""Shared plumbing: tables written to the cluster's shared folder, and global ranks without a single-task window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where the session has none: a temporary one if all runs in this machine's
    process (local tests), else the warehouse, which executors on other hosts see too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.conf.get("spark.master", "").split("[")[0] == "local":
        root = _ROOTS.setdefault("local", tempfile.mkdtemp(prefix="folio-"))
    return (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def save(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and lost executors cost no rework.

    The folder goes when the JVM ends. PySpark has no call that deletes files or lets shuffles go that nothing refers to any
    more; for these two the JVM is asked."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by save() that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._folio_path).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that go to a Python worker at once, in a session that has not set its own number; Spark's is ARROW_DEFAULT. A batch
#: is held several times, in the JVM and in Python, by every task that an executor runs.
ARROW_BYTES, ARROW_DEFAULT, ARROW_KEY = 4 << 20, "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about ARROW_BYTES, or of one row that is longer. The plan reads the setting when it
    runs, so it stays set."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_KEY) == ARROW_DEFAULT:
        conf.set(ARROW_KEY, str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


#: Bytes that one partition of a dealt table should hold at most.
PART_BYTES = 128 << 20


def partitions(df: DataFrame, column: str | None = None) -> int:
    """Partitions to deal df into: the session's number, or more where `column` holds more than PART_BYTES for each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if column is None:
        return n
    total = df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
    return max(n, -(-total // PART_BYTES))


def ranged(df: DataFrame, order: list[Column], name: str, codec: str = "snappy") -> DataFrame:
    """df dealt out by range of `order` and saved, with the partition number in `_part`: ascending _part, then `order`, is
    the global order. Later running totals need only one small row for each partition."""
    dealt = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    return save(dealt.withColumn("_part", F.spark_partition_id()), name, codec)


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of value over all rows before this one. df comes from ranged(); a window sees one partition."""
    tally = df.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(F.broadcast(base), "_part")  # one row for each partition of the plan
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long"))
        .drop("_base")
    )


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def boxed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that helper columns beside it clash with none of them; unboxed() opens it."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])


def unboxed(columns: list[str], box: str = "_row", **replaced: Column) -> list[Column]:
    return [replaced.get(c, F.col(box)[f"c{i}"]).alias(c) for i, c in enumerate(columns)]
