"""Files in the folder that the cluster shares: scratch tables, and small files that appear whole or not at all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session has none, a temporary folder for a session inside this process, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.conf.get("spark.master", "").split("[")[0] == "local":
        root = _ROOTS.setdefault("local", tempfile.mkdtemp(prefix="folio-"))
    return (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below shared_dir() that goes when the session ends."""
    path = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}"
    fs, where = _fs(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{path}/{name}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written below shared_dir() and read back, for a plan that reads it several times. It goes when the session ends."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    """PySpark has no calls on files; Hadoop's own reach whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file `path`, whole, unless it is there already; whether this call made it. A rename that replaces nothing, so
    of two writers one wins, and one that dies halfway leaves no file of that name."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    fs, where = _fs(spark, draft)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(where, jvm.org.apache.hadoop.fs.Path(path), never)
    except (PySparkException, _java_error()) as e:
        fs.delete(where, False)
        if "already exist" in str(e) or "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def _java_error() -> type[Exception]:
    from py4j.protocol import Py4JJavaError

    return Py4JJavaError
