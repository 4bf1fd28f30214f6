"""Scanning document trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.zips import scan_zip  # noqa: F401

EXTENSIONS = r"\.(txt|html?|md|markdown|pdf)\z"


def texts(files: DataFrame) -> DataFrame:
    """(file_path, content) of the documents among binary files: bytes that are not UTF-8 read as U+FFFD, PDFs are not decoded."""
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    files = files.filter(F.lower("path").rlike(EXTENSIONS))
    text = F.when(F.lower("path").endswith(".pdf"), F.lit("")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return files.select(path.alias("file_path"), text.alias("content"))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content): documents below root. The folder listing and the reads are Spark's own, so any store and any number of
    files will do."""
    return texts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root))


def stream_tree(spark: SparkSession, root: str, files: int = 100, delete: bool = False) -> DataFrame:
    """The same as a stream, `files` at a time; with delete, files go once they have been read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("maxFilesPerTrigger", files)
    return texts((stream.option("cleanSource", "delete") if delete else stream).load(root))
