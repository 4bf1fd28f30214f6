"""The catalogue's tables seen in the star-schema test tables, so that its operators run on them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as guides: the source is the game, metadata holds the language as platform and a tag for its source."""
    d = table(spark, sf_dir, "documents")
    meta = F.to_json(F.struct(F.col("lang").alias("platform"), F.array("lang", "source").alias("tags")))
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Document "), F.col("doc_id")).alias("title"), F.col("text").alias("content"), F.lit("txt").alias("format"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"), F.col("source").alias("game_id"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("last_read_position"), meta.alias("metadata"), F.lit(None).cast("long").alias("ai_analyzed_at"),
        F.col("n_chars").alias("created_at"), (F.col("doc_id") % 100).alias("updated_at"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as games."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("ra_game_id"), F.col("p_brand").alias("platform"), F.col("p_retailprice").alias("completion_percentage"),
        F.when(F.col("p_size") < 15, "not_started").when(F.col("p_size") < 35, "in_progress").otherwise("completed").alias("status"),
        F.to_json(F.struct(F.col("p_partkey").cast("string").alias("external_id"))).alias("metadata"), F.col("p_size").cast("long").alias("updated_at"),
    )


GUIDES_SQL = """(select doc_id as id, 'Document ' || doc_id as title, text as content, 'txt' as format, source || '/' || doc_id || '.txt' as file_path,
  source as game_id, case when doc_id % 3 = 0 then n_chars end as last_read_position, lang, source,
  '{"platform":"' || lang || '","tags":["' || lang || '","' || source || '"]}' as metadata, n_chars as created_at, doc_id % 100 as updated_at from documents)"""
GAMES_SQL = """(select p_partkey as id, p_name as title, p_brand as platform, p_retailprice as completion_percentage,
  case when p_size < 15 then 'not_started' when p_size < 35 then 'in_progress' else 'completed' end as status, p_size::bigint as updated_at from part)"""
