"""Parts of the operators' results, made without the rest of their work, are the same rows."""

from pyspark.sql import functions as F

from folio.llm import language, maxent

SF = "/root/testdata/sf0.001"


def test_held_out_only(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    want = language.digest(documents).filter("held_out")
    assert sorted(language.digest(documents, held_out=True).collect()) == sorted(want.collect())


def test_base_without_the_model(spark, monkeypatch):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(maxent.score(documents).drop("score").withColumn("base_score", F.round("base_score", 6)).collect())
    monkeypatch.setattr(maxent, "train", None)  # not called
    assert sorted(maxent.base(documents).withColumn("base_score", F.round("base_score", 6)).collect()) == want
