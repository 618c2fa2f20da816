"""The sanctions lists that the queries write."""

from pyspark.sql import functions as F

from vesselflow import queries


def test_lists_stay_bounded(spark, monkeypatch):
    text = [F.lit("x").alias(c) for c in ("name", "imo", "mmsi", "flag")]
    many = spark.range(90_000).select(F.col("id").cast("string").alias("source_entity_id"), *text, F.array(F.lit("p")).alias("programs"), F.array(F.lit("a"), F.lit("b")).alias("aliases"))
    monkeypatch.setattr(queries, "entities", lambda spark, d: many)
    lines = spark.read.text(queries.sdn_file(spark, "")).where(F.contains("value", F.lit("<sdnEntry>")))
    counts = [r["count"] for r in lines.groupBy("f").count().collect()]
    assert sum(counts) == 90_000 and max(counts) <= 10_000
