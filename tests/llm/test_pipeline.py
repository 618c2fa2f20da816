"""Each stage on its own input, held against its operator."""

import re

import pytest
from pyspark.sql import functions as F

from vesselflow.llm import mixing, neardup, secret_scan, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(3)).withColumn("extra", F.lit(None).cast("string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    (_, one), (_, two), (_, three), (_, four), (_, five) = corpus_pipeline.STAGES
    a = one(spark, docs, SF).cache()
    assert a.columns == docs.columns and ids(a) == ids(toxicity.toxicity(docs, labels).where("predicted = 0"))
    b = two(spark, a, SF).cache()
    assert b.columns == docs.columns and ids(b) == sorted({r.doc_id for r in neardup.near_duplicates(a).where("kept").collect()})
    c = three(spark, b, SF).cache()
    assert c.columns == docs.columns and ids(c) == ids(b)
    assert secret_scan.scan(c).where("n_assign + n_access + n_hex > 0").count() == 0
    d = four(spark, c, SF).cache()
    words = lambda df: sum(len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in df.collect())
    assert d.columns == docs.columns and words(d) == mixing.mix_sources(c).agg(F.sum("taken")).first()[0]
    e = five(spark, d, SF)
    assert e.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096 and set(ids(e)) == set(ids(d))


def test_stages_on_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_mixing_starts_no_python_workers(spark, capsys):
    """Rows made in the driver are local tables, not Python RDDs, whose workers would stay in memory beside packing's; nulls and no rows too."""
    import pyarrow as pa
    from vesselflow.llm._shared import driver_table

    made = driver_table(spark, [("a", 1), (None, 2)], of=pa.string(), size=pa.int64())
    none = driver_table(spark, [], of=pa.string(), size=pa.int64())
    assert [tuple(r) for r in made.collect()] == [("a", 1), (None, 2)] and none.collect() == [] and none.dtypes == [("of", "string"), ("size", "bigint")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (made, mixing.mix_sources(docs), mixing.apply_mix(docs)):
        df.explain()
        assert "ExistingRDD" not in capsys.readouterr().out
