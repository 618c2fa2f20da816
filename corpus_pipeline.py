"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vesselflow.llm import mixing, neardup, packing, secret_scan, toxicity
from vesselflow.llm._shared import small_side, written

#: No SQL expresses the trained classifier, the packing or the mix; tests hold each stage against its operator and brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, with all columns of `docs`, whatever their names.

    Null and empty texts are scored as empty, very long ones whole; repeated rows
    share one verdict; a row of null doc_id stays; an empty table gives none.
    """
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = written(scored.where("predicted = 1").select("doc_id").distinct(), "toxic")
    return docs.join(small_side(bad), "doc_id", "left_anti").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest doc_id, and one row of each document.

    Null and empty texts have no shingles and stay; very long texts count whole;
    of repeated rows one stays, any of them; rows of null doc_id stay each; all
    columns of `docs` stay, whatever their names; an empty table gives none.
    """
    gone = written(neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies")
    once = docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
    ids = once.groupBy("doc_id").count()
    again = written(ids.where("count > 1").select("doc_id"), "again")
    if not again.count():
        return once
    twice = once.join(small_side(again), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return once.join(small_side(again), "doc_id", "left_anti").select(docs.columns).union(twice)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; null and empty texts stay, repeated rows are masked alike, columns of any name stay, an empty table gives none."""
    return secret_scan.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document; documents that the mix does not take go.

    Null and empty texts have no words and go; very long texts count whole;
    repeated rows count each; a null source is one of its own; an empty table
    gives none. The columns of `docs` stay.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all mixed rows.

    A null or empty text is its end token alone; very long texts are cut into
    pieces; repeated rows are packed each; columns other than doc_id and text
    are left out, whatever their names; an empty table gives none.
    """
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
