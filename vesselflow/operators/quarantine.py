"""Dead letters (Q1-Q4): malformed records, failure accounts, listing, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import append_event_log

MOST_LISTED = 500


def split_malformed(log: DataFrame, stream: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(sound, quarantined) rows of (message_id, data, received_at): data that is no JSON goes to quarantine at once; null data is skipped."""
    sound = F.get_json_object("data", "$").isNotNull()
    there = log.where("data is not null")
    bad = there.where(~sound).select(
        "message_id", F.lit(stream).alias("original_stream"), F.lit(group).alias("consumer_group"), F.lit(None).cast("string").alias("original_event"), F.col("data").alias("original_raw_data"),
        F.lit(1).alias("attempts"), F.col("received_at").alias("first_failed_at"), F.col("received_at").alias("last_failed_at"), F.lit("invalid-json").alias("reason"),
    )
    return there.where(sound), bad


def account_failures(failures: DataFrame, limit: int = 3) -> DataFrame:
    """Attempts of each (stream, consumer_group, message_id) with first and last failure and the last error; outcome quarantine at the limit, else retry."""
    per = failures.groupBy("stream", "consumer_group", "message_id").agg(F.count("*").alias("attempts"), F.min("failed_at").alias("first_failed_at"), F.max("failed_at").alias("last_failed_at"), F.max_by("error", F.struct("failed_at", "seq")).alias("error"))
    return per.withColumn("outcome", F.when(F.col("attempts") >= limit, "quarantine").otherwise("retry"))


def list_quarantine(rows: DataFrame, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= MOST_LISTED:
        raise ValueError(f"limit must be from 1 to {MOST_LISTED}")
    return rows.orderBy(F.desc("last_failed_at"), F.desc("message_id")).limit(limit)


def replayable(rows: DataFrame, ids: list | None = None) -> DataFrame:
    """Rows that name their stream and kept their event; optionally only some."""
    own = rows.where("original_stream is not null and original_event is not null")
    return own.where(F.col("message_id").isin(*ids)) if ids is not None else own


def replay(rows: DataFrame, path: str, ids: list | None = None) -> int:
    """Append the events of replayable rows to a log again; the quarantine keeps them."""
    own = replayable(rows, ids).select("message_id", F.col("original_event").alias("data"), F.col("last_failed_at").alias("received_at"))
    append_event_log(own, path)
    return own.count()
