"""Keyed state and upserts (E1-E8): identity, profile, latest position, history, retention."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trace_id
from ..sources.readers import POSITION_COLUMNS, first_of_key

PROFILE = ["imo", "name", "call_sign", "ship_type", "destination", "dimension_to_bow"]
MOVEMENT = ["lon", "lat", "sog", "cog", "true_heading", "nav_status", "rate_of_turn"]


def vessel_id(mmsi: Column) -> Column:
    """A vessel's id, derived from its mmsi so that reruns agree."""
    return trace_id(F.lit("vessel"), mmsi)


def last_non_null(column: str, order: str = "seq") -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def first_non_null(column: str, order: str = "seq") -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def upsert_identity(vessels: DataFrame, positions: DataFrame) -> DataFrame:
    """Vessels (mmsi, name) with every vessel seen; a position's name only fills a missing one."""
    seen = positions.groupBy("mmsi").agg(first_non_null("ship_name").alias("new_name"))
    return vessels.join(seen, "mmsi", "full_outer").select("mmsi", F.coalesce("name", "new_name").alias("name"))


def upsert_profile(vessels: DataFrame, statics: DataFrame, columns=tuple(PROFILE)) -> DataFrame:
    """Vessels with each profile field's last non-null value in order of arrival."""
    new = statics.groupBy("mmsi").agg(*[last_non_null(c).alias(f"new_{c}") for c in columns])
    return vessels.join(new, "mmsi", "full_outer").select("mmsi", *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def merge_vessels(vessels: DataFrame, events: DataFrame, columns=tuple(PROFILE)) -> DataFrame:
    """Identity and profile of a micro-batch in one aggregation: a static's name, else the known one, else a position's first."""
    static = lambda c: F.max_by(c, F.when((F.col("kind") == "static") & F.col(c).isNotNull(), F.col("seq")))
    new = events.groupBy("mmsi").agg(*[static(c).alias(f"new_{c}") for c in columns], F.min_by("ship_name", F.when((F.col("kind") == "position") & F.col("ship_name").isNotNull(), F.col("seq"))).alias("seen_name"))
    joined = vessels.join(new, "mmsi", "full_outer")
    return joined.select("mmsi", *[F.coalesce(f"new_{c}", c, *(["seen_name"] if c == "name" else [])).alias(c) for c in columns])


def upsert_latest(latest: DataFrame | None, positions: DataFrame) -> DataFrame:
    """The newest position of each vessel by occurred_at, ties to the later arrival; a winner replaces every movement field.

    last_seen_at is the winner's reception time. `latest` rows have seq -1.
    """
    rest = ["occurred_at", "last_seen_at", *MOVEMENT]
    new = positions.withColumn("last_seen_at", F.col("received_at")).select("mmsi", "seq", *rest)
    both = new if latest is None else latest.select("mmsi", F.lit(-1).cast("long").alias("seq"), *rest).unionByName(new)
    return both.groupBy("mmsi").agg(F.max_by(F.struct(*rest), F.struct("occurred_at", "seq")).alias("x")).select("mmsi", "x.*")


def append_history(history: DataFrame | None, positions: DataFrame) -> DataFrame:
    """History with the first arrival of each (mmsi, occurred_at); what is there stays."""
    new = first_of_key(positions, ["mmsi", "occurred_at"], POSITION_COLUMNS)
    if history is None:
        return new
    return history.unionByName(new.join(history.select("mmsi", "occurred_at"), ["mmsi", "occurred_at"], "left_anti"))


PARTITION = re.compile(r"^.*_y(\d{4})m(\d{2})d(\d{2})$")


def partition_name(day: Column, table: str = "history") -> Column:
    return F.concat(F.lit(table), F.date_format(day, "'_y'yyyy'm'MM'd'dd"))


def partition_plan(existing: DataFrame, now: date, retention_days: int = 7, safety_days: int = 1, precreate_days: int = 7, table: str = "history") -> DataFrame:
    """(name, action): daily partitions to create, from the cutoff to the last precreated day, and to drop, before the cutoff.

    Names that are not daily are left alone.
    """
    low, high = now - timedelta(days=retention_days + safety_days), now + timedelta(days=precreate_days)
    spark = existing.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("day")).select(partition_name(F.col("day"), table).alias("name"))
    create = wanted.join(existing.hint("merge"), "name", "left_anti").withColumn("action", F.lit("create"))
    day = F.to_date(F.concat_ws("-", *[F.regexp_extract("name", PARTITION.pattern, k) for k in (1, 2, 3)]))
    drop = existing.where(F.col("name").rlike(PARTITION.pattern)).where(day < F.lit(low)).select("name", F.lit("drop").alias("action"))
    return create.unionByName(drop)


def apply_retention(history: DataFrame, now: Column, retention_days: int = 7, safety_days: int = 1) -> DataFrame:
    """History without the days before the cutoff; on a daily partitioned table only kept days are read."""
    day = F.col("occurred_date") if "occurred_date" in history.columns else F.to_date("occurred_at")
    return history.where(day >= F.date_sub(F.to_date(now), retention_days + safety_days))
