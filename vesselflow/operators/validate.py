"""Filters, predicates and contract checks (P1-P8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chain, point_in_bbox

# Accepted message types of the provider.
ACCEPTED = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport", "StaticDataReport", "ShipStaticData")

# Coverage zones, in order of precedence.
ZONES = (
    ("Black Sea", {"west": 27.0, "south": 40.5, "east": 42.5, "north": 47.5}),
    ("Levant / East Mediterranean", {"west": 34.782715, "south": 32.787275, "east": 36.254883, "north": 36.967449}),
    ("Central / East Mediterranean", {"west": 9.492188, "south": 30.477083, "east": 35.084839, "north": 46.437857}),
    ("West Mediterranean / Europe", {"west": -6.152344, "south": 34.452218, "east": 9.09668, "north": 48.57479}),
)


def raw_filter(frames: DataFrame) -> DataFrame:
    """Adds drop_reason to (raw, msg): why a frame is not taken, null if it is."""
    kind = F.col("msg.MessageType")
    payload = reduce(lambda a, b: a | b, [(kind == k) & F.col(f"msg.Message.{k}").isNotNull() for k in ACCEPTED])
    return frames.withColumn(
        "drop_reason",
        chain(
            [
                (F.col("msg").isNull() | kind.isNull(), F.lit("invalid")),
                (~kind.isin(*ACCEPTED), F.lit("non_vessel_mmsi")),
                (~F.coalesce(payload, F.lit(False)), F.lit("invalid")),
                (~F.coalesce(F.col("msg.MetaData.MMSI"), F.lit("")).rlike(r"^\d{9}$"), F.lit("non_vessel_mmsi")),
            ],
            F.lit(None).cast("string"),
        ),
    )


def _outside(column: str, low: float, high: float) -> Column:
    return F.coalesce(~F.col(column).between(low, high), F.lit(False))


def first_of(reasons: list[Column]) -> Column:
    """The first reason that is not null. An array keeps the optimiser from expanding tests of it into all their combinations."""
    return F.try_element_at(F.array_compact(F.array(*reasons)), F.lit(1))


def violation() -> Column:
    """The first field, in contract order, that breaks its bound; null for a sound event."""
    position = F.col("kind") == "position"
    rules = [
        ("mmsi", ~F.coalesce(F.col("mmsi").rlike(r"^\d{9}$"), F.lit(False))),
        ("lat", position & (F.col("lat").isNull() | _outside("lat", -90, 90))),
        ("lon", position & (F.col("lon").isNull() | _outside("lon", -180, 180))),
        ("sog", position & F.coalesce(F.col("sog") < 0, F.lit(False))),
        ("cog", position & _outside("cog", 0, 360)),
        ("true_heading", position & _outside("true_heading", 0, 511)),
        ("nav_status", position & _outside("nav_status", 0, 15)),
        ("imo", ~position & F.coalesce(~F.col("imo").rlike(r"^\d{7}$"), F.lit(False))),
        ("call_sign", ~position & F.coalesce(F.length("call_sign") > 32, F.lit(False))),
        ("ship_type", ~position & _outside("ship_type", 0, 255)),
        ("destination", ~position & F.coalesce(F.length("destination") > 120, F.lit(False))),
        ("occurred_at", F.col("occurred_at").isNull()),
    ]
    return first_of([F.when(bad, F.lit(name)) for name, bad in rules])


def validate_canonical(events: DataFrame) -> DataFrame:
    return events.withColumn("violation", violation()).withColumn("valid", F.col("violation").isNull())


def validate_persisted(events: DataFrame) -> DataFrame:
    """Persisted facts that a consumer takes; others are skipped."""
    return events.where(F.col("vessel_id").isNotNull() & F.col("mmsi").rlike(r"^\d{9}$") & (F.col("imo").isNull() | F.col("imo").rlike(r"^\d{7}$")))


def validate_enriched(events: DataFrame) -> DataFrame:
    return events.where(F.col("vessel_id").isNotNull() & F.col("mmsi").rlike(r"^\d{9}$") & F.col("status").isin("clear", "candidate", "sanctioned") & F.col("checked_at").isNotNull())


def zone_name(lat: Column, lon: Column, zones=ZONES) -> Column:
    return chain([(point_in_bbox(lat, lon, box), F.lit(name)) for name, box in zones], F.lit(None).cast("string"))


def in_coverage(events: DataFrame, zones=ZONES) -> DataFrame:
    """Adds zone and in_zone; static events are never tested."""
    zone = F.when(F.col("kind") == "position", zone_name(F.col("lat"), F.col("lon"), zones))
    return events.withColumn("zone", zone).withColumn("in_zone", (F.col("kind") != "position") | F.col("zone").isNotNull())


def retention_cutoff(now: Column, retention_days: int = 7, safety_days: int = 1) -> Column:
    return F.date_sub(F.to_date(now), retention_days + safety_days)


def retention_filter(events: DataFrame, now: Column, retention_days: int = 7, safety_days: int = 1) -> DataFrame:
    """Events of the retained days; a missing time is not retained."""
    return events.where(F.to_date("occurred_at") >= retention_cutoff(now, retention_days, safety_days))


def future_partition_guard(events: DataFrame, now: Column, precreate_days: int = 7) -> DataFrame:
    """Adds `partitioned`: false for events later than the days that have a partition."""
    return events.withColumn("partitioned", F.to_date("occurred_at") <= F.date_add(F.to_date(now), precreate_days))


def snapshot_params(limit: int = 10_000, stale_minutes: int = 1440) -> tuple[int, int]:
    if not 1 <= limit <= 30_000:
        raise ValueError("limit must be from 1 to 30000")
    if not 1 <= stale_minutes <= 10_080:
        raise ValueError("stale_minutes must be from 1 to 10080")
    return limit, stale_minutes


def track_params(start, end, simplify: float | None = None):
    if not start < end:
        raise ValueError("from must be before to")
    if (end - start).total_seconds() > 7 * 86_400:
        raise ValueError("the window must not exceed 7 days")
    if simplify is not None and not simplify > 0:
        raise ValueError("simplify must be positive")
    return start, end, simplify
