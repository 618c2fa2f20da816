"""Normalising parsed provider frames into canonical events (N1-N9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_string, dimensions_or_null, parse_provider_ts, trace_id
from .validate import first_of, violation

POSITION_KINDS = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")
NAVIGATION_KIND = "PositionReport"


def _payload(kind: str, field: str) -> Column:
    return F.col(f"msg.Message.{kind}.{field}")


def _position(field: str) -> Column:
    kind = F.col("msg.MessageType")
    return F.coalesce(*[F.when(kind == k, _payload(k, field)) for k in POSITION_KINDS])


def _static(part: Column, full: Column) -> Column:
    return F.when(F.col("msg.MessageType") == "StaticDataReport", part).when(F.col("msg.MessageType") == "ShipStaticData", full)


def normalize(frames: DataFrame) -> DataFrame:
    """Canonical events of (provider, received_at, msg), one pass for all message types.

    Adds drop_reason `invalid` for payloads marked invalid, without a valid
    part, or outside the contract; other frames have a null reason.
    """
    kind = F.col("msg.MessageType")
    is_position = kind.isin(*POSITION_KINDS)
    rep = "StaticDataReport"
    a, b = F.coalesce(_payload(rep, "ReportA.Valid"), F.lit(False)), F.coalesce(_payload(rep, "ReportB.Valid"), F.lit(False))
    ship = "ShipStaticData"
    dims = [_static(F.when(b, _payload(rep, f"ReportB.Dimension.{d}")), _payload(ship, f"Dimension.{d}")) for d in "ABCD"]
    bow, stern, port, starboard = dimensions_or_null(*dims)
    type_ = _static(F.when(b, _payload(rep, "ReportB.ShipType")), _payload(ship, "Type"))
    user = F.coalesce(_position("UserID"), _static(_payload(rep, "UserID"), _payload(ship, "UserID")))
    imo = F.when((kind == ship) & _payload(ship, "ImoNumber").rlike(r"^\d{7}$"), _payload(ship, "ImoNumber"))
    carries = kind == NAVIGATION_KIND
    meta_name, own_name = clean_string(F.col("msg.MetaData.ShipName"), 255), clean_string(_position("Name"), 255)
    usable = F.when(is_position, F.coalesce(_position("Valid"), F.lit(True))).when(kind == rep, a | b).when(kind == ship, F.coalesce(_payload(ship, "Valid"), F.lit(True))).otherwise(False)
    events = frames.select(
        "*",
        F.when(is_position, "position").otherwise("static").alias("kind"),
        F.coalesce(F.col("msg.MetaData.MMSI"), user).alias("mmsi"),
        _position("Latitude").alias("lat"), _position("Longitude").alias("lon"), _position("Sog").alias("sog"), _position("Cog").alias("cog"),
        _position("TrueHeading").alias("true_heading"),
        F.when(carries, _position("NavigationalStatus")).alias("nav_status"), F.when(carries, _position("RateOfTurn")).alias("rate_of_turn"),
        F.when(is_position, F.coalesce(meta_name, own_name)).alias("ship_name"),
        _static(F.when(a, clean_string(_payload(rep, "ReportA.Name"), 255)), clean_string(_payload(ship, "Name"), 255)).alias("name"),
        _static(F.when(b, clean_string(_payload(rep, "ReportB.CallSign"), 32)), clean_string(_payload(ship, "CallSign"), 32)).alias("call_sign"),
        F.when(type_ > 0, type_).alias("ship_type"), imo.alias("imo"),
        F.when(kind == ship, clean_string(_payload(ship, "Destination"), 120)).alias("destination"),
        bow.alias("dimension_to_bow"), stern.alias("dimension_to_stern"), port.alias("dimension_to_port"), starboard.alias("dimension_to_starboard"),
        F.coalesce(parse_provider_ts(F.col("msg.MetaData.time_utc")), F.col("received_at").cast("timestamp_ntz")).alias("occurred_at"),
        usable.alias("_usable"),
    )
    bad = first_of([F.when(~F.coalesce("_usable", F.lit(False)), "invalid"), F.when(violation().isNotNull(), "invalid")])
    return events.withColumn("drop_reason", bad).drop("_usable", "msg")


def normalize_position(frames: DataFrame) -> DataFrame:
    return normalize(frames.where(F.col("msg.MessageType").isin(*POSITION_KINDS))).where("drop_reason is null")


def normalize_static_report(frames: DataFrame) -> DataFrame:
    return normalize(frames.where(F.col("msg.MessageType") == "StaticDataReport")).where("drop_reason is null")


def normalize_ship_static(frames: DataFrame) -> DataFrame:
    return normalize(frames.where(F.col("msg.MessageType") == "ShipStaticData")).where("drop_reason is null")


def with_trace_id(events: DataFrame) -> DataFrame:
    """Keeps an upstream trace_id, else makes one from the event's key."""
    own = trace_id(F.col("mmsi"), F.col("kind"), F.col("occurred_at"))
    return events.withColumn("trace_id", F.coalesce(F.col("trace_id"), own) if "trace_id" in events.columns else own)


def correlation_fields(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """trace_id, mmsi (number or text), vessel_id and provider of any JSON payload."""
    get = lambda key: F.get_json_object(column, f"$.{key}")
    return payloads.select("*", get("traceId").alias("c_trace_id"), get("mmsi").alias("c_mmsi"), get("vesselId").alias("c_vessel_id"), get("provider").alias("c_provider"))
