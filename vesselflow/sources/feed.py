"""Telemetry made from the driver tables with integer arithmetic, so that SQL can repeat it.

`events` become position and static events of vessels named by `customer`;
some arrive late and some twice. `supplier` gives sanctioned entities, `nation`
gives axis-aligned polygons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _unless(n: int, value: Column) -> Column:
    return F.when(F.col("event_id") % n != 0, value)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in arrival order `seq`, the twice received ones with odd `seq`."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    e = table(spark, sf_dir, "events").join(customer, "user_id", "left")
    i, u = F.col("event_id"), F.col("user_id")
    ms = F.date_trunc("millisecond", F.col("ts")).cast("timestamp_ntz")
    static = F.col("event_type") == "signup"
    once = e.select(
        (i * 2).alias("seq"), i.alias("event_id"), u.alias("user_id"),
        F.concat(F.lit("2"), F.lpad(u.cast("string"), 8, "0")).alias("mmsi"),
        F.when(static, "static").otherwise("position").alias("kind"),
        F.when(i % 13 == 0, ms - F.expr("interval 2 hours")).otherwise(ms).alias("occurred_at"),
        F.col("ts").cast("timestamp_ntz").alias("received_at"),
        F.when(F.regexp_extract("props", r"(\d+)", 1).cast("int") % 2 == 0, "feed_a").otherwise("feed_b").alias("provider"),
        (F.lit(-8) + (u * 37 % 500) / F.lit(10.0) + (i % 50) / F.lit(100.0)).alias("lon"),
        (F.lit(29) + (u * 53 % 200) / F.lit(10.0) + (i % 30) / F.lit(100.0)).alias("lat"),
        F.when(i % 29 == 0, None).when(i % 5 == 0, 0.1).otherwise(F.col("value") / 10).alias("sog"),
        (i * 7 % 361).cast("double").alias("cog"),
        (i * 11 % 512).cast("int").alias("true_heading"),
        _unless(11, F.expr("(day(ts) div 5) % 16").cast("int")).alias("nav_status"),
        ((i % 21) - F.lit(10.0)).alias("rate_of_turn"),
        _unless(4, F.col("c_name")).alias("ship_name"),
        F.when(u % 3 == 0, (u + 9_000_000).cast("string")).alias("imo"),
        _unless(7, (i % 120).cast("int")).alias("ship_type"),
        _unless(5, F.concat(F.lit("C"), u.cast("string"))).alias("call_sign"),
        _unless(6, F.concat(F.lit("PORT "), (i % 40).cast("string"))).alias("destination"),
        (i % 90).cast("int").alias("dimension_to_bow"),
    )
    later = F.when(i % 50 == 0, F.expr("interval 700 seconds")).otherwise(F.expr("interval 5 seconds"))
    again = once.where(i % 10 == 0).withColumn("seq", F.col("seq") + 1).withColumn("received_at", F.col("received_at") + later)
    return once.unionByName(again)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).where("kind = 'position'")


def statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).where("kind = 'static'").withColumn("name", F.col("ship_name"))


#: The same feed for DuckDB.
FEED_SQL = """
WITH once AS (
  SELECT event_id * 2 AS seq, event_id, user_id, '2' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS mmsi,
    CASE WHEN event_type = 'signup' THEN 'static' ELSE 'position' END AS kind,
    CASE WHEN event_id % 13 = 0 THEN date_trunc('millisecond', ts) - INTERVAL 2 HOUR ELSE date_trunc('millisecond', ts) END AS occurred_at,
    ts AS received_at,
    CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END AS provider,
    -8 + (user_id * 37 % 500) / CAST(10 AS DOUBLE) + (event_id % 50) / CAST(100 AS DOUBLE) AS lon,
    29 + (user_id * 53 % 200) / CAST(10 AS DOUBLE) + (event_id % 30) / CAST(100 AS DOUBLE) AS lat,
    CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST(0.1 AS DOUBLE) ELSE value / CAST(10 AS DOUBLE) END AS sog,
    CAST(event_id * 7 % 361 AS DOUBLE) AS cog, CAST(event_id * 11 % 512 AS INTEGER) AS true_heading,
    CASE WHEN event_id % 11 <> 0 THEN CAST((day(ts) // 5) % 16 AS INTEGER) END AS nav_status,
    (event_id % 21) - CAST(10 AS DOUBLE) AS rate_of_turn,
    CASE WHEN event_id % 4 <> 0 THEN c_name END AS ship_name,
    CASE WHEN user_id % 3 = 0 THEN CAST(user_id + 9000000 AS VARCHAR) END AS imo,
    CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 120 AS INTEGER) END AS ship_type,
    CASE WHEN event_id % 5 <> 0 THEN 'C' || CAST(user_id AS VARCHAR) END AS call_sign,
    CASE WHEN event_id % 6 <> 0 THEN 'PORT ' || CAST(event_id % 40 AS VARCHAR) END AS destination,
    CAST(event_id % 90 AS INTEGER) AS dimension_to_bow
  FROM events LEFT JOIN customer ON user_id = c_custkey),
feed AS (
  SELECT * FROM once UNION ALL
  SELECT seq + 1, * EXCLUDE (seq, received_at, provider, lon, lat, sog, cog, true_heading, nav_status, rate_of_turn, ship_name, imo, ship_type, call_sign, destination, dimension_to_bow),
    received_at + CASE WHEN event_id % 50 = 0 THEN INTERVAL 700 SECOND ELSE INTERVAL 5 SECOND END,
    provider, lon, lat, sog, cog, true_heading, nav_status, rate_of_turn, ship_name, imo, ship_type, call_sign, destination, dimension_to_bow
  FROM once WHERE event_id % 10 = 0),
positions AS (SELECT * FROM feed WHERE kind = 'position'),
statics AS (SELECT *, ship_name AS name FROM feed WHERE kind = 'static')
"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanctioned entities: every supplier, with identifiers of some vessels and customers' names."""
    s = F.col("s_suppkey")
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad((k % 1000).cast("string"), 9, "0"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ofac-"), s.cast("string")).alias("entity_id"), F.lit("ofac").alias("source"), s.cast("string").alias("source_entity_id"),
        (s * 3 + 9_000_000).cast("string").alias("imo"),
        F.when(s % 2 == 0, F.concat(F.lit("2"), F.lpad((s * 5).cast("string"), 8, "0"))).alias("mmsi"),
        name(s * 7).alias("name"), F.array(name(s * 11), name(s * 13)).alias("aliases"),
        F.array(F.concat(F.lit("P"), (s % 4).cast("string"))).alias("programs"), F.concat(F.lit("F"), (s % 9).cast("string")).alias("flag"),
    )


ENTITIES_SQL = """
entities AS (
  SELECT 'ofac-' || s_suppkey AS entity_id, 'ofac' AS source, CAST(s_suppkey AS VARCHAR) AS source_entity_id,
    CAST(s_suppkey * 3 + 9000000 AS VARCHAR) AS imo,
    CASE WHEN s_suppkey % 2 = 0 THEN '2' || lpad(CAST(s_suppkey * 5 AS VARCHAR), 8, '0') END AS mmsi,
    'Customer#' || lpad(CAST(s_suppkey * 7 % 1000 AS VARCHAR), 9, '0') AS name,
    ['Customer#' || lpad(CAST(s_suppkey * 11 % 1000 AS VARCHAR), 9, '0'), 'Customer#' || lpad(CAST(s_suppkey * 13 % 1000 AS VARCHAR), 9, '0')] AS aliases,
    'P' || (s_suppkey % 4) AS program, 'F' || (s_suppkey % 9) AS flag
  FROM supplier)
"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned boxes over the feed's area, a large one for each nation and a small one for each supplier: layer land, navigable_water or manual_allow."""
    n, r, s = F.col("n_nationkey"), F.col("n_regionkey"), F.col("s_suppkey")
    layer = lambda k: F.when(k % 3 == 0, "land").when(k % 3 == 1, "navigable_water").otherwise("manual_allow").alias("layer")
    west, south = (F.lit(-8) + (n * 7 % 25) * F.lit(2.0)), (F.lit(29) + (n * 11 % 25) * F.lit(0.8))
    large = table(spark, sf_dir, "nation").select(n.cast("long").alias("polygon_id"), layer(r), west.alias("w"), south.alias("s"), (west + 3.0 + r).alias("e"), (south + 2.0 + r / 2).alias("n"))
    west, south = F.lit(-8) + (s * 29 % 480) / F.lit(10.0), F.lit(29) + (s * 17 % 190) / F.lit(10.0)
    small = table(spark, sf_dir, "supplier").select((s + 1000).cast("long").alias("polygon_id"), layer(s), west.alias("w"), south.alias("s"), (west + (3 + s % 4 * 2) / F.lit(10.0)).alias("e"), (south + (2 + s % 3 * 2) / F.lit(10.0)).alias("n"))
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    return large.unionByName(small).select("polygon_id", "layer", F.lit("v1").alias("version_id"), F.array(ring).alias("rings"))


BOXES_SQL = """
boxes AS (
  SELECT n_nationkey AS polygon_id, CASE n_regionkey % 3 WHEN 0 THEN 'land' WHEN 1 THEN 'navigable_water' ELSE 'manual_allow' END AS layer,
    -8 + (n_nationkey * 7 % 25) * CAST(2 AS DOUBLE) AS w, 29 + (n_nationkey * 11 % 25) * CAST(0.8 AS DOUBLE) AS s,
    -8 + (n_nationkey * 7 % 25) * CAST(2 AS DOUBLE) + CAST(3 AS DOUBLE) + n_regionkey AS e,
    29 + (n_nationkey * 11 % 25) * CAST(0.8 AS DOUBLE) + CAST(2 AS DOUBLE) + n_regionkey / CAST(2 AS DOUBLE) AS n
  FROM nation
  UNION ALL SELECT s_suppkey + 1000, CASE s_suppkey % 3 WHEN 0 THEN 'land' WHEN 1 THEN 'navigable_water' ELSE 'manual_allow' END,
    -8 + (s_suppkey * 29 % 480) / CAST(10 AS DOUBLE), 29 + (s_suppkey * 17 % 190) / CAST(10 AS DOUBLE),
    -8 + (s_suppkey * 29 % 480) / CAST(10 AS DOUBLE) + (3 + s_suppkey % 4 * 2) / CAST(10 AS DOUBLE),
    29 + (s_suppkey * 17 % 190) / CAST(10 AS DOUBLE) + (2 + s_suppkey % 3 * 2) / CAST(10 AS DOUBLE)
  FROM supplier)
"""


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon for each customer: a box, or a box without its corner, its middle or the middle of its top."""
    k = F.col("c_custkey")
    west, south = F.lit(-10) + (k * 37 % 560) / F.lit(10.0), F.lit(27) + (k * 53 % 240) / F.lit(10.0)
    own = table(spark, sf_dir, "customer").select(k.cast("long").alias("polygon_id"), (k % 4).alias("kind"), west.alias("w"), south.alias("s"), ((6 + k % 7) / F.lit(10.0)).alias("wd"), ((6 + k % 5) / F.lit(10.0)).alias("ht"))
    p = lambda x, y: f"struct(w + wd * {x}D as lon, s + ht * {y}D as lat)"
    ring = lambda *corners: f"array({', '.join(p(x, y) for x, y in corners)})"
    box = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    shapes = {
        0: f"array({ring(*box)})", 1: f"array({ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0))})",
        2: f"array({ring(*box)}, {ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25))})",
        3: f"array({ring((0, 0), (1, 0), (1, 1), (0.75, 1), (0.75, 0.5), (0.25, 0.5), (0.25, 1), (0, 1), (0, 0))})",
    }
    return own.withColumn("rings", F.expr("case kind " + " ".join(f"when {i} then {x}" for i, x in shapes.items()) + " end")).select("polygon_id", "kind", "rings")


#: The same as boxes (w, s, e, n) less a notch (nw, ns, ne, nn), which is empty where there is none.
AREAS_SQL = """
plain AS (
  SELECT c_custkey AS polygon_id, c_custkey % 4 AS kind, -10 + (c_custkey * 37 % 560) / CAST(10 AS DOUBLE) AS w, 27 + (c_custkey * 53 % 240) / CAST(10 AS DOUBLE) AS s,
    (6 + c_custkey % 7) / CAST(10 AS DOUBLE) AS wd, (6 + c_custkey % 5) / CAST(10 AS DOUBLE) AS ht FROM customer),
areas AS (
  SELECT polygon_id, kind, w, s, w + wd AS e, s + ht AS n,
    w + wd * CASE kind WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 0.25 END AS nw, s + ht * CASE kind WHEN 0 THEN 0 WHEN 2 THEN 0.25 ELSE 0.5 END AS ns,
    w + wd * CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0.75 END AS ne, s + ht * CASE kind WHEN 0 THEN 0 WHEN 2 THEN 0.75 ELSE 1 END AS nn FROM plain)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A waterway of two segments for each supplier, some with a width and some of a class that is not taken."""
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(k, (F.lit(12) + (k * 7 % 60) / F.lit(10.0)).alias("x"), (F.lit(35) + (k * 11 % 80) / F.lit(10.0)).alias("y"))
    path = F.expr("array(array(x, y), array(x + 0.03D, y), array(x + 0.03D, y + 0.02D))")
    return own.select(k.alias("line_id"), path.alias("path"), F.when(k % 3 == 0, "river").when(k % 3 == 1, "canal").otherwise("stream").alias("fclass"), F.when(k % 2 == 0, "200").alias("width"))


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as provider frames (seq, event_id, received_at, value): some unsupported, broken, without a valid part or with a short MMSI."""
    f = feed(spark, sf_dir)
    i = F.col("event_id")
    kind = (
        F.when(i % 17 == 0, "BaseStationReport").when((F.col("kind") == "static") & (i % 2 == 0), "StaticDataReport").when(F.col("kind") == "static", "ShipStaticData")
        .when(i % 3 == 0, "PositionReport").when(i % 3 == 1, "StandardClassBPositionReport").otherwise("ExtendedClassBPositionReport")
    )
    padded = F.concat(F.lit("  "), F.col("ship_name"), F.lit(" @@@"))
    mmsi = F.when(i % 23 == 0, F.substring("mmsi", 1, 7)).otherwise(F.col("mmsi"))
    meta = F.struct(mmsi.cast("long").alias("MMSI"), padded.alias("ShipName"), F.concat(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("123 +0000 UTC")).alias("time_utc"))
    valid = (i % 31 != 0).alias("Valid")
    position = F.struct(
        F.col("user_id").alias("UserID"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.col("sog").alias("Sog"), F.col("cog").alias("Cog"),
        F.col("true_heading").alias("TrueHeading"), F.col("nav_status").alias("NavigationalStatus"), F.col("rate_of_turn").alias("RateOfTurn"), valid, F.lit("EMBEDDED@").alias("Name"),
    )
    bow = F.col("dimension_to_bow")
    dims = F.struct(bow.alias("A"), (bow * 2).alias("B"), (bow * 3).alias("C"), (bow * 4).alias("D"))
    report = F.struct(
        F.col("user_id").alias("UserID"), F.struct(padded.alias("Name"), (i % 4 != 2).alias("Valid")).alias("ReportA"),
        F.struct(F.col("call_sign").alias("CallSign"), F.col("ship_type").alias("ShipType"), dims.alias("Dimension"), (i % 3 != 0).alias("Valid")).alias("ReportB"),
    )
    ship = F.struct(
        F.col("user_id").alias("UserID"), F.col("imo").cast("long").alias("ImoNumber"), F.col("call_sign").alias("CallSign"), padded.alias("Name"), F.col("ship_type").alias("Type"),
        F.concat(F.col("destination"), F.lit("@@")).alias("Destination"), dims.alias("Dimension"), valid,
    )
    body = F.struct(
        *[F.when(kind == k, position).alias(k) for k in ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")],
        F.when(kind == "StaticDataReport", report).alias("StaticDataReport"), F.when(kind == "ShipStaticData", ship).alias("ShipStaticData"),
    )
    text = F.to_json(F.struct(kind.alias("MessageType"), meta.alias("MetaData"), body.alias("Message")))
    return f.select("seq", "event_id", "received_at", F.when(i % 19 == 0, F.lit('{"MessageType": ')).otherwise(text).alias("value"))


#: What normalising those frames gives.
FRAMES_SQL = """
frames AS (
  SELECT *, CASE WHEN event_id % 17 = 0 THEN 'BaseStationReport' WHEN kind = 'static' AND event_id % 2 = 0 THEN 'StaticDataReport' WHEN kind = 'static' THEN 'ShipStaticData'
      WHEN event_id % 3 = 0 THEN 'PositionReport' WHEN event_id % 3 = 1 THEN 'StandardClassBPositionReport' ELSE 'ExtendedClassBPositionReport' END AS message_type,
    CASE WHEN event_id % 19 = 0 THEN 'invalid' WHEN event_id % 17 = 0 OR event_id % 23 = 0 THEN 'non_vessel_mmsi' END AS drop_reason
  FROM feed)
"""
