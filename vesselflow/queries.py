"""The registered queries of the telemetry operators and their SQL.

Every query runs an operator over whole driver tables through the feed; windows
of hours replace the defaults of seconds, since the feed's vessels speak rarely.
Times leave as text to the millisecond, lists as text in a fixed order.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as fn
from .operators import fanout, geo, normalize, quality, quarantine, rollups, sanctions, state, validate, views
from .operators.polygons import disjoint
from .plans import pipelines
from .plans.geo_dataset import load_geo_dataset
from .plans.registry import Registry
from .sources import readers
from .sources.feed import AREAS_SQL, BOXES_SQL, ENTITIES_SQL, FEED_SQL, FRAMES_SQL, areas, entities, feed, lines, now, polygons, positions, raw_frames, statics, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"
SAMPLING = quality.Sampling(moving_s=12 * 3600, stationary_s=48 * 3600, state_ttl_s=96 * 3600)
DEDUP_S = 600


def query(name: str, sql: str | None = None, feed_sql: bool = True):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = (FEED_SQL + sql) if feed_sql else sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(column: str) -> F.Column:
    return fn.ms_text(F.col(column)).alias(column)


def day(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def sql_t(column: str) -> str:
    return f"{TEXT.format(column)} AS {column}"


# --- states used below -------------------------------------------------------

LATEST_SQL = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY occurred_at DESC, seq DESC) AS rn FROM positions),
latest AS (SELECT mmsi, occurred_at, received_at AS last_seen_at, lon, lat, sog, cog, true_heading, nav_status, rate_of_turn FROM ranked WHERE rn = 1)
"""
VESSELS_SQL = """
, pv AS (SELECT mmsi, arg_min(ship_name, seq) FILTER (ship_name IS NOT NULL) AS seen_name FROM positions GROUP BY mmsi),
sv AS (SELECT mmsi, arg_max(imo, seq) FILTER (imo IS NOT NULL) AS imo, arg_max(name, seq) FILTER (name IS NOT NULL) AS name,
    arg_max(call_sign, seq) FILTER (call_sign IS NOT NULL) AS call_sign, arg_max(ship_type, seq) FILTER (ship_type IS NOT NULL) AS ship_type,
    arg_max(destination, seq) FILTER (destination IS NOT NULL) AS destination, arg_max(dimension_to_bow, seq) FILTER (dimension_to_bow IS NOT NULL) AS dimension_to_bow
  FROM statics GROUP BY mmsi),
vessels AS (SELECT mmsi, sv.imo, coalesce(sv.name, pv.seen_name) AS name, sv.call_sign, sv.ship_type, sv.destination, sv.dimension_to_bow FROM pv FULL JOIN sv USING (mmsi))
"""
HISTORY_SQL = """
, hist AS (SELECT mmsi, occurred_at, arg_min(lon, seq) AS lon, arg_min(lat, seq) AS lat, min(seq) AS seq FROM positions GROUP BY mmsi, occurred_at)
"""


def no_vessels(spark) -> DataFrame:
    return spark.createDataFrame([], "mmsi string, imo string, name string, call_sign string, ship_type int, destination string, dimension_to_bow int")


def latest_of(spark, d) -> DataFrame:
    return state.upsert_latest(None, positions(spark, d))


def vessels_of(spark, d) -> DataFrame:
    events = feed(spark, d).withColumn("name", F.when(F.col("kind") == "static", F.col("ship_name")))
    return state.merge_vessels(no_vessels(spark), events)


def history_of(spark, d) -> DataFrame:
    return state.append_history(None, positions(spark, d))


# --- sources and sinks -------------------------------------------------------


@query("S1_raw_feed", ", " + FRAMES_SQL + "SELECT CASE WHEN event_id % 19 <> 0 THEN message_type END AS message_type, count(*) AS n FROM frames GROUP BY 1")
def s1(spark, d):
    path = readers.to_text_file(frames_of(spark, d).select("value"), "raw")
    return readers.read_raw_feed(spark, path, "feed_a").groupBy(F.col("msg.MessageType").alias("message_type")).agg(F.count("*").alias("n"))


def sdn_file(spark, d) -> str:
    e = entities(spark, d)
    entry = F.concat(
        F.lit("<sdnEntry><uid>"), "source_entity_id", F.lit("</uid><lastName>"), "name", F.lit("</lastName><sdnType>"),
        F.when(F.col("source_entity_id").cast("int") % 5 == 0, "Entity").otherwise("Vessel"), F.lit("</sdnType><programList><program>"), F.element_at("programs", 1),
        F.lit("</program></programList><idList><id><idType>Vessel Registration Identification</idType><idNumber>IMO "), "imo", F.lit("</idNumber></id>"),
        F.coalesce(F.concat(F.lit("<id><idType>MMSI</idType><idNumber>"), "mmsi", F.lit("</idNumber></id>")), F.lit("")),
        F.lit("</idList><akaList><aka><category>strong</category><lastName>"), F.element_at("aliases", 1), F.lit("</lastName></aka><aka><category>weak</category><lastName>"), F.element_at("aliases", 2),
        F.lit("</lastName></aka></akaList><vesselInfo><vesselFlag>"), "flag", F.lit("</vesselFlag></vesselInfo></sdnEntry>"),
    )
    listed = e.select(F.floor(F.col("source_entity_id").cast("long") / 10_000).alias("f"), entry.alias("x")).groupBy("f").agg(F.concat(F.lit("<sdnList>\n"), F.array_join(F.collect_list("x"), "\n"), F.lit("\n</sdnList>")).alias("value"))
    path = readers.shared_path(spark, "sdn")
    listed.write.partitionBy("f").text(path)  # a list of 10,000 ids at most to a file, each with its own root
    return path


@query("S2_read_sdn_xml", "WITH " + ENTITIES_SQL + "SELECT source_entity_id AS uid, name, 1 AS programs, CASE WHEN mmsi IS NULL THEN 1 ELSE 2 END AS ids, 2 AS akas FROM entities", False)
def s2(spark, d):
    return readers.read_sdn_xml(spark, sdn_file(spark, d)).select("uid", F.col("lastName").alias("name"), F.size("programList.program").alias("programs"), F.size("idList.id").alias("ids"), F.size("akaList.aka").alias("akas"))


def _feature(kind: str, coordinates: F.Column, **properties: F.Column) -> F.Column:
    """A GeoJSON Feature."""
    named = F.map_filter(F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), named.alias("properties"))


def _polygon_feature() -> F.Column:
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    return _feature("Polygon", rings, id=F.col("polygon_id").cast("string"), fclass=F.col("layer"))


def feature_lines(features: DataFrame, name: str) -> str:
    """Features (a struct column f) a line each, as exports write them, in a new folder."""
    bare = F.lit('{"type":"FeatureCollection","features":[\n{"type":"Feature","geometry":null,"properties":{"id":"none"}},\n')
    return readers.to_text_file(features.select(F.concat(F.when(F.xxhash64(F.to_json("f")) % 7 == 0, bare).otherwise(""), F.to_json("f"), F.lit(",")).alias("value")), name)


@query("S3_read_geojson", "WITH " + BOXES_SQL + "SELECT CAST(polygon_id AS VARCHAR) AS id, layer AS fclass, w AS lon0, n AS lat2 FROM boxes", False)
def s3(spark, d):
    path = feature_lines(polygons(spark, d).select(_polygon_feature().alias("f")), "geojson")
    got = readers.read_geojson(spark, path, "land", by_line=True)
    return got.select(F.col("properties")["id"].alias("id"), F.col("properties")["fclass"].alias("fclass"), F.col("rings")[0][0]["lon"].alias("lon0"), F.col("rings")[0][2]["lat"].alias("lat2"))


def override_folder(spark, d) -> str:
    """The manual areas as GeoJSON collections of at most 200 ids, in a new folder of files named *.geojson."""
    files = polygons(spark, d).where("layer = 'manual_allow'").groupBy(F.floor(F.col("polygon_id") / 200).alias("f")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(_polygon_feature()).alias("features"))).alias("value"))
    raw = readers.shared_path(spark, "overrides")
    files.write.partitionBy("f").text(raw)
    path = spark._jvm.org.apache.hadoop.fs.Path(raw)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, folder in enumerate(x for x in fs.listStatus(path) if x.isDirectory()):  # Spark's writer names files itself
        part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
        fs.rename(part, path.suffix(f"/{i}.geojson"))
    return raw


@query("S4_read_override_dir", "WITH " + BOXES_SQL + "SELECT 'manual_allow' AS layer, w AS lon0 FROM boxes WHERE layer = 'manual_allow'", False)
def s4(spark, d):
    return readers.read_override_dir(spark, override_folder(spark, d)).select("layer", F.col("rings")[0][0]["lon"].alias("lon0"))


def _margin_sql() -> str:
    """The zones with their margin of 50 km, as rows w, s, e, n."""
    dx = lambda b: f"50000 / 111320.0 / cos(radians({max(abs(b['south']), abs(b['north']))}))"
    dy = "50000 / 111320.0"
    return "zone AS (" + " UNION ALL ".join(f"SELECT {b['west']} - {dx(b)} AS w, {b['south']} - {dy} AS s, {b['east']} + {dx(b)} AS e, {b['north']} + {dy} AS n" for _, b in validate.ZONES) + ")"


#: The zones' union as the cells between all their borders; a place of any zone is in one cell.
_UNION_SQL = _margin_sql() + """,
xs AS (SELECT v AS w, lead(v) OVER (ORDER BY v) AS e FROM (SELECT w AS v FROM zone UNION SELECT e FROM zone)), ys AS (SELECT v AS s, lead(v) OVER (ORDER BY v) AS n FROM (SELECT s AS v FROM zone UNION SELECT n FROM zone)),
cell AS (SELECT x.w, y.s, x.e, y.n FROM xs x, ys y WHERE x.e IS NOT NULL AND y.n IS NOT NULL AND EXISTS (SELECT 1 FROM zone z WHERE z.w <= x.w AND z.e >= x.e AND z.s <= y.s AND z.n >= y.n))
"""


def _overlap(w: str, s: str, e: str, n: str) -> str:
    return f"greatest(least({e}, c.e) - greatest({w}, c.w), 0) * greatest(least({n}, c.n) - greatest({s}, c.s), 0)"


def ring_area(rings: str = "rings") -> F.Column:
    """Square degrees of a polygon whose holes run the other way; measured from the first corner."""
    x, y = "(r[$i].lon - r[0].lon)", "(r[$i].lat - r[0].lat)"
    at = lambda t, i: t.replace("$i", i)
    one = f"aggregate(sequence(1, size(r) - 1), 0D, (t, i) -> t + {at(x, 'i - 1')} * {at(y, 'i')} - {at(x, 'i')} * {at(y, 'i - 1')}) / 2"
    return F.expr(f"aggregate({rings}, 0D, (a, r) -> a + {one})")


@query(
    "G8_load_geo_dataset",
    "WITH " + BOXES_SQL + ", " + _UNION_SQL + f""", own AS (SELECT layer, polygon_id, sum({_overlap('b.w', 'b.s', 'b.e', 'b.n')}) AS area FROM boxes b, cell c GROUP BY ALL)
    SELECT layer, CASE layer WHEN 'land' THEN 'coast' WHEN 'manual_allow' THEN 'manual' ELSE 'water' END AS source_layer, CASE layer WHEN 'manual_allow' THEN 'manual' ELSE 'all' END AS region, round(sum(area), 6) AS area, CAST(NULL AS BIGINT) AS pieces FROM own WHERE area > 0 GROUP BY layer
    UNION ALL SELECT 'navigable_water', 'waterways', 'inland', NULL, 2 * count(*) FROM supplier WHERE s_suppkey % 3 <> 2""",
    False,
)
def g8(spark, d):
    boxes = lambda layer: feature_lines(polygons(spark, d).where(F.col("layer") == layer).select(_polygon_feature().alias("f")), layer)
    rivers = feature_lines(lines(spark, d).select(_feature("LineString", F.col("path"), fclass=F.col("fclass"), width=F.col("width")).alias("f")), "rivers")
    source = lambda name, kind, region, to, path, **x: {"name": name, "type": kind, "region": region, "targetTable": to, "path": path, "layout": "lines", "license": "none", "attribution": "none", **x}
    manifest = {
        "metadataVersion": "boxes", "description": "boxes of nations and suppliers",
        "sources": [
            source("land-boxes", "land", "all", "geo_land_polygons", boxes("land"), sourceLayer="coast"), source("water-boxes", "water", "all", "geo_navigable_water_polygons", boxes("navigable_water"), geometryOperation="polygon"),
            source("rivers", "navigable_water", "inland", "geo_navigable_water_polygons", rivers, sourceLayer="waterways", geometryOperation="line_buffer", includeFclasses=["river", "canal"], defaultLineBufferMeters=150),
        ],
    }
    _, got = load_geo_dataset(spark, manifest, "20240131000000", override_folder(spark, d), validate.ZONES)
    river = F.col("source_layer") == "waterways"
    return got.groupBy("layer", "source_layer", "region").agg(F.round(F.sum(F.when(~river, ring_area())), 6).alias("area"), F.sum(F.when(river, 1)).alias("pieces"))


@query("S5_event_log", "SELECT CAST(CAST(received_at AS DATE) AS VARCHAR) AS received_date, kind, count(*) AS n FROM feed WHERE received_at >= TIMESTAMP '2024-01-10 06:00:00' GROUP BY 1, 2")
def s5(spark, d):
    path = readers.shared_path(spark, "log")
    readers.append_event_log(feed(spark, d), path)
    return readers.read_event_log(spark, path, "2024-01-10 06:00:00").groupBy(F.col("received_date").cast("string").alias("received_date"), "kind").agg(F.count("*").alias("n"))


@query("S6_trim_log", "SELECT seq, mmsi FROM feed ORDER BY seq DESC LIMIT 1000")
def s6(spark, d):
    return readers.trim_log(feed(spark, d), 1000).select("seq", "mmsi")


@query("S7_write_history", HISTORY_SQL + f"SELECT mmsi, {sql_t('occurred_at')}, lon, lat, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS occurred_date FROM hist")
def s7(spark, d):
    path = readers.shared_path(spark, "history")
    own = positions(spark, d)
    readers.write_history(own.where("seq % 2 = 0"), path)
    return readers.write_history(own, path).select("mmsi", t("occurred_at"), "lon", "lat", F.col("occurred_date").cast("string").alias("occurred_date"))


@query(
    "S8_upsert_table",
    """, a AS (SELECT mmsi, max(sog) AS top, count(*) AS n FROM positions WHERE received_at < TIMESTAMP '2024-01-16' GROUP BY mmsi),
    b AS (SELECT mmsi, max(sog) AS top, count(*) AS n FROM positions WHERE received_at >= TIMESTAMP '2024-01-16' GROUP BY mmsi)
    SELECT mmsi, greatest(a.top, b.top) AS top, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b USING (mmsi)""",
)
def s8(spark, d):
    own = positions(spark, d)
    part = lambda rows: rows.groupBy("mmsi").agg(F.max("sog").alias("top"), F.count("*").alias("n"))
    cut = day("2024-01-16")
    folder = readers.shared_path(spark, "table")
    merge = {"top": F.greatest("c.top", "n.top"), "n": F.coalesce("c.n", F.lit(0)) + F.coalesce("n.n", F.lit(0))}
    readers.upsert_buckets(part(own.where(F.col("received_at") < cut)), folder, ["mmsi"], merge)
    return readers.upsert_buckets(part(own.where(F.col("received_at") >= cut)), folder, ["mmsi"], merge)


@query(
    "S9_export_features",
    LATEST_SQL + """SELECT mmsi, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(CAST(lon AS DECIMAL(9,2)) AS VARCHAR) || ',' || CAST(CAST(lat AS DECIMAL(9,2)) AS VARCHAR)
    || ']},"properties":{"mmsi":"' || mmsi || '","heading":' || true_heading || '}}' AS feature FROM latest""",
)
def s9(spark, d):
    exact = latest_of(spark, d).withColumns({"lon": F.col("lon").cast("decimal(9,2)"), "lat": F.col("lat").cast("decimal(9,2)")})
    return readers.export_features(exact, {"mmsi": F.col("mmsi"), "heading": F.col("true_heading")})


# --- filters, predicates, validation -----------------------------------------


@query("P1_raw_filter", ", " + FRAMES_SQL + "SELECT seq, drop_reason FROM frames")
def p1(spark, d):
    return validate.raw_filter(readers.parse_raw(frames_of(spark, d), "feed_a")).select("seq", "drop_reason")


def _broken() -> dict:
    """Columns with some values outside the contract."""
    return {"lat": F.when(F.col("event_id") % 37 == 0, 91.0).otherwise(F.col("lat")), "sog": F.when(F.col("event_id") % 41 == 0, -1.0).otherwise(F.col("sog")), "mmsi": F.when(F.col("event_id") % 43 == 0, "12").otherwise(F.col("mmsi"))}


@query(
    "P2_validate_canonical",
    """SELECT seq, CASE WHEN event_id % 43 = 0 THEN 'mmsi' WHEN kind = 'position' AND event_id % 37 = 0 THEN 'lat' WHEN kind = 'position' AND event_id % 41 = 0 THEN 'sog' END AS violation,
    NOT (event_id % 43 = 0 OR (kind = 'position' AND (event_id % 37 = 0 OR event_id % 41 = 0))) AS valid FROM feed""",
)
def p2(spark, d):
    return validate.validate_canonical(feed(spark, d).withColumns(_broken())).select("seq", "violation", "valid")


@query("P3_validate_persisted", "SELECT seq FROM feed WHERE event_id % 43 <> 0 AND event_id % 9 <> 0")
def p3(spark, d):
    facts = feed(spark, d).withColumns(_broken()).withColumn("vessel_id", F.when(F.col("event_id") % 9 != 0, state.vessel_id(F.col("mmsi"))))
    return validate.validate_persisted(facts).select("seq")


@query("P3_validate_enriched", "SELECT seq FROM feed WHERE event_id % 43 <> 0 AND event_id % 9 <> 0 AND event_id % 4 <> 3")
def p3b(spark, d):
    facts = feed(spark, d).withColumns(_broken()).withColumns({"vessel_id": F.when(F.col("event_id") % 9 != 0, F.col("mmsi")), "status": F.element_at(F.array(*[F.lit(x) for x in ("clear", "candidate", "sanctioned", "odd")]), (F.col("event_id") % 4).cast("int") + 1), "checked_at": F.col("received_at")})
    return validate.validate_enriched(facts).select("seq")


def _box_sql(b: dict) -> str:
    return f"(lon BETWEEN {b['west']} AND {b['east']} AND lat BETWEEN {b['south']} AND {b['north']})"


_ZONE_SQL = "CASE " + " ".join(f"WHEN {_box_sql(b)} THEN '{n}'" for n, b in validate.ZONES) + " END"


@query("P4_point_in_bbox", f"SELECT seq, {_box_sql(validate.ZONES[2][1])} AS inside FROM positions")
def p4(spark, d):
    return positions(spark, d).select("seq", fn.point_in_bbox(F.col("lat"), F.col("lon"), validate.ZONES[2][1]).alias("inside"))


@query("P5_in_coverage", f"SELECT seq, CASE WHEN kind = 'position' THEN {_ZONE_SQL} END AS zone, kind <> 'position' OR {_ZONE_SQL} IS NOT NULL AS in_zone FROM feed")
def p5(spark, d):
    return validate.in_coverage(feed(spark, d)).select("seq", "zone", "in_zone")


@query("P6_retention_filter", f"SELECT seq, kind FROM feed WHERE occurred_at >= date_trunc('day', {NOW_SQL}) - INTERVAL 8 DAY")
def p6(spark, d):
    return validate.retention_filter(feed(spark, d), now()).select("seq", "kind")


@query("P7_future_partition_guard", "SELECT seq, CAST(occurred_at AS DATE) <= DATE '2024-01-27' AS partitioned FROM feed")
def p7(spark, d):
    return validate.future_partition_guard(feed(spark, d), day("2024-01-20")).select("seq", "partitioned")


# --- normalisation -----------------------------------------------------------

_NORM_SQL = (
    ", "
    + FRAMES_SQL
    + f""", norm AS (
  SELECT seq, kind, message_type, mmsi,
    CASE WHEN kind = 'position' THEN lat END AS lat, CASE WHEN kind = 'position' THEN sog END AS sog,
    CASE WHEN message_type = 'PositionReport' THEN nav_status END AS nav_status,
    CASE WHEN kind = 'position' THEN coalesce(ship_name, 'EMBEDDED') END AS ship_name,
    CASE WHEN message_type = 'ShipStaticData' THEN ship_name WHEN message_type = 'StaticDataReport' AND event_id % 4 <> 2 THEN ship_name END AS name,
    CASE WHEN message_type = 'ShipStaticData' OR (message_type = 'StaticDataReport' AND event_id % 3 <> 0) THEN call_sign END AS call_sign,
    CASE WHEN (message_type = 'ShipStaticData' OR (message_type = 'StaticDataReport' AND event_id % 3 <> 0)) AND ship_type > 0 THEN ship_type END AS ship_type,
    CASE WHEN message_type = 'ShipStaticData' THEN imo END AS imo, CASE WHEN message_type = 'ShipStaticData' THEN destination END AS destination,
    CASE WHEN (message_type = 'ShipStaticData' OR (message_type = 'StaticDataReport' AND event_id % 3 <> 0)) AND dimension_to_bow > 0 THEN dimension_to_bow END AS dimension_to_bow,
    {sql_t('occurred_at')},
    CASE WHEN message_type = 'StaticDataReport' THEN CASE WHEN event_id % 4 = 2 AND event_id % 3 = 0 THEN 'invalid' END WHEN event_id % 31 = 0 THEN 'invalid' END AS drop_reason
  FROM frames WHERE drop_reason IS NULL)
"""
)
_NORM_COLUMNS = ["seq", "kind", "mmsi", "lat", "sog", "nav_status", "ship_name", "name", "call_sign", "ship_type", "imo", "destination", "dimension_to_bow"]
_NORM_LIST = ", ".join(_NORM_COLUMNS)


def frames_of(spark, d) -> DataFrame:
    """The raw frames, written first as they would arrive: in many files, however few the tables have."""
    path = readers.shared_path(spark, "frames")
    raw_frames(spark, d).repartition(4 * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.parquet(path)


def clean_frames(spark, d) -> DataFrame:
    return validate.raw_filter(readers.parse_raw(frames_of(spark, d), "feed_a")).where("drop_reason is null").drop("drop_reason")


@query("N1_normalize_position", _NORM_SQL + f"SELECT {_NORM_LIST}, occurred_at FROM norm WHERE kind = 'position' AND drop_reason IS NULL")
def n1(spark, d):
    return normalize.normalize_position(clean_frames(spark, d)).select(*_NORM_COLUMNS, t("occurred_at"))


@query("N2_normalize_static_report", _NORM_SQL + f"SELECT {_NORM_LIST}, occurred_at FROM norm WHERE message_type = 'StaticDataReport' AND drop_reason IS NULL")
def n2(spark, d):
    return normalize.normalize_static_report(clean_frames(spark, d)).select(*_NORM_COLUMNS, t("occurred_at"))


@query("N3_normalize_ship_static", _NORM_SQL + f"SELECT {_NORM_LIST}, occurred_at FROM norm WHERE message_type = 'ShipStaticData' AND drop_reason IS NULL")
def n3(spark, d):
    return normalize.normalize_ship_static(clean_frames(spark, d)).select(*_NORM_COLUMNS, t("occurred_at"))


@query("N4_normalize", _NORM_SQL + "SELECT seq, kind, mmsi, drop_reason FROM norm")
def n4(spark, d):
    return normalize.normalize(clean_frames(spark, d)).select("seq", "kind", "mmsi", "drop_reason")


@query("N5_parse_provider_ts", f"SELECT seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE {TEXT.format('occurred_at')} END AS at FROM feed")
def n5(spark, d):
    text = F.concat(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("999 +0000 UTC"))
    return feed(spark, d).select("seq", fn.ms_text(fn.parse_provider_ts(F.when(F.col("event_id") % 3 == 0, "soon").otherwise(text))).alias("at"))


@query("N6_clean_string", "SELECT seq, substr(ship_name, 1, 12) AS name FROM feed")
def n6(spark, d):
    return feed(spark, d).select("seq", fn.clean_string(F.concat(F.lit(" @"), F.coalesce("ship_name", F.lit("@ @")), F.lit("@ ")), 12).alias("name"))


@query("N7_dimensions_or_null", "SELECT seq, CASE WHEN event_id % 90 = 0 THEN NULL ELSE dimension_to_bow END AS bow, CASE WHEN event_id % 90 = 0 THEN NULL ELSE dimension_to_bow * 2 END AS stern FROM feed")
def n7(spark, d):
    bow = F.col("dimension_to_bow")
    a, b, _, _ = fn.dimensions_or_null(bow, bow * 2, bow * 3, bow * 4)
    return feed(spark, d).select("seq", a.alias("bow"), b.alias("stern"))


_HASH_SQL = f"sha256(mmsi || '|' || kind || '|' || {TEXT.format('occurred_at')})"


@query("N8_trace_id", f"SELECT seq, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS trace_id FROM (SELECT seq, {_HASH_SQL} AS h FROM feed)")
def n8(spark, d):
    return normalize.with_trace_id(feed(spark, d).withColumn("occurred_at", fn.ms_text(F.col("occurred_at")))).select("seq", "trace_id")


@query("N9_correlation_fields", "SELECT seq, mmsi AS c_mmsi, provider AS c_provider, CAST(NULL AS VARCHAR) AS c_trace_id FROM feed")
def n9(spark, d):
    payload = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("mmsi").cast("long").cast("string")).otherwise(F.col("mmsi")).alias("mmsi"), "provider", F.array("seq").alias("other")))
    return normalize.correlation_fields(feed(spark, d).select("seq", payload.alias("payload"))).select("seq", "c_mmsi", "c_provider", "c_trace_id")


# --- stream quality ----------------------------------------------------------

_DEDUP_SQL = f"""
, arr AS (SELECT seq, mmsi, occurred_at, received_at, row_number() OVER (PARTITION BY mmsi, occurred_at ORDER BY received_at, seq) AS n FROM feed),
dd AS (
  SELECT a.seq, a.mmsi, a.occurred_at, a.n, a.received_at AS at, true AS accepted FROM arr a WHERE n = 1
  UNION ALL
  SELECT a.seq, a.mmsi, a.occurred_at, a.n, CASE WHEN a.received_at - d.at >= INTERVAL {DEDUP_S} SECOND THEN a.received_at ELSE d.at END, a.received_at - d.at >= INTERVAL {DEDUP_S} SECOND
  FROM dd d JOIN arr a ON a.mmsi = d.mmsi AND a.occurred_at = d.occurred_at AND a.n = d.n + 1)
"""


def recursive(sql: str) -> str:
    return FEED_SQL.replace("WITH once", "WITH RECURSIVE once", 1) + sql


@query("D1_dedup", recursive(_DEDUP_SQL + "SELECT seq, accepted FROM dd"), False)
def d1(spark, d):
    return quality.dedup(feed(spark, d), DEDUP_S).select("seq", "accepted")


def _sample_sql(source: str) -> str:
    return f"""
, srow AS (SELECT seq, mmsi, occurred_at, received_at, nav_status, sog, row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS n FROM {source}),
sm AS (
  SELECT seq, mmsi, n, occurred_at AS last_at, received_at AS rec, nav_status AS nav, true AS emitted FROM srow WHERE n = 1
  UNION ALL
  SELECT seq, mmsi, n, CASE WHEN e THEN occurred_at ELSE last_at END, CASE WHEN e THEN received_at ELSE rec END, CASE WHEN e THEN nav_status ELSE nav END, e FROM (
    SELECT s.*, m.last_at, m.rec, m.nav, s.received_at - m.rec >= INTERVAL {SAMPLING.state_ttl_s} SECOND
      OR (s.nav_status IS NOT NULL AND s.nav_status IS DISTINCT FROM m.nav)
      OR s.occurred_at - m.last_at >= CASE WHEN coalesce(s.sog, 0) < {SAMPLING.sog_threshold} THEN INTERVAL {SAMPLING.stationary_s} SECOND ELSE INTERVAL {SAMPLING.moving_s} SECOND END AS e
    FROM sm m JOIN srow s ON s.mmsi = m.mmsi AND s.n = m.n + 1))
"""


@query("D2_adaptive_sample", recursive(_sample_sql("positions") + "SELECT seq, emitted FROM sm"), False)
def d2(spark, d):
    return quality.adaptive_sample(positions(spark, d), SAMPLING).select("seq", "emitted")


_TOL = geo.TOLERANCE_M / geo.METERS_A_DEGREE
_S = f"(1 - {geo.ECCENTRICITY_2} * pow(sin(radians(lat)), 2))"
_EAST = f"({geo.SEMI_MAJOR_M} / sqrt({_S}) * cos(radians(lat)) * 0.017453292519943295)"
_NORTH = f"({geo.SEMI_MAJOR_M} * (1 - {geo.ECCENTRICITY_2}) / pow({_S}, 1.5) * 0.017453292519943295)"
_IN = "(lon BETWEEN w AND e AND lat BETWEEN s AND n)"
_DIST = f"""CASE WHEN {_IN} THEN least(least(lon - w, e - lon) * {_EAST}, least(lat - s, n - lat) * {_NORTH})
  ELSE sqrt(pow(greatest(w - lon, lon - e, 0) * {_EAST}, 2) + pow(greatest(s - lat, lat - n, 0) * {_NORTH}, 2)) END"""


def _verdict_sql(source: str) -> str:
    return f"""
, {BOXES_SQL}, hit AS (
  SELECT seq, bool_or(layer = 'manual_allow' AND {_IN}) AS m, bool_or(layer = 'navigable_water' AND {_IN}) AS wa, bool_or(layer = 'land' AND {_IN}) AS la,
    bool_or(layer = 'land' AND lon BETWEEN w - {_TOL!r} AND e + {_TOL!r} AND lat BETWEEN s - {_TOL!r} AND n + {_TOL!r} AND {_DIST} <= {geo.TOLERANCE_M}) AS ne
  FROM {source}, boxes WHERE lon BETWEEN w - 1 AND e + 1 AND lat BETWEEN s - 1 AND n + 1 GROUP BY seq),
verdicts AS (SELECT p.*, CASE WHEN m THEN 'manual_allow' WHEN wa THEN 'navigable_water' WHEN ne THEN 'coastal_tolerance' WHEN la THEN 'deep_land' ELSE 'not_land' END AS reason FROM {source} p LEFT JOIN hit USING (seq)),
judged AS (SELECT *, CASE reason WHEN 'deep_land' THEN 'reject' WHEN 'coastal_tolerance' THEN 'uncertain' ELSE 'allow' END AS verdict, reason = 'deep_land' AS should_drop FROM verdicts)
"""


@query("D3_geo_validate", _verdict_sql("positions") + "SELECT seq, verdict, reason, should_drop FROM judged")
def d3(spark, d):
    return geo.geo_result(geo.geo_verdict(positions(spark, d), polygons(spark, d), "v1")).select("seq", "verdict", "reason", "should_drop")


@query(
    "D4_geo_bucket_reuse",
    """, bk AS (SELECT *, min(seq) OVER (PARTITION BY round(lat, 4), round(lon, 4)) AS first_seq FROM positions),
    firsts AS (SELECT * FROM bk WHERE seq = first_seq)""" + _verdict_sql("firsts") + "SELECT b.seq, j.verdict, j.reason, b.first_seq AS judged_seq FROM bk b JOIN judged j ON j.seq = b.first_seq",
)
def d4(spark, d):
    zones = polygons(spark, d)
    return quality.geo_bucket_reuse(positions(spark, d), lambda p: geo.geo_verdict(p, zones, "v1")).select("seq", "verdict", "reason", "judged_seq")


_INGEST_SQL = (
    _DEDUP_SQL
    + f", live AS (SELECT f.*, accepted, {_ZONE_SQL} AS zone FROM feed f JOIN dd USING (seq)), afloat0 AS (SELECT * FROM live WHERE accepted AND kind = 'position' AND zone IS NOT NULL)"
    + _verdict_sql("afloat0")
    + ", afloat AS (SELECT * FROM judged WHERE NOT should_drop)"
    + _sample_sql("afloat")
    + """SELECT l.seq, CASE WHEN NOT accepted THEN 'duplicate' WHEN kind = 'static' THEN 'published' WHEN zone IS NULL THEN 'out_of_bbox' WHEN j.should_drop THEN 'on_land' WHEN s.emitted THEN 'published' ELSE 'sampled' END AS outcome
  FROM live l LEFT JOIN (SELECT seq, should_drop FROM judged) j USING (seq) LEFT JOIN sm s USING (seq)"""
)


def ingested(spark, d) -> DataFrame:
    return pipelines.ingest(feed(spark, d), polygons(spark, d), "v1", pipelines.IngestConfig(DEDUP_S, SAMPLING))


@query("D5_ingest", recursive(_INGEST_SQL), False)
def d5(spark, d):
    return ingested(spark, d).select("seq", "outcome")


# --- keyed state -------------------------------------------------------------

_VESSEL_COLUMNS = ["mmsi", *state.PROFILE]
_VESSEL_LIST = ", ".join(_VESSEL_COLUMNS)


@query("E1_upsert_identity", ", known AS (SELECT '2' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS mmsi, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name FROM supplier)" + VESSELS_SQL + "SELECT mmsi, coalesce(k.name, pv.seen_name) AS name FROM known k FULL JOIN pv USING (mmsi)")
def e1(spark, d):
    known = table(spark, d, "supplier").select(F.concat(F.lit("2"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("mmsi"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return state.upsert_identity(known, positions(spark, d))


@query("E2_upsert_profile", VESSELS_SQL + f"SELECT {_VESSEL_LIST} FROM sv")
def e2(spark, d):
    return state.upsert_profile(no_vessels(spark), statics(spark, d)).select(_VESSEL_COLUMNS)


@query("E3_merge_vessels", VESSELS_SQL + f"SELECT {_VESSEL_LIST} FROM vessels")
def e3(spark, d):
    return vessels_of(spark, d).select(_VESSEL_COLUMNS)


@query("E4_upsert_latest", LATEST_SQL + f"SELECT mmsi, {sql_t('occurred_at')}, {sql_t('last_seen_at')}, lon, lat, sog, cog, true_heading, nav_status FROM latest")
def e4(spark, d):
    own = positions(spark, d)
    first = state.upsert_latest(None, own.where(F.col("received_at") < day("2024-01-16")))
    return state.upsert_latest(first, own.where(F.col("received_at") >= day("2024-01-16"))).select("mmsi", t("occurred_at"), t("last_seen_at"), "lon", "lat", "sog", "cog", "true_heading", "nav_status")


@query("E5_append_history", HISTORY_SQL + f"SELECT mmsi, {sql_t('occurred_at')}, lon, lat FROM hist")
def e5(spark, d):
    own = positions(spark, d)
    return state.append_history(state.append_history(None, own.where("seq % 2 = 0")), own).select("mmsi", t("occurred_at"), "lon", "lat")


@query("E6_persist_events", f", kept AS (SELECT * FROM feed WHERE occurred_at >= date_trunc('day', {NOW_SQL}) - INTERVAL 8 DAY), pos2 AS (SELECT * FROM kept WHERE kind = 'position'), sta2 AS (SELECT *, ship_name AS name FROM kept WHERE kind = 'static')" + VESSELS_SQL.replace("FROM positions", "FROM pos2").replace("FROM statics", "FROM sta2") + "SELECT seq, mmsi, kind, v.imo, v.name FROM (SELECT seq, mmsi, kind FROM kept) JOIN vessels v USING (mmsi)")
def e6(spark, d):
    events = feed(spark, d).withColumn("name", F.when(F.col("kind") == "static", F.col("ship_name")))
    return pipelines.persist_events(events, no_vessels(spark), None, None, now()).facts.select("seq", "mmsi", "kind", "imo", "name")


@query(
    "E7_partition_plan",
    """, days AS (SELECT DISTINCT CAST(occurred_at AS DATE) AS day FROM positions WHERE day(occurred_at) % 3 <> 0),
    want AS (SELECT CAST(unnest(generate_series(DATE '2024-01-12', DATE '2024-01-27', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT strftime(day, 'history_y%Ym%md%d') AS name, 'create' AS action FROM want WHERE day NOT IN (SELECT day FROM days)
    UNION ALL SELECT strftime(day, 'history_y%Ym%md%d'), 'drop' FROM days WHERE day < DATE '2024-01-12'""",
)
def e7(spark, d):
    own = positions(spark, d).where(F.dayofmonth("occurred_at") % 3 != 0).select(state.partition_name(F.to_date("occurred_at")).alias("name")).distinct()
    odd = spark.createDataFrame([("history_default",)], "name string")
    return state.partition_plan(own.union(odd), datetime.date(2024, 1, 20))


@query("E8_apply_retention", HISTORY_SQL + f"SELECT mmsi, {sql_t('occurred_at')} FROM hist WHERE occurred_at >= date_trunc('day', {NOW_SQL}) - INTERVAL 8 DAY")
def e8(spark, d):
    path = readers.shared_path(spark, "history")
    return state.apply_retention(readers.write_history(positions(spark, d), path), now()).select("mmsi", t("occurred_at"))


# --- read queries ------------------------------------------------------------

_SINCE = "2024-01-29 00:00:00"
_ANY_ZONE = " OR ".join(_box_sql(b) for _, b in validate.ZONES)


@query("V1_latest_snapshot", LATEST_SQL + VESSELS_SQL + f"SELECT mmsi, lon, lat, name, imo, {sql_t('last_seen_at')} FROM latest JOIN (SELECT mmsi, name, imo FROM vessels) v USING (mmsi) WHERE last_seen_at >= TIMESTAMP '{_SINCE}' AND ({_ANY_ZONE}) ORDER BY last_seen_at DESC, mmsi LIMIT 1000")
def v1(spark, d):
    limit, _ = validate.snapshot_params(1000)
    return views.latest_snapshot(latest_of(spark, d), vessels_of(spark, d), [b for _, b in validate.ZONES], day(_SINCE), limit).select("mmsi", "lon", "lat", "name", "imo", t("last_seen_at"))


@query("V2_vessel_detail", LATEST_SQL + VESSELS_SQL + "SELECT mmsi, v.imo, v.name, v.ship_type, l.lon, l.sog, l.mmsi IS NOT NULL AS has_position FROM vessels v LEFT JOIN latest l USING (mmsi)")
def v2(spark, d):
    return views.vessel_detail(vessels_of(spark, d), latest_of(spark, d)).select("mmsi", "imo", "name", "ship_type", "position.lon", "position.sog", F.col("position").isNotNull().alias("has_position"))


@query("V3_track_points", HISTORY_SQL + f"SELECT mmsi, {sql_t('occurred_at')}, lon, lat FROM hist WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-12'")
def v3(spark, d):
    history = readers.write_history(positions(spark, d), readers.shared_path(spark, "history"))
    return views.track_points(history, day("2024-01-05"), day("2024-01-12")).select("mmsi", t("occurred_at"), "lon", "lat")


@query("V4_track_line", HISTORY_SQL + "SELECT mmsi, count(*) AS n_points, arg_min(lon, occurred_at) AS first_lon, arg_max(lat, occurred_at) AS last_lat FROM hist WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-12' GROUP BY mmsi HAVING count(*) >= 2")
def v4(spark, d):
    line = views.track_line(history_of(spark, d), day("2024-01-05"), day("2024-01-12"))
    return line.select("mmsi", F.size("line").cast("long").alias("n_points"), F.col("line")[0]["lon"].alias("first_lon"), F.element_at("line", -1)["lat"].alias("last_lat"))


_SIMPLIFY_SQL = HISTORY_SQL + """
, pt AS (SELECT mmsi, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY mmsi) AS n, lon, lat, radians(lon) * 6378137.0 AS x, ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0 AS y
  FROM hist WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-12' WINDOW w AS (PARTITION BY mmsi ORDER BY occurred_at)),
seg AS (
  SELECT DISTINCT mmsi, CAST(0 AS BIGINT) AS a, n - 1 AS b FROM pt WHERE n >= 2
  UNION ALL
  SELECT mmsi, unnest([a, k]), unnest([k, b]) FROM (
    SELECT mmsi, a, b, max(d) AS most, arg_max(i, (d, -i)) AS k FROM (
      SELECT s.mmsi, s.a, s.b, p.i, pow(p.x - q.x - t * (r.x - q.x), 2) + pow(p.y - q.y - t * (r.y - q.y), 2) AS d FROM seg s
        JOIN pt q ON q.mmsi = s.mmsi AND q.i = s.a JOIN pt r ON r.mmsi = s.mmsi AND r.i = s.b JOIN pt p ON p.mmsi = s.mmsi AND p.i > s.a AND p.i < s.b,
        LATERAL (SELECT CASE WHEN r.x = q.x AND r.y = q.y THEN 0 ELSE greatest(0, least(1, ((p.x - q.x) * (r.x - q.x) + (p.y - q.y) * (r.y - q.y)) / (pow(r.x - q.x, 2) + pow(r.y - q.y, 2)))) END AS t))
    GROUP BY mmsi, a, b) WHERE most > 20000.0 * 20000.0),
kept AS (SELECT mmsi, a AS i FROM seg UNION SELECT mmsi, b FROM seg)
SELECT mmsi, count(*) AS n_points, round(sum(lon), 6) AS lon_sum, round(sum(lat), 6) AS lat_sum FROM kept JOIN pt USING (mmsi, i) GROUP BY mmsi
"""


@query("V5_track_simplify", recursive(_SIMPLIFY_SQL), False)
def v5(spark, d):
    line = views.track_line(history_of(spark, d), day("2024-01-05"), day("2024-01-12"))
    total = lambda c: F.round(F.aggregate("line", F.lit(0.0), lambda t, p: t + p[c]), 6).alias(f"{c}_sum")
    return views.track_simplify(line, 20_000.0).select("mmsi", F.size("line").cast("long").alias("n_points"), total("lon"), total("lat"))


@query("V6_vessel_fingerprint", VESSELS_SQL + "SELECT mmsi, imo, name FROM vessels WHERE mmsi IN (SELECT '2' || lpad(CAST(s_suppkey * 5 AS VARCHAR), 8, '0') FROM supplier WHERE s_suppkey % 2 = 0)")
def v6(spark, d):
    own = vessels_of(spark, d).withColumn("vessel_id", state.vessel_id(F.col("mmsi")))
    return views.vessel_fingerprint(own, entities(spark, d).where("mmsi is not null")).select("mmsi", "imo", "name")


def checked_vessels(spark, d) -> DataFrame:
    """Vessels with an earlier check: by the number, none, an old one or a recent one."""
    n = F.substring("mmsi", 2, 8).cast("long")
    at = F.when(n % 3 == 0, None).when(n % 3 == 1, day("2024-01-10")).otherwise(day("2024-01-30"))
    return vessels_of(spark, d).join(latest_of(spark, d).select("mmsi", F.col("last_seen_at").alias("updated_at")), "mmsi").select("mmsi", "imo", "name", F.lit("clear").alias("status"), at.alias("checked_at"), "updated_at")


_CHECKED_SQL = LATEST_SQL + VESSELS_SQL + """, checked AS (SELECT mmsi, v.imo, v.name, 'clear' AS status, CASE CAST(substr(mmsi, 2, 8) AS BIGINT) % 3 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-30' END AS checked_at, l.last_seen_at AS updated_at FROM vessels v JOIN latest l USING (mmsi))
"""
_DUE = f"(checked_at IS NULL OR checked_at < {NOW_SQL} - INTERVAL 7 DAY)"


@query("V7_needs_enrichment", _CHECKED_SQL + f"SELECT mmsi FROM checked WHERE {_DUE} ORDER BY checked_at NULLS FIRST, updated_at, mmsi LIMIT 500")
def v7(spark, d):
    return views.needs_enrichment(checked_vessels(spark, d), now() - F.expr("interval 7 days")).select("mmsi")


def import_runs(spark, d) -> DataFrame:
    """Import runs from the orders: the customer's remainder is the source."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        key.alias("run_id"), F.concat(F.lit("source_"), (F.col("o_custkey") % 5).cast("string")).alias("source"), start.alias("started_at"), F.timestamp_add("SECOND", key % 900, start).cast("timestamp_ntz").alias("finished_at"),
        F.when(key % 7 == 0, "failed").otherwise("completed").alias("status"), (key % 1000).cast("int").alias("records_imported"),
    )


_RUNS_SQL = """WITH runs AS (SELECT o_orderkey AS run_id, 'source_' || (o_custkey % 5) AS source, o_orderdate AS started_at, o_orderdate + to_seconds(o_orderkey % 900) AS finished_at,
  CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, CAST(o_orderkey % 1000 AS INTEGER) AS records_imported FROM orders)
"""


@query("V8_recent_import_runs", _RUNS_SQL + f"SELECT run_id, source, {sql_t('started_at')} FROM runs ORDER BY runs.started_at DESC, run_id DESC LIMIT 20", False)
def v8(spark, d):
    return views.recent_import_runs(import_runs(spark, d)).select("run_id", "source", t("started_at"))


@query("V8_last_run_by_source", _RUNS_SQL + "SELECT source, arg_max(run_id, (started_at, run_id)) AS run_id, bool_or(status = 'completed') AS has_completed FROM runs GROUP BY source", False)
def v8b(spark, d):
    runs = import_runs(spark, d)
    return views.last_run_by_source(runs).join(views.has_completed_run(runs), "source").select("source", "last_run.run_id", "has_completed")


@query("V9_sources_with_last_import", _RUNS_SQL + ", l AS (SELECT source, arg_max(run_id, (started_at, run_id)) AS run_id FROM runs GROUP BY source) SELECT 'source_' || r_regionkey * 2 AS source, run_id FROM region LEFT JOIN l ON l.source = 'source_' || r_regionkey * 2", False)
def v9(spark, d):
    registry = table(spark, d, "region").select(F.concat(F.lit("source_"), (F.col("r_regionkey") * 2).cast("string")).alias("source"))
    return views.sources_with_last_import(registry, import_runs(spark, d)).select("source", "last_run.run_id")


# --- geography ---------------------------------------------------------------


@query("G1_geo_verdict", _verdict_sql("positions") + "SELECT seq, verdict, reason FROM judged")
def g1(spark, d):
    return geo.geo_verdict(positions(spark, d), polygons(spark, d), "v1").select("seq", "verdict", "reason")


@query("G2_covers", f", {BOXES_SQL} SELECT seq, polygon_id FROM positions, boxes WHERE {_IN}")
def g2(spark, d):
    return geo.matching(positions(spark, d), polygons(spark, d), geo.covers())


@query("G3_within_distance", f", {BOXES_SQL} SELECT seq, polygon_id FROM positions, boxes WHERE lon BETWEEN w - 20000/111320.0 AND e + 20000/111320.0 AND lat BETWEEN s - 20000/111320.0 AND n + 20000/111320.0 AND {_DIST} <= 20000")
def g3(spark, d):
    return geo.matching(positions(spark, d), polygons(spark, d), geo.within_distance(20_000), 20_000 / geo.METERS_A_DEGREE)


def _rects_sql() -> str:
    return "rect AS (" + " UNION ALL ".join(f"SELECT CAST({w!r} AS DOUBLE) AS w, CAST({s!r} AS DOUBLE) AS s, CAST({e!r} AS DOUBLE) AS e, CAST({n!r} AS DOUBLE) AS n" for w, s, e, n in disjoint(geo.coverage_area(validate.ZONES))) + ")"


@query(
    "G4_clip_polygons",
    "WITH " + AREAS_SQL + ", " + _UNION_SQL + ", " + _rects_sql() + f""", own AS (SELECT polygon_id, kind, sum({_overlap('a.w', 'a.s', 'a.e', 'a.n')} - {_overlap('a.nw', 'a.ns', 'a.ne', 'a.nn')}) AS area FROM areas a, cell c GROUP BY ALL),
    parts AS (SELECT polygon_id, bool_or(a.w >= c.w AND a.e <= c.e AND a.s >= c.s AND a.n <= c.n) AS uncut, CAST(sum(CASE WHEN {_overlap('a.w', 'a.s', 'a.e', 'a.n')} - {_overlap('a.nw', 'a.ns', 'a.ne', 'a.nn')} <= 1e-12 THEN 0
        WHEN kind = 3 AND c.s >= a.ns THEN CAST({_overlap('a.w', 'a.s', 'a.nw', 'a.n')} > 1e-12 AS INTEGER) + CAST({_overlap('a.ne', 'a.s', 'a.e', 'a.n')} > 1e-12 AS INTEGER) ELSE 1 END) AS BIGINT) AS parts FROM areas a, rect c GROUP BY polygon_id)
    SELECT polygon_id, kind, round(area, 6) AS area, parts, CASE WHEN uncut THEN [5, 7, 10, 9][kind + 1] END AS corners FROM own JOIN parts USING (polygon_id) WHERE area > 1e-12""",
    False,
)
def g4(spark, d):
    got = geo.clip_polygons(areas(spark, d), geo.coverage_area(validate.ZONES)).groupBy("polygon_id", "kind").agg(F.sum(ring_area()).alias("area"), F.count("*").alias("parts"), F.sum(F.size(F.flatten("rings"))).alias("n"))
    at = F.col("polygon_id")
    own = areas(spark, d).select("polygon_id", geo.ring_box().alias("b"))
    uncut = F.lit(False)
    for w, s, e, n in disjoint(geo.coverage_area(validate.ZONES)):
        uncut = uncut | ((F.col("b.west") >= w) & (F.col("b.east") <= e) & (F.col("b.south") >= s) & (F.col("b.north") <= n))
    both = got.join(own.hint("merge"), "polygon_id")
    return both.select(at, "kind", F.round("area", 6).alias("area"), "parts", F.when(uncut, F.col("n")).cast("int").alias("corners"))


@query("G5_buffer_lines", "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN 'wide' END AS width FROM part) SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND CAST(width AS INTEGER) > 0 THEN CAST(width AS INTEGER) / CAST(2 AS DOUBLE) ELSE CAST(75 AS DOUBLE) END AS radius_m FROM p", False)
def g5(spark, d):
    k = F.col("p_partkey")
    lines = table(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, F.col("p_size").cast("string")).when(k % 3 == 1, "wide").alias("width"))
    return geo.buffer_lines(lines).select("p_partkey", "radius_m")


def _metres_sql(lat: str) -> tuple[str, str]:
    return tuple(x.replace("radians(lat)", f"radians({lat})") for x in (_EAST, _NORTH))


def _buffer_area_sql(length: str) -> str:
    """A rectangle of both sides of a segment and a polygon of 32 corners around its ends, in square metres."""
    return f"(2 * r * {length} + 16 * r * r * sin(pi() / 16))"


@query(
    "G5_line_buffers",
    f"""WITH p AS (SELECT s_suppkey AS line_id, 35 + (s_suppkey * 11 % 80) / CAST(10 AS DOUBLE) AS y, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 100 ELSE 75 END AS DOUBLE) AS r FROM supplier)
    SELECT line_id, CAST(2 AS BIGINT) AS polygons, round({_buffer_area_sql('0.03 * ' + _metres_sql('y')[0])} + {_buffer_area_sql('0.02 * ' + _metres_sql('(y + 0.01)')[1])}) AS area_m2 FROM p""",
    False,
)
def g5_polygons(spark, d):
    line = F.transform("path", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    wide = geo.line_buffers(geo.buffer_lines(lines(spark, d).withColumn("line", line)))
    own = wide.withColumn("b", geo.ring_box())
    east, north = (F.expr(x) for x in geo.meters_a_degree("(b.south + b.north) / 2"))
    return own.groupBy("line_id").agg(F.count("*").alias("polygons"), F.round(F.sum(F.abs(ring_area()) * east * north)).alias("area_m2"))


@query("G6_fclass_filter", "SELECT p_partkey, p_type AS fclass FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')", False)
def g6(spark, d):
    return geo.fclass_filter(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("fclass")), ["ECONOMY", "STANDARD"])


def _coverage_sql(b: dict) -> str:
    dy = "50000/111320.0"
    return f"(lon BETWEEN {b['west']} - {dy}/cos(radians({max(abs(b['south']), abs(b['north']))})) AND {b['east']} + {dy}/cos(radians({max(abs(b['south']), abs(b['north']))})) AND lat BETWEEN {b['south']} - {dy} AND {b['north']} + {dy})"


@query("G7_coverage_area", "SELECT seq FROM positions WHERE " + " OR ".join(_coverage_sql(b) for _, b in validate.ZONES))
def g7(spark, d):
    area = [(str(i), b) for i, b in enumerate(geo.coverage_area(validate.ZONES))]
    return validate.in_coverage(positions(spark, d), area).where("in_zone").select("seq")


@query("G9_layer_counts", "WITH " + BOXES_SQL + "SELECT layer, count(*) AS polygons FROM boxes GROUP BY layer", False)
def g9(spark, d):
    return geo.layer_counts(polygons(spark, d), "v1")


def versions(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, d, "orders").select(k.cast("string").alias("version_id"), (k % 2 == 0).alias("is_active"), F.when(k % 3 != 0, at).alias("activated_at"), at.alias("created_at"))


@query("G10_activate_version", f"SELECT CAST(o_orderkey AS VARCHAR) AS version_id, o_orderkey = 7 AS is_active, {TEXT.format(f'CASE WHEN o_orderkey = 7 THEN {NOW_SQL} WHEN o_orderkey % 3 <> 0 THEN o_orderdate END')} AS activated_at FROM orders", False)
def g10(spark, d):
    return geo.activate_version(versions(spark, d), "7", now()).select("version_id", "is_active", t("activated_at"))


@query("G11_active_version", "SELECT CAST(o_orderkey AS VARCHAR) AS version_id FROM orders WHERE o_orderkey % 2 = 0 ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 1", False)
def g11(spark, d):
    return geo.active_version(versions(spark, d)).select("version_id")


@query("G12_probe_report", _verdict_sql("positions") + "SELECT reason, count(*) AS probes, count(*) FILTER (reason = 'not_land') AS passed FROM judged GROUP BY reason")
def g12(spark, d):
    probes = positions(spark, d).select("seq", "lon", "lat", F.lit("allow").alias("expected_verdict"), F.lit("not_land").alias("expected_reason"))
    return geo.probe_report(probes, polygons(spark, d), "v1").groupBy("reason").agg(F.count("*").alias("probes"), F.count(F.when(F.col("passed"), 1)).alias("passed"))


@query("G13_geo_result", _verdict_sql("positions") + "SELECT verdict, should_drop, count(*) AS n FROM judged GROUP BY 1, 2 UNION ALL SELECT 'reject', true, count(*) FROM positions")
def g13(spark, d):
    own = geo.geo_verdict(positions(spark, d), polygons(spark, d), "v1")
    count = lambda df: df.groupBy("verdict", "should_drop").agg(F.count("*").alias("n"))
    # Without polygons no verdict is looked up.
    return count(geo.geo_result(own)).unionAll(count(geo.geo_result(positions(spark, d), fail_open=False, available=False)))


# --- sanctions ---------------------------------------------------------------


@query("H1_sdn_to_entities", "WITH " + ENTITIES_SQL + "SELECT entity_id, name, imo, mmsi, flag, program AS programs, aliases[1] AS aliases FROM entities WHERE CAST(source_entity_id AS INTEGER) % 5 <> 0", False)
def h1(spark, d):
    got = sanctions.sdn_to_entities(readers.read_sdn_xml(spark, sdn_file(spark, d)))
    return got.select("entity_id", "name", "imo", "mmsi", "flag", F.array_join("programs", ",").alias("programs"), F.array_join("aliases", ",").alias("aliases"))


@query("H2_first_valid_id", "WITH " + ENTITIES_SQL + "SELECT source_entity_id AS uid, imo, mmsi FROM entities", False)
def h2(spark, d):
    ids = F.col("idList.id")
    got = readers.read_sdn_xml(spark, sdn_file(spark, d))
    return got.select("uid", sanctions.first_valid_id(ids, "Vessel Registration Identification", r"\d{7}", r"IMO\s").alias("imo"), sanctions.first_valid_id(ids, "MMSI", r"\d{9}").alias("mmsi"))


@query("H3_upsert_entities", "WITH " + ENTITIES_SQL + "SELECT entity_id, source, source_entity_id, CASE WHEN CAST(source_entity_id AS INTEGER) % 3 = 0 THEN 'renamed' ELSE name END AS name FROM entities WHERE CAST(source_entity_id AS INTEGER) % 3 <> 2 OR CAST(source_entity_id AS INTEGER) % 2 = 0", False)
def h3(spark, d):
    own = entities(spark, d).select("entity_id", "source", "source_entity_id", "name")
    n = F.col("source_entity_id").cast("int")
    incoming = own.where(n % 3 == 0).withColumn("seq", F.lit(1)).unionByName(own.where(n % 3 == 0).withColumns({"name": F.lit("renamed"), "seq": F.lit(2)})).unionByName(own.where(n % 3 == 1).withColumn("seq", F.lit(1)))
    return sanctions.upsert_entities(own.where(n % 2 == 0), incoming)


@query("H4_import_run", _RUNS_SQL + "SELECT status, count(*) AS n FROM runs GROUP BY status UNION ALL SELECT 'run completed', count(*) FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT 'run skipped', 0 UNION ALL SELECT 'run failed', 0", False)
def h4(spark, d):
    runs = import_runs(spark, d).withColumns({"errors": F.array().cast("array<string>")}).select("run_id", "source", "started_at", "finished_at", "status", "records_imported", "errors")
    load = lambda: sanctions.sdn_to_entities(readers.read_sdn_xml(spark, sdn_file(spark, d)))
    folder = readers.shared_path(spark, "entities")

    def save(entities: DataFrame) -> int:
        entities.write.parquet(folder)
        return spark.read.parquet(folder).count()

    done = sanctions.import_run(runs, "ofac", -1, now(), load, save, now())
    busy = done.withColumn("status", F.when(F.col("run_id") == -1, "running").otherwise(F.col("status")))
    again = sanctions.import_run(busy, "ofac", -2, now(), load, save, now())  # another import of the source is running
    broken = sanctions.import_run(done, "ofac", -3, now(), load, save, now())  # the folder is there: nothing is saved
    log = done.where("run_id >= 0").groupBy("status").agg(F.count("*").alias("n"))
    own = done.where("run_id = -1").unionByName(again.where("run_id = -2")).unionByName(broken.where("run_id = -3"))
    return log.unionAll(own.select(F.concat(F.lit("run "), "status"), F.col("records_imported").cast("long")))


_MATCH_SQL = LATEST_SQL + VESSELS_SQL + ", " + ENTITIES_SQL + """
, ids AS (SELECT v.mmsi, entity_id, source_entity_id, 0 AS rank FROM vessels v JOIN entities e ON e.imo = v.imo UNION ALL SELECT v.mmsi, entity_id, source_entity_id, 1 FROM vessels v JOIN entities e ON e.mmsi = v.mmsi),
named AS (SELECT entity_id, source_entity_id, unnest(list_concat([name], aliases)) AS k FROM entities),
found AS (SELECT * FROM ids UNION ALL SELECT DISTINCT v.mmsi, entity_id, source_entity_id, 2 FROM vessels v JOIN named ON k = v.name WHERE v.mmsi NOT IN (SELECT mmsi FROM ids)),
once2 AS (SELECT mmsi, entity_id, source_entity_id, min(rank) AS rank FROM found GROUP BY ALL),
matched AS (SELECT *, ['imo', 'mmsi', 'name'][rank + 1] AS method, row_number() OVER (PARTITION BY mmsi ORDER BY rank, source_entity_id, entity_id) AS position FROM once2),
statuses AS (SELECT v.mmsi, CASE WHEN min(rank) < 2 THEN 'sanctioned' WHEN min(rank) = 2 THEN 'candidate' ELSE 'clear' END AS status, count(m.mmsi) AS n_matches FROM vessels v LEFT JOIN matched m ON m.mmsi = v.mmsi GROUP BY v.mmsi)
"""


@query("M1_match_sanctions", _MATCH_SQL + "SELECT mmsi, entity_id, method, CAST(position AS INTEGER) AS position FROM matched")
def m1(spark, d):
    return sanctions.match_sanctions(vessels_of(spark, d), entities(spark, d)).select("mmsi", "entity_id", "method", "position")


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "M1_match_normalized",
    LATEST_SQL + VESSELS_SQL + ", " + ENTITIES_SQL + f"""
, shown AS (SELECT mmsi, imo, CASE CAST(substr(mmsi, 2, 8) AS BIGINT) % 3 WHEN 0 THEN name WHEN 1 THEN '  ' || upper(replace(name, '#', ' - ')) ELSE '--' END AS name FROM vessels),
ids AS (SELECT v.mmsi, entity_id, source_entity_id, 0 AS rank FROM shown v JOIN entities e ON e.imo = v.imo UNION ALL SELECT v.mmsi, entity_id, source_entity_id, 1 FROM shown v JOIN entities e ON e.mmsi = v.mmsi),
named AS (SELECT entity_id, source_entity_id, {_PLAIN.format('k')} AS k FROM (SELECT entity_id, source_entity_id, unnest(list_concat([name], aliases)) AS k FROM entities)),
found AS (SELECT * FROM ids UNION ALL SELECT DISTINCT v.mmsi, entity_id, source_entity_id, 2 FROM shown v JOIN named ON k = {_PLAIN.format('v.name')} AND k <> '' WHERE v.mmsi NOT IN (SELECT mmsi FROM ids)),
once2 AS (SELECT mmsi, entity_id, source_entity_id, min(rank) AS rank FROM found GROUP BY ALL)
SELECT mmsi, entity_id, ['imo', 'mmsi', 'name'][rank + 1] AS method, CAST(row_number() OVER (PARTITION BY mmsi ORDER BY rank, source_entity_id, entity_id) AS INTEGER) AS position FROM once2""",
)
def m1_normalized(spark, d):
    n = F.substring("mmsi", 2, 8).cast("long")
    spelt = F.when(n % 3 == 0, F.col("name")).when(n % 3 == 1, F.concat(F.lit("  "), F.upper(F.replace("name", F.lit("#"), F.lit(" - "))))).otherwise("--")
    own = vessels_of(spark, d).withColumn("name", F.when(F.col("name").isNotNull() | (n % 3 == 2), spelt))
    return sanctions.match_sanctions(own, entities(spark, d), "normalized").select("mmsi", "entity_id", "method", "position")


@query("P8_track_params", HISTORY_SQL + "SELECT mmsi, count(*) AS n FROM hist WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-12' GROUP BY mmsi")
def p8(spark, d):
    start, end, _ = validate.track_params(datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 12))
    return views.track_points(history_of(spark, d), day(str(start)), day(str(end))).groupBy("mmsi").agg(F.count("*").alias("n"))


@query("R1_registry", _NORM_SQL + "SELECT kind, drop_reason, count(*) AS n FROM norm GROUP BY kind, drop_reason")
def r1(spark, d):
    providers = Registry("provider")
    providers.register("feed", normalize.normalize)
    providers.register("feed", lambda frames: frames.limit(0))  # the name is taken
    return providers.get("feed")(clean_frames(spark, d)).groupBy("kind", "drop_reason").agg(F.count("*").alias("n"))


@query("M2_normalize_name", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM customer", False)
def m2(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.normalize_name(F.col("c_name")).alias("name"))


@query("M3_candidates", _MATCH_SQL + "SELECT mmsi, entity_id, 'imo' AS method FROM ids WHERE rank = 0 UNION ALL SELECT mmsi, entity_id, 'mmsi' FROM ids WHERE rank = 1 UNION ALL SELECT DISTINCT v.mmsi, entity_id, 'name' FROM vessels v JOIN named ON k = v.name")
def m3(spark, d):
    own, listed = vessels_of(spark, d), entities(spark, d)
    return sanctions.candidates_by_imo(own, listed).unionByName(sanctions.candidates_by_mmsi(own, listed)).unionByName(sanctions.candidates_by_name(own, listed)).select("mmsi", "entity_id", "method")


@query("M4_status_of", _MATCH_SQL + "SELECT mmsi, status, n_matches FROM statuses")
def m4(spark, d):
    own = vessels_of(spark, d)
    return sanctions.status_of(own, sanctions.match_sanctions(own, entities(spark, d)))


_PROFILE_HASH = """substr(sha1('{"imo":"' || coalesce(imo, '') || '","name":"' || trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ', 'g')) || '"}'), 1, 16)"""


@query("M5_profile_hash", VESSELS_SQL + f"SELECT mmsi, {_PROFILE_HASH} AS profile_hash FROM vessels")
def m5(spark, d):
    return vessels_of(spark, d).select("mmsi", fn.profile_hash(F.col("imo"), F.col("name")).alias("profile_hash"))


def checks_of(vessels: DataFrame) -> DataFrame:
    """What earlier runs knew of checked vessels: of every fourth nothing, of others their hash or another."""
    n = F.substring("mmsi", 2, 8).cast("long")
    own = vessels.where(n % 4 != 0)
    return own.select("mmsi", F.when(n % 4 == 1, "0000").otherwise(fn.profile_hash(F.col("imo"), F.col("name"))).alias("profile_hash"), "checked_at")


_TRIGGER_SQL = _CHECKED_SQL + f""", hashed AS (SELECT *, CAST(substr(mmsi, 2, 8) AS BIGINT) % 4 AS r, {_PROFILE_HASH} AS profile_hash FROM checked),
jobs AS (SELECT mmsi, imo, name, status, checked_at, profile_hash, CASE WHEN r = 0 THEN 'discovered' WHEN r = 1 AND profile_hash <> '0000' THEN 'profile_changed' WHEN {_DUE} THEN 'stale' END AS trigger, updated_at FROM hashed)
"""


@query("M6_enrichment_trigger", _TRIGGER_SQL + "SELECT mmsi, trigger, profile_hash FROM jobs WHERE trigger IS NOT NULL")
def m6(spark, d):
    own = readers.written(checked_vessels(spark, d), "vessels")
    return sanctions.enrichment_trigger(own, checks_of(own), now()).select("mmsi", "trigger", "profile_hash")


@query("M7_apply_enrichment", _CHECKED_SQL + f"SELECT mmsi, CASE WHEN checked_at IS NULL OR checked_at < TIMESTAMP '2024-01-20' THEN 'applied' ELSE 'noop' END AS outcome, CASE WHEN checked_at IS NULL OR checked_at < TIMESTAMP '2024-01-20' THEN 'candidate' ELSE status END AS status FROM checked")
def m7(spark, d):
    own = checked_vessels(spark, d)
    return sanctions.apply_enrichment(own, own.select("mmsi", F.lit("candidate").alias("status"), day("2024-01-20").alias("checked_at"))).select("mmsi", "outcome", "status")


@query("M8_enrich", _MATCH_SQL + _TRIGGER_SQL[len(LATEST_SQL + VESSELS_SQL):] + "SELECT mmsi, trigger, s.status, s.n_matches FROM jobs JOIN (SELECT mmsi, status, n_matches FROM statuses) s USING (mmsi) WHERE trigger IS NOT NULL")
def m8(spark, d):
    own = readers.written(checked_vessels(spark, d), "vessels")
    facts = own.select("mmsi", "imo", "name", F.lit(1).alias("seq"))
    return pipelines.enrich(facts, own, entities(spark, d), checks_of(own), now()).select("mmsi", "trigger", "status", "n_matches")


@query("M9_reconcile", _TRIGGER_SQL + f", due AS (SELECT * FROM jobs WHERE {_DUE} ORDER BY checked_at NULLS FIRST, updated_at, mmsi LIMIT 500) SELECT count(*) AS scanned, count(trigger) AS enqueued, count(*) - count(trigger) AS skipped FROM due")
def m9(spark, d):
    own = readers.written(checked_vessels(spark, d), "vessels")
    return sanctions.reconcile(own, checks_of(own), now())


# --- fan-out and live view ---------------------------------------------------


@query(
    "X1_conflate",
    """, s AS (SELECT *, time_bucket(INTERVAL 1 DAY, received_at) AS slot FROM feed)
    SELECT mmsi, kind, seq, seq AS place, strftime(slot, '%Y-%m-%d') AS slot FROM s WHERE kind <> 'position'
    UNION ALL SELECT mmsi, 'position', max(seq), min(seq), strftime(slot, '%Y-%m-%d') FROM s WHERE kind = 'position' GROUP BY slot, mmsi""",
)
def x1(spark, d):
    return fanout.conflate(feed(spark, d), "1 day").select("mmsi", "kind", "seq", "place", F.date_format("slot", "yyyy-MM-dd").alias("slot"))


@query("X1_conflate_capacity")
def x1_capacity(spark, d):
    """A queue of 40 entries a day; no SQL: which vessel goes depends on all that came before it."""
    own = fanout.conflate(feed(spark, d), "1 day", 40)
    return own.select("mmsi", "kind", "seq", "place", F.date_format("slot", "yyyy-MM-dd").alias("slot"))


_MATCHED = "CASE WHEN event_id % 4 < 2 THEN 'e' || event_id || ':ofac:Name ' || event_id % 7 || ':imo:P' || event_id % 3 || '+Q' ELSE '' END"
_LIVE_SQL = f"""
, all_events AS (SELECT * REPLACE (CASE WHEN kind = 'static' AND event_id % 2 = 1 THEN 'enriched' ELSE kind END AS kind) FROM feed),
g AS (SELECT *, max(occurred_at) OVER (PARTITION BY mmsi, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM all_events),
ok AS (SELECT * FROM g WHERE top IS NULL OR occurred_at >= top),
live AS (SELECT mmsi, arg_max(lon, seq) FILTER (kind = 'position') AS lon, arg_max(lat, seq) FILTER (kind = 'position') AS lat, arg_max(coalesce(sog, -1), seq) FILTER (kind = 'position') AS sog0,
    arg_max(cog, seq) FILTER (kind = 'position') AS cog, arg_max(true_heading, seq) FILTER (kind = 'position') AS true_heading, arg_max(coalesce(nav_status, -1), seq) FILTER (kind = 'position') AS nav0,
    max(occurred_at) FILTER (kind = 'position') AS occurred_at, max(received_at) FILTER (kind = 'position') AS last_seen_at,
    arg_max(ship_name, seq) FILTER (ship_name IS NOT NULL AND kind <> 'enriched') AS name, arg_max(imo, seq) FILTER (kind = 'static' AND imo IS NOT NULL) AS imo, arg_max(ship_type, seq) FILTER (kind = 'static' AND ship_type IS NOT NULL) AS ship_type,
    arg_max(call_sign, seq) FILTER (kind = 'static' AND call_sign IS NOT NULL) AS call_sign, arg_max(destination, seq) FILTER (kind = 'static' AND destination IS NOT NULL) AS destination,
    max(occurred_at) FILTER (kind = 'static') AS static_occurred_at, max(occurred_at) FILTER (kind = 'enriched') AS sanctions_checked_at,
    arg_max('v' || user_id, seq) FILTER (kind = 'enriched') AS vessel_id, arg_max(['clear', 'candidate', 'sanctioned'][event_id % 3 + 1], seq) FILTER (kind = 'enriched') AS sanctions_status,
    arg_max({_MATCHED}, seq) FILTER (kind = 'enriched') AS matches FROM ok GROUP BY mmsi)
"""
_MATCH_FIELDS = ("entity_id", "source", "name", "match_method", "programs")


def with_checks(events: DataFrame) -> DataFrame:
    """Adds what an enriched event has: vessel_id, status, and matches, of a known source for half of the events."""
    i = F.col("event_id")
    text = i.cast("string")
    match = F.struct(F.concat(F.lit("e"), text).alias("entity_id"), F.when(i % 4 < 2, "ofac").otherwise("other").alias("source"), F.concat(F.lit("Name "), (i % 7).cast("string")).alias("name"), F.lit("imo").alias("match_method"), F.array(F.concat(F.lit("P"), (i % 3).cast("string")), F.lit("Q")).alias("programs"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("clear", "candidate", "sanctioned")]), (i % 3).cast("int") + 1)
    return events.withColumns({"status": status, "matches": F.array(match), "vessel_id": F.concat(F.lit("v"), F.col("user_id").cast("string"))})


def all_events(spark, d) -> DataFrame:
    """The feed with every other static event as an enriched one."""
    kind = F.when((F.col("kind") == "static") & (F.col("event_id") % 2 == 1), "enriched").otherwise(F.col("kind"))
    return with_checks(feed(spark, d)).withColumns({"kind": kind, "name": F.col("ship_name")})


def live_of(spark, d) -> DataFrame:
    return fanout.live_view(all_events(spark, d))


def matches_text(column: str = "sanctions_matches") -> F.Column:
    one = lambda m: F.concat_ws(":", m["id"], m["source"], m["entity_name"], m["match_method"], F.array_join(m["programs"], "+"))
    return F.array_join(F.transform(column, one), ",")


_LIVE_COLUMNS = f"mmsi, lon, lat, {sql_t('occurred_at')}, {sql_t('last_seen_at')}"
_LIVE_ALL_SQL = f"mmsi, vessel_id, lon, lat, nullif(sog0, -1) AS sog, cog, true_heading, nullif(nav0, -1) AS nav_status, {sql_t('occurred_at')}, {sql_t('last_seen_at')}, imo, name, call_sign, ship_type, destination, {sql_t('static_occurred_at')}, sanctions_status, {sql_t('sanctions_checked_at')}, matches"


def live_columns(live: DataFrame) -> DataFrame:
    """All of the live view, times and matches as text."""
    plain = ["mmsi", "vessel_id", "lon", "lat", "sog", "cog", "true_heading", "nav_status", "imo", "name", "call_sign", "ship_type", "destination", "sanctions_status"]
    return live.select(*plain, *map(t, ("occurred_at", "last_seen_at", "static_occurred_at", "sanctions_checked_at")), matches_text().alias("matches"))


@query("X2_fold_position", _LIVE_SQL + f"SELECT {_LIVE_COLUMNS} FROM live WHERE lon IS NOT NULL")
def x2(spark, d):
    own, cut = positions(spark, d), day("2024-01-16")
    first = spark.createDataFrame([], "mmsi string, lon double, lat double, sog double, cog double, true_heading int, nav_status int, occurred_at timestamp_ntz, last_seen_at timestamp_ntz, name string")
    half = fanout.fold_position(first, own.where(F.col("received_at") < cut))
    return fanout.fold_position(half, own.where(F.col("received_at") >= cut)).select("mmsi", "lon", "lat", t("occurred_at"), t("last_seen_at"))


@query("X3_fold_static", _LIVE_SQL.replace("event_id % 2 = 1 THEN 'enriched'", "false THEN 'enriched'") + f", st AS (SELECT mmsi, arg_max(ship_name, seq) FILTER (ship_name IS NOT NULL) AS name FROM ok WHERE kind = 'static' GROUP BY mmsi) SELECT mmsi, st.name, l.imo, l.ship_type, l.call_sign, l.destination, {sql_t('static_occurred_at')} FROM live l JOIN st USING (mmsi)")
def x3(spark, d):
    own, cut = statics(spark, d), day("2024-01-16")
    first = spark.createDataFrame([], "mmsi string, imo string, call_sign string, ship_type int, destination string, name string, static_occurred_at timestamp_ntz")
    half = fanout.fold_static(first, own.where(F.col("received_at") < cut))
    return fanout.fold_static(half, own.where(F.col("received_at") >= cut)).select("mmsi", "name", "imo", "ship_type", "call_sign", "destination", t("static_occurred_at"))


@query("X4_fold_enriched", f""", en AS (SELECT *, max(occurred_at) OVER (PARTITION BY mmsi ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM positions)
SELECT mmsi, arg_max('v' || user_id, seq) AS vessel_id, arg_max(['clear', 'candidate', 'sanctioned'][event_id % 3 + 1], seq) AS sanctions_status, arg_max({_MATCHED}, seq) AS matches, {TEXT.format('max(occurred_at)')} AS sanctions_checked_at FROM en WHERE top IS NULL OR occurred_at >= top GROUP BY mmsi""")
def x4(spark, d):
    own = with_checks(positions(spark, d)).withColumn("checked_at", F.col("occurred_at"))
    first = spark.createDataFrame([], fanout.LIVE)
    cut = day("2024-01-16")
    half = fanout.fold_enriched(first, own.where(F.col("received_at") < cut))
    return fanout.fold_enriched(half, own.where(F.col("received_at") >= cut)).select("mmsi", "vessel_id", "sanctions_status", matches_text().alias("matches"), t("sanctions_checked_at"))


@query(
    "X5_fold_snapshot",
    _LIVE_SQL + LATEST_SQL.replace("FROM positions", "FROM positions WHERE seq % 3 <> 1") + VESSELS_SQL + f""", snap AS (SELECT l.*, v.imo, v.name, v.call_sign, v.ship_type, 'id' || l.mmsi AS vessel_id, CAST(substr(l.mmsi, 2, 8) AS BIGINT) AS k FROM latest l JOIN vessels v USING (mmsi)),
    both2 AS (SELECT coalesce(r.mmsi, o.mmsi) AS mmsi, r.mmsi IS NOT NULL AS has, r.occurred_at IS NOT NULL AND (o.occurred_at IS NULL OR r.occurred_at >= o.occurred_at) AS newer,
      k % 3 <> 0 AND r.last_seen_at IS NOT NULL AND (o.sanctions_checked_at IS NULL OR r.last_seen_at >= o.sanctions_checked_at) AS rechecked, r, o FROM live o FULL JOIN snap r ON r.mmsi = o.mmsi)
    SELECT mmsi, CASE WHEN has THEN r.vessel_id ELSE o.vessel_id END AS vessel_id, CASE WHEN newer THEN r.lon ELSE o.lon END AS lon, CASE WHEN newer THEN r.lat ELSE o.lat END AS lat, CASE WHEN newer THEN r.sog ELSE nullif(o.sog0, -1) END AS sog, CASE WHEN newer THEN r.cog ELSE o.cog END AS cog,
      CASE WHEN newer THEN r.true_heading ELSE o.true_heading END AS true_heading, CASE WHEN newer THEN r.nav_status ELSE nullif(o.nav0, -1) END AS nav_status, {TEXT.format('CASE WHEN newer THEN r.occurred_at ELSE o.occurred_at END')} AS occurred_at,
      {TEXT.format('greatest(r.last_seen_at, o.last_seen_at)')} AS last_seen_at, coalesce(r.imo, o.imo) AS imo, coalesce(r.name, o.name) AS name, coalesce(r.call_sign, o.call_sign) AS call_sign, coalesce(r.ship_type, o.ship_type) AS ship_type, o.destination AS destination,
      {TEXT.format('o.static_occurred_at')} AS static_occurred_at, CASE WHEN rechecked THEN 'clear' ELSE o.sanctions_status END AS sanctions_status, {TEXT.format('CASE WHEN rechecked THEN r.last_seen_at ELSE o.sanctions_checked_at END')} AS sanctions_checked_at, o.matches AS matches FROM both2""",
)
def x5(spark, d):
    k = F.substring("mmsi", 2, 8).cast("long")
    checked = {"vessel_id": F.concat(F.lit("id"), "mmsi"), "sanctions_status": F.lit("clear"), "sanctions_checked_at": F.when(k % 3 != 0, F.col("last_seen_at"))}
    latest = state.upsert_latest(None, positions(spark, d).where("seq % 3 != 1"))
    rows = latest.join(vessels_of(spark, d).select("mmsi", *fanout.SNAPSHOT_PROFILE), "mmsi").withColumns(checked)
    return live_columns(fanout.fold_snapshot(live_of(spark, d), rows))


_DETAIL_NEWER = "k % 4 <> 0 AND (o.at IS NULL OR d.at >= o.at)"


@query("X5_fold_detail", LATEST_SQL + f", old AS (SELECT mmsi, max(occurred_at) AS at FROM positions WHERE seq % 3 = 0 GROUP BY mmsi), det AS (SELECT mmsi, CAST(substr(mmsi, 2, 8) AS BIGINT) AS k, occurred_at - to_days(CAST(CAST(substr(mmsi, 2, 8) AS BIGINT) % 5 AS INTEGER)) AS at FROM latest) SELECT mmsi, CASE WHEN {_DETAIL_NEWER} THEN k END AS vessel_id, CASE WHEN {_DETAIL_NEWER} THEN 'clear' ELSE 'candidate' END AS sanctions_status FROM det d FULL JOIN old o USING (mmsi) WHERE o.at IS NOT NULL OR k % 4 <> 0")
def x5_detail(spark, d):
    k = F.substring("mmsi", 2, 8).cast("long")
    none = F.lit(None).cast("array<string>").alias("sanctions_matches")
    old = positions(spark, d).where("seq % 3 = 0").groupBy("mmsi").agg(F.max("occurred_at").alias("sanctions_checked_at")).select("mmsi", F.lit(None).cast("long").alias("vessel_id"), F.lit("candidate").alias("sanctions_status"), "sanctions_checked_at", none)
    checked = F.when(k % 4 != 0, F.col("occurred_at") - F.make_dt_interval((k % 5).cast("int")))
    details = latest_of(spark, d).select("mmsi", k.alias("vessel_id"), F.lit("clear").alias("sanctions_status"), checked.alias("sanctions_checked_at"), none)
    return fanout.fold_detail(old, details).select("mmsi", "vessel_id", "sanctions_status")


@query("X6_prune_stale", _LIVE_SQL + f"SELECT mmsi FROM live WHERE coalesce(last_seen_at, occurred_at, static_occurred_at) IS NULL OR {NOW_SQL} - coalesce(last_seen_at, occurred_at, static_occurred_at) <= INTERVAL 24 HOUR")
def x6(spark, d):
    return fanout.prune_stale(live_of(spark, d), now()).select("mmsi")


@query("X7_live_view", _LIVE_SQL + f"SELECT {_LIVE_ALL_SQL} FROM live")
def x7(spark, d):
    return live_columns(live_of(spark, d))


_COLOR_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'ship_type BETWEEN {a} AND {b}' for a, b in r)} THEN '{c}'" for _, c, r in fn.SHIP_CATEGORIES) + f" ELSE '{fn.OTHER_COLOR}' END"
_CATEGORY_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'ship_type BETWEEN {a} AND {b}' for a, b in r)} THEN '{n}'" for n, _, r in fn.SHIP_CATEGORIES) + f" ELSE '{fn.OTHER_CATEGORY}' END"
_MARKER_SQL = "CASE WHEN nav_status IN (1, 5, 6) OR ((nav_status IS NULL OR nav_status = 15) AND sog <= 0.3) THEN 'circle' ELSE 'arrow' END"


@query("X8_map_layer", f"SELECT mmsi, lon, lat, CASE WHEN cog BETWEEN 0 AND 359 THEN cog WHEN true_heading BETWEEN 0 AND 359 THEN true_heading ELSE 0 END AS rotation, {_COLOR_SQL} AS color, {_MARKER_SQL} AS marker FROM positions")
def x8(spark, d):
    return fanout.map_layer(positions(spark, d))


# --- scalar functions --------------------------------------------------------


@query("F1_ship_type_category", f"SELECT seq, {_CATEGORY_SQL} AS category, {_COLOR_SQL} AS color FROM feed")
def f1(spark, d):
    return feed(spark, d).select("seq", fn.ship_type_category(F.col("ship_type")).alias("category"), fn.ship_type_color(F.col("ship_type")).alias("color"))


@query("F2_ship_type_label", "SELECT seq, CASE WHEN ship_type IS NULL THEN '—' " + " ".join(f"WHEN ship_type BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in fn.SHIP_LABELS) + " ELSE 'Unknown' END AS label FROM feed")
def f2(spark, d):
    return feed(spark, d).select("seq", fn.ship_type_label(F.col("ship_type")).alias("label"))


@query("F3_nav_status_label", "SELECT seq, CASE WHEN nav_status IS NULL THEN '—' " + " ".join(f"WHEN nav_status = {i} THEN '{n}'" for i, n in enumerate(fn.NAV_LABELS)) + " END AS label, CASE " + " ".join(f"WHEN nav_status = {i} THEN '{fn.NAV_SHORT.get(i, n)}'" for i, n in enumerate(fn.NAV_LABELS)) + " ELSE '—' END AS short_label FROM (SELECT seq, CASE WHEN event_id % 11 <> 0 THEN event_id % 16 END AS nav_status FROM feed)")
def f3(spark, d):
    nav = F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 16)
    return feed(spark, d).select("seq", fn.nav_status_label(nav).alias("label"), fn.nav_status_short(nav).alias("short_label"))


@query("F4_marker_shape", f"SELECT seq, {_MARKER_SQL} AS marker FROM feed")
def f4(spark, d):
    return feed(spark, d).select("seq", fn.marker_shape(F.col("nav_status"), F.col("sog")).alias("marker"))


@query(
    "F5_age_label",
    """SELECT seq, CASE WHEN us IS NULL THEN '—' WHEN us < 0 THEN 'just now' WHEN us < 60000000 THEN '< 1 min ago' WHEN us < 3600000000 THEN (us // 60000000) || ' min ago'
    WHEN us < 86400000000 THEN (us // 3600000000) || ' h ago' ELSE (us // 86400000000) || ' d ago' END AS age FROM (SELECT seq, CASE WHEN event_id % 9 <> 0 THEN date_diff('microsecond', occurred_at, TIMESTAMP '2024-01-20') END AS us FROM feed)""",
)
def f5(spark, d):
    return feed(spark, d).select("seq", fn.age_label(F.when(F.col("event_id") % 9 != 0, F.col("occurred_at")), day("2024-01-20")).alias("age"))


@query("F6_sanctions_label", "SELECT seq, CASE event_id % 4 WHEN 0 THEN 'No match' WHEN 1 THEN 'Candidate' WHEN 2 THEN 'Sanctioned' ELSE 'Unchecked' END AS label FROM feed")
def f6(spark, d):
    status = F.try_element_at(F.array(*[F.lit(x) for x in ("clear", "candidate", "sanctioned")]), (F.col("event_id") % 4).cast("int") + 1)
    return feed(spark, d).select("seq", fn.sanctions_label(status).alias("label"))


@query("F7_to_lat_lon_corners", f"SELECT seq, zone, CASE zone {' '.join(f'''WHEN '{n}' THEN '{b['south']},{b['west']},{b['north']},{b['east']}' ''' for n, b in validate.ZONES)} END AS corners FROM (SELECT seq, {_ZONE_SQL} AS zone FROM positions)")
def f7(spark, d):
    own = validate.in_coverage(positions(spark, d))
    corners = fn.chain([(F.col("zone") == n, F.array_join(F.flatten(fn.to_lat_lon_corners(b)).cast("array<string>"), ",")) for n, b in validate.ZONES], F.lit(None).cast("string"))
    return own.select("seq", "zone", corners.alias("corners"))


@query("F8_web_mercator", "SELECT seq, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(radians(lat) / 2 + 0.7853981633974483)) * 6378137.0, 3) AS y, round(lon, 6) AS lon2, round(lat, 6) AS lat2 FROM positions")
def f8(spark, d):
    return views.mercator_round_trip(positions(spark, d)).select("seq", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("lon2", 6).alias("lon2"), F.round("lat2", 6).alias("lat2"))


# --- rollups -----------------------------------------------------------------


def _window_sql(source: str, at: str, by: str) -> str:
    return f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, {at}), '%Y-%m-%d %H') AS hour, {by}, count(*) AS n, round(count(*) / CAST(3600 AS DOUBLE), 9) AS rate FROM {source} GROUP BY ALL"


def _hourly(rows: DataFrame, *by: str) -> DataFrame:
    return rollups.per_window(rows, "received_at", "1 hour", *by).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), *by, "n", F.round("rate", 9).alias("rate"))


@query("A1_received_per_window", _window_sql("feed", "received_at", "provider, kind"))
def a1(spark, d):
    return _hourly(feed(spark, d), "provider", "kind")


@query("A2_drops_per_window", recursive(_INGEST_SQL.replace("SELECT l.seq, CASE", ", outcomes AS (SELECT l.received_at, CASE") + ") " + _window_sql("(SELECT * FROM outcomes WHERE outcome <> 'published')", "received_at", "outcome")), False)
def a2(spark, d):
    return _hourly(ingested(spark, d).where("outcome != 'published'"), "outcome")


@query("A3_geo_decisions", _verdict_sql("positions") + "SELECT verdict, reason, provider, count(*) AS n FROM judged GROUP BY ALL")
def a3(spark, d):
    return rollups.geo_decisions(geo.geo_verdict(positions(spark, d), polygons(spark, d), "v1"), "provider")


@query("A3_geo_rates", _verdict_sql("positions") + "SELECT count(*) AS decisions, CAST(sum(CAST(reason = 'deep_land' AS INTEGER)) AS BIGINT) AS deep_land, CAST(0 AS DOUBLE) AS error_rate FROM judged")
def a3b(spark, d):
    return rollups.geo_rates(geo.geo_verdict(positions(spark, d), polygons(spark, d), "v1"))


@query("A4_reuse_ratio", "SELECT count(*) AS lookups, count(*) - count(DISTINCT (round(lat, 4), round(lon, 4))) AS hits, round((count(*) - count(DISTINCT (round(lat, 4), round(lon, 4)))) / CAST(count(*) AS DOUBLE), 9) AS ratio FROM positions")
def a4(spark, d):
    return rollups.reuse_ratio(quality.geo_buckets(positions(spark, d))).withColumn("ratio", F.round("ratio", 9))


@query("A5_matches_by_method", _MATCH_SQL + "SELECT method AS what, count(*) AS n FROM matched GROUP BY 1 UNION ALL SELECT status, count(*) FROM statuses GROUP BY 1")
def a5(spark, d):
    own = vessels_of(spark, d)
    matches = sanctions.match_sanctions(own, entities(spark, d))
    return rollups.matches_by_method(matches).toDF("what", "n").unionAll(rollups.outcomes_by_status(sanctions.status_of(own, matches)).toDF("what", "n"))


@query("A6_import_durations", _RUNS_SQL + "SELECT source, round(quantile_cont(date_diff('microsecond', started_at, finished_at) / CAST(1000000 AS DOUBLE), 0.95), 6) AS p95_s, CAST(sum(records_imported) AS BIGINT) AS records FROM runs WHERE status = 'completed' GROUP BY source", False)
def a6(spark, d):
    return rollups.import_durations(import_runs(spark, d)).withColumn("p95_s", F.round("p95_s", 6))


@query("A7_rows_written", LATEST_SQL + VESSELS_SQL + HISTORY_SQL + "SELECT 'vessels' AS \"table\", count(*) AS n FROM vessels UNION ALL SELECT 'latest', count(*) FROM latest UNION ALL SELECT 'history', count(*) FROM hist")
def a7(spark, d):
    return rollups.rows_written({"vessels": vessels_of(spark, d), "latest": latest_of(spark, d), "history": history_of(spark, d)})


@query("A8_feed_health", f"""SELECT p.provider, CASE WHEN l.last_at IS NULL THEN CAST(-1 AS DOUBLE) ELSE round(date_diff('microsecond', l.last_at, {NOW_SQL}) / CAST(1000000 AS DOUBLE), 6) END AS last_message_s, coalesce(l.last_at, TIMESTAMP '2024-01-01') < {NOW_SQL} - INTERVAL 60 SECOND AS degraded
FROM (SELECT unnest(['feed_a', 'feed_b', 'feed_c']) AS provider) p LEFT JOIN (SELECT provider, max(received_at) AS last_at FROM feed GROUP BY provider) l USING (provider)""")
def a8(spark, d):
    providers = spark.createDataFrame([("feed_a",), ("feed_b",), ("feed_c",)], "provider string")
    return rollups.feed_health(providers, feed(spark, d), day("2024-01-01"), now()).withColumn("last_message_s", F.round("last_message_s", 6))


_DEAD_SQL = """(SELECT received_at, 'events' AS stream, 'invalid-json' AS reason FROM feed WHERE event_id % 13 <> 0 AND event_id % 8 = 0
  UNION ALL SELECT max(received_at), 'events', 'failed' FROM feed GROUP BY user_id HAVING count(*) >= 60)"""


@query("A9_deadletter_rate", _window_sql(_DEAD_SQL, "received_at", "stream, reason"))
def a9(spark, d):
    """What malformed records and exhausted attempts put into quarantine, by hour."""
    malformed = quarantine.split_malformed(log_of(spark, d), "events", "writer")[1].select(F.col("first_failed_at").alias("received_at"), F.col("original_stream").alias("stream"), "reason")
    given_up = quarantine.account_failures(failures_of(spark, d), 60).where("outcome = 'quarantine'").select(F.col("last_failed_at").alias("received_at"), "stream", F.lit("failed").alias("reason"))
    return _hourly(malformed.unionAll(given_up), "stream", "reason")


_BOUNDS = [60.0, 120.0, 300.0, 600.0, 900.0]


@query("A10_histogram", _RUNS_SQL + ", b AS (SELECT unnest([60.0, 120.0, 300.0, 600.0, 900.0]) AS le) SELECT source, CAST(le AS DOUBLE) AS le, count(*) FILTER (run_id % 900 <= le) AS n FROM runs, b GROUP BY ALL", False)
def a10(spark, d):
    seconds = import_runs(spark, d).withColumn("s", fn.micros_between(F.col("started_at"), F.col("finished_at")) / 1e6)
    return rollups.histogram(seconds, "s", _BOUNDS, "source").where("le < 1000")


@query(
    "A10_bucket_quantile",
    _RUNS_SQL + """, b AS (SELECT unnest([60.0, 120.0, 300.0, 600.0, 900.0]) AS le), h AS (SELECT source, CAST(le AS DOUBLE) AS le, count(*) FILTER (run_id % 900 <= le) AS n FROM runs, b GROUP BY ALL),
    w AS (SELECT *, coalesce(lag(le) OVER x, 0) AS low, coalesce(lag(n) OVER x, 0) AS before, max(n) OVER (PARTITION BY source) AS total FROM h WINDOW x AS (PARTITION BY source ORDER BY le))
    SELECT source, round(low + (le - low) * (total * CAST(0.9 AS DOUBLE) - before) / (n - before), 6) AS quantile FROM w WHERE n >= total * CAST(0.9 AS DOUBLE) AND before < total * CAST(0.9 AS DOUBLE)""",
    False,
)
def a10b(spark, d):
    seconds = import_runs(spark, d).withColumn("s", fn.micros_between(F.col("started_at"), F.col("finished_at")) / 1e6)
    return rollups.bucket_quantile(rollups.histogram(seconds, "s", _BOUNDS, "source"), 0.9, "source").withColumn("quantile", F.round("quantile", 6))


# --- quarantine --------------------------------------------------------------


def log_of(spark, d) -> DataFrame:
    i = F.col("event_id")
    data = F.when(i % 13 == 0, None).when(i % 8 == 0, '{"broken": ').otherwise(F.to_json(F.struct("mmsi", "kind")))
    return feed(spark, d).select(F.col("seq").alias("message_id"), "received_at", data.alias("data"))


@query("Q1_split_malformed", f"SELECT seq AS message_id, 'invalid-json' AS reason, 1 AS attempts, {TEXT.format('received_at')} AS first_failed_at FROM feed WHERE event_id % 13 <> 0 AND event_id % 8 = 0")
def q1(spark, d):
    return quarantine.split_malformed(log_of(spark, d), "events", "writer")[1].select("message_id", "reason", "attempts", t("first_failed_at"))


def failures_of(spark, d) -> DataFrame:
    i = F.col("event_id")
    return feed(spark, d).select(F.lit("events").alias("stream"), F.lit("writer").alias("consumer_group"), F.col("user_id").alias("message_id"), F.col("received_at").alias("failed_at"), F.concat(F.lit("E"), (i % 4).cast("string")).alias("error"), "seq")


_FAILURES_SQL = ", per AS (SELECT user_id AS message_id, count(*) AS attempts, min(received_at) AS first_failed_at, max(received_at) AS last_failed_at, arg_max('E' || event_id % 4, (received_at, seq)) AS error, CASE WHEN count(*) >= 60 THEN 'quarantine' ELSE 'retry' END AS outcome FROM feed GROUP BY user_id)\n"


@query("Q2_account_failures", _FAILURES_SQL + f"SELECT message_id, attempts, outcome, error, {sql_t('last_failed_at')} FROM per")
def q2(spark, d):
    return quarantine.account_failures(failures_of(spark, d), 60).select("message_id", "attempts", "outcome", "error", t("last_failed_at"))


@query("Q3_list_quarantine", _FAILURES_SQL + "SELECT message_id FROM per WHERE outcome = 'quarantine' ORDER BY last_failed_at DESC, message_id DESC LIMIT 50")
def q3(spark, d):
    return quarantine.list_quarantine(quarantine.account_failures(failures_of(spark, d), 60).where("outcome = 'quarantine'")).select("message_id")


@query("Q4_replay", "SELECT seq AS message_id, mmsi AS data FROM feed WHERE event_id % 5 <> 0")
def q4(spark, d):
    i = F.col("event_id")
    rows = feed(spark, d).select(F.col("seq").alias("message_id"), F.when(i % 5 != 0, "events").alias("original_stream"), F.col("mmsi").alias("original_event"), F.col("received_at").alias("last_failed_at"))
    path = readers.shared_path(spark, "replay")
    quarantine.replay(rows, path)
    return readers.read_event_log(spark, path).select("message_id", "data")
