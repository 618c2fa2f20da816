"""Readers and writers: raw feed, sanctions XML, GeoJSON, event log, history, keyed tables."""

from __future__ import annotations


import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_DIMENSION = _struct(A=_I, B=_I, C=_I, D=_I)
_POSITION = _struct(UserID=_S, Latitude=_D, Longitude=_D, Sog=_D, Cog=_D, TrueHeading=_I, NavigationalStatus=_I, RateOfTurn=_D, Valid=_B, Name=_S)
#: One struct for all accepted message types; every field may be missing.
RAW_SCHEMA = _struct(
    MessageType=_S,
    MetaData=_struct(MMSI=_S, ShipName=_S, latitude=_D, longitude=_D, time_utc=_S),
    Message=_struct(
        PositionReport=_POSITION, StandardClassBPositionReport=_POSITION, ExtendedClassBPositionReport=_POSITION,
        StaticDataReport=_struct(UserID=_S, Valid=_B, ReportA=_struct(Name=_S, Valid=_B), ReportB=_struct(CallSign=_S, ShipType=_I, Dimension=_DIMENSION, Valid=_B)),
        ShipStaticData=_struct(UserID=_S, ImoNumber=_S, CallSign=_S, Name=_S, Type=_I, Destination=_S, Dimension=_DIMENSION, Valid=_B),
    ),
)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="vesselflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to a new shared path and read back: derived once, with a true size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_raw(lines: DataFrame, provider: str) -> DataFrame:
    """provider, received_at, raw and the parsed frame `msg` of (value[, received_at]); null where the line is no JSON object.

    The frame comes out of explode, which the optimiser does not inline, so that
    a line is parsed once however many of its fields are read.
    """
    received = F.col("received_at") if "received_at" in lines.columns else F.localtimestamp()
    parsed = F.from_json("value", RAW_SCHEMA, {"mode": "PERMISSIVE"})
    is_object = F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull()
    rest = [c for c in lines.columns if c not in ("value", "received_at", "provider")]
    return lines.select(*rest, F.lit(provider).alias("provider"), received.alias("received_at"), F.col("value").alias("raw"), F.explode(F.array(F.when(is_object, parsed))).alias("msg"))


def read_raw_feed(spark: SparkSession, path: str, provider: str, stream: bool = False) -> DataFrame:
    """Newline-JSON frames from files, once or as a stream."""
    return parse_raw((spark.readStream if stream else spark.read).text(path), provider)


SDN_SCHEMA = _struct(
    uid=_S, lastName=_S, sdnType=_S,
    programList=_struct(program=T.ArrayType(_S)),
    idList=_struct(id=T.ArrayType(_struct(idType=_S, idNumber=_S))),
    akaList=_struct(aka=T.ArrayType(_struct(category=_S, lastName=_S))),
    vesselInfo=_struct(vesselFlag=_S),
)


def read_sdn_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per sdnEntry; one child or many both give arrays; leaves stay text."""
    return spark.read.format("xml").option("rowTag", "sdnEntry").option("ignoreNamespace", "true").schema(SDN_SCHEMA).load(path)


_RING = T.ArrayType(T.ArrayType(_D))


def read_geojson(spark: SparkSession, path, layer: str, source: str = "geojson", by_line: bool = False) -> DataFrame:
    """Features with a geometry: layer, source, geometry_type, rings (arrays of lon/lat), line, properties.

    Multipart polygons and lines give a row for each part. Coordinates are read as text
    first, since their depth depends on the geometry's type. With `by_line`, files have a
    feature to a line, as common exports do, with or without the collection around them:
    a file of any size is then read by many tasks. Without it, a file is one collection
    and one task reads it.
    """
    feature = _struct(type=_S, geometry=_struct(type=_S, coordinates=_S), properties=T.MapType(_S, _S))
    if by_line:
        bare = F.regexp_replace(F.trim("value"), r"^\x1e|[,\s]+$", "")
        rows = spark.read.text(path).where(F.trim("value").rlike(r'^\x1e?\{')).select(F.from_json(bare, feature).alias("f")).where("f.type = 'Feature'")
    else:
        rows = spark.read.schema(_struct(features=T.ArrayType(feature))).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    rows = rows.where("f.geometry.type is not null")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(text, T.ArrayType(_RING)))
    many = F.from_json(text, T.ArrayType(T.ArrayType(_RING)))
    parts = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    lines = F.when(kind == "LineString", F.array(F.from_json(text, _RING))).when(kind == "MultiLineString", F.from_json(text, T.ArrayType(_RING)))
    shape = F.coalesce(F.transform(parts, lambda p: F.struct(p.alias("part"), F.lit(None).cast(_RING).alias("line"))), F.transform(lines, lambda x: F.struct(F.lit(None).cast(T.ArrayType(_RING)).alias("part"), x.alias("line"))))
    out = rows.select(kind.alias("geometry_type"), F.col("f.properties").alias("properties"), F.explode_outer(shape).alias("s")).select("geometry_type", "properties", "s.part", "s.line")
    point = lambda p: F.struct(F.element_at(p, 1).alias("lon"), F.element_at(p, 2).alias("lat"))
    rings = F.transform("part", lambda ring: F.transform(ring, point))
    return out.select(F.lit(layer).alias("layer"), F.lit(source).alias("source"), "geometry_type", rings.alias("rings"), F.transform("line", point).alias("line"), "properties")


def read_override_dir(spark: SparkSession, folder: str) -> DataFrame:
    """All *.geojson and *.json of a folder as manual_allow; a missing folder is an empty table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in fs.listStatus(path)) if fs.exists(path) else []
    names = [n for n in names if n.endswith((".geojson", ".json"))]
    if not names:
        return spark.createDataFrame([], "layer string, source string, geometry_type string, rings array<array<struct<lon:double,lat:double>>>, line array<struct<lon:double,lat:double>>, properties map<string,string>")
    return read_geojson(spark, names, "manual_allow", "override")


def append_event_log(events: DataFrame, path: str) -> None:
    """Append events to the durable log, partitioned by day of reception."""
    events.withColumn("received_date", F.to_date("received_at")).write.mode("append").partitionBy("received_date").parquet(path)


def read_event_log(spark: SparkSession, path: str, from_ts: str | None = None, stream_schema: T.StructType | None = None) -> DataFrame:
    """The log from a time on: only its days are read; with a schema, as a stream."""
    log = spark.readStream.schema(stream_schema).parquet(path) if stream_schema else spark.read.parquet(path)
    if from_ts is None:
        return log
    at = F.lit(from_ts).cast("timestamp_ntz")
    return log.where((F.col("received_date") >= F.to_date(at)) & (F.col("received_at") >= at))


def trim_log(log: DataFrame, newest: int) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(newest)


HISTORY_KEY = ["mmsi", "occurred_at"]
POSITION_COLUMNS = ["mmsi", "occurred_at", "lon", "lat", "sog", "cog", "true_heading", "nav_status", "rate_of_turn"]


def first_of_key(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The first arrival of each key, folded as a partial minimum, without a window."""
    rest = [c for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("x")).select(*keys, "x.*")


def write_history(positions: DataFrame, path: str) -> DataFrame:
    """Append positions to daily partitions, first write wins on (mmsi, occurred_at); reads only the touched days."""
    spark = positions.sparkSession
    new = first_of_key(positions, HISTORY_KEY, POSITION_COLUMNS).withColumn("occurred_date", F.to_date("occurred_at"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        held = new.persist()
        there = spark.read.parquet(path).join(held.select("occurred_date").distinct(), "occurred_date", "left_semi").select(HISTORY_KEY)
        held.join(there, HISTORY_KEY, "left_anti").write.mode("append").partitionBy("occurred_date").parquet(path)
        held.unpersist()
    else:
        new.write.mode("append").partitionBy("occurred_date").parquet(path)
    return spark.read.parquet(path)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], merge: dict[str, Column]) -> DataFrame:
    """A keyed upsert: `merge` gives each other column from the aliases c (current) and n (new); changes have one row a key."""
    joined = current.alias("c").join(changes.alias("n"), keys, "full_outer")
    return joined.select(*keys, *[e.alias(k) for k, e in merge.items()])


def swap(table: DataFrame, folder: str) -> DataFrame:
    """Write a new version of a table beside the old ones, then point to it: readers see one version or the next."""
    spark = table.sparkSession
    version = uuid.uuid4().hex
    table.write.parquet(f"{folder}/{version}")
    pointer = spark.createDataFrame([(version,)], "version string").coalesce(1)
    pointer.write.mode("overwrite").json(f"{folder}/_current")
    return current_version(spark, folder)


def current_version(spark: SparkSession, folder: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{folder}/_current").first().version
    return spark.read.parquet(f"{folder}/{version}")


BUCKETS = 64


def bucket_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """A table kept in key buckets, each as its newest version; none if nothing was written yet."""
    versions = _bucket_versions(spark, folder)
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/version={v}/bucket={b}" for b, v in sorted(versions.items())]).drop("version", "bucket") if versions else None


def _bucket_versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The version of each bucket, as the newest pointer has it: a name for each bucket, no rows of data."""
    names = _listed(spark, f"{folder}/_versions")
    return {r.bucket: r.at for r in spark.read.schema("bucket int, at string").json(f"{folder}/_versions/{names[-1]}").collect()} if names else {}


def upsert_buckets(changes: DataFrame, folder: str, keys: list[str], merge: dict[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """A keyed upsert into a table of key buckets: only buckets with changed keys are read and written anew.

    The table has the same number of buckets for its life. `merge` is as in
    `upsert`; changes have one row a key. The new pointer appears in one rename,
    so that readers see all of the upsert or nothing of it.
    """
    spark = changes.sparkSession
    new = written(changes.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "changes")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
    versions = _bucket_versions(spark, folder)
    paths = [f"{folder}/version={versions[b]}/bucket={b}" for b in touched if b in versions]
    current = spark.read.option("basePath", folder).parquet(*paths).drop("version", "bucket") if paths else new.drop("bucket").limit(0)
    both = upsert(current, new.drop("bucket"), keys, merge)
    version = f"{len(_listed(spark, f'{folder}/_versions')):08d}-{uuid.uuid4().hex}"
    both.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/version={version}")
    pointer = spark.createDataFrame([(b, version if b in set(touched) else versions[b]) for b in sorted({*touched, *versions})], "bucket int, at string")
    pointer.coalesce(1).write.json(f"{folder}/_versions/.{version}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_versions/.{version}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(path, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_versions/{version}"))
    return bucket_table(spark, folder)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path) if not f.getPath().getName().startswith(".")) if fs.exists(path) else []


def export_features(vessels: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """One GeoJSON Feature as text for each vessel with coordinates."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    own = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[e.alias(k) for k, e in properties.items()]).alias("properties"))
    return vessels.where("lon is not null and lat is not null").select("mmsi", F.to_json(own).alias("feature"))


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by a window; for small groups."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def to_text_file(lines: DataFrame, name: str) -> str:
    """Write one text column to a new shared path and return it."""
    path = shared_path(lines.sparkSession, name)
    lines.write.text(path)
    return path
