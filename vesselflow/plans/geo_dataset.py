"""G8: a manifest's sources loaded, checked and filtered into the three polygon layers of a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geo
from ..sources.readers import read_geojson, read_override_dir, written

def checksum(spark: SparkSession, path: str) -> str:
    """sha256 of a file's bytes, or of its parts' digests in order of their paths."""
    parts = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()
    return parts[0].h if len(parts) == 1 else spark.range(1).select(F.sha2(F.lit("".join(p.h for p in parts)), 256)).first()[0]


def load_geo_dataset(spark: SparkSession, manifest: dict, stamp: str, override_dir: str | None = None, zones=None) -> tuple[str, DataFrame]:
    """(version_id, polygons) of all the manifest's sources, clipped to the coverage if zones are given.

    Lines of a line_buffer source become the polygons around them, of half their
    width or else the source's default radius; other sources give their polygons.
    A source's layer name is its sourceLayer or else its type. One whose layout is
    "lines" has a feature to a line and is read by many tasks. Sources are read
    by path: one that has only a url is to be fetched first. A source whose
    checksum differs is an error, and so is a version without land or water:
    whatever was active stays.
    """
    sources = geo.check_manifest(manifest)
    version = geo.version_id(manifest, stamp)
    out = None
    for s in sources:
        if not s.get("path"):
            raise ValueError(f"source {s['name']!r} has only a url: fetch it and give its path")
        if s.get("checksumSha256") and checksum(spark, s["path"]) != s["checksumSha256"]:
            raise ValueError(f"source {s['name']!r} has another checksum")
        rows = read_geojson(spark, s["path"], geo.TARGETS[s["targetTable"]], s["name"], s.get("layout") == "lines").withColumn("fclass", F.col("properties")["fclass"])
        rows = geo.fclass_filter(rows, s.get("includeFclasses"))
        if s.get("geometryOperation") == "line_buffer":
            wide = geo.buffer_lines(rows.where("line is not null").drop("rings").withColumn("width", F.col("properties")["width"]), float(s.get("defaultLineBufferMeters") or geo.DEFAULT_BUFFER_M))
            rows = geo.line_buffers(wide)
        rows = rows.where("rings is not null").select("layer", "source", F.lit(s.get("sourceLayer") or s["type"]).alias("source_layer"), F.lit(s["region"]).alias("region"), "rings")
        out = rows if out is None else out.unionByName(rows)
    if override_dir:
        out = out.unionByName(read_override_dir(spark, override_dir).select("layer", "source", F.lit("manual").alias("source_layer"), F.lit("manual").alias("region"), "rings"))
    polygons = out.withColumn("version_id", F.lit(version))
    if zones:
        polygons = geo.clip_polygons(polygons, geo.coverage_area(zones))
    polygons = written(polygons, "polygons")  # read for the counts and by every later use
    if not geo.sufficient(geo.layer_counts(polygons, version)):
        raise ValueError("the dataset has no land or no water")
    return version, polygons
