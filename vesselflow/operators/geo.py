"""Land and water verdicts (G1-G13): polygons are cut into grid tiles, and points meet the tiles of their cell.

A tile holds the polygon's rings cut to its cell, nothing at all where the polygon
covers the cell, and the edges that may be within the tolerance of its points. All
tiles of a cell make one row of the index, so a point meets one row at most: the
verdict is one join and a chain of tests, in batch and in streams alike.
"""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import chain
from ..sources.readers import written
from . import polygons as cut

CELL = 0.5
TOLERANCE_M = 500.0
METERS_A_DEGREE = 111_320.0
LAYERS = ("manual_allow", "navigable_water", "land")
# WGS84 ellipsoid.
SEMI_MAJOR_M, ECCENTRICITY_2 = 6378137.0, 0.00669437999014

RINGS = "array<array<struct<lon:double,lat:double>>>"


def _edges(rings: str) -> str:
    return f"flatten(transform({rings}, r -> transform(sequence(1, size(r) - 1), i -> named_struct('a', r[i - 1], 'b', r[i]))))"


def _on_edge(edges: str, x: str, y: str) -> str:
    return f"exists({edges}, e -> (e.b.lon - e.a.lon) * ({y} - e.a.lat) = (e.b.lat - e.a.lat) * ({x} - e.a.lon) and {x} between least(e.a.lon, e.b.lon) and greatest(e.a.lon, e.b.lon) and {y} between least(e.a.lat, e.b.lat) and greatest(e.a.lat, e.b.lat))"


def _crossed(edges: str, x: str, y: str) -> str:
    return f"size(filter({edges}, e -> (e.a.lat > {y}) != (e.b.lat > {y}) and {x} < (e.b.lon - e.a.lon) * ({y} - e.a.lat) / (e.b.lat - e.a.lat) + e.a.lon)) % 2 = 1"


def covers(rings: str = "rings", lon: str = "lon", lat: str = "lat") -> Column:
    """The point lies in the polygon, holes left out, or on its boundary. Names are columns."""
    return F.expr(f"({_on_edge(_edges(rings), lon, lat)}) or ({_crossed(_edges(rings), lon, lat)})")


def meters_a_degree(lat: str) -> tuple[str, str]:
    """Metres of a degree of longitude and of latitude at a latitude, on WGS84."""
    s = f"(1 - {ECCENTRICITY_2} * pow(sin(radians({lat})), 2))"
    east = f"({SEMI_MAJOR_M} / sqrt({s}) * cos(radians({lat})) * {math.pi / 180!r})"
    north = f"({SEMI_MAJOR_M} * (1 - {ECCENTRICITY_2}) / pow({s}, 1.5) * {math.pi / 180!r})"
    return east, north


def _distance(edges: str, x: str, y: str) -> str:
    east, north = meters_a_degree(y)
    local = f"transform({edges}, e -> named_struct('ax', (e.a.lon - {x}) * {east}, 'ay', (e.a.lat - {y}) * {north}, 'dx', (e.b.lon - e.a.lon) * {east}, 'dy', (e.b.lat - e.a.lat) * {north}))"
    along = "if(s.dx = 0 and s.dy = 0, 0D, greatest(0D, least(1D, -(s.ax * s.dx + s.ay * s.dy) / (s.dx * s.dx + s.dy * s.dy))))"
    return f"array_min(transform(transform({local}, s -> named_struct('s', s, 't', {along})), p -> sqrt(pow(p.s.ax + p.t * p.s.dx, 2) + pow(p.s.ay + p.t * p.s.dy, 2))))"


def boundary_distance(rings: str = "rings", lon: str = "lon", lat: str = "lat") -> Column:
    """Metres from the point to the nearest edge, on the plane that touches at the point."""
    return F.expr(_distance(_edges(rings), lon, lat))


def boxed(polygons: DataFrame) -> DataFrame:
    """Adds the polygon's box: west, south, east, north."""
    flat = F.flatten("rings")
    of = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    return polygons.withColumns({"west": of(F.array_min, "lon"), "east": of(F.array_max, "lon"), "south": of(F.array_min, "lat"), "north": of(F.array_max, "lat")})


def ring_box() -> Column:
    """The box of the column `rings` as a struct west, south, east, north."""
    of = lambda f, c: f(F.transform(F.flatten("rings"), lambda p: p[c]))
    return F.struct(of(F.array_min, "lon").alias("west"), of(F.array_min, "lat").alias("south"), of(F.array_max, "lon").alias("east"), of(F.array_max, "lat").alias("north"))


def within_distance(meters: float, wide: bool = False) -> Column:
    """Boundary within `meters`, after the degree-box test; `wide` widens it by latitude as longitude degrees shrink."""
    d = meters / METERS_A_DEGREE
    dx = F.lit(d) / F.greatest(F.cos(F.radians("lat")), F.lit(0.01)) if wide else F.lit(d)
    near = F.col("lon").between(F.col("west") - dx, F.col("east") + dx) & F.col("lat").between(F.col("south") - d, F.col("north") + d)
    return F.when(near, boundary_distance() <= meters).otherwise(False)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt over all shuffle partitions: few bytes of polygons are much work, and would be one task by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cell(x: Column) -> Column:
    return F.floor(x / CELL).cast("int")


def matching(points: DataFrame, polygons: DataFrame, near: Column, margin: float = 0.0) -> DataFrame:
    """(seq, polygon_id) of all points (seq, lon, lat) and polygons (polygon_id, rings) for which `near` holds.

    `near` reads lon, lat, rings and the box west, south, east, north, and can hold
    only within `margin` degrees of the box. It is tested once for each pair of a
    place and a shape: points of one place and polygons of equal rings share the result,
    and only then every point is given the ids found at its place.
    """
    own = written(points.where("lon is not null and lat is not null").select("seq", "lon", "lat"), "points")
    shapes = boxed(polygons.groupBy(F.col("rings").cast(RINGS).alias("rings")).agg(F.collect_list("polygon_id").alias("ids")))
    cells = lambda low, high: F.explode(F.sequence(_cell(F.col(low) - margin), _cell(F.col(high) + margin)))
    listed = shapes.withColumn("_cx", cells("west", "east")).withColumn("_cy", cells("south", "north"))
    places = own.select("lon", "lat").distinct().withColumn("_cx", _cell(F.col("lon"))).withColumn("_cy", _cell(F.col("lat")))
    boxes = F.col("lon").between(F.col("west") - margin, F.col("east") + margin) & F.col("lat").between(F.col("south") - margin, F.col("north") + margin)
    found = places.join(listed.hint("merge"), ["_cx", "_cy"]).where(boxes).where(near)
    ids = written(found.groupBy("lon", "lat").agg(F.flatten(F.collect_list("ids")).alias("ids")), "places")
    return own.join(ids.hint("merge"), ["lon", "lat"]).select("seq", F.explode("ids").alias("polygon_id"))


_TILE = "cx int, cy int, layer string, whole boolean, rings " + RINGS + ", edges array<struct<a:struct<lon:double,lat:double>,b:struct<lon:double,lat:double>>>, west double, south double, east double, north double"


def _tile_batch(layers: list[str], boxes: list[tuple], own: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([t[0] for t in own], pa.int32()), pa.array([t[1] for t in own], pa.int32()), pa.array(layers, pa.string()), pa.array([t[2] == [] for t in own]),
            cut.write_rings([t[2] or [] for t in own]), cut.write_edges([t[3] for t in own]), *[pa.array(v, pa.float64()) for v in zip(*boxes)],
        ],
        ["cx", "cy", "layer", "whole", "rings", "edges", "west", "south", "east", "north"],
    )


def _tiles(tolerance_m: float, size: float):
    def run(batches):
        for batch in batches:
            of, boxes, own = [], [], []
            for layer, rings in zip(batch.column("layer").to_pylist(), cut.read_rings(batch.column("rings"))):
                if not any(map(len, rings)):
                    continue
                box = west, south, east, north = tuple(map(float, cut.box_of([r for r in rings if len(r)])))
                dy = 1.01 * tolerance_m / METERS_A_DEGREE
                dx = dy / max(math.cos(math.radians(min(90.0, max(abs(south), abs(north)) + dy))), 0.01)
                for tile in cut.tiles(rings, size, dx, dy):
                    of.append(layer)
                    boxes.append(box)
                    own.append(tile)
                    if len(own) == 10_000:
                        yield _tile_batch(of, boxes, own)
                        of, boxes, own = [], [], []
            if own:
                yield _tile_batch(of, boxes, own)

    return run


def geo_index(polygons: DataFrame, version: str, tolerance_m: float = TOLERANCE_M, size: float = CELL) -> DataFrame:
    """The tiles of a dataset version by grid cell: cx, cy and tiles. Polygons without a usable ring have none.

    Equal polygons of a layer count once, and a cell keeps no tile that a layer
    decided before it, or a polygon of the same layer that covers the cell, leaves without effect.
    """
    own = polygons.where(F.col("version_id") == version).select("layer", F.col("rings").cast(RINGS).alias("rings")).where("rings is not null").distinct()
    each = dealt(own).mapInArrow(_tiles(tolerance_m, size), _TILE)
    cells = each.groupBy("cx", "cy").agg(F.collect_list(F.struct("layer", "whole", "rings", "edges", "west", "south", "east", "north")).alias("tiles"), *[F.bool_or(F.col("whole") & (F.col("layer") == x)).alias(f"_{x}") for x in LAYERS])
    counts = "case t.layer when 'manual_allow' then t.whole or not _manual_allow when 'navigable_water' then not _manual_allow and (t.whole or not _navigable_water) when 'land' then not _manual_allow and not _navigable_water and (t.whole or not _land or size(t.edges) > 0) else false end"
    return cells.select("cx", "cy", F.expr(f"filter(tiles, t -> {counts})").alias("tiles"))


def geo_verdict(points: DataFrame, polygons: DataFrame | None, version: str | None, tolerance_m: float = TOLERANCE_M, wide: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Adds verdict, reason and version_id to points (lon, lat, ...), which may be a stream.

    In order: bad coordinates, no active dataset, manual areas, water, the
    shore's tolerance on both sides, land; anything else is allowed. `index` is
    the version's geo_index, of the same tolerance, if there is one already.
    """
    bad = F.col("lon").isNull() | F.col("lat").isNull() | ~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90)
    if version is None:
        return points.withColumn("verdict", F.when(bad, "reject").otherwise("allow")).withColumn("reason", F.when(bad, "invalid_coordinates").otherwise("dataset_unavailable")).withColumn("version_id", F.lit(None).cast("string"))
    listed = geo_index(polygons, version, tolerance_m) if index is None else index
    cell = listed.select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("tiles").alias("_tiles")).hint("merge")
    found = points.join(cell, (_cell(F.col("lon")) == F.col("_cx")) & (_cell(F.col("lat")) == F.col("_cy")), "left")
    inside = f"(t.whole or lon between t.west and t.east and lat between t.south and t.north and ({_on_edge('t.edges', 'lon', 'lat')} or {_crossed(_edges('t.rings'), 'lon', 'lat')}))"
    d = tolerance_m / METERS_A_DEGREE
    dx = f"{d!r} / greatest(cos(radians(lat)), 0.01)" if wide else repr(d)
    near = f"size(t.edges) > 0 and lon between t.west - {dx} and t.east + {dx} and lat between t.south - {d!r} and t.north + {d!r} and {_distance('t.edges', 'lon', 'lat')} <= {tolerance_m!r}"
    has = lambda layer, test: F.coalesce(F.expr(f"exists(_tiles, t -> t.layer = '{layer}' and {test})"), F.lit(False))
    reason = chain(
        [(bad, F.lit("invalid_coordinates")), (has("manual_allow", inside), F.lit("manual_allow")), (has("navigable_water", inside), F.lit("navigable_water")), (has("land", near), F.lit("coastal_tolerance")), (has("land", inside), F.lit("deep_land"))],
        F.lit("not_land"),
    )
    verdict = F.when(F.col("reason").isin("invalid_coordinates", "deep_land"), "reject").when(F.col("reason") == "coastal_tolerance", "uncertain").otherwise("allow")
    return found.withColumn("reason", reason).withColumn("verdict", verdict).withColumn("version_id", F.when(~bad, F.lit(version))).drop("_cx", "_cy", "_tiles")


def geo_result(verdicts: DataFrame, fail_open: bool = True, enabled: bool = True, available: bool = True) -> DataFrame:
    """Adds should_drop: deep land goes, and without polygons everything if not `fail_open`; bad coordinates stay."""
    if not enabled:
        return verdicts.withColumn("verdict", F.lit("allow")).withColumn("reason", F.lit("disabled")).withColumn("should_drop", F.lit(False))
    if not available:
        return verdicts.withColumn("verdict", F.lit("allow" if fail_open else "reject")).withColumn("reason", F.lit("geo_validation_error")).withColumn("should_drop", F.lit(not fail_open))
    return verdicts.withColumn("should_drop", F.col("reason") == "deep_land")


#: Corners of a clipped piece at the most.
CORNERS = 256


def clip_polygons(features: DataFrame, boxes: list[dict], corners: int = CORNERS) -> DataFrame:
    """The features' parts inside the union of the coverage boxes, valid and of at most `corners` corners each.

    A row is one part: an anticlockwise outer ring and the clockwise rings of its
    holes, with the feature's other columns and piece, its number in the feature.
    Boxes that overlap count once. Rings that cross themselves or each other are
    mended: a place is inside if it is inside an odd number of rings. Rings
    without area or with coordinates that are no numbers go, and so do features
    of which nothing is left. Features are dealt over all tasks, each is cut in one.
    """
    area = cut.disjoint([{k: float(b[k]) for k in ("west", "south", "east", "north")} for b in boxes])
    keep = [c for c in features.columns if c not in ("rings", "piece")]
    own = features.where("rings is not null").select(*keep, F.col("rings").cast(RINGS).alias("rings"))
    schema = T.StructType([*own.schema.fields, T.StructField("piece", T.IntegerType())])

    def run(batches):
        for batch in batches:
            at, number, out = [], [], []
            polygons = cut.read_rings(batch.column("rings"))
            done = cut.settled(polygons, area, corners)
            for i, rings in enumerate(polygons):
                for k, piece in enumerate(done[i] if i in done else cut.pieces(rings, area, corners)):
                    at.append(i)
                    number.append(k)
                    out.append(piece)
            rows = batch.select(keep).take(pa.array(at, pa.int64()))
            yield pa.record_batch([*rows.columns, cut.write_rings(out), pa.array(number, pa.int32())], [*keep, "rings", "piece"])

    return dealt(own).mapInArrow(run, schema)


def buffer_lines(features: DataFrame, default_m: float = 75.0) -> DataFrame:
    """Adds radius_m: half a plain positive width, else the default. The line stays."""
    width = F.when(F.col("width").rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim("width").try_cast("double"))
    return features.withColumn("radius_m", F.when(width > 0, width / 2).otherwise(F.lit(default_m)))


#: Chords of a half circle at a buffered segment's end.
CHORDS = 16


def line_buffers(lines: DataFrame) -> DataFrame:
    """Adds rings to (line, radius_m, ...): a row for each segment, the polygon of points within radius_m of it.

    A segment's polygon has half circles of CHORDS chords around its ends, on the
    plane that touches at its middle; together a line's polygons cover its buffer.
    A line of one point gives its circle; rows without a line go.
    """
    segments = F.expr("if(size(line) = 1, array(named_struct('a', line[0], 'b', line[0])), transform(sequence(1, size(line) - 1), i -> named_struct('a', line[i - 1], 'b', line[i])))")
    own = lines.where("size(line) > 0").withColumn("_seg", F.explode(segments))
    east, north = meters_a_degree("((_seg.a.lat + _seg.b.lat) / 2)")
    own = own.withColumn("_east", F.expr(east)).withColumn("_north", F.expr(north))
    own = own.withColumn("_turn", F.expr("atan2((_seg.b.lat - _seg.a.lat) * _north, (_seg.b.lon - _seg.a.lon) * _east)"))
    half = f"transform(sequence(0, {CHORDS}), i -> named_struct('lon', $p.lon + radius_m * cos(_turn + $f + i * pi() / {CHORDS}) / _east, 'lat', $p.lat + radius_m * sin(_turn + $f + i * pi() / {CHORDS}) / _north))"
    back, front = half.replace("$p", "_seg.a").replace("$f", "pi() / 2"), half.replace("$p", "_seg.b").replace("$f", "-pi() / 2")
    return own.withColumn("_ring", F.expr(f"concat({back}, {front})")).withColumn("rings", F.expr("array(concat(_ring, array(_ring[0])))")).drop("_seg", "_east", "_north", "_turn", "_ring")


def near_line(radius: Column) -> Column:
    """The point is within `radius` of the line in the column `line`."""
    return boundary_distance("array(line)") <= radius


def fclass_filter(features: DataFrame, classes: list[str] | None) -> DataFrame:
    return features.where(F.col("fclass").isin(*classes)) if classes else features


def coverage_area(zones, margin_km: float = 50.0) -> list[dict]:
    """The zones widened by a margin; corners are square, where a round buffer would cut them."""
    out = []
    for _, b in zones:
        dy = margin_km * 1000 / METERS_A_DEGREE
        dx = dy / math.cos(math.radians(max(abs(b["south"]), abs(b["north"]))))
        out.append({"west": b["west"] - dx, "south": b["south"] - dy, "east": b["east"] + dx, "north": b["north"] + dy})
    return out


# The manifest's tables, with their layers here, and its operations.
TARGETS = {"geo_land_polygons": "land", "geo_navigable_water_polygons": "navigable_water", "geo_manual_overrides": "manual_allow"}
OPERATIONS = ("polygon", "line_buffer")
DEFAULT_BUFFER_M = 75.0


def check_manifest(manifest: dict) -> list[dict]:
    """The sources of a manifest, each with a known target; operation, layer name and buffer may be left out."""
    if not manifest.get("metadataVersion"):
        raise ValueError("the manifest has no metadataVersion")
    sources = manifest.get("sources")
    if not isinstance(sources, list) or not sources:
        raise ValueError("the manifest has no sources")
    for s in sources:
        missing = [k for k in ("name", "type", "region", "targetTable") if not s.get(k)]
        if missing:
            raise ValueError(f"source {s.get('name')!r} lacks {', '.join(missing)}")
        if s["targetTable"] not in TARGETS:
            raise ValueError(f"source {s['name']!r} has an unknown target table")
        if s.get("geometryOperation") and s["geometryOperation"] not in OPERATIONS:
            raise ValueError(f"source {s['name']!r} has an unknown operation")
        if not (s.get("path") or s.get("url")):
            raise ValueError(f"source {s['name']!r} has neither path nor url")
        width = s.get("defaultLineBufferMeters")
        if width is not None and not (isinstance(width, (int, float)) and math.isfinite(width) and width > 0):
            raise ValueError(f"source {s['name']!r} has a defaultLineBufferMeters that is not positive")
    return sources


def version_id(manifest: dict, stamp: str) -> str:
    """<metadataVersion>-<yyyymmddhhmmss>-<12 hex of the manifest and the time>, so that reruns agree."""
    return f"{manifest['metadataVersion']}-{stamp}-{hashlib.sha256((json.dumps(manifest, sort_keys=True) + stamp).encode()).hexdigest()[:12]}"


def layer_counts(polygons: DataFrame, version: str) -> DataFrame:
    """Polygons of each layer, zeros included."""
    layers = polygons.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    counts = polygons.where(F.col("version_id") == version).groupBy("layer").agg(F.count("*").alias("polygons"))
    return layers.join(counts, "layer", "left").select("layer", F.coalesce("polygons", F.lit(0)).alias("polygons"))


def sufficient(counts: DataFrame) -> bool:
    """Land and water both have polygons."""
    return counts.where("layer in ('land', 'navigable_water') and polygons = 0").count() == 0


def activate_version(versions: DataFrame, version: str, now: Column) -> DataFrame:
    """Exactly one active version."""
    chosen = F.col("version_id") == version
    return versions.withColumn("activated_at", F.when(chosen, now).otherwise(F.col("activated_at"))).withColumn("is_active", chosen)


def active_version(versions: DataFrame) -> DataFrame:
    return versions.where("is_active").orderBy(F.desc_nulls_last("activated_at"), F.desc("created_at"), "version_id").limit(1)


def probe_report(probes: DataFrame, polygons: DataFrame, version: str) -> DataFrame:
    """Named probes (name, seq, lon, lat, expected_verdict, expected_reason) with actual results and passed."""
    got = geo_verdict(probes, polygons, version)
    return got.withColumn("passed", F.col("verdict").eqNullSafe(F.col("expected_verdict")) & F.col("reason").eqNullSafe(F.col("expected_reason")))
