"""Edge cases of the telemetry operators on small authored rows, and batch against stream."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesselflow.functions import scalars as fn
from vesselflow.operators import fanout, geo, normalize, quality, quarantine, sanctions, state, validate, views
from vesselflow.plans.registry import Registry
from vesselflow.sources import readers

T0 = dt.datetime(2024, 1, 10, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frames(spark, *items):
    lines = spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x), T0) for i, x in enumerate(items)], "seq int, value string, received_at timestamp_ntz")
    return readers.parse_raw(lines, "feed")


def frame(kind="PositionReport", mmsi=212345678, **payload):
    return {"MessageType": kind, "MetaData": {"MMSI": mmsi, "ShipName": " NAME@@ ", "time_utc": "2024-01-10 11:59:59.987654321 +0000 UTC"}, "Message": {kind: payload}}


def test_raw_filter_order(spark):
    got = validate.raw_filter(frames(spark, "no json", "[1]", {"MessageType": 5}, frame("BaseStationReport"), {"MessageType": "PositionReport", "Message": 3}, {**frame(), "Message": {"Other": {}}}, frame(mmsi=1234567), {"MessageType": "PositionReport", "Message": {"PositionReport": {}}}, frame()))
    reasons = [r.drop_reason for r in got.orderBy("seq").collect()]
    assert reasons == ["invalid", "invalid", "non_vessel_mmsi", "non_vessel_mmsi", "invalid", "invalid", "non_vessel_mmsi", "non_vessel_mmsi", None]


def test_normalize_edges(spark):
    got = normalize.normalize(frames(
        spark, frame(Latitude=91.0, Longitude=1.0), frame(Latitude=1.0, Longitude=1.0, Valid=False), frame(Latitude=1.0, Longitude=2.0, NavigationalStatus=3), frame("StandardClassBPositionReport", Latitude=1.0, Longitude=2.0, NavigationalStatus=3),
        frame("ShipStaticData", ImoNumber=0, Type=0, Dimension={"A": 0, "B": 0, "C": 0, "D": 0}), frame("ShipStaticData", ImoNumber=9187629, Type=70, Destination="  @ "), frame("StaticDataReport", ReportA={"Valid": False}, ReportB={"Valid": False}),
        frame("StaticDataReport", Valid=False, ReportA={"Name": "A@", "Valid": True}, ReportB={"Valid": False, "ShipType": 70}),
    )).orderBy("seq").collect()
    assert [r.drop_reason for r in got] == ["invalid", "invalid", None, None, None, None, "invalid", None]
    assert (got[2].nav_status, got[3].nav_status, got[2].ship_name) == (3, None, "NAME")
    assert got[2].occurred_at == dt.datetime(2024, 1, 10, 11, 59, 59, 987000)
    assert (got[4].imo, got[4].ship_type, got[4].dimension_to_bow) == (None, None, None)
    assert (got[5].imo, got[5].ship_type, got[5].destination) == ("9187629", 70, None)
    assert (got[7].name, got[7].ship_type) == ("A", None)


def positions(spark, rows):
    return spark.createDataFrame([(i, "212345678", "position", at(o), at(r), sog, nav) for i, (o, r, sog, nav) in enumerate(rows)], "seq long, mmsi string, kind string, occurred_at timestamp_ntz, received_at timestamp_ntz, sog double, nav_status int")


def test_sampler_edges(spark):
    rows = [(0, 0, 5.0, 0), (9, 9, 5.0, 0), (10, 10, 5.0, 0), (69, 69, 0.1, 0), (70, 70, 0.1, 0), (71, 71, 0.1, 5), (72, 72, 0.1, None), (60, 73, 0.1, 0), (75, 673, 0.1, 0)]
    got = quality.adaptive_sample(positions(spark, rows)).orderBy("seq").collect()
    assert [r.emitted for r in got] == [True, False, True, False, True, True, False, True, True]


def test_dedup_edges(spark):
    rows = [(0, 0, 1.0, 0), (0, 599, 1.0, 0), (0, 600, 1.0, 0), (0, 1100, 1.0, 0), (1, 1100, 1.0, 0)]
    assert [r.accepted for r in quality.dedup(positions(spark, rows)).orderBy("seq").collect()] == [True, False, True, False, True]


def square(low, high):
    return [[(low, low), (high, low), (high, high), (low, high), (low, low)]]


POLYGONS = "polygon_id long, layer string, version_id string, rings array<array<struct<lon:double,lat:double>>>"


def test_verdict_within_a_rounding_of_a_cells_border(spark):
    box = lambda w, e: [[(w, 43.3), (e, 43.3), (e, 44.2), (w, 44.2), (w, 43.3)]]
    df = spark.createDataFrame([(1, 14.0, 43.6)], "seq long, lon double, lat double")
    reason = lambda rings: geo.geo_verdict(df, spark.createDataFrame([(1, "manual_allow", "v", rings)], POLYGONS), "v").first().reason
    assert [reason(box(13.1, 14.000000000000002)), reason(box(13.1, 13.999999999999998)), reason(box(14.000000000000002, 15.1))] == ["manual_allow", "not_land", "not_land"]


def test_index_keeps_no_tile_without_effect(spark):
    """Equal polygons count once; covered cells keep only what a verdict needs."""
    rows = [(i, "land", "v", square(0.1, 0.3)) for i in range(50)] + [(60, "manual_allow", "v", square(1.0, 2.0)), (61, "land", "v", square(1.1, 1.9)), (62, "navigable_water", "v", square(1.2, 1.8)), (63, "land", "v", square(3.0, 4.0)), (64, "land", "v", square(3.1, 3.2))]
    tiles = {(r.cx, r.cy): sorted((t.layer, t.whole) for t in r.tiles) for r in geo.geo_index(spark.createDataFrame(rows, POLYGONS), "v").collect()}
    assert tiles[0, 0] == [("land", False)] and tiles[2, 2] == tiles[3, 3] == [("manual_allow", True)]
    assert tiles[6, 6] == [("land", False), ("land", True)] and tiles[7, 7] == [("land", True)]
    df = spark.createDataFrame([(1, 0.2, 0.2), (2, 1.5, 1.5), (3, 3.15, 3.15), (4, 3.101, 3.15), (5, 3.7, 3.7)], "seq long, lon double, lat double")
    got = [r.reason for r in geo.geo_verdict(df, spark.createDataFrame(rows, POLYGONS), "v").orderBy("seq").collect()]
    assert got == ["deep_land", "manual_allow", "deep_land", "coastal_tolerance", "deep_land"]


def test_matching_tests_a_place_and_a_shape_once(spark):
    """Copies of places and shapes all get their pairs, also across cells, on borders and near a hole."""
    polygons = spark.createDataFrame([(i, "land", "v", square(0.1, 0.3)) for i in range(30)] + [(40, "land", "v", square(0.0, 3.0) + square(1.0, 2.0)), (41, "land", "v", None)], POLYGONS)
    places = [(0.2, 0.2), (0.2, 0.2), (0.3, 0.1), (1.5, 1.5), (1.0, 1.5), (3.0, 3.0), (3.05, 3.0), (None, 1.0), (float("nan"), 0.2)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "seq long, lon double, lat double")
    pairs = lambda *near: sorted((r.seq, r.polygon_id) for r in geo.matching(points, polygons, *near).collect())
    want = [(i, k) for i in range(3) for k in range(30)] + [(i, 40) for i in (0, 1, 2, 4, 5)]
    assert pairs(geo.covers()) == sorted(want)
    near = pairs(geo.within_distance(10_000), 10_000 / geo.METERS_A_DEGREE)
    assert [p for p in near if p[1] == 40] == [(4, 40), (5, 40), (6, 40)] and (2, 7) in near


def test_verdict_order_and_holes(spark):
    rings = "polygon_id long, layer string, version_id string, rings array<array<struct<lon:double,lat:double>>>"
    polygons = spark.createDataFrame([(1, "land", "v", square(0.0, 1.0)), (2, "navigable_water", "v", square(0.4, 0.6)), (3, "manual_allow", "v", square(0.45, 0.55)), (4, "land", "v", square(3.0, 4.0) + square(3.2, 3.8))], rings)
    points = [(0.5, 0.5), (0.42, 0.42), (0.998, 0.5), (1.002, 0.5), (0.75, 0.75), (2.0, 2.0), (3.5, 3.5), (3.1, 3.5), (200.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "seq long, lon double, lat double")
    got = [r.reason for r in geo.geo_verdict(df, polygons, "v").orderBy("seq").collect()]
    assert got == ["manual_allow", "navigable_water", "coastal_tolerance", "coastal_tolerance", "deep_land", "not_land", "not_land", "deep_land", "invalid_coordinates"]
    assert {r.reason for r in geo.geo_verdict(df, polygons, None).collect()} == {"dataset_unavailable", "invalid_coordinates"}
    assert {r.reason for r in geo.geo_verdict(df.limit(8), polygons, "other").collect()} == {"not_land"}
    pieces = geo.clip_polygons(polygons.where("polygon_id in (1, 4)"), [{"west": 0.5, "south": 0.5, "east": 3.5, "north": 3.5}]).orderBy("polygon_id").collect()
    assert [(p.polygon_id, len(p.rings), len(p.rings[0])) for p in pieces] == [(1, 1, 5), (4, 1, 7)]  # the cut goes through the hole
    assert geo.sufficient(geo.layer_counts(polygons, "v")) and not geo.sufficient(geo.layer_counts(polygons, "w"))


def test_lines_and_manifest(spark):
    line = spark.createDataFrame([(1, 0.0005, 0.0, [(0.0, -1.0), (0.0, 1.0)], "120"), (2, 0.0005, 0.0, [(0.0, -1.0), (0.0, 1.0)], "about 9")], "id long, lon double, lat double, line array<struct<lon:double,lat:double>>, width string")
    got = geo.buffer_lines(line).withColumn("near", geo.near_line(F.col("radius_m"))).orderBy("id").collect()
    assert [(r.radius_m, r.near) for r in got] == [(60.0, True), (75.0, True)] and geo.buffer_lines(line, 30.0).where(geo.near_line(F.col("radius_m"))).count() == 1
    good = {"name": "a", "type": "land", "region": "x", "targetTable": "geo_land_polygons", "path": "p"}
    for s in (good, {**good, "geometryOperation": "polygon"}, {**good, "geometryOperation": "line_buffer", "defaultLineBufferMeters": 150}, {**good, "path": None, "url": "u"}):
        assert geo.check_manifest({"metadataVersion": "m", "sources": [s]}) == [s]
    for bad in ({**good, "name": ""}, {**good, "targetTable": "x"}, {**good, "path": None}, {**good, "geometryOperation": "clip"}, {**good, "defaultLineBufferMeters": 0}, {**good, "region": None}):
        with pytest.raises(ValueError):
            geo.check_manifest({"metadataVersion": "m", "sources": [bad]})
    for bad in ({"sources": [good]}, {"metadataVersion": "m"}, {"metadataVersion": "m", "sources": []}):
        with pytest.raises(ValueError):
            geo.check_manifest(bad)


def test_names_and_statuses(spark):
    rows = spark.createDataFrame([("Ünïted  STAR-1",), ("ﬁn",), (None,), ("--",)], "n string")
    assert [r[0] for r in rows.select(fn.normalize_name(F.col("n"))).collect()] == ["united star 1", "fin", "", ""]
    vessels = spark.createDataFrame([("1", "9000001", "STAR"), ("2", None, "star"), ("3", None, "STAR"), ("4", None, "--")], "mmsi string, imo string, name string")
    entities = spark.createDataFrame([("e1", "ofac", "1", "STAR", "9000001", None, ["OLD"]), ("e2", "ofac", "2", "OLD", None, "1", ["--"])], "entity_id string, source string, source_entity_id string, name string, imo string, mmsi string, aliases array<string>")
    got = {(r.mmsi, r.entity_id, r.method, r.position) for r in sanctions.match_sanctions(vessels, entities).collect()}
    assert got == {("1", "e1", "imo", 1), ("1", "e2", "mmsi", 2), ("3", "e1", "name", 1)}
    loose = sanctions.match_sanctions(vessels, entities, "normalized")
    assert {r.mmsi: r.status for r in sanctions.status_of(vessels, loose).collect()} == {"1": "sanctioned", "2": "candidate", "3": "candidate", "4": "clear"}


def test_import_run_logs_failures(spark):
    runs = spark.createDataFrame([], "run_id long, source string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, records_imported int, errors array<string>")
    when = F.lit(T0).cast("timestamp_ntz")

    def broken():
        raise OSError("no file")

    failed = sanctions.import_run(runs, "ofac", 1, when, broken, lambda df: df.count(), when)
    assert [(r.status, r.errors) for r in failed.collect()] == [("failed", ["no file"])]
    busy = runs.union(spark.createDataFrame([(0, "ofac", T0, None, "running", 0, [])], runs.schema))
    assert sanctions.import_run(busy, "ofac", 1, when, broken, lambda df: 0, when).where("run_id = 1").first().status == "skipped"


def test_simplify_keeps_ends_and_corners():
    x, y = np.array([0.0, 1, 2, 3, 3]), np.array([0.0, 0.01, 0, 0, 3])
    assert views.simplify_line(x, y, 0.1).tolist() == [True, False, False, True, True]
    assert views.simplify_line(x[:2], y[:2], 9).tolist() == [True, True]


def test_parameters():
    assert validate.snapshot_params() == (10_000, 1440)
    for bad in (lambda: validate.snapshot_params(0), lambda: validate.snapshot_params(1, 10_081), lambda: validate.track_params(at(1), at(1)), lambda: validate.track_params(at(0), at(8 * 86_400)), lambda: validate.track_params(at(0), at(1), 0), lambda: quarantine.list_quarantine(None, 501)):
        with pytest.raises(ValueError):
            bad()


def test_registry():
    r = Registry("provider")
    first = lambda df: df
    assert r.register("a", first) and not r.register("a", lambda df: None) and r.get("a") is first and r.names() == ["a"]
    with pytest.raises(KeyError):
        r.get("b")


def test_lines_of_a_file_become_polygons(spark, tmp_path):
    from vesselflow.plans.geo_dataset import load_geo_dataset

    feature = lambda kind, xy, **p: {"type": "Feature", "geometry": {"type": kind, "coordinates": xy}, "properties": p}
    collection = lambda *f: json.dumps({"type": "FeatureCollection", "features": f})
    (tmp_path / "land.geojson").write_text(collection(feature("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]])))
    (tmp_path / "water.geojson").write_text(collection(feature("LineString", [[0.2, 0.2], [0.2, 0.8]], width=" 2000 "), feature("MultiLineString", [[[0.4, 0.4], [0.6, 0.4], [0.6, 0.6]], [[0.9, 0.9], [0.9, 0.8]]], width="wide")))
    assert readers.read_geojson(spark, str(tmp_path / "water.geojson"), "x").where("size(line) > 1").count() == 3
    source = lambda name, table, **x: {"name": name, "type": name, "region": "r", "targetTable": table, "path": str(tmp_path / f"{name}.geojson"), "license": "l", "attribution": "a", **x}
    manifest = {"metadataVersion": "m", "description": "d", "sources": [source("land", "geo_land_polygons", sourceLayer="s"), source("water", "geo_navigable_water_polygons", geometryOperation="line_buffer", defaultLineBufferMeters=300)]}
    version, polygons = load_geo_dataset(spark, manifest, "20240101000000")
    assert version.startswith("m-20240101000000-") and {(r.source_layer, r.region) for r in polygons.collect()} == {("s", "r"), ("water", "r")}
    assert {r["layer"]: r["count"] for r in polygons.groupBy("layer").count().collect()} == {"land": 1, "navigable_water": 4}
    meters = lambda m: m / 111_320
    points = [(0.2 + meters(990), 0.5), (0.2 + meters(1020), 0.5), (0.2, 0.8 + meters(980)), (0.5, 0.4 - meters(290)), (0.5, 0.4 - meters(310)), (0.6 + meters(200), 0.4 - meters(200)), (0.6 + meters(230), 0.4 - meters(230)), (0.9, 0.85)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "seq long, lon double, lat double")
    got = [r.reason for r in geo.geo_verdict(df, polygons, version).orderBy("seq").collect()]
    assert got == ["navigable_water", "deep_land", "navigable_water", "navigable_water", "deep_land", "navigable_water", "deep_land", "navigable_water"]


def test_detail_rows_and_hashes_of_other_letters(spark):
    import hashlib

    schema = "mmsi string, vessel_id long, sanctions_status string, sanctions_checked_at timestamp_ntz, sanctions_matches array<string>"
    old = spark.createDataFrame([("1", None, "clear", at(10), []), ("2", 2, "clear", None, []), ("3", 3, "clear", at(5), ["x"])], schema)
    new = spark.createDataFrame([("1", 11, "sanctioned", at(9), ["e"]), ("2", 12, "candidate", at(0), ["e"]), ("3", 13, "clear", at(5), []), ("4", 14, "clear", at(1), []), ("5", 15, "clear", None, [])], schema)
    got = {r.mmsi: (r.vessel_id, r.sanctions_status, r.sanctions_matches) for r in fanout.fold_detail(old, new).collect()}
    assert got == {"1": (None, "clear", []), "2": (12, "candidate", ["e"]), "3": (13, "clear", []), "4": (14, "clear", [])}
    rows = spark.createDataFrame([("9000001", "São José-1", "sao jose 1"), (None, "ÅNGSTRÖM", "angstrom"), ("1", "PLAIN", "plain")], "imo string, name string, want string")
    for r in rows.withColumn("h", fn.profile_hash(F.col("imo"), F.col("name"))).collect():
        assert r.h == hashlib.sha1(f'{{"imo":"{r.imo or ""}","name":"{r.want}"}}'.encode()).hexdigest()[:16]


def test_labels_written_down_independently(spark):
    """Values of the published AIS code tables, not read from the library's own tables."""
    types = {30: "Fishing", 31: "Towing", 36: "Sailing", 37: "Pleasure Craft", 51: "SAR Vessel", 52: "Tug", 60: "Passenger", 69: "Passenger", 70: "Cargo", 80: "Tanker", 99: "Other", 0: "Unknown"}
    status = {0: "Under way (engine)", 1: "At anchor", 2: "Not under command", 5: "Moored", 6: "Aground", 7: "Engaged in fishing", 8: "Under way sailing", 15: "Undefined", 16: "Unknown"}
    for codes, label in ((types, fn.ship_type_label), (status, fn.nav_status_label)):
        got = spark.createDataFrame([(k,) for k in codes], "code int").withColumn("label", label(F.col("code"))).collect()
        assert {r.code: r.label for r in got} == codes


def test_override_folder(spark, tmp_path):
    assert readers.read_override_dir(spark, str(tmp_path / "none")).count() == 0
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}, "properties": {"name": "x"}}, {"type": "Feature", "geometry": None, "properties": {}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(shape, indent=1))
    (tmp_path / "notes.txt").write_text("no")
    got = readers.read_override_dir(spark, str(tmp_path)).collect()
    assert [(r.layer, r.rings[0][0].lon) for r in got] == [("manual_allow", 0.0), ("manual_allow", 5.0)]


def test_conflation_places(spark):
    rows = [(0, "1", "position"), (1, "2", "position"), (2, "1", "static"), (3, "1", "position"), (4, "3", "position")]
    df = spark.createDataFrame([(s, m, k, T0) for s, m, k in rows], "seq long, mmsi string, kind string, received_at timestamp_ntz")
    out = lambda d: [(r.kind, r.mmsi, r.seq) for r in d.orderBy("slot", "group", "place").collect()]
    assert out(fanout.conflate(df)) == [("static", "1", 2), ("position", "1", 3), ("position", "2", 1), ("position", "3", 4)]
    assert out(fanout.conflate(df, max_entries=3)) == [("static", "1", 2), ("position", "2", 1), ("position", "3", 4)]
    assert out(fanout.conflate(df, max_entries=2)) == [("position", "2", 1), ("position", "3", 4)]  # the static finds the queue full


def test_a_bounded_queue_by_its_rule(spark):
    """Against a queue kept in plain lists: newest position in the first one's place, the oldest place makes room, others are refused."""
    import random

    rng = random.Random(5)
    rows = [(s, f"{rng.randrange(12)}", rng.choice(("position", "position", "position", "static", "enriched")), at(s // 60)) for s in range(600)]
    df = spark.createDataFrame(rows, "seq long, mmsi string, kind string, received_at timestamp_ntz")
    for most in (1, 4, 9):
        want = set()
        for minute in range(10):
            others, order, newest, first = [], [], {}, {}
            for seq, mmsi, kind, _ in rows[minute * 60 : minute * 60 + 60]:
                room = len(others) + len(order) < most
                if kind != "position":
                    others += [seq] * room
                elif mmsi in order:
                    newest[mmsi] = seq
                elif room or order:
                    if not room:
                        order.pop(0)
                    order.append(mmsi)
                    newest[mmsi] = first[mmsi] = seq
            want |= {(s, s, 0) for s in others} | {(newest[m], first[m], 1) for m in order}
        got = fanout.conflate(df, "1 second", most)
        assert {(r.seq, r.place, r.group) for r in got.collect()} == want


def test_arrival_order_comes_from_seq_alone(spark):
    from vesselflow.sources.feed import positions as feed_positions

    own = feed_positions(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(tuple(r) for r in df.select("mmsi", "lon", "occurred_at").collect())
    assert key(state.upsert_latest(None, own)) == key(state.upsert_latest(None, own.orderBy(F.rand(3)).repartition(7)))


def test_streams_equal_batches(spark, tmp_path):
    from vesselflow.sources.feed import positions as feed_positions
    from vesselflow.streaming import stateful

    # State with processing-time timeouts asks for empty batches without end, and a run over what is available would never be done.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own = feed_positions(spark, "/root/testdata/sf0.001").where("user_id < 12")
    own.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
    how = quality.Sampling(moving_s=12 * 3600, stationary_s=48 * 3600, state_ttl_s=10**9)
    run = stateful.sample_stream(read(), how).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(str(tmp_path / "sampled"))
    assert run.awaitTermination(120)
    got = {r.seq for r in spark.read.parquet(str(tmp_path / "sampled")).collect()}
    assert got == {r.seq for r in quality.adaptive_sample(own, how).where("emitted").collect()}
