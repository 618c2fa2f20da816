"""Streams over several micro-batches against the batch forms, repeated batches, expiry, bucketed upserts."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from vesselflow import queries as Q
from vesselflow.operators import fanout, geo, quality, state
from vesselflow.plans import pipelines
from vesselflow.sources import feed as source
from vesselflow.sources import readers
from vesselflow.streaming import stateful

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)


def streamed(spark, rows, folder, parts=4):
    """The rows as a stream of micro-batches in order of arrival."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    cuts = rows.approxQuantile("n", [k / parts for k in range(1, parts)], 0.0) if parts > 1 else []
    edges = [float("-inf"), *cuts, float("inf")]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        rows.where((F.col("n") > a) & (F.col("n") <= b)).drop("n").coalesce(1).write.parquet(f"{folder}/{k}")
        for f in os.listdir(f"{folder}/{k}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                os.rename(f"{folder}/{k}/{f}", f"{folder}/in/{k}.parquet")
                os.utime(f"{folder}/in/{k}.parquet", (10**9 + k, 10**9 + k))
    return spark.readStream.schema(rows.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def arrivals(df):
    return df.withColumn("n", F.unix_micros(F.col("received_at").cast("timestamp")).cast("double"))


def finish(writer, folder):
    run = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    assert run.awaitTermination(240)


@pytest.fixture(scope="module")
def events(spark):
    return source.feed(spark, SF).where("user_id < 14").cache()


def test_dedup_by_arrival(spark, events, tmp_path):
    """Sights after the time-to-live are accepted again, whether their state is there or has gone."""
    own = arrivals(events.select("mmsi", "occurred_at", "received_at", "seq"))
    out = stateful.dedup_stream(streamed(spark, own, tmp_path), 600)
    finish(out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")), tmp_path)
    got = {(r.seq, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.seq, r.accepted) for r in quality.dedup(events, 600).collect()}
    assert got == want and {a for _, a in want} == {True, False}
    assert any(a and s % 2 for s, a in want)  # the second sight 700 seconds on


def test_live_view(spark, tmp_path):
    own = Q.all_events(spark, SF).where("user_id < 14").cache()
    spread = own.withColumn("n", F.col("seq").cast("double"))
    rows = stateful.live_stream(streamed(spark, spread.withColumn("received_at", F.col("received_at")), tmp_path), 24 * 365, late="400 days")
    finish(rows.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("b", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))), tmp_path)
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("mmsi").agg(F.max_by(F.struct("*"), "b").alias("x")).select("x.*")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    view = fanout.live_view(own).withColumns({"occurred_us": us("occurred_at"), "last_seen_us": us("last_seen_at"), "static_us": us("static_occurred_at"), "checked_us": us("sanctions_checked_at"), "sanctions_matches": F.to_json("sanctions_matches")})
    columns = [c.split()[0] for c in stateful.LIVE_ROW.split(", ") if not c.startswith("gone")]
    key = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    a, b = key(last), key(view)
    assert [x for x, y in zip(a, b) if x != y] == [y for x, y in zip(a, b) if x != y] and len(a) == len(b)
    assert last.where("sanctions_matches like '%ofac%'").count() > 0
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.max("b")).first()[0] >= 3


def test_silent_vessels_leave_the_live_view(spark, tmp_path):
    at = lambda h: T0 + datetime.timedelta(hours=h)
    base = Q.all_events(spark, SF).where("kind = 'position'").limit(1)
    place = lambda mmsi, h, seq: base.withColumns({"mmsi": F.lit(mmsi), "occurred_at": F.lit(at(h)).cast("timestamp_ntz"), "received_at": F.lit(at(h)).cast("timestamp_ntz"), "seq": F.lit(seq).cast("long")})
    own = place("1", 0, 1).union(place("2", 20, 2)).union(place("2", 30, 3)).union(place("3", 60, 4))
    rows = stateful.live_stream(streamed(spark, own.withColumn("n", F.col("seq").cast("double")), tmp_path, 4), 24)
    finish(rows.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("b", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))), tmp_path)
    got = [(r.mmsi, r.gone) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("b", "mmsi").collect()]
    assert sorted(got) == [("1", False), ("1", True), ("2", False), ("2", False), ("2", True), ("3", False)] and got[-1] == ("2", True)


def test_verdicts(spark, events, tmp_path):
    own = arrivals(events.where("kind = 'position'").select("seq", "lon", "lat", "received_at"))
    index = readers.written(geo.geo_index(source.polygons(spark, SF), "v1"), "index")
    out = stateful.geo_stream(streamed(spark, own, tmp_path, 3), index, "v1")
    finish(out.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path)
    columns = ("seq", "verdict", "reason", "version_id", "should_drop")
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(geo.geo_result(geo.geo_verdict(own, source.polygons(spark, SF), "v1")))


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_persistence_is_one_transaction(spark, events, tmp_path):
    own = events.withColumn("name", F.when(F.col("kind") == "static", F.col("ship_name")))
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    kept, folder = own.withColumn("n", F.col("seq").cast("double")), str(tmp_path / "store")
    finish(stateful.persist_stream(streamed(spark, kept, tmp_path, 3), folder, str(tmp_path / "checkpoint"), Q.no_vessels(spark), now), tmp_path)
    store = stateful.Store(spark, folder)
    whole = pipelines.persist_events(own, Q.no_vessels(spark), None, None, now)
    key = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
    same = lambda: (
        key(store.newest("vessels"), "mmsi", *state.PROFILE) == key(whole.vessels, "mmsi", *state.PROFILE) and key(store.newest("latest"), "mmsi", "occurred_at", "lon") == key(whole.latest, "mmsi", "occurred_at", "lon")
        and key(store.appended("history"), "mmsi", "occurred_at", "lon") == key(whole.history, "mmsi", "occurred_at", "lon") and key(store.appended("facts"), "seq", "kind") == key(whole.facts, "seq", "kind")
    )
    assert sorted(store.commits()) == [0, 1, 2] and same()
    before = files(folder)
    stateful.persist_batch(own, 2, store, Q.no_vessels(spark), now)  # the batch runs again
    assert files(folder) == before and same()
    store.write("latest", 3, whole.latest.limit(0))  # a batch that ends between its tables
    assert same()
    stateful.persist_batch(own, 3, store, Q.no_vessels(spark), now)  # and runs again: all its rows are known
    assert sorted(store.commits()) == [0, 1, 2, 3] and key(store.appended("history"), "mmsi", "occurred_at") == key(whole.history, "mmsi", "occurred_at")


def test_enrichment_in_two_batches_equals_one(spark, tmp_path):
    own = readers.written(Q.checked_vessels(spark, SF), "vessels")
    facts = own.select("mmsi", "imo", "name", F.lit(1).alias("seq"))
    half, now, listed = F.substring("mmsi", 2, 8).cast("long") % 2 == 0, F.lit("2024-02-20").cast("timestamp_ntz"), source.entities(spark, SF)
    one, two = (stateful.Store(spark, str(tmp_path / name)) for name in ("one", "two"))
    stateful.enrich_batch(facts, 0, one, own, listed, now)
    stateful.enrich_batch(facts.where(half), 0, two, own, listed, now)
    stateful.enrich_batch(facts, 1, two, own, listed, now)  # the first half's jobs are done already
    stateful.enrich_batch(facts, 1, two, own, listed, now)
    for table, columns in (("checked", ("mmsi", "status", "checked_at")), ("checks", ("mmsi", "profile_hash", "checked_at"))):
        key = lambda s: sorted(tuple(r) for r in s.newest(table).select(*columns).collect())  # noqa: B023, E731
        assert key(one) == key(two)
    key = lambda s: sorted(tuple(r) for r in s.appended("enriched").select("mmsi", "trigger", "status", "n_matches").collect())
    assert key(one) == key(two) and len(key(one)) > 10


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "table")
    merge = {"v": F.coalesce("n.v", "c.v")}
    rows = lambda *r: spark.createDataFrame(r, "k string, v long")
    assert readers.bucket_table(spark, folder) is None
    got = readers.upsert_buckets(rows(*[(f"k{i}", i) for i in range(200)]), folder, ["k"], merge, 16)
    assert got.count() == 200
    before = {f: t for f, t in files(folder).items() if "_versions" not in f}
    got = readers.upsert_buckets(rows(("k3", -3), ("new", 7)), folder, ["k"], merge, 16)
    assert {r.k: r.v for r in got.collect()} == {**{f"k{i}": i for i in range(200)}, "k3": -3, "new": 7}
    after = {f: t for f, t in files(folder).items() if "_versions" not in f}
    assert all(after[f] == t for f, t in before.items()) and len({os.path.dirname(f) for f in after} - {os.path.dirname(f) for f in before}) <= 2
    assert readers.upsert_buckets(rows(), folder, ["k"], merge, 16).count() == 201


def test_one_large_collection_is_read_by_many_tasks(spark, tmp_path):
    feature = lambda i: f'{{ "type": "Feature", "properties": {{ "fclass": "c{i}" }}, "geometry": {{ "type": "Polygon", "coordinates": [ [ [ {i}.0, 0.0 ], [ {i}.5, 0.0 ], [ {i}.5, 1.0 ], [ {i}.0, 0.0 ] ] ] }} }}'
    (tmp_path / "big.geojson").write_text('{\n"type": "FeatureCollection",\n"name": "land",\n"features": [\n' + ",\n".join(feature(i) for i in range(3000)) + "\n]\n}\n")
    (tmp_path / "seq.geojsons").write_text("".join(f"\x1e{feature(i)}\n" for i in range(5)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = readers.read_geojson(spark, str(tmp_path / "big.geojson"), "land", by_line=True)
        assert got.rdd.getNumPartitions() > 4
        assert sorted(int(r.x) for r in got.select(F.col("rings")[0][0]["lon"].alias("x")).collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert readers.read_geojson(spark, str(tmp_path / "seq.geojsons"), "land", by_line=True).count() == 5
    whole = readers.read_geojson(spark, str(tmp_path / "big.geojson"), "land")
    assert whole.count() == 3000 and whole.columns == got.columns
