"""Structured Streaming forms: dedup, sampling, verdicts, the live view, persistence and enrichment by micro-batch, tumbling rates.

Event times are zone-less in tables; streams carry timestamps, as watermarks
need. State has the time-to-live that the batch folds apply by arrival time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fanout import shown_matches
from ..operators.geo import geo_result, geo_verdict
from ..operators.quality import Sampling
from ..plans.pipelines import enrich, persist_events
from ..sources.readers import written


def _arrival(rows: DataFrame, late: str) -> DataFrame:
    """The stream with its arrival time as a watermarked timestamp, so that state can go by arrival."""
    return rows.withColumn("_arrived", F.col("received_at").cast("timestamp")).withWatermark("_arrived", late)


def dedup_stream(events: DataFrame, ttl_seconds: int = 600, late: str = "1 hour") -> DataFrame:
    """(mmsi, occurred_at, seq, accepted): the batch form's rule on a stream, by arrival time.

    A key's state is the arrival last accepted. It goes once the watermark of
    arrivals has passed its time-to-live, when the next sight would be accepted
    anyway, so losing it changes nothing. Rows that arrive more than `late` before
    the newest of an earlier micro-batch are dropped by the watermark; rows of a
    micro-batch are taken by (received_at, seq).
    """
    ttl = ttl_seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        accepted_at = kept.get[0] if kept.exists else None
        table = pd.concat(list(frames)).sort_values(["received_us", "seq"])
        flags = []
        for received in table.received_us.tolist():
            new = accepted_at is None or received - accepted_at >= ttl
            accepted_at = received if new else accepted_at
            flags.append(new)
        kept.update((accepted_at,))
        kept.setTimeoutTimestamp(max((accepted_at + ttl) // 1000 + 1, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"mmsi": key[0], "occurred_us": key[1], "seq": table.seq, "accepted": flags})

    own = _arrival(events, late).select("mmsi", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("occurred_us"), F.unix_micros("_arrived").alias("received_us"), "seq", "_arrived")
    out = own.groupBy("mmsi", "occurred_us").applyInPandasWithState(run, "mmsi string, occurred_us long, seq long, accepted boolean", "accepted_at long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("mmsi", F.timestamp_micros("occurred_us").cast("timestamp_ntz").alias("occurred_at"), "seq", "accepted")


def sample_stream(positions: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """(mmsi, seq) of emitted positions. Rows of a micro-batch are taken by seq; a vessel's state goes after its time-to-live."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state = tuple(kept.get) if kept.exists else None
        table = pd.concat(list(frames)).sort_values("seq")
        keep = []
        for at, received, sog, nav in zip(table.occurred_us, table.received_us, table.sog, table.nav_status):
            state, emit = sampling.step(state, int(at), int(received), None if pd.isna(sog) else float(sog), None if pd.isna(nav) else int(nav))
            keep.append(emit)
        kept.update(state)
        kept.setTimeoutDuration(sampling.state_ttl_s * 1000)
        yield pd.DataFrame({"mmsi": key[0], "seq": table[keep].seq})

    own = positions.select("mmsi", "seq", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("occurred_us"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"), "sog", "nav_status")
    return own.groupBy("mmsi").applyInPandasWithState(run, "mmsi string, seq long", "occurred long, received long, nav int", "append", GroupStateTimeout.ProcessingTimeTimeout)


_LIVE_STATE = "json string, active_us long"
#: Columns of the live view as a stream keeps them: times as microseconds, matches as JSON.
LIVE_ROW = (
    "mmsi string, vessel_id string, last_seen_us long, lat double, lon double, sog double, cog double, true_heading int, nav_status int, occurred_us long, imo string, name string, call_sign string, "
    "ship_type int, destination string, static_us long, sanctions_status string, checked_us long, sanctions_matches string, gone boolean"
)
_MOVED = ("lat", "lon", "sog", "cog", "true_heading", "nav_status")
_PROFILE = ("imo", "name", "call_sign", "ship_type", "destination")


def _fold_live(live: dict, e: dict) -> None:
    """One event into a vessel's row; each kind has its own guard, an older event of a kind changes nothing."""
    at = e["occurred_us"]
    if e["kind"] == "position" and (live.get("occurred_us") is None or at >= live["occurred_us"]):
        live.update({c: e[c] for c in _MOVED}, occurred_us=at, last_seen_us=max(live.get("last_seen_us") or e["received_us"], e["received_us"]), name=live.get("name") if e["ship_name"] is None else e["ship_name"])
    elif e["kind"] == "static" and (live.get("static_us") is None or at >= live["static_us"]):
        live.update({c: live.get(c) if e[c] is None else e[c] for c in _PROFILE}, static_us=at)
    elif e["kind"] == "enriched" and (live.get("checked_us") is None or at >= live["checked_us"]):
        live.update(vessel_id=e["vessel_id"], sanctions_status=e["status"], checked_us=at, sanctions_matches=e["matches"])


def live_stream(events: DataFrame, max_age_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """The live view as a stream: a vessel's row after each micro-batch that has an event of it, LIVE_ROW.

    Rows of a micro-batch are folded by seq into the vessel's state, with the
    batch form's guards. A vessel without an event for `max_age_hours` by the
    watermark of arrivals leaves with a last row whose `gone` is true, and its
    state goes with it. Matches of unknown sources are left out.
    """
    names = [c.split()[0] for c in LIVE_ROW.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        live = json.loads(kept.get[0]) if kept.exists else {}
        gone = kept.hasTimedOut
        if gone:
            kept.remove()
        else:
            table = pd.concat(list(frames)).sort_values("seq")
            table = table.astype(object).where(table.notna(), None)
            for e in table.to_dict("records"):
                _fold_live(live, e)
            active = next((live[c] for c in ("last_seen_us", "occurred_us", "static_us") if live.get(c) is not None), max(table.received_us))
            kept.update((json.dumps(live), int(active)))
            kept.setTimeoutTimestamp(max(active // 1000 + max_age_hours * 3_600_000, kept.getCurrentWatermarkMs() + 1))
        row = {**live, "mmsi": key[0], "gone": gone}
        yield pd.DataFrame([[row.get(c) for c in names]], columns=names).astype({"true_heading": "Int32", "nav_status": "Int32", "ship_type": "Int32", "occurred_us": "Int64", "last_seen_us": "Int64", "static_us": "Int64", "checked_us": "Int64"})

    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    columns = ["mmsi", "seq", "kind", *_MOVED, *_PROFILE, "ship_name", "vessel_id", "status"]
    own = _arrival(events, late).select(*columns, F.to_json(shown_matches(F.col("matches"))).alias("matches"), us("occurred_at").alias("occurred_us"), us("received_at").alias("received_us"), "_arrived")
    return own.groupBy("mmsi").applyInPandasWithState(run, LIVE_ROW, _LIVE_STATE, "update", GroupStateTimeout.EventTimeTimeout)


class Store:
    """Tables that change together: a micro-batch writes its part of each, and one committed record makes all of it visible.

    Every batch has a folder of its own below each table. Readers see the batches
    that are committed; what a failed batch left is written over when it runs again,
    and a batch that was committed is not done twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> dict[int, list[str]]:
        """The tables that each committed batch wrote; a name for each batch, no rows of data."""
        path, fs = self._fs(f"{self.folder}/_commits")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return {int(n.split("-")[0]): n.split("-")[1:] for n in names if n[0].isdigit()}

    def write(self, table: str, batch: int, rows: DataFrame, by: str | None = None) -> None:
        out = rows.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(f"{self.folder}/{table}/batch={batch}")

    def commit(self, batch: int, *tables: str) -> None:
        """Make the batch's tables visible, in one rename."""
        name = "-".join([str(batch), *tables])
        path, fs = self._fs(f"{self.folder}/_commits/.{name}")
        fs.create(path, True).close()
        fs.rename(path, self._fs(f"{self.folder}/_commits/{name}")[0])

    def newest(self, table: str) -> DataFrame | None:
        """The last committed version of a table that is written whole each time."""
        batches = [b for b, tables in self.commits().items() if table in tables]
        return self.spark.read.parquet(f"{self.folder}/{table}/batch={max(batches)}") if batches else None

    def appended(self, table: str) -> DataFrame | None:
        """All committed parts of a table that grows."""
        batches = [b for b, tables in self.commits().items() if table in tables]
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/batch={b}" for b in sorted(batches)]).drop("batch") if batches else None


PERSISTED = ("vessels", "latest", "history", "facts")


def persist_batch(batch: DataFrame, batch_id: int, store: Store, vessels: DataFrame, now: Column) -> None:
    """One micro-batch of events into vessels, latest, history and facts, committed together; a batch done before changes nothing.

    `vessels` is the table to begin with. Vessels and latest are new versions;
    history and facts grow, and history reads only the days that the batch touches.
    """
    if batch_id in store.commits():
        return
    batch = written(batch, "batch")
    held = store.appended("history")
    if held is not None:
        touched = batch.where("kind = 'position'").select(F.to_date("occurred_at").alias("occurred_date")).distinct()
        held = held.join(touched.hint("merge"), "occurred_date", "left_semi")
    known = store.newest("vessels")
    done = persist_events(batch, vessels if known is None else known, store.newest("latest"), None, now)
    new = done.history if held is None else done.history.join(held.select("mmsi", "occurred_at").hint("merge"), ["mmsi", "occurred_at"], "left_anti")
    store.write("vessels", batch_id, done.vessels)
    store.write("latest", batch_id, done.latest)
    store.write("history", batch_id, new.withColumn("occurred_date", F.to_date("occurred_at")), "occurred_date")
    store.write("facts", batch_id, done.facts)
    store.commit(batch_id, *PERSISTED)


def persist_stream(events: DataFrame, folder: str, checkpoint: str, vessels: DataFrame, now: Column):
    """Events of a stream into a Store of PERSISTED tables: a writer to start."""
    save = lambda batch, batch_id: persist_batch(batch, batch_id, Store(batch.sparkSession, folder), vessels, now)
    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def enrich_batch(facts: DataFrame, batch_id: int, store: Store, vessels: DataFrame, entities: DataFrame, now: Column, name_mode: str = "raw") -> None:
    """One micro-batch of persisted facts into enriched facts; the checks made so far are kept, so that an equal job of a later batch is not done again.

    `vessels` (mmsi, imo, name, status, checked_at) is the table to begin with.
    Tables of the store: enriched grows, checks and checked (the vessels with
    their newest check) are new versions.
    """
    if batch_id in store.commits():
        return
    facts = written(facts, "facts")
    checks, checked = store.newest("checks"), store.newest("checked")
    none = facts.sparkSession.createDataFrame([], "mmsi string, profile_hash string, checked_at timestamp_ntz")
    checks, checked = none if checks is None else checks, vessels if checked is None else checked
    done = written(enrich(facts, checked, entities, checks, now, name_mode), "enriched")
    new = done.select("mmsi", "profile_hash", "checked_at")
    store.write("enriched", batch_id, done)
    store.write("checks", batch_id, checks.join(new.hint("merge"), "mmsi", "left_anti").unionByName(new))
    latest = done.select("mmsi", F.col("status").alias("new_status"), F.col("checked_at").alias("new_at"))
    own = checked.join(latest.hint("merge"), "mmsi", "left")
    store.write("checked", batch_id, own.withColumns({"status": F.coalesce("new_status", "status"), "checked_at": F.coalesce("new_at", "checked_at")}).select(checked.columns))
    store.commit(batch_id, "enriched", "checks", "checked")


def enrich_stream(facts: DataFrame, folder: str, checkpoint: str, vessels: DataFrame, entities: DataFrame, now: Column, name_mode: str = "raw"):
    """Facts of a stream into a Store of enriched facts: a writer to start."""
    save = lambda batch, batch_id: enrich_batch(batch, batch_id, Store(batch.sparkSession, folder), vessels, entities, now, name_mode)
    return facts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def geo_stream(points: DataFrame, index: DataFrame, version: str, fail_open: bool = True) -> DataFrame:
    """D3 on a stream of points: each meets the static index of tiles by its cell, without state."""
    return geo_result(geo_verdict(points, None, version, index=index), fail_open)


def rates(events: DataFrame, at: str, every: str, late: str, *by: str) -> DataFrame:
    """Tumbling counts of a stream with a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), *by).count()
