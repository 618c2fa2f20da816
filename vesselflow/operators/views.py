"""Read queries (V1-V9): snapshot, detail, tracks, work lists, import runs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import from_web_mercator, point_in_bbox, web_mercator


def latest_snapshot(latest: DataFrame, vessels: DataFrame, boxes: list[dict], since: Column, limit: int = 10_000) -> DataFrame:
    """Vessels last seen since a time in any box, newest first, ties by mmsi; no box gives no rows."""
    inside = reduce(lambda a, b: a | b, [point_in_bbox(F.col("lat"), F.col("lon"), b) for b in boxes], F.lit(False))
    return latest.where((F.col("last_seen_at") >= since) & inside).join(vessels, "mmsi").orderBy(F.desc("last_seen_at"), "mmsi").limit(limit)


def vessel_detail(vessels: DataFrame, latest: DataFrame) -> DataFrame:
    """Vessels with a nested position, null without a fix; `vessels` may be filtered to one before."""
    fix = F.struct("lon", "lat", "sog", "cog", "true_heading", "nav_status", "occurred_at", "last_seen_at")
    return vessels.join(latest, "mmsi", "left").select(*[F.col(c) for c in vessels.columns], F.when(F.col("lon").isNotNull(), fix).alias("position"))


def track_points(history: DataFrame, start: Column, end: Column) -> DataFrame:
    """Points of [start, end) in order; on a daily partitioned table only the window's days are read."""
    rows = history.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    if "occurred_date" in history.columns:
        rows = rows.where(F.col("occurred_date").between(F.to_date(start), F.to_date(end)))
    return rows.orderBy("mmsi", "occurred_at")


def track_line(history: DataFrame, start: Column, end: Column) -> DataFrame:
    """One ordered line for each vessel with two points or more in the window."""
    rows = history.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    line = F.array_sort(F.collect_list(F.struct("occurred_at", "lon", "lat")))
    return rows.groupBy("mmsi").agg(line.alias("line")).where(F.size("line") >= 2)


def simplify_line(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps; both ends always."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(x) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(len(px))
        far = (px - t * dx) ** 2 + (py - t * dy) ** 2
        k = int(far.argmax())
        if far[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def track_simplify(lines: DataFrame, meters: float) -> DataFrame:
    """Lines simplified on the web Mercator plane: mmsi and the kept points."""

    @F.pandas_udf("array<struct<lon:double,lat:double>>")
    def kept(lon: pd.Series, lat: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(lon, lat):
            a, b = np.asarray(a, float), np.asarray(b, float)
            k = simplify_line(np.radians(a) * 6378137.0, np.log(np.tan(np.radians(b) / 2 + np.pi / 4)) * 6378137.0, meters)
            out.append([{"lon": p, "lat": q} for p, q in zip(a[k], b[k])])
        return pd.Series(out)

    return lines.select("mmsi", kept(F.transform("line", lambda p: p["lon"]), F.transform("line", lambda p: p["lat"])).alias("line"))


def mercator_round_trip(points: DataFrame) -> DataFrame:
    x, y = web_mercator(F.col("lon"), F.col("lat"))
    lon, lat = from_web_mercator(F.col("x"), F.col("y"))
    return points.withColumn("x", x).withColumn("y", y).withColumn("lon2", lon).withColumn("lat2", lat)


def vessel_fingerprint(vessels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vessel_id, mmsi, imo, name) of the wanted mmsi, one row each at most."""
    return vessels.join(wanted.select("mmsi").distinct(), "mmsi", "left_semi").select("vessel_id", "mmsi", "imo", "name")


def needs_enrichment(vessels: DataFrame, stale_before: Column, limit: int = 500) -> DataFrame:
    """Unchecked or stale vessels, unchecked first, then the least recently updated; ties by mmsi."""
    due = F.col("checked_at").isNull() | (F.col("checked_at") < stale_before)
    return vessels.where(due).orderBy(F.asc_nulls_first("checked_at"), "updated_at", "mmsi").limit(limit)


def recent_import_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def last_run_by_source(runs: DataFrame) -> DataFrame:
    rest = [c for c in runs.columns if c != "source"]
    return runs.groupBy("source").agg(F.max_by(F.struct(*rest), F.struct("started_at", "run_id")).alias("last_run"))


def has_completed_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").agg(F.bool_or(F.col("status") == "completed").alias("has_completed"))


def sources_with_last_import(registry: DataFrame, runs: DataFrame) -> DataFrame:
    return registry.join(last_run_by_source(runs), "source", "left")
