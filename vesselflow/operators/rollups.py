"""Operational rollups (A1-A10) over outcome tables; windows tumble, so they run on streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros_between


def per_window(rows: DataFrame, at: str, every: str, *by: str) -> DataFrame:
    """Counts and rates a second by tumbling window and columns: A1 (provider or kind), A2 (reason), A9 (stream and reason)."""
    out = rows.groupBy(F.window(at, every).alias("w"), *by).agg(F.count("*").alias("n"))
    seconds = micros_between(F.col("w.start"), F.col("w.end")) / 1e6
    return out.select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") / seconds).alias("rate"))


def geo_decisions(verdicts: DataFrame, *by: str) -> DataFrame:
    """Decisions by verdict, reason and more; with the share of deep-land rejects and errors."""
    return verdicts.groupBy("verdict", "reason", *by).agg(F.count("*").alias("n"))


def geo_rates(verdicts: DataFrame) -> DataFrame:
    n = F.count("*")
    return verdicts.agg(n.alias("decisions"), F.sum((F.col("reason") == "deep_land").cast("int")).alias("deep_land"), (F.sum((F.col("reason") == "geo_validation_error").cast("int")) / F.greatest(n, F.lit(1))).alias("error_rate"))


def reuse_ratio(buckets: DataFrame) -> DataFrame:
    """Share of look-ups that a bucket seen before answers."""
    return buckets.agg(F.count("*").alias("lookups"), (F.count("*") - F.count_distinct("bucket")).alias("hits")).withColumn("ratio", F.col("hits") / F.greatest(F.col("lookups").cast("double"), F.lit(1e-6)))


def matches_by_method(matches: DataFrame) -> DataFrame:
    return matches.groupBy("method").agg(F.count("*").alias("n"))


def outcomes_by_status(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def import_durations(runs: DataFrame) -> DataFrame:
    """p95 seconds and records of each source's completed imports."""
    seconds = micros_between(F.col("started_at"), F.col("finished_at")) / 1e6
    return runs.where("status = 'completed'").groupBy("source").agg(F.percentile(seconds, F.lit(0.95)).alias("p95_s"), F.sum("records_imported").alias("records"))


def rows_written(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows by table: each is counted in its own pass, partial counts only."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def feed_health(providers: DataFrame, received: DataFrame, started_at: Column, now: Column, degraded_s: int = 60) -> DataFrame:
    """Seconds since each provider's last message (-1 when none) and whether it is degraded, counted from the start when it never spoke."""
    last = received.groupBy("provider").agg(F.max("received_at").alias("last_at"))
    age = micros_between(F.coalesce("last_at", started_at), now) / 1e6
    return providers.join(last, "provider", "left").select("provider", F.when(F.col("last_at").isNull(), F.lit(-1.0)).otherwise(age).alias("last_message_s"), (age > degraded_s).alias("degraded"))


def histogram(values: DataFrame, column: str, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative bucket counts `le`, one row a bound, the last for all values; one pass of conditional counts."""
    counts = [F.struct(F.lit(float(b)).alias("le"), F.sum((F.col(column) <= b).cast("int")).alias("n")) for b in bounds]
    total = F.struct(F.lit(float("inf")).alias("le"), F.count(column).alias("n"))
    return values.groupBy(*by).agg(F.array(*counts, total).alias("b")).select(*by, F.inline("b"))


def bucket_quantile(buckets: DataFrame, share: float, *by: str) -> DataFrame:
    """The quantile by linear interpolation inside its bucket; the highest finite bound if it lies beyond."""
    order = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumns({"low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "before": F.coalesce(F.lag("n").over(order), F.lit(0)), "total": F.max("n").over(Window.partitionBy(*by))})
    rank = F.col("total") * share
    hit = rows.where((F.col("n") >= rank) & (F.col("before") < rank))
    inside = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("before")) / (F.col("n") - F.col("before")))
    return hit.select(*by, inside.alias("quantile"))
