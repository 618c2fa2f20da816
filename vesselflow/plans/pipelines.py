"""Compositions: ingest (D5) and persist (E6), each one declarative plan, and enrich (M8), which writes the vessels to check once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chain
from ..operators import geo, quality, sanctions, state, validate
from ..sources.readers import written


@dataclass(frozen=True)
class IngestConfig:
    dedup_ttl_s: int = 600
    sampling: quality.Sampling = field(default_factory=quality.Sampling)
    tolerance_m: float = geo.TOLERANCE_M
    fail_open: bool = True
    geo_enabled: bool = True


def ingest(events: DataFrame, polygons: DataFrame, version: str | None, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Canonical events with one outcome each: published, or why they were dropped.

    In order: contract, duplicates, coverage, land, sampling. A later drop has
    still used its dedup key; only positions are tested for place and sampled.
    """
    once = quality.dedup(validate.validate_canonical(events), config.dedup_ttl_s, only="valid")
    placed = validate.in_coverage(once)
    judged = geo.geo_result(geo.geo_verdict(placed, polygons, version, config.tolerance_m), config.fail_open, config.geo_enabled)
    position = F.col("kind") == "position"
    afloat = judged.withColumn("afloat", F.col("accepted") & F.col("in_zone") & position & ~F.col("should_drop"))
    done = quality.adaptive_sample(afloat, config.sampling, only="afloat")
    cases = [
        (~F.col("valid"), F.lit("invalid")), (~F.col("accepted"), F.lit("duplicate")), (~F.col("in_zone"), F.lit("out_of_bbox")), (~position, F.lit("published")),
        (F.col("should_drop"), F.lit("on_land")), (F.col("emitted"), F.lit("published")),
    ]
    return done.select("seq", "mmsi", "kind", "provider", "received_at", chain(cases, F.lit("sampled")).alias("outcome"))


@dataclass
class Persisted:
    vessels: DataFrame
    latest: DataFrame
    history: DataFrame
    facts: DataFrame


def persist_events(events: DataFrame, vessels: DataFrame, latest: DataFrame | None, history: DataFrame | None, now: Column) -> Persisted:
    """A micro-batch into vessels, latest and history, and one persisted fact per stored event with the merged identity."""
    kept = validate.retention_filter(events, now)
    positions = kept.where("kind = 'position'")
    merged = state.merge_vessels(vessels, kept)
    facts = kept.select("seq", "mmsi", "kind", "occurred_at").join(merged.select("mmsi", "imo", "name"), "mmsi").withColumn("vessel_id", state.vessel_id(F.col("mmsi")))
    return Persisted(merged, state.upsert_latest(latest, positions), state.append_history(history, positions), facts)


def enrich(facts: DataFrame, vessels: DataFrame, entities: DataFrame, checks: DataFrame, now: Column, name_mode: str = "raw") -> DataFrame:
    """Enriched facts of the vessels that need a check: trigger, status and number of matches, where the check is newer.

    `checks` holds mmsi, profile_hash and checked_at of earlier runs; `vessels`
    mmsi, imo, name, status and checked_at.
    """
    newest = facts.groupBy("mmsi").agg(F.max_by(F.struct("imo", "name"), "seq").alias("x")).select("mmsi", "x.*")
    jobs = sanctions.enrichment_trigger(newest, checks, now)
    # Matching, status and the update all read the vessels to check, so these are derived once.
    own = written(vessels.join(jobs.select("mmsi", "trigger", "profile_hash"), "mmsi"), "due")
    judged = sanctions.status_of(own, sanctions.match_sanctions(own, entities, name_mode)).withColumn("checked_at", now)
    done = sanctions.apply_enrichment(own, judged).where("outcome = 'applied'")
    return done.join(judged.select("mmsi", "n_matches"), "mmsi").select("mmsi", "imo", "name", "trigger", "profile_hash", "status", "checked_at", "n_matches")
