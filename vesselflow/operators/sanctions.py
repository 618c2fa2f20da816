"""Sanctions lists and matching (H1-H4, M1-M9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_name, profile_hash
from ..sources.readers import upsert

METHODS = ("imo", "mmsi", "name")


def first_valid_id(ids: Column, kind: str, pattern: str, strip: str | None = None) -> Column:
    """The first id of a kind whose number, without a leading `strip` in any case, matches the whole pattern."""
    number = lambda x: F.regexp_replace(F.trim(x["idNumber"]), f"(?i)^{strip}", "") if strip else F.trim(x["idNumber"])
    own = F.transform(F.filter(ids, lambda x: x["idType"] == kind), number)
    return F.try_element_at(F.filter(own, lambda v: v.rlike(f"^{pattern}$")), F.lit(1))


def sdn_to_entities(entries: DataFrame, source: str = "ofac") -> DataFrame:
    """Vessels of an SDN list as entities; strong non-empty aliases only."""
    ids = F.col("idList.id")
    strong = F.filter("akaList.aka", lambda a: (F.lower(a["category"]) == "strong") & (F.length(F.trim(a["lastName"])) > 0))
    aliases = F.coalesce(F.transform(strong, lambda a: a["lastName"]), F.array().cast("array<string>"))
    return entries.where("sdnType = 'Vessel'").select(
        F.concat(F.lit(f"{source}-"), F.col("uid")).alias("entity_id"), F.lit(source).alias("source"), F.col("uid").alias("source_entity_id"),
        F.coalesce("lastName", F.lit("")).alias("name"),
        first_valid_id(ids, "Vessel Registration Identification", r"\d{7}", r"IMO\s").alias("imo"), first_valid_id(ids, "MMSI", r"\d{9}").alias("mmsi"),
        aliases.alias("aliases"), F.col("vesselInfo.vesselFlag").alias("flag"), F.lit(None).cast("date").alias("listing_date"),
        F.coalesce("programList.program", F.array().cast("array<string>")).alias("programs"), F.to_json(F.struct("*")).alias("raw_payload"),
    )


def upsert_entities(current: DataFrame, incoming: DataFrame, drop_missing: bool = False) -> DataFrame:
    """Incoming rows replace current ones on (source, source_entity_id), the last of a file wins by `seq`; delisted rows stay unless dropped."""
    keys = ["source", "source_entity_id"]
    rest = [c for c in current.columns if c not in keys]
    new = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("x"), F.lit(True).alias("_new")).select(*keys, "x.*", "_new")
    out = upsert(current.withColumn("_new", F.lit(False)), new, keys, {c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")) for c in rest} | {"_new": F.col("n._new")})
    return (out.where("_new") if drop_missing else out).drop("_new")


def import_run(runs: DataFrame, source: str, run_id: int, started_at: Column, load: Callable[[], DataFrame], save: Callable[[DataFrame], int], finished_at: Column) -> DataFrame:
    """The run log with this import: completed with its record count, or failed with the error; skipped while another runs."""
    if runs.where((F.col("source") == source) & (F.col("status") == "running")).limit(1).count():
        status, records, errors = "skipped", 0, ["an import of this source is running"]
    else:
        try:
            status, records, errors = "completed", save(load()), []
        except Exception as e:  # noqa: BLE001  the log keeps whatever ended the run
            status, records, errors = "failed", 0, [str(e)[:500]]
    spark = runs.sparkSession
    row = spark.createDataFrame([(run_id, source, status, records, errors)], "run_id long, source string, status string, records_imported int, errors array<string>")
    return runs.unionByName(row.withColumn("started_at", started_at).withColumn("finished_at", finished_at).select(runs.columns))


def _by(vessels: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    own = entities.select("entity_id", "source", "source_entity_id", F.col("name").alias("entity_name"), F.col(key).alias("k"))
    return vessels.where(F.col(key).isNotNull()).select("mmsi", F.col(key).alias("k")).join(own, "k").select("mmsi", "entity_id", "source", "source_entity_id", "entity_name", F.lit(key).alias("method"))


def candidates_by_imo(vessels: DataFrame, entities: DataFrame) -> DataFrame:
    return _by(vessels, entities, "imo")


def candidates_by_mmsi(vessels: DataFrame, entities: DataFrame) -> DataFrame:
    own = entities.select("entity_id", "source", "source_entity_id", F.col("name").alias("entity_name"), "mmsi")
    return vessels.select("mmsi").join(own, "mmsi").select("mmsi", "entity_id", "source", "source_entity_id", "entity_name", F.lit("mmsi").alias("method"))


def candidates_by_name(vessels: DataFrame, entities: DataFrame, mode: str = "raw") -> DataFrame:
    """Equal names or aliases, raw or normalised; names that normalise to nothing match nothing."""
    names = entities.select("entity_id", "source", "source_entity_id", F.col("name").alias("entity_name"), F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("k"))
    own = vessels.select("mmsi", F.col("name").alias("k")).where(normalize_name(F.col("k")) != "")
    if mode == "normalized":
        names, own = names.withColumn("k", normalize_name(F.col("k"))), own.withColumn("k", normalize_name(F.col("k")))
    return own.join(names.hint("merge"), "k").select("mmsi", "entity_id", "source", "source_entity_id", "entity_name", F.lit("name").alias("method")).distinct()


def match_sanctions(vessels: DataFrame, entities: DataFrame, name_mode: str = "raw") -> DataFrame:
    """(mmsi, entity_id, ..., method, position): identifier matches first; names only for vessels without any.

    An entity counts once, with its first method. Positions order a vessel's
    matches by method, then (source, source_entity_id, entity_id).
    """
    tagged = lambda rank, k: F.struct(F.lit(rank).alias("rank"), k.alias("k"))
    ids = [tagged(0, F.col("imo")), tagged(1, F.col("mmsi"))]
    plain = normalize_name(F.when(F.col("rank") == 2, F.col("k")))  # of whole columns: names are listed first
    keyed = lambda df: df.withColumn("k", F.when((F.col("rank") == 2), plain).otherwise(F.col("k"))) if name_mode == "normalized" else df
    own = vessels.select("mmsi", F.inline(F.array(*ids, tagged(2, F.col("name"))))).where("k is not null")
    own = keyed(own.where((F.col("rank") < 2) | (plain != "")))
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    keys = F.concat(F.array(*ids), F.transform(names, lambda x: tagged(2, x)))
    listed = keyed(entities.select("entity_id", "source", "source_entity_id", F.col("name").alias("entity_name"), F.inline(keys)).where("k is not null"))
    found = own.join(listed.hint("merge"), ["rank", "k"]).withColumn("method", F.element_at(F.array(*map(F.lit, METHODS)), F.col("rank") + 1))
    once = found.groupBy("mmsi", "entity_id", "source", "source_entity_id", "entity_name").agg(F.min("rank").alias("rank"), F.min_by("method", "rank").alias("method"))
    order = Window.partitionBy("mmsi").orderBy("rank", "source", "source_entity_id", "entity_id")
    best = F.min("rank").over(order)  # the first in order has the least rank
    return once.withColumn("best", best).where("rank < 2 or best = 2").withColumn("position", F.row_number().over(order)).drop("rank", "best")


def status_of(vessels: DataFrame, matches: DataFrame) -> DataFrame:
    """(mmsi, status, matches): sanctioned by an identifier, candidate by name only, else clear."""
    per = matches.groupBy("mmsi").agg(F.min(F.when(F.col("method") == "name", 1).otherwise(0)).alias("best"), F.count("*").alias("n_matches"))
    status = F.when(F.col("best") == 0, "sanctioned").when(F.col("best") == 1, "candidate").otherwise("clear")
    return vessels.select("mmsi").join(per, "mmsi", "left").select("mmsi", status.alias("status"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def enrichment_trigger(persisted: DataFrame, state: DataFrame, now: Column, ttl_days: int = 7) -> DataFrame:
    """Jobs to run for persisted facts: discovered, profile_changed or stale, in that order; fresh ones are skipped, equal jobs collapse."""
    facts = persisted.withColumn("profile_hash", profile_hash(F.col("imo"), F.col("name")))
    known = state.select("mmsi", F.col("profile_hash").alias("known_hash"), F.col("checked_at").alias("last_check"))
    expired = F.col("last_check").isNull() | (F.col("last_check") < now - F.expr(f"interval {ttl_days} days"))
    trigger = F.when(F.col("known_hash").isNull(), "discovered").when(F.col("known_hash") != F.col("profile_hash"), "profile_changed").when(expired, "stale").otherwise("fresh")
    return facts.join(known, "mmsi", "left").withColumn("trigger", trigger).where("trigger != 'fresh'").select("mmsi", "imo", "name", "trigger", "profile_hash").dropDuplicates(["mmsi", "trigger", "profile_hash"])


def apply_enrichment(vessels: DataFrame, results: DataFrame) -> DataFrame:
    """Vessels with newer checks applied; outcome is applied, noop or null where there was no result."""
    both = vessels.join(results.select("mmsi", F.col("status").alias("new_status"), F.col("checked_at").alias("new_check")), "mmsi", "left")
    wins = F.col("new_check").isNotNull() & (F.col("checked_at").isNull() | (F.col("checked_at") < F.col("new_check")))
    outcome = F.when(wins, "applied").when(F.col("new_check").isNotNull(), "noop")
    return both.withColumn("outcome", outcome).withColumn("status", F.when(wins, F.col("new_status")).otherwise(F.col("status"))).withColumn("checked_at", F.when(wins, F.col("new_check")).otherwise(F.col("checked_at"))).drop("new_status", "new_check")


def reconcile(vessels: DataFrame, state: DataFrame, now: Column, batch: int = 500, ttl_days: int = 7) -> DataFrame:
    """One row scanned, enqueued, skipped for the vessels most in need of a check."""
    from .views import needs_enrichment

    due = needs_enrichment(vessels, now - F.expr(f"interval {ttl_days} days"), batch)
    jobs = enrichment_trigger(due, state, now, ttl_days)
    both = due.select("mmsi").distinct().join(jobs.select("mmsi", F.lit(1).alias("job")), "mmsi", "left")
    return both.agg(F.count("*").alias("scanned"), F.count("job").alias("enqueued"), (F.count("*") - F.count("job")).alias("skipped"))
