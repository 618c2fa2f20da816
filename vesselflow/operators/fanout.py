"""Change fan-out and the live view (X1-X8)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import marker_shape, micros_between, ship_type_color

LIVE_SOURCES = ("ofac", "opensanctions")
#: A vessel of the live view.
LIVE = (
    "mmsi string, vessel_id string, last_seen_at timestamp_ntz, lat double, lon double, sog double, cog double, true_heading int, nav_status int, occurred_at timestamp_ntz, "
    "imo string, name string, call_sign string, ship_type int, destination string, static_occurred_at timestamp_ntz, sanctions_status string, sanctions_checked_at timestamp_ntz, "
    "sanctions_matches array<struct<id:string,source:string,entity_name:string,match_method:string,programs:array<string>>>"
)
MOVEMENT = ["lon", "lat", "sog", "cog", "true_heading", "nav_status"]
PROFILE = ["imo", "call_sign", "ship_type", "destination"]


def conflate(messages: DataFrame, every: str = "1 second", max_entries: int | None = None) -> DataFrame:
    """What goes out per interval: other messages in order of arrival, then one position a vessel, the newest, in its first one's place.

    Adds slot (the interval), place and group. With `max_entries` an interval's
    queue is filled in order of arrival: a new vessel's position puts out the
    position that is oldest in place when the queue is full, and that vessel may
    come in again at the end; other messages put out nothing and are refused by a
    full queue, as is a position when no other position is there to go.
    """
    own = messages.withColumn("slot", F.window("received_at", every)["start"])
    if max_entries is not None:
        queue = own.select("slot", "seq", "mmsi", (F.col("kind") == "position").alias("position")).repartition("slot").sortWithinPartitions("slot", "seq")
        left = queue.mapInArrow(_queue(max_entries), "seq long, place long, group int")
        return own.join(left.hint("merge"), "seq")
    others = own.where("kind != 'position'").withColumn("place", F.col("seq")).withColumn("group", F.lit(0))
    rest = [c for c in own.columns if c not in ("slot", "mmsi")]
    newest = own.where("kind = 'position'").groupBy("slot", "mmsi").agg(F.max_by(F.struct(*rest), "seq").alias("x"), F.min("seq").alias("place"))
    positions = newest.select("slot", "mmsi", "x.*", "place", F.lit(1).alias("group"))
    return others.unionByName(positions)


def _queue(most: int):
    """A fold over an interval's messages in order; its state is the queue, at most `most` entries."""

    def drained(others: list[int], positions: dict) -> pa.RecordBatch:
        seq, place = [*others, *(s for s, _ in positions.values())], [*others, *(p for _, p in positions.values())]
        return pa.record_batch([pa.array(seq, pa.int64()), pa.array(place, pa.int64()), pa.array([0] * len(others) + [1] * len(positions), pa.int32())], ["seq", "place", "group"])

    def run(batches):
        slot, others, positions = None, [], {}
        for batch in batches:
            for at, seq, mmsi, position in zip(*(batch.column(c).cast(pa.int64()).to_pylist() if c == "slot" else batch.column(c).to_pylist() for c in ("slot", "seq", "mmsi", "position"))):
                if at != slot:
                    yield drained(others, positions)
                    slot, others, positions = at, [], {}
                full = len(others) + len(positions) >= most
                if not position:
                    if not full:
                        others.append(seq)
                elif mmsi in positions:
                    positions[mmsi] = (seq, positions[mmsi][1])
                elif not full or positions:
                    if full:
                        del positions[next(iter(positions))]
                    positions[mmsi] = (seq, seq)
        yield drained(others, positions)

    return run


def accepted(events: DataFrame, keys: list[str], at: str = "occurred_at", order: str = "seq") -> DataFrame:
    """Events not older than every earlier arrival of their key: those that a newest-wins fold takes."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_top", F.max(at).over(before)).where(F.col("_top").isNull() | (F.col(at) >= F.col("_top"))).drop("_top")


def _last(column: str, when: Column) -> Column:
    return F.max_by(column, F.when(when & F.col(column).isNotNull(), F.col("seq")))


def shown_matches(matches: Column) -> Column:
    """The matches of known sources, as the live view has them."""
    known = F.filter(matches, lambda m: m["source"].isin(*LIVE_SOURCES))
    return F.transform(known, lambda m: F.struct(m["entity_id"].alias("id"), m["source"].alias("source"), m["name"].alias("entity_name"), m["match_method"].alias("match_method"), m["programs"].alias("programs")))


def live_view(events: DataFrame) -> DataFrame:
    """One row a vessel from position, static and enriched events (X2-X4 folded in order of arrival), with LIVE's columns.

    Each kind has its own newest-wins guard by occurred_at, for enriched events the
    time of the check; a name comes from the last accepted event that has one, of
    either kind. Without enriched events (columns status, vessel_id, matches) the
    sanctions are null.
    """
    rich_columns = {"status": "string", "vessel_id": "string", "matches": "array<struct<entity_id:string,source:string,name:string,match_method:string,programs:array<string>>>"}
    events = events.withColumns({c: F.lit(None).cast(t) for c, t in rich_columns.items() if c not in events.columns})
    taken = accepted(events, ["mmsi", "kind"]).withColumn("label", F.when(F.col("kind") == "position", F.col("ship_name")).when(F.col("kind") == "static", F.col("name")))
    pos, static, rich = (F.col("kind") == k for k in ("position", "static", "enriched"))
    check = F.max_by(F.struct("vessel_id", "status", "matches"), F.when(rich, F.col("seq"))).alias("check")
    folded = taken.groupBy("mmsi").agg(
        *[F.max_by(c, F.when(pos, F.col("seq"))).alias(c) for c in MOVEMENT],
        F.max(F.when(pos, F.col("occurred_at"))).alias("occurred_at"), F.max(F.when(pos, F.col("received_at"))).alias("last_seen_at"),
        _last("label", pos | static).alias("name"), *[_last(c, static).alias(c) for c in PROFILE],
        F.max(F.when(static, F.col("occurred_at"))).alias("static_occurred_at"), check, F.max(F.when(rich, F.col("occurred_at"))).alias("sanctions_checked_at"),
    )
    whole = folded.withColumns({"vessel_id": F.col("check.vessel_id"), "sanctions_status": F.col("check.status"), "sanctions_matches": shown_matches(F.col("check.matches"))})
    return whole.select(*[c.split()[0] for c in LIVE.split(", ")])


def fold_position(state: DataFrame, positions: DataFrame) -> DataFrame:
    """Known vessels (mmsi, occurred_at, last_seen_at, name, movement) with newer positions applied."""
    known = state.select("mmsi", F.col("occurred_at").alias("k_at"))
    fresh = accepted(positions, ["mmsi"]).join(known, "mmsi", "left").where("k_at is null or occurred_at >= k_at")
    new = fresh.groupBy("mmsi").agg(*[F.max_by(c, "seq").alias(f"n_{c}") for c in MOVEMENT], F.max("occurred_at").alias("n_occurred_at"), F.max("received_at").alias("n_seen"), F.max_by("ship_name", F.when(F.col("ship_name").isNotNull(), F.col("seq"))).alias("n_name"))
    moved = F.col("n_occurred_at").isNotNull()
    both = state.join(new, "mmsi", "full_outer")
    return both.select("mmsi", *[F.when(moved, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in MOVEMENT], F.coalesce("n_occurred_at", "occurred_at").alias("occurred_at"), F.greatest("last_seen_at", "n_seen").alias("last_seen_at"), F.coalesce("n_name", "name").alias("name"))


def fold_static(state: DataFrame, statics: DataFrame) -> DataFrame:
    """Known vessels (mmsi, static_occurred_at, name, profile) with newer static fields; unknown vessels get a row."""
    known = state.select("mmsi", F.col("static_occurred_at").alias("k_at"))
    fresh = accepted(statics, ["mmsi"]).join(known, "mmsi", "left").where("k_at is null or occurred_at >= k_at")
    fields = [*PROFILE, "name"]
    new = fresh.groupBy("mmsi").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"n_{c}") for c in fields], F.max("occurred_at").alias("n_at"))
    return state.join(new, "mmsi", "full_outer").select("mmsi", *[F.coalesce(f"n_{c}", c).alias(c) for c in fields], F.coalesce("n_at", "static_occurred_at").alias("static_occurred_at"))


def fold_enriched(state: DataFrame, enriched: DataFrame) -> DataFrame:
    """Known vessels (mmsi, vessel_id, sanctions_*) with checks that are not older; matches of known sources only, as structs."""
    known = state.select("mmsi", F.col("sanctions_checked_at").alias("k_at"))
    fresh = accepted(enriched, ["mmsi"], "checked_at").join(known, "mmsi", "left").where("k_at is null or checked_at >= k_at")
    new = fresh.withColumn("shown", shown_matches(F.col("matches"))).groupBy("mmsi").agg(F.max_by(F.struct("vessel_id", "status", "shown", "checked_at"), "seq").alias("n"))
    both = state.join(new, "mmsi", "full_outer")
    pick = lambda f, c: F.when(F.col("n").isNotNull(), F.col(f"n.{f}")).otherwise(F.col(c)).alias(c)
    return both.select("mmsi", pick("vessel_id", "vessel_id"), pick("status", "sanctions_status"), pick("shown", "sanctions_matches"), pick("checked_at", "sanctions_checked_at"))


SNAPSHOT_PROFILE = ["imo", "name", "call_sign", "ship_type"]


def fold_snapshot(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Snapshot rows joined into the live view, all of LIVE's columns; `rows` has a row a vessel.

    The row's id, the later last_seen_at, the movement if its occurred_at is not
    older, what it knows of the profile, and its sanctions if its check is not older.
    Destination, the static time and the matches are not in snapshots and stay.
    """
    s, r = state.alias("s"), rows.withColumn("_row", F.lit(True)).alias("r")
    both = s.join(r, "mmsi", "full_outer")
    newer = lambda c: F.col(f"r.{c}").isNotNull() & (F.col(f"s.{c}").isNull() | (F.col(f"r.{c}") >= F.col(f"s.{c}")))
    pick = lambda cond, c: F.when(cond, F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    chosen = {
        "vessel_id": pick(F.col("r._row"), "vessel_id"), "last_seen_at": F.greatest("r.last_seen_at", "s.last_seen_at"),
        **{c: pick(newer("occurred_at"), c) for c in (*MOVEMENT, "occurred_at")}, **{c: F.coalesce(f"r.{c}", f"s.{c}") for c in SNAPSHOT_PROFILE},
        **{c: pick(newer("sanctions_checked_at"), c) for c in ("sanctions_status", "sanctions_checked_at")},
    }
    return both.select(*[(chosen[c] if c in chosen else F.col("mmsi") if c == "mmsi" else F.col(f"s.{c}")).alias(c) for c in (x.split()[0] for x in LIVE.split(", "))])


def fold_detail(state: DataFrame, details: DataFrame) -> DataFrame:
    """Known vessels (mmsi, vessel_id, sanctions_*) with the sanctions of detail rows that are checked and not older; `details` has a row a vessel."""
    s, r = state.alias("s"), details.alias("r")
    newer = F.col("r.sanctions_checked_at").isNotNull() & (F.col("s.sanctions_checked_at").isNull() | (F.col("r.sanctions_checked_at") >= F.col("s.sanctions_checked_at")))
    both = s.join(r, "mmsi", "full_outer").where(newer | F.col("s.mmsi").isNotNull())
    return both.select("mmsi", *[F.when(newer, F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in ("vessel_id", "sanctions_status", "sanctions_checked_at", "sanctions_matches")])


def prune_stale(state: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """Vessels active within the age; a vessel without any time stays."""
    activity = F.coalesce("last_seen_at", "occurred_at", "static_occurred_at")
    return state.where(activity.isNull() | (micros_between(activity, now) <= max_age_hours * 3_600_000_000))


def rotation() -> Column:
    usable = lambda c: F.when(F.col(c).between(0, 359), F.col(c).cast("double"))
    return F.coalesce(usable("cog"), usable("true_heading"), F.lit(0.0))


def map_layer(state: DataFrame) -> DataFrame:
    return state.where("lon is not null and lat is not null").select("mmsi", "lon", "lat", rotation().alias("rotation"), ship_type_color(F.col("ship_type")).alias("color"), marker_shape(F.col("nav_status"), F.col("sog")).alias("marker"))
