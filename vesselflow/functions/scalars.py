"""Column expressions of the telemetry domain; all stay in generated JVM code."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship type categories in order of precedence, with colour and code ranges.
SHIP_CATEGORIES = (
    ("Cargo", "#2ECC71", ((70, 79),)),
    ("Tanker", "#E53935", ((80, 89),)),
    ("Passenger", "#3498DB", ((60, 69),)),
    ("Fishing", "#E67E22", ((30, 30),)),
    ("Military / Law Enf.", "#8E44AD", ((35, 35), (55, 55))),
    ("Tug / Service", "#1ABC9C", ((31, 34), (50, 54), (56, 59))),
    ("High Speed / WIG", "#F1C40F", ((20, 29), (40, 49))),
    ("Sailing / Pleasure", "#FF4FC3", ((36, 37),)),
)
OTHER_CATEGORY, OTHER_COLOR = "Unknown / Other", "#95A5A6"

# Ship type labels by code range.
SHIP_LABELS = (
    (20, 29, "Wing in Ground"), (40, 49, "High Speed Craft"), (60, 69, "Passenger"), (70, 79, "Cargo"), (80, 89, "Tanker"), (90, 99, "Other"),
    (30, 30, "Fishing"), (31, 32, "Towing"), (33, 33, "Dredging / Underwater Ops"), (34, 34, "Diving Ops"), (35, 35, "Military Ops"),
    (36, 36, "Sailing"), (37, 37, "Pleasure Craft"), (50, 50, "Pilot Vessel"), (51, 51, "SAR Vessel"), (52, 52, "Tug"), (53, 53, "Port Tender"),
    (54, 54, "Anti-Pollution"), (55, 55, "Law Enforcement"), (56, 57, "Local Vessel"), (58, 58, "Medical Transport"), (59, 59, "Non-combatant"),
)

# Navigation status labels by code, and the short forms of some.
NAV_LABELS = (
    "Under way (engine)", "At anchor", "Not under command", "Restricted manoeuvrability", "Constrained by draught", "Moored", "Aground",
    "Engaged in fishing", "Under way sailing", "Reserved (HSC)", "Reserved (WIG)", "Towing astern", "Pushing ahead / towing alongside",
    "Reserved", "AIS-SART / MOB-AIS / EPIRB-AIS", "Undefined",
)
NAV_SHORT = {
    0: "Underway", 1: "Anchored", 2: "NUC", 3: "Restricted", 4: "Constrained", 7: "Fishing", 8: "Sailing", 12: "Pushing", 14: "AIS-SART",
}

# Sanctions status labels.
SANCTIONS_LABELS = {"clear": "No match", "candidate": "Candidate", "sanctioned": "Sanctioned"}
DASH = "—"
EARTH_RADIUS_M = 6378137.0


def chain(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The first case that holds, in order."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)


def _in(code: Column, ranges) -> Column:
    return reduce(lambda a, b: a | b, [code.between(lo, hi) for lo, hi in ranges])


def ship_type_category(code: Column) -> Column:
    return chain([(_in(code, r), F.lit(name)) for name, _, r in SHIP_CATEGORIES], F.lit(OTHER_CATEGORY))


def ship_type_color(code: Column) -> Column:
    return chain([(_in(code, r), F.lit(color)) for _, color, r in SHIP_CATEGORIES], F.lit(OTHER_COLOR))


def ship_type_label(code: Column) -> Column:
    return chain([(code.isNull(), F.lit(DASH)), *[(code.between(lo, hi), F.lit(name)) for lo, hi, name in SHIP_LABELS]], F.lit("Unknown"))


def nav_status_label(code: Column) -> Column:
    known = F.element_at(F.array(*[F.lit(x) for x in NAV_LABELS]), code.cast("int") + 1)
    return F.when(code.isNull(), DASH).when(code.between(0, len(NAV_LABELS) - 1), known).otherwise("Unknown")


def nav_status_short(code: Column) -> Column:
    return chain([(code == k, F.lit(v)) for k, v in NAV_SHORT.items()], nav_status_label(code))


def marker_shape(nav: Column, sog: Column) -> Column:
    """A circle for moored, anchored or grounded vessels, and for slow ones of unknown status."""
    still = nav.isin(1, 5, 6) | ((nav.isNull() | (nav == 15)) & (sog <= 0.3))
    return F.when(still, "circle").otherwise("arrow")


def micros_between(a: Column, b: Column) -> Column:
    """b - a in microseconds."""
    return F.timestamp_diff("MICROSECOND", a, b)


def age_label(at: Column, now: Column) -> Column:
    minutes = F.floor(micros_between(at, now) / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(at.isNull(), DASH).when(at > now, "just now").when(minutes < 1, "< 1 min ago").when(minutes < 60, text(minutes, "min")).when(hours < 24, text(hours, "h")).otherwise(text(days, "d"))
    )


def sanctions_label(status: Column) -> Column:
    return chain([(status == k, F.lit(v)) for k, v in SANCTIONS_LABELS.items()], F.lit("Unchecked"))


def to_lat_lon_corners(box: dict) -> Column:
    """[[min lat, min lon], [max lat, max lon]] of a box with the keys west, south, east, north."""
    return F.array(F.array(F.lit(box["south"]), F.lit(box["west"])), F.array(F.lit(box["north"]), F.lit(box["east"])))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH_RADIUS_M, F.ln(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * EARTH_RADIUS_M


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_RADIUS_M), F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS_M)) - F.lit(1.5707963267948966))


def parse_provider_ts(text: Column) -> Column:
    """A provider's UTC time; the fraction is cut to milliseconds; anything else is null."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:\.(\d+))?"
    fraction = F.rpad(F.substring(F.regexp_extract(text, pattern, 2), 1, 3), 3, "0")
    return F.concat(F.regexp_extract(text, pattern, 1), F.lit("."), fraction).try_cast("timestamp_ntz")


def clean_string(text: Column, length: int) -> Column:
    """Without white space and @ at both ends, cut to `length`; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\s@]+$", ""), r"^[\s@]+", "")
    return F.nullif(F.substring(bare, 1, length), F.lit(""))


def dimensions_or_null(*parts: Column) -> list[Column]:
    """Four dimensions; all zero means unknown."""
    unknown = reduce(lambda a, b: a & b, [F.coalesce(p == 0, F.lit(False)) for p in parts])
    return [F.when(~unknown, p) for p in parts]


def point_in_bbox(lat: Column, lon: Column, box: dict) -> Column:
    return lon.between(box["west"], box["east"]) & lat.between(box["south"], box["north"])


def normalize_name_ascii(name: Column) -> Column:
    """Lower case, runs of other characters as one space, trimmed; null is empty. Exact for ASCII names."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def normalize_name(name: Column) -> Column:
    """The same after compatibility decomposition without combining marks; ASCII names skip Python."""
    @F.pandas_udf("string")
    def plain(names: pd.Series) -> pd.Series:
        return names.str.normalize("NFKD").str.replace("[̀-ͯ]", "", regex=True)

    ascii_only = F.coalesce(name, F.lit("")).rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, normalize_name_ascii(name)).otherwise(normalize_name_ascii(plain(F.when(~ascii_only, name))))


def profile_hash(imo: Column, name: Column) -> Column:
    """First 16 hex digits of the sha1 of the profile as JSON, the name normalised."""
    text = F.concat(F.lit('{"imo":"'), F.coalesce(imo, F.lit("")), F.lit('","name":"'), normalize_name(name), F.lit('"}'))
    return F.substring(F.sha1(text), 1, 16)


def trace_id(*key: Column) -> Column:
    """A UUID-shaped id that depends on the key alone, so that a task that runs again agrees."""
    h = F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def ms_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS")
