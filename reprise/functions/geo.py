"""Coordinates read from stamped text and distances between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------------
EARTH_RADIUS_M = 6371000.0
RADIUS_M = 50.0
SUSPECT_M = 5000.0
REPAIR_LIMIT_M = 1000.0
LAT_MIN, LAT_MAX = -34.0, 5.5
LON_MIN, LON_MAX = -74.0, -34.0
LAT_REACH, LON_REACH = 34.0, 74.0
LOST_TENS = (10, 20, 30, 40, 50, 60, 70)
COORDINATE_PATTERN = (
    r"(?i)(-?\d{1,2}[.,]\d{3,})\s*°?\s*([SN])?[^\d+-]{1,4}(-?\d{1,3}[.,]\d{3,})\s*°?\s*([WOE])?"
)
INSIDE, OUTSIDE, SUSPECT = "dentro", "fora", "suspeita"
# ----------------------------------------------------------------------------------------------------------------------


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = (
        F.pow(F.sin((p2 - p1) / 2), 2.0)
        + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2.0)
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def extract_coordinate(text: Column) -> Column:
    """First match that lies in the country box, as struct(lat, lon); null when there is none.

    Bound to lambda variables, the text and the matches are worked out once; as plain columns Spark would do so anew for every
    mention of them.
    """
    return F.get(F.transform(F.array(text), _first_point), F.lit(0))


def _first_point(text: Column) -> Column:
    pattern = F.lit(COORDINATE_PATTERN)
    found = F.arrays_zip(
        *[F.regexp_extract_all(text, pattern, F.lit(g)).alias(n) for g, n in enumerate(("la", "ns", "lo", "we"), 1)]
    )

    def number(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")

    def signed(value: Column, hemisphere: Column, negative: str, reach: float) -> Column:
        by_letter = F.when((hemisphere != "") & F.upper(hemisphere).isin(*negative), -F.abs(value)).otherwise(value)
        return F.when((by_letter > 0) & (by_letter <= reach), -by_letter).otherwise(by_letter)

    points = F.transform(
        found,
        lambda m: F.struct(
            signed(number(m["la"]), m["ns"], "S", LAT_REACH).alias("lat"),
            signed(number(m["lo"]), m["we"], "WO", LON_REACH).alias("lon"),
        ),
    )
    valid = F.filter(points, lambda p: p["lat"].between(LAT_MIN, LAT_MAX) & p["lon"].between(LON_MIN, LON_MAX))
    rounded = F.transform(F.slice(valid, 1, 1), lambda p: F.struct(F.bround(p["lat"], 6).alias("lat"), F.bround(p["lon"], 6).alias("lon")))
    return F.get(rounded, F.lit(0))


def repair_digit(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column) -> Column:
    """Put back a lost tens digit when that lands within a kilometre of the centre.

    A reading already closer than the acceptance limit is left alone: every candidate lies ten degrees or more away from
    it, so none can be closer.
    """
    steps = F.array(*[
        F.struct(F.lit(axis * 10 + i).alias("rank"), F.lit(t * (1 - axis)).alias("la"), F.lit(t * axis).alias("lo"))
        for axis in (0, 1) for i, t in enumerate(LOST_TENS)
    ])
    moved = F.filter(
        F.transform(steps, lambda s: F.struct(
            s["rank"].alias("rank"), F.when(s["la"] > 0, -(F.abs(lat) + s["la"])).otherwise(lat).alias("lat"),
            F.when(s["lo"] > 0, -(F.abs(lon) + s["lo"])).otherwise(lon).alias("lon"))),
        lambda c: F.when(c["rank"] < 10, F.abs(c["lat"]) <= LAT_REACH).otherwise(F.abs(c["lon"]) <= LON_REACH),
    )
    ranked = F.transform(moved, lambda c: F.struct(
        haversine_m(centre_lat, centre_lon, c["lat"], c["lon"]).alias("d"), c["rank"], c["lat"].alias("lat"),
        c["lon"].alias("lon")))
    kept = F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(False).alias("reparado"))
    best = F.transform(F.array(F.array_min(ranked)), lambda b: F.when(
        F.coalesce(b["d"] < REPAIR_LIMIT_M, F.lit(False)),
        F.struct(b["lat"].alias("lat"), b["lon"].alias("lon"), F.lit(True).alias("reparado"))).otherwise(kept))
    far = haversine_m(centre_lat, centre_lon, lat, lon) >= REPAIR_LIMIT_M
    return F.when(far, F.get(best, F.lit(0))).otherwise(kept)


def situation(distance: Column, radius_m: float = RADIUS_M) -> Column:
    return F.when(distance > SUSPECT_M, SUSPECT).when(distance > radius_m, OUTSIDE).otherwise(INSIDE)
