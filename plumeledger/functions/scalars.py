"""Scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees the wind comes from."""
    return F.pmod(270 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def angular_difference(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def cloud_quality(cloud: Column) -> Column:
    return F.when(cloud.isNull(), "unknown").when(cloud <= 10, "optimal").when(cloud <= 30, "acceptable").otherwise("poor")


def wind_regime(speed: Column) -> Column:
    return F.when(speed.isNull(), "unknown").when(speed < 3, "low").when(speed >= 7, "high").otherwise("moderate")


def strength_label(sc: Column) -> Column:
    return F.when(sc >= 1.5, "strong").when(sc >= 1.1, "elevated").when(sc >= 0.9, "neutral").otherwise("suppressed")


def wilson(k: Column, n: Column, z: float = 1.645) -> tuple[Column, Column]:
    """Bounds of a proportion, clipped to 0..1; (0, 0) for n = 0."""
    p, zz = k / F.nullif(n, F.lit(0)), z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    empty = n == 0
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), centre + half))


def risk_tier(n_valid: Column, p: Column) -> Column:
    return F.when(n_valid == 0, "NO_DATA").when(p >= 0.6, "HIGH").when(p >= 0.3, "MEDIUM").when(p > 0, "LOW").otherwise("UNDETECTED")


def logistic(x: Column, k: float, x0: float) -> Column:
    return 1 / (1 + F.exp(-k * (x - x0)))


def flow_kgh(mass_kg: Column, length_m: Column, wind_ms: Column) -> Column:
    return mass_kg / (length_m / F.greatest(wind_ms, F.lit(0.5))) * 3600


def uncertainty_pct(wind_source: Column) -> Column:
    """Per cent of a flow rate that is uncertain: 30 where the wind is reanalysis, else, and where it is unknown, 50."""
    return F.when(F.lower(wind_source).contains("era5"), 30.0).otherwise(50.0)


def annual_tonnes(kg_per_hour: Column) -> Column:
    return kg_per_hour * 8760 / 1000


def circular_mean(degrees: Column) -> Column:
    """Aggregate: the mean direction in [0, 360); null without rows."""
    r = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def box_text(lat: Column, lon: Column, half: float) -> Column:
    """The closed polygon, as text, of half degrees around a point; null where a coordinate is."""
    w, e, s, n = (F.format_number(x, 4) for x in (lon - half, lon + half, lat - half, lat + half))
    corner = lambda x, y: F.concat(x, F.lit(" "), y)
    ring = [F.lit("POLYGON(("), corner(w, s), F.lit(","), corner(e, s), F.lit(","), corner(e, n), F.lit(","), corner(w, n), F.lit(","), corner(w, s), F.lit("))")]
    return F.concat(*ring)
