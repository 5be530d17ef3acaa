"""Queries over substring containment, site overlap and map projection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.functions import utm as U
from plumeledger.operators import matching as M
from plumeledger.sources import fixtures as X


def _candidates(s, d):
    t = s.read.parquet(f"{d}/supplier.parquet")
    return t.select(F.concat(F.lit("R#00000"), (F.col("s_suppkey") * 7 % 90 + 10).cast("string")).alias("site"), (F.col("s_nationkey") + F.col("s_suppkey") % 3 * 30).alias("tile"))


def _train(s, d):
    t = s.read.parquet(f"{d}/customer.parquet")
    source = F.when(F.col("c_custkey") % 5 == 0, "data/synthetic").otherwise("data/real")
    return t.select(F.col("c_name").alias("crop"), F.col("c_nationkey").alias("tile"), source.alias("source"), (F.col("c_custkey") % 3).alias("label"))


def _utm(s, d):
    """Every site in its own zone, in zone 32 where that is near, and back."""
    near = F.when(F.col("lon").between(4, 14), 32).otherwise(U.zone_of(F.col("lon")))
    x = X.sites(s, d).select("site", "lat", "lon", U.to_utm(F.col("lat"), F.col("lon")).alias("own"), U.to_utm(F.col("lat"), F.col("lon"), near).alias("forced"))
    back = U.from_utm(F.col("own.easting"), F.col("own.northing"), F.col("own.zone"))
    x = x.withColumn("back", back)
    return x.select("site", "own.zone", F.round("own.easting", 2).alias("easting"), F.round("own.northing", 2).alias("northing"), F.round("forced.easting", 0).alias("easting_32"), F.round("forced.northing", 0).alias("northing_32"), F.round("back.lat", 7).alias("lat"), F.round("back.lon", 7).alias("lon"))


QUERIES = {
    "d8_site_overlap": lambda s, d: M.site_overlap(_candidates(s, d), _train(s, d)),
    "d8_overlap_matches": lambda s, d: M.overlap_matches(_candidates(s, d), _train(s, d)),
    "i2_utm": _utm,
}

_OVER = """, ca AS (SELECT DISTINCT 'R#00000' || (s_suppkey * 7 % 90 + 10) AS site, s_nationkey + s_suppkey % 3 * 30 AS tile FROM supplier),
tr AS (SELECT c_custkey, c_name AS crop, c_nationkey AS tile, CASE WHEN c_custkey % 5 = 0 THEN 'data/synthetic' ELSE 'data/real' END AS source, c_custkey % 3 AS label FROM customer),
ma AS (SELECT DISTINCT site, c_custkey, crop, source, label FROM ca JOIN tr ON ca.tile = tr.tile OR contains(lower(crop), lower(site)))"""


def _series(lat: str, lon: str, zone: str) -> tuple[str, str]:
    """Easting and northing by the older series in the eccentricity (powers of the distance from the meridian)."""
    e2 = U.FLATTENING * (2 - U.FLATTENING)
    ep2 = e2 / (1 - e2)
    p, c = f"radians({lat})", f"{ep2!r} * pow(cos(radians({lat})), 2)"
    n, t, a = f"({U.A!r} / sqrt(1 - {e2!r} * pow(sin({p}), 2)))", f"pow(tan({p}), 2)", f"(cos({p}) * radians({lon} - ({zone} * 6 - 183)))"
    m = f"{U.A!r} * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * {p} - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * {p}) + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * {p}) - {35 * e2**3 / 3072!r} * sin(6 * {p}))"
    east = f"500000 + 0.9996 * {n} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - {58 * ep2!r}) * pow({a}, 5) / 120)"
    north = f"0.9996 * ({m} + {n} * tan({p}) * (pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * pow({c}, 2)) * pow({a}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {330 * ep2!r}) * pow({a}, 6) / 720))"
    return east, north




SQL = {
    "d8_site_overlap": f"""{_OVER}, g AS (SELECT site, count(*) AS n, array_to_string(list_sort(list_distinct(list(CASE WHEN contains(source, 'synthetic') THEN 'synthetic_substrate' WHEN label = 1 THEN 'positive' WHEN label = 0 THEN 'negative' END))), ',') AS roles FROM ma GROUP BY site)
 SELECT site, n IS NOT NULL AS in_training, coalesce(roles, '') AS roles, coalesce(n, 0) AS n_crops FROM (SELECT DISTINCT site FROM ca) LEFT JOIN g USING (site)""",
    "d8_overlap_matches": f"{_OVER} SELECT site, crop, source, label FROM ma",
}
_E, _N = _series("lat", "lon", "zone")
_E32, _N32 = _series("lat", "lon", "near")
SQL["i2_utm"] = f", z AS (SELECT *, CAST(least(floor((lon + 180) / 6) + 1, 60) AS INTEGER) AS zone, CASE WHEN lon BETWEEN 4 AND 14 THEN 32 ELSE least(floor((lon + 180) / 6) + 1, 60) END AS near FROM v_sites) SELECT site, zone, round({_E}, 2) AS easting, round({_N}, 2) AS northing, round({_E32}, 0) AS easting_32, round({_N32}, 0) AS northing_32, round(lat, 7) AS lat, round(lon, 7) AS lon FROM z"
