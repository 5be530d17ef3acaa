"""Queries over soundings of a second sensor, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import soundings as S
from plumeledger.sources import fixtures as X

ORBITS = 24


def _soundings(s, d):
    """Order lines as soundings over the sites' region."""
    l = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    x = F.col("l_extendedprice").cast("double") % 100
    return l.select((F.col("l_orderkey") % ORBITS).cast("int").alias("orbit"), (45 + (F.col("l_partkey") * 13 % 1000) / 100.0).alias("lat"), (-5 + ((F.col("l_orderkey") * 29 + F.col("l_linenumber") * 531) % 2500) / 100.0).alias("lon"), F.when(F.col("l_suppkey") % 7 > 0, 1850 + x * 0.97137).alias("xch4"), ((F.col("l_partkey") + F.col("l_linenumber")) % 11 / 10.0).alias("qa"))


def _orbits(s, d):
    """An orbit every 29 hours."""
    o = s.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % ORBITS).cast("int").alias("orbit")).distinct()
    return o.select("orbit", F.timestamp_seconds(1_704_067_200 + F.col("orbit") * 104_400).alias("start"))


def _observations(s, d):
    """A scene of each site and day, at the site of that number."""
    return X.scores(s, d).groupBy("site", F.col("acq_date").alias("date")).agg(F.min("event_id").alias("id")).select("id", F.col("site").cast("long").alias("site"), "date")


def _pairs(s, d):
    return X.sites(s, d).select("site", F.explode(F.sequence(F.lit(0), F.lit(ORBITS - 1))).alias("orbit"))


QUERIES = {
    "c27_annulus_enhancement": lambda s, d: S.annulus_enhancement(_soundings(s, d), X.sites(s, d), _pairs(s, d)),
    "c28_box_enhancement": lambda s, d: S.box_enhancement(_soundings(s, d), X.sites(s, d), _pairs(s, d)),
    "d4_orbit_colocation": lambda s, d: S.orbit_colocation(_observations(s, d), _orbits(s, d), _soundings(s, d), X.sites(s, d)),
    "d15_dual_sensor_pairs": lambda s, d: S.dual_sensor_pairs(
        X.scores(s, d).select("event_id", F.col("site").cast("long").alias("site"), F.col("acq_date").alias("date")),
        S.orbit_colocation(_observations(s, d), _orbits(s, d), _soundings(s, d), X.sites(s, d)).join(_observations(s, d).hint("merge"), "id"),
    ),
}

_NEAR = f""", so AS (SELECT CAST(l_orderkey % {ORBITS} AS INTEGER) AS orbit, 45 + (l_partkey * 13 % 1000) / 100.0 AS lat, -5 + ((l_orderkey * 29 + l_linenumber * 531) % 2500) / 100.0 AS lon,
 CASE WHEN l_suppkey % 7 > 0 THEN 1850 + CAST(l_extendedprice AS DOUBLE) % 100 * 0.97137 END AS xch4, (l_partkey + l_linenumber) % 11 / 10.0 AS qa FROM lineitem),
pr AS (SELECT site, CAST(unnest(range({ORBITS})) AS INTEGER) AS orbit FROM v_sites),
nr AS (SELECT orbit, site, round(so.lat - s.lat, 9) AS dlat, round(so.lon - s.lon, 9) AS dlon, xch4, qa FROM so JOIN v_sites s ON abs(so.lat - s.lat) < 1.01 AND abs(so.lon - s.lon) < 1.01 WHERE abs(round(so.lat - s.lat, 9)) <= 1 AND abs(round(so.lon - s.lon, 9)) <= 1)"""
_RING = f"""{_NEAR}, v AS (SELECT *, sqrt(dlat * dlat + dlon * dlon) AS d FROM nr WHERE qa >= 0.5 AND xch4 IS NOT NULL),
g AS (SELECT orbit, site, min(d) AS d, first(xch4 ORDER BY d, dlat, dlon, xch4) AS x, count(*) FILTER (d BETWEEN 0.25 AND 1) AS n_bg, quantile_cont(xch4, 0.2) FILTER (d BETWEEN 0.25 AND 1) AS bg FROM v GROUP BY ALL),
e AS (SELECT orbit, site, x, bg, coalesce(n_bg, 0) AS n_bg, CASE WHEN d IS NULL OR d > 0.15 THEN 'swath_miss' WHEN n_bg < 10 THEN 'few_background' END AS error FROM pr LEFT JOIN g USING (orbit, site)),
an AS (SELECT orbit, site, CASE WHEN error IS NULL THEN round(x, 2) END AS site_xch4, CASE WHEN error IS NULL THEN round(bg, 2) END AS bg_xch4, CASE WHEN error IS NULL THEN round(x - bg, 2) END AS enhancement, n_bg, error FROM e)"""
_TRIED = f"""{_RING}, ob AS (SELECT site, acq_date AS date, min(event_id) AS id FROM v_scores GROUP BY ALL), orb AS (SELECT orbit, TIMESTAMP '2024-01-01' + to_seconds(orbit * 104400) AS "start" FROM (SELECT DISTINCT o_orderkey % {ORBITS} AS orbit FROM orders)),
ca AS (SELECT ob.id, ob.site, orb.orbit, NOT (hour("start") >= 11 AND hour("start") < 14) AS night, abs(epoch("start") - epoch(date::TIMESTAMP) - 45000) AS sec FROM ob JOIN orb ON CAST("start" AS DATE) BETWEEN date - 2 AND date + 2),
rk AS (SELECT id, ca.orbit, enhancement, error, row_number() OVER (PARTITION BY id ORDER BY night, sec, ca.orbit) AS k, count(*) OVER (PARTITION BY id) AS n FROM ca JOIN an ON an.orbit = ca.orbit AND an.site = ca.site),
st AS (SELECT id, coalesce(min(k) FILTER (error IS DISTINCT FROM 'swath_miss'), max(k)) AS k FROM rk GROUP BY id),
co AS (SELECT ob.id, rk.orbit, coalesce(rk.k, 0) AS n_tried, enhancement, CASE WHEN rk.k IS NULL THEN 'no_orbit' ELSE error END AS error FROM ob LEFT JOIN st ON st.id = ob.id LEFT JOIN rk ON rk.id = st.id AND rk.k = st.k)"""
_LEVEL = "CASE WHEN n0 >= 3 THEN {0} WHEN n1 >= 3 THEN {1} ELSE {2} END"
_L = lambda c: _LEVEL.format(*[c.replace("#", str(i)) for i in range(3)])
_AGG = ", ".join(f"count(*) FILTER (qa >= {q}) AS n{i}, quantile_cont(xch4, 0.5) FILTER (qa >= {q}) AS m{i}, " + ", ".join(f"count(*) FILTER (qa >= {q} AND away <= {r}) AS n{i}_{k}, avg(xch4) FILTER (qa >= {q} AND away <= {r}) AS m{i}_{k}" for k, r in enumerate(S.RADII)) for i, q in enumerate(S.LEVELS))

SQL = {
    "c27_annulus_enhancement": f"{_RING} SELECT * FROM an",
    "c28_box_enhancement": f"""{_NEAR}, w AS (SELECT *, greatest(abs(dlat), abs(dlon)) AS away FROM nr), g AS (SELECT orbit, site, max(qa) AS top, {_AGG} FROM w GROUP BY ALL),
 h AS (SELECT orbit, site, top, {_LEVEL.format(0.5, 0.3, 0.0)} AS qa_level, coalesce({_L("n#")}, 0) AS n_box, {_L("m#")} AS background, {", ".join(f"{_L(f'{c}#_{k}')} AS {c}_{k}" for c in "nm" for k in range(3))} FROM pr LEFT JOIN g USING (orbit, site)),
 i AS (SELECT *, CASE WHEN n_0 >= 1 THEN 0.3 WHEN n_1 >= 1 THEN 0.5 WHEN n_2 >= 1 THEN 0.75 END AS radius, CASE WHEN n_0 >= 1 THEN n_0 WHEN n_1 >= 1 THEN n_1 WHEN n_2 >= 1 THEN n_2 END AS n_near, CASE WHEN n_0 >= 1 THEN m_0 WHEN n_1 >= 1 THEN m_1 WHEN n_2 >= 1 THEN m_2 END AS near_mean FROM h),
 j AS (SELECT *, CASE WHEN n_box = 0 THEN 'orbit_miss' WHEN top < 0.01 THEN 'cloudy' WHEN radius IS NULL THEN 'no_near_pixels' END AS error FROM i)
 SELECT orbit, site, CASE WHEN error IS NULL OR error = 'no_near_pixels' THEN round(background, 2) END AS background, CASE WHEN error IS NULL THEN round(near_mean, 2) END AS near_mean, CASE WHEN error IS NULL THEN round(near_mean - background, 2) END AS enhancement, n_box,
 CASE WHEN error IS NULL THEN n_near ELSE 0 END AS n_near, CASE WHEN error IS NULL THEN radius END AS radius, CASE WHEN error IS NULL THEN qa_level END AS qa_level, CASE WHEN error IS NULL THEN near_mean - background >= 10 END AS validated, error FROM j""",
    "d4_orbit_colocation": f"{_TRIED} SELECT * FROM co",
    "d15_dual_sensor_pairs": f"{_TRIED}, se AS (SELECT ob.site, ob.date, max(enhancement) AS e FROM co JOIN ob USING (id) GROUP BY ALL) SELECT event_id, v.site, acq_date AS date, e AS second_enhancement, e IS NOT NULL AS has_second FROM v_scores v LEFT JOIN se ON se.site = v.site AND se.date = v.acq_date",
}
