"""Queries over unit conversions, geometry text, directions and unmatched keys, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.functions import scalars as S
from plumeledger.sources import fixtures as X

CHARGE_PER_TONNE = 1500


def _bounds(s, d):
    q = F.col("sc_cfar") * 100
    source = F.when(F.col("event_id") % 7 == 0, "fallback").otherwise("ERA5")
    part = S.uncertainty_pct(source) / 100.0
    hundredths = lambda x: F.floor(x * 100 + 0.5) / 100  # noqa: E731  half up on the scaled value
    return X.scores(s, d).select("event_id", hundredths(q * (1 - part)).alias("low"), hundredths(q * (1 + part)).alias("high"))


def _charges(s, d):
    t = S.annual_tonnes(F.col("sc_cfar") * 100)
    return X.scores(s, d).where("cfar_detect").groupBy("site").agg(F.round(F.max(t), 3).alias("tonnes"), F.round(F.max(t) * CHARGE_PER_TONNE, 0).alias("charge"))


def _mean_direction(s, d):
    w = X.wind(s, d).where("u <> 0 or v <> 0")
    direction = S.wind_direction(F.col("u"), F.col("v"))
    return w.groupBy((F.col("event_id") % 10).alias("site")).agg(F.round(S.circular_mean(direction), 3).alias("mean_dir"))


def _unmatched(s, d):
    known = X.sites(s, d).where("site % 4 = 0").select("ticker").distinct()
    return X.exposures(s, d).select("ticker").distinct().join(known.hint("shuffle_hash"), "ticker", "left_anti")


QUERIES = {
    "i9_flow_bounds": _bounds,
    "i11_annual_charge": _charges,
    "i8_mean_direction": _mean_direction,
    "i4_site_box": lambda s, d: X.sites(s, d).select("site", S.box_text(F.col("lat"), F.col("lon"), 0.25).alias("box")),
    "h4_unmatched_tickers": _unmatched,
}

_DIR = "((degrees(atan2(-u, -v)) % 360) + 360) % 360"
_N = "printf('%.4f', {})"
_W, _E, _S, _NO = (_N.format(x) for x in ("lon - 0.25::DOUBLE", "lon + 0.25::DOUBLE", "lat - 0.25::DOUBLE", "lat + 0.25::DOUBLE"))

SQL = {
    "i9_flow_bounds": " SELECT event_id, floor(sc_cfar * 100 * (1 - p) * 100 + 0.5::DOUBLE) / 100 AS low, floor(sc_cfar * 100 * (1 + p) * 100 + 0.5::DOUBLE) / 100 AS high FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS p FROM v_scores)",
    "i11_annual_charge": " SELECT site, round(max(sc_cfar * 100 * 8760 / 1000), 3) AS tonnes, round(max(sc_cfar * 100 * 8760 / 1000) * 1500, 0) AS charge FROM v_scores WHERE cfar_detect GROUP BY site",
    "i8_mean_direction": f", a AS (SELECT event_id % 10 AS site, radians({_DIR}) AS r FROM v_wind WHERE u <> 0 OR v <> 0) SELECT site, round(((degrees(atan2(avg(sin(r)), avg(cos(r)))) % 360) + 360) % 360, 3) AS mean_dir FROM a GROUP BY site",
    "i4_site_box": f" SELECT site, 'POLYGON((' || {_W} || ' ' || {_S} || ',' || {_E} || ' ' || {_S} || ',' || {_E} || ' ' || {_NO} || ',' || {_W} || ' ' || {_NO} || ',' || {_W} || ' ' || {_S} || '))' AS box FROM v_sites",
    "h4_unmatched_tickers": " SELECT DISTINCT ticker FROM v_exposures WHERE ticker NOT IN (SELECT ticker FROM v_sites WHERE site % 4 = 0)",
}
