"""Queries of governance, portfolios, inventories and months of several sensors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import detection as D
from plumeledger.operators import portfolios as P
from plumeledger.plans import risk as plans_risk
from plumeledger.sources import fixtures as X

DRAWS = 500


def _governed(s, d):
    k, e = F.col("cloud"), F.col("event_id")
    x = X.scores(s, d).select(
        "event_id", F.when(e % 7 == 0, "Climatological_3.5ms").otherwise("ERA5_reanalysis").alias("wind_source"), F.when(k % 5 > 0, (k % 13 - 6).cast("double")).alias("era5_offset_h"), (e % 5 == 0).alias("bitemporal_missing"),
        F.when(k % 4 > 0, k % 24).alias("cloud"), F.when(e % 19 == 0, "cloudy").alias("cloud_quality"), (F.col("sc_cfar") * 8).alias("solar_zenith"), F.when(e % 3 == 0, (k % 4 * 10 + 10).cast("double")).alias("sigma_wind"),
        F.lit(None).cast("double").alias("sigma_coeff"), F.when(e % 6 == 0, F.lit(float("nan"))).when(e % 2 == 0, k % 3 * 5.0).alias("sigma_mask"), (k % 2 * 4.0).alias("sigma_background"), F.when(k % 8 > 0, F.col("sc_cfar") * 97.137).alias("flow"),
    )
    return P.inflated(P.degradation(x), DRAWS)


def _governance(s, d):
    g, b = _governed(s, d), F.col("governance_inflated")
    i = F.col("input_degradation")
    return g.select(
        "event_id", F.array_join(i["flags"], ",").alias("flags"), i["delta_sigma_wind_pp"].alias("d_wind"), i["delta_sigma_mask_pp"].alias("d_mask"), i["delta_sigma_coeff_pp"].alias("d_coeff"), "exclude_from_aggregates", "governance_sigma_inflated",
        *[b[f"effective_{c}"].alias(c) for c in P.DEFAULTS], b["mc_pct"].alias("mc_pct"), b["quad_pct"].alias("quad_pct"), b["p5"].alias("p5"), b["p95"].alias("p95"), b["lo"].alias("lo"), b["hi"].alias("hi"),
    )


def _members(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    tickers = n.select(F.explode(F.array(F.col("n_name"), F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")))).alias("ticker"))  # the second ones are unknown, or null
    sites = X.sites(s, d).select("ticker", (F.col("site") % 13).alias("site"))
    return P.portfolio_members(tickers, sites, D.site_risk(X.scores(s, d)))


def _nested(s, d):
    b = P.portfolio_by_ticker(_members(s, d), nested=True)
    text = F.concat_ws(" ", F.transform("sites", lambda x: F.concat_ws(":", x["site"].cast("string"), x["tier"], F.coalesce(x["eur"].cast("long").cast("string"), F.lit("-")))))
    return b.withColumn("sites", text)


def _flows(s, d):
    m = X.scores(s, d).groupBy("site", F.trunc("acq_date", "month").alias("month")).agg((F.avg("sc_cfar") * 100).alias("flow"))
    o = s.read.parquet(f"{d}/orders.parquet")
    i = o.where("o_orderstatus <> 'P'").select(F.concat(F.lit("list "), F.col("o_orderstatus")).alias("name"), (F.col("o_custkey") % 8).alias("site"), F.make_date(F.lit(2024), F.month("o_orderdate") % 2 + 1, F.lit(7)).alias("month"), (F.col("o_totalprice").cast("double") / 1e5).alias("tonnes"))
    return P.flow_against_inventory(m, i).select("site", "month", "name", *[F.round(c, 4).alias(c) for c in ("tonnes", "low", "high", "inventory", "ratio")], "within")


def _co_detected(s, d):
    x = X.scores(s, d)
    days = lambda w: x.where(w).select("site", F.date_add("acq_date", (F.col("event_id") % 90).cast("int")).alias("day"))
    return P.co_detected_months(days("cfar_detect and sc_cfar > 4"), days("cloud > 90"), days("cv > 1.5 and cloud < 40"))


QUERIES = {
    "b18_governance": _governance,
    "e7_portfolio_members": _members,
    "e7_portfolio_nested": _nested,
    "e7_portfolio_total": lambda s, d: P.portfolio_total(P.portfolio_by_ticker(_members(s, d))),
    "d19_flow_against_inventories": _flows,
    "h3_co_detected_by_month": _co_detected,
}

_E = ("e0", "e1", "e2", "e3")
SQL = {
    "b18_governance": f""", x AS (SELECT event_id, event_id % 7 = 0 AS fb, cloud % 5 > 0 AND abs(cloud % 13 - 6) > 4 AS st, event_id % 5 = 0 AS mi, (cloud % 4 > 0 AND cloud % 24 > 15) OR event_id % 19 = 0 AS cl, sc_cfar * 8 > 70 AS su, cloud, CASE WHEN cloud % 8 > 0 THEN sc_cfar * 97.137::DOUBLE END AS flow FROM v_scores),
 y AS (SELECT *, array_to_string([f FOR f IN [CASE WHEN fb THEN 'WIND_FALLBACK' END, CASE WHEN mi THEN 'BITEMPORAL_MISSING' END, CASE WHEN cl THEN 'CLOUD_FRACTION_HIGH' END, CASE WHEN su THEN 'SOLAR_ZENITH_EXTREME' END, CASE WHEN st THEN 'ERA5_STALE' END] IF f IS NOT NULL], ',') AS flags,
 CASE WHEN fb THEN 30.0 WHEN st THEN 10.0 ELSE 0.0 END::DOUBLE AS d_wind, CASE WHEN mi THEN 15.0 ELSE 0.0 END::DOUBLE AS d_mask, CASE WHEN su THEN 5.0 ELSE 0.0 END::DOUBLE AS d_coeff, fb OR st OR mi OR cl OR su AS inf FROM x),
 z AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN cloud % 4 * 10 + 10 ELSE 20 END + d_wind AS e0, 15 + d_coeff AS e1, CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 2 = 0 THEN cloud % 3 * 5 ELSE 0 END + d_mask AS e2, (cloud % 2 * 4)::DOUBLE AS e3 FROM y),
 dr AS (SELECT *, {", ".join(f"{plans_risk._u('i', str(k))} AS u{k}" for k in range(4))} FROM (SELECT DISTINCT e0, e1, e2, e3 FROM z WHERE inf), (SELECT unnest(range({DRAWS})) AS i)),
 fa AS (SELECT *, {" * ".join(f"greatest(0.01, 1 + {e} / 100 * {plans_risk._z(f'u{k}')})" for k, e in enumerate(_E))} AS f FROM dr),
 g AS (SELECT e0, e1, e2, e3, round(100 * stddev_samp(f) / avg(f), 1) AS mc_pct, round(quantile_cont(f, 0.05), 4) AS p5, round(quantile_cont(f, 0.95), 4) AS p95 FROM fa GROUP BY ALL)
 SELECT event_id, coalesce(flags, '') AS flags, d_wind, d_mask, d_coeff, cl AS exclude_from_aggregates, inf AS governance_sigma_inflated, CASE WHEN inf THEN round(z.e0, 1) END AS sigma_wind, CASE WHEN inf THEN round(z.e1, 1) END AS sigma_coeff, CASE WHEN inf THEN round(z.e2, 1) END AS sigma_mask, CASE WHEN inf THEN round(z.e3, 1) END AS sigma_background,
 mc_pct, CASE WHEN inf THEN round(sqrt(z.e0 * z.e0 + z.e1 * z.e1 + z.e2 * z.e2 + z.e3 * z.e3), 1) END AS quad_pct, p5, p95, CASE WHEN flow > 0 THEN round(flow * p5, 2) END AS lo, CASE WHEN flow > 0 THEN round(flow * p95, 2) END AS hi
 FROM z LEFT JOIN g ON inf AND g.e0 = z.e0 AND g.e1 = z.e1 AND g.e2 = z.e2 AND g.e3 = z.e3""",
    "d19_flow_against_inventories": """, m AS (SELECT site, date_trunc('month', acq_date)::DATE AS month, avg(sc_cfar) * 100 * 24 * day(last_day(any_value(acq_date))) / 1000 AS t FROM v_scores GROUP BY 1, 2),
 i AS (SELECT 'list ' || o_orderstatus AS name, o_custkey % 8 AS site, make_date(2024, month(o_orderdate) % 2 + 1, 1) AS month, sum(o_totalprice::DOUBLE / 1e5) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3)
 SELECT m.site, m.month, name, round(t, 4) AS tonnes, round(t * 0.7::DOUBLE, 4) AS low, round(t * 1.3::DOUBLE, 4) AS high, round(v, 4) AS inventory, round(t / v, 4) AS ratio, v BETWEEN t * 0.7::DOUBLE AND t * 1.3::DOUBLE AS within FROM m LEFT JOIN i ON i.site = m.site AND i.month = m.month""",
    "h3_co_detected_by_month": """, x AS (SELECT *, date_trunc('month', acq_date + CAST(event_id % 90 AS INTEGER))::DATE AS month FROM v_scores)
 SELECT site, month FROM x WHERE cfar_detect AND sc_cfar > 4 INTERSECT SELECT site, month FROM x WHERE cloud > 90 INTERSECT SELECT site, month FROM x WHERE cv > 1.5 AND cloud < 40""",
}
_LIST = "['HIGH_DUAL_SENSOR', 'HIGH', 'MEDIUM', 'LOW', 'UNDETECTED', 'NO_DATA']"
_COLS = ("t_co2e", "t_lo", "t_hi", "eur", "eur_lo", "eur_hi")


def finish(site_risk_sql: str) -> None:
    """The portfolio's SQL builds on that of the site risk."""
    me = f""", ri AS ({site_risk_sql.replace(", g AS (", "WITH g AS (", 1)}), ti AS (SELECT DISTINCT ticker FROM (SELECT n_name AS ticker FROM nation UNION ALL SELECT lower(n_name) FROM nation WHERE n_nationkey % 4 = 0)),
 me AS (SELECT ti.ticker, s.site, CASE WHEN s.site IS NOT NULL THEN coalesce(tier, 'NO_DATA') END AS tier, n_valid, p, {", ".join(_COLS)} FROM ti LEFT JOIN (SELECT DISTINCT ticker, site % 13 AS site FROM v_sites) s USING (ticker) LEFT JOIN ri ON ri.site = s.site)"""
    sums = ", ".join(f"round(sum(coalesce({c}, 0.0)), {0 if c.startswith('eur') else 1}) AS {c}" for c in _COLS)
    SQL["e7_portfolio_members"] = f"{me} SELECT * FROM me"
    SQL["e7_portfolio_nested"] = f"""{me} SELECT ticker, count(site) AS n_sites, {sums}, coalesce(string_agg(site || ':' || tier || ':' || coalesce(CAST(CAST(eur AS BIGINT) AS VARCHAR), '-'), ' ' ORDER BY site), '') AS sites,
 {_LIST}[min(CASE WHEN site IS NOT NULL THEN list_position({_LIST}, tier) END)] AS tier, count(site) > 0 AS matched FROM me GROUP BY ticker"""
    SQL["e7_portfolio_total"] = f"""{me}, b AS (SELECT ticker, count(site) > 0 AS matched, {sums} FROM me GROUP BY ticker)
 SELECT count(*) AS n_tickers, count(*) FILTER (NOT matched) AS n_unmatched, round(100 * count(*) FILTER (matched) / count(*)::DOUBLE, 1) AS coverage_pct, {sums} FROM b"""
