"""Queries over owners, write-back, summaries, rankings, difference retrieval and crops, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import detection as D
from plumeledger.operators import joins as J
from plumeledger.operators import reports as R
from plumeledger.operators import retrievals as T
from plumeledger.operators import soundings as N
from plumeledger.plans.soundings import ORBITS, _soundings
from plumeledger.sources import fixtures as X

#: Thresholds of the scan, and what a background and a plume need in test scenes of 8 x 8 pixels.
SCAN = [0.01, 0.026, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
FEW_BACKGROUND, FEW_PLUME = 8, 4
TAU = 2.5
BOX = (47.0, 0.0, 52.0, 10.0)
#: Boxes of soundings: west, south, east, north.
EAST, WEST = (6.0, 46.0, 18.0, 54.0), (-4.0, 46.0, 5.0, 54.0)


def _owners(s, d):
    """Customers as assets: the owner is the nation's name in one of three spellings, or none, or unknown."""
    c, n = s.read.parquet(f"{d}/customer.parquet"), s.read.parquet(f"{d}/nation.parquet")
    j = c.join(n.hint("merge"), c.c_nationkey == n.n_nationkey)
    k = F.col("c_custkey") % 5
    owner = F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit(" "), F.lower("n_name"))).when(k == 2, F.lit("Nobody Ltd")).otherwise(F.col("n_name"))
    return j.select("c_custkey", owner.alias("owner"))


def _entities(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    return n.select(F.col("n_name").alias("owner"), F.concat(F.lit("Op "), "n_name").alias("operator"), F.substring("n_name", 1, 4).alias("ticker"), F.concat(F.lit("X"), F.col("n_regionkey").cast("string")).alias("exchange"))


def _written_back(s, d):
    """Scenes as records, with results of wind events: of a user's day the last ok one."""
    x = X.scores(s, d)
    rec = x.select(F.col("event_id").alias("scene_id"), "site")
    k = F.col("cloud")
    res = x.where("event_id % 3 > 0").select(F.expr("event_id - event_id % 2").alias("scene_id"), F.col("event_id").alias("seq"), F.when(F.col("status") == "ok", "ok").otherwise("failed").alias("status"), (k / 2.0).alias("sigma_pct"), (k * 3).alias("n"))
    got = R.write_back_uncertainty(rec, res, ["sigma_pct", "n"])
    return got.select("scene_id", "site", F.col("uncertainty.sigma_pct").alias("sigma_pct"), F.col("uncertainty.n").alias("n_draws"), F.col("uncertainty").isNotNull().alias("has"))


def _inventory(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select((F.col("o_custkey") % 8).alias("site"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice").cast("double") / 1000).alias("quantity"))


def _plumes(s, d):
    return X.scores(s, d).where("event_id % 7 = 0").select("site", F.col("acq_date").alias("date"))


def _summary(s, d):
    got = R.site_summary(X.scores(s, d), TAU, _inventory(s, d), _plumes(s, d), "cloud % 11 = 0")
    text = F.array_join(F.transform("inventory_by_year", lambda y: F.concat(y["year"].cast("string"), F.lit(":"), F.round(y["total"]).cast("long").cast("string"))), " ")
    return got.withColumn("inventory_by_year", text)


def _recovery(s, d):
    x = X.scores(s, d).select("site", "status", "sc_cfar", "cfar_detect", ((F.col("sc_cfar") - 1) * 100).alias("flow"))
    return R.recovery_ratio(x, _inventory(s, d), TAU)


def _scan(s, d):
    px = X.pixels(s, d)
    ref = px.where("not (scene % 10 = 0 and row = 0 and col = 0)")
    ref = ref.select("scene", "row", "col", (F.col("b11") * (0.9 + 0.02 * (F.col("row") % 4))).alias("b11"), (F.col("b12") * (0.9 + 0.03 * (F.col("col") % 3))).alias("b12"))
    return T.difference_retrieval(px, ref, SCAN, least_background=FEW_BACKGROUND, least_plume=FEW_PLUME)


def _crops(s, d):
    px = X.pixels(s, d)
    at = px.select("scene").distinct().select("scene", F.lit(1).alias("site"), (F.col("scene") % 9).cast("int").alias("row"), (F.col("scene") * 5 % 8).cast("int").alias("col"))
    return T.crop_stats(px.withColumns({"b11": F.col("b11") * 20, "b12": F.col("b12") * 20}), at, 8, 8, size=6, least=4)


QUERIES = {
    "d2_resolve_entity": lambda s, d: R.resolve_entity(_owners(s, d), _entities(s, d)),
    "d14_write_back": _written_back,
    "e13_site_summary": _summary,
    "e29_dataset_profile": lambda s, d: R.dataset_profile(X.sites(s, d), BOX, "ticker", "ecoregion"),
    "e30_recovery_ratio": _recovery,
    "g8_banks_by_liability": lambda s, d: R.ranked(J.bank_summary(J.financed_emissions(X.exposures(s, d), X.exposures(s, d).groupBy("ticker").agg((F.sum("exposure") * 2).alias("debt"), F.lit(1000.0).alias("t_co2e")))).where("bank is not null").select("bank", "eur"), "eur"),
    "g8_sites_by_contrast": lambda s, d: R.ranked(X.scores(s, d).select("event_id", (F.col("sc_cfar") - 2.5).alias("delta")), "delta", absolute=True),
    "c30_difference_retrieval": _scan,
    "c21_crop_stats": _crops,
    "c29_region_contrast": lambda s, d: N.region_contrast(_soundings(s, d), EAST, WEST),
    "g1_best_scene_of_year": lambda s, d: D.best_scene(X.scores(s, d), grain="year").select("site", "acq_date", "event_id"),
    "g2_top_n_per_month": lambda s, d: D.best_scene(X.scores(s, d), 3, 40, "month").select("site", "acq_date", "event_id", F.col("place").cast("long").alias("place")),
}

SOUNDINGS_SQL = f""", so AS (SELECT CAST(l_orderkey % {ORBITS} AS INTEGER) AS orbit, 45 + (l_partkey * 13 % 1000) / 100.0 AS lat, -5 + ((l_orderkey * 29 + l_linenumber * 531) % 2500) / 100.0 AS lon,
 CASE WHEN l_suppkey % 7 > 0 THEN 1850 + CAST(l_extendedprice AS DOUBLE) % 100 * 0.97137 END AS xch4, (l_partkey + l_linenumber) % 11 / 10.0 AS qa FROM lineitem)"""
_KG = "(1e-9::DOUBLE * 2.1e25 * 0.016 / 6.022e23 * 400)"
_INV = "inv AS (SELECT o_custkey % 8 AS site, year(o_orderdate) AS year, CAST(o_totalprice AS DOUBLE) / 1000 AS quantity FROM orders)"
SQL = {
    "d2_resolve_entity": """, a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || lower(n_name) WHEN 2 THEN 'Nobody Ltd' ELSE n_name END AS owner FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT c_custkey, owner, CASE WHEN trim(owner) = '' THEN 'Unknown' ELSE trim(owner) END AS subsidiary, coalesce('Op ' || n_name, 'Unknown') AS operator, substr(n_name, 1, 4) AS ticker, 'X' || n_regionkey AS exchange FROM a LEFT JOIN nation ON lower(trim(owner)) = lower(n_name)""",
    "d14_write_back": """, r AS (SELECT event_id - event_id % 2 AS sid, event_id AS seq, cloud / 2.0 AS sigma, cloud * 3 AS n FROM v_scores WHERE event_id % 3 > 0 AND status = 'ok'),
 l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY sid ORDER BY seq DESC) = 1) SELECT event_id AS scene_id, site, sigma AS sigma_pct, n AS n_draws, sid IS NOT NULL AS has FROM v_scores LEFT JOIN l ON sid = event_id""",
    "e13_site_summary": f""", {_INV}, f AS (SELECT *, status = 'ok' AS done, cloud % 11 = 0 AS same, date_trunc('month', acq_date) AS mo, sc_cfar > {TAU} AS over FROM v_scores),
 g AS (SELECT site, count(*) FILTER (done) AS processed, count(*) FILTER (done AND same) AS uniform_excluded, count(*) FILTER (done AND NOT same) AS valid, count(*) FILTER (done AND NOT same AND cfar_detect) AS detected,
 count(*) FILTER (done AND NOT same AND over) AS above_tau, count(*) FILTER (done AND NOT same AND over AND cfar_detect) AS cfar_pass, count(DISTINCT mo) FILTER (done AND NOT same) AS observed_months, count(DISTINCT mo) FILTER (done AND NOT same AND cfar_detect) AS detection_months,
 round(avg(sc_cfar) FILTER (done AND NOT same AND over AND cfar_detect), 4) AS mean_enhancement FROM f GROUP BY site),
 co AS (SELECT h.site, count(*) AS n FROM (SELECT DISTINCT site, mo FROM f WHERE done AND NOT same AND cfar_detect) h SEMI JOIN (SELECT site, mo FROM f WHERE event_id % 7 = 0) p ON h.site = p.site AND h.mo = p.mo GROUP BY h.site),
 y AS (SELECT site, string_agg(year || ':' || CAST(round(round(total, 2)) AS BIGINT), ' ' ORDER BY year) AS t FROM (SELECT site, year, sum(quantity) AS total FROM inv GROUP BY ALL) GROUP BY site)
 SELECT g.site, processed, uniform_excluded, valid, detected, above_tau, cfar_pass, observed_months, detection_months, round(CASE WHEN observed_months > 0 THEN detection_months / observed_months::DOUBLE ELSE 0 END, 4) AS detection_rate, coalesce(co.n, 0) AS co_detected_months, mean_enhancement, coalesce(t, '') AS inventory_by_year
 FROM g LEFT JOIN co ON co.site = g.site LEFT JOIN y ON y.site = g.site""",
    "e29_dataset_profile": f""" SELECT 'size' AS section, 'rows' AS value, count(*) AS n FROM v_sites UNION ALL SELECT 'size', 'in_box', count(*) FILTER (lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}) FROM v_sites
 UNION ALL (SELECT 'country', ticker, count(*) AS c FROM v_sites GROUP BY ticker ORDER BY c DESC, ticker LIMIT 20) UNION ALL SELECT 'kind', ecoregion, count(*) FROM v_sites GROUP BY ecoregion""",
    "e30_recovery_ratio": f""", {_INV}, f AS (SELECT *, status = 'ok' AND sc_cfar > {TAU} AND cfar_detect AS hit, CASE WHEN status = 'ok' AND sc_cfar > {TAU} AND cfar_detect AND sc_cfar > 1 THEN (sc_cfar - 1) * 100 END AS flow FROM v_scores),
 g AS (SELECT site, count(*) AS n, count(*) FILTER (status = 'ok') AS n_valid, count(*) FILTER (hit) AS n_hit, count(flow) AS n_flow, avg(flow) AS m, CASE WHEN count(flow) > 1 THEN 1.96::DOUBLE * stddev_samp(flow) / sqrt(count(flow)) END AS h FROM f GROUP BY site), q AS (SELECT site, sum(quantity) AS q FROM inv GROUP BY site)
 SELECT g.site, n, n_valid, n_hit, n_flow, round(m, 2) AS mean_flow, round(m * 8.76, 2) AS annual_t, round(876 * m / q, 2) AS ratio_pct, CASE WHEN h IS NOT NULL THEN round(876 * greatest(0.0, m - h) / q, 2) END AS ratio_lo, round(876 * (m + h) / q, 2) AS ratio_hi FROM g LEFT JOIN q ON g.site = q.site""",
    "g8_banks_by_liability": """, e AS (SELECT bank, ticker, sum(exposure) AS exposure FROM v_exposures GROUP BY 1, 2), i AS (SELECT ticker, sum(exposure) * 2 AS debt FROM v_exposures GROUP BY 1), b AS (SELECT bank, round(sum(round(exposure / debt * 1000.0 * 65, 0)), 0) AS eur FROM e JOIN i USING (ticker) GROUP BY bank)
 SELECT bank, eur, rank() OVER (ORDER BY eur DESC) AS rank FROM b""",
    "g8_sites_by_contrast": " SELECT event_id, sc_cfar - 2.5::DOUBLE AS delta, CASE WHEN sc_cfar IS NOT NULL THEN rank() OVER (ORDER BY abs(sc_cfar - 2.5::DOUBLE) DESC NULLS LAST) END AS rank FROM v_scores",
    "c30_difference_retrieval": f""", th AS (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in SCAN)}]) AS threshold),
 a AS (SELECT scene, threshold, prob > threshold AS m, b11, b12 * (1 - (0.9::DOUBLE + 0.03 * (col % 3))) - 0.5 * b11 * (1 - (0.9::DOUBLE + 0.02 * ("row" % 4))) AS y FROM v_pixels, th),
 b AS (SELECT *, avg(y) FILTER (NOT m) OVER w AS my, avg(b11) FILTER (NOT m) OVER w AS m11 FROM a WINDOW w AS (PARTITION BY scene, threshold)),
 g AS (SELECT scene, threshold, count(*) FILTER (m) AS n_px, count(*) FILTER (NOT m) AS bg, any_value(m11) AS m11, sum(greatest(0.0, y - my)) FILTER (m) AS above FROM b GROUP BY ALL),
 w AS (SELECT *, CASE WHEN scene % 10 = 0 THEN 'shape_mismatch' WHEN n_px < {FEW_PLUME} THEN 'too_few_plume' WHEN bg < {FEW_BACKGROUND} THEN 'too_few_background' WHEN m11 < 1e-6 THEN 'dark_background' END AS warning FROM g)
 SELECT scene, threshold, n_px, CASE WHEN warning IS NULL THEN round(above / (m11 * 4e-7) * {_KG}, 4) ELSE 0 END AS mass_kg, CASE WHEN warning IS NULL THEN round(above / (m11 * 4e-7) * {_KG} * 3.5 / sqrt(n_px * 400.0::DOUBLE) * 3600, 1) ELSE 0 END AS flow_kgh, warning FROM w""",
    "c21_crop_stats": """, s AS (SELECT DISTINCT scene, CAST(scene % 9 AS INTEGER) AS r, CAST(scene * 5 % 8 AS INTEGER) AS c FROM v_pixels), k AS (SELECT scene, greatest(0, r - 3) AS r0, least(8, r + 3) AS r1, greatest(0, c - 3) AS c0, least(8, c + 3) AS c1 FROM s)
 SELECT scene, 1 AS site, r1 - r0 AS n_rows, c1 - c0 AS n_cols, r1 - r0 < 6 OR c1 - c0 < 6 AS edge, round(avg(b11 * 20), 2) AS b11_mean, round(avg(b12 * 20), 2) AS b12_mean, round(avg(b12 * 20) / greatest(avg(b11 * 20), 1), 4) AS ratio
 FROM v_pixels JOIN k USING (scene) WHERE r1 - r0 >= 4 AND c1 - c0 >= 4 AND "row" >= r0 AND "row" < r1 AND col >= c0 AND col < c1 GROUP BY scene, r0, r1, c0, c1""",
    "g1_best_scene_of_year": " SELECT site, acq_date, event_id FROM v_scores QUALIFY row_number() OVER (PARTITION BY site, year(acq_date) ORDER BY coalesce(nullif(cloud, 0), 99), acq_date, event_id) = 1",
    "g2_top_n_per_month": " SELECT site, acq_date, event_id, row_number() OVER (PARTITION BY site, date_trunc('month', acq_date) ORDER BY coalesce(nullif(cloud, 0), 99), acq_date, event_id) AS place FROM v_scores WHERE cloud <= 40 QUALIFY place <= 3",
}
_NAMES = {"mean": "avg(xch4)", "median": "quantile_cont(xch4, 0.5)", "std": "stddev_pop(xch4)", "p25": "quantile_cont(xch4, 0.25)", "p75": "quantile_cont(xch4, 0.75)", "least": "min(xch4)", "greatest": "max(xch4)"}
_BOXES = {k: f"lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n} AND qa >= 0.5" for k, (w, s, e, n) in (("a", EAST), ("b", WEST))}
SQL["c29_region_contrast"] = f"""{SOUNDINGS_SQL}, g AS (SELECT orbit, {", ".join(f"count(xch4) FILTER ({w}) AS n_{k}, " + ", ".join(f"round({x} FILTER ({w}), 2) AS {c}_{k}" for c, x in _NAMES.items()) for k, w in _BOXES.items())} FROM so GROUP BY orbit),
 r AS (SELECT *, round(mean_a - mean_b, 2) AS enhancement, round(mean_a / mean_b, 3) AS ratio FROM g)
 SELECT *, round(enhancement / mean_b * 100, 1) AS enhancement_pct, CASE WHEN ratio >= 1.05 THEN 'validated' WHEN ratio >= 1.01 THEN 'marginal' WHEN ratio IS NOT NULL THEN 'not_confirmed' ELSE 'no_data' END AS verdict FROM r"""
