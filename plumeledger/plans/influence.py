"""Queries on how much results rest on single scenes, months, thresholds and parameters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import influence as I
from plumeledger.operators import risk as R
from plumeledger.plans import risk as plans_risk
from plumeledger.sources import fixtures as X

YEARS = 6
_FIGURES = {"rate": 6, "loo_rate": 6, "delta_rate": 6, "loo_mean": 7, "loo_median": 5, "influence_rate": 6, "influence_mean": 6}


def _rounded(df, *keep):
    return df.select(*keep, "n", "k", *[F.round(c, p).alias(c) for c, p in _FIGURES.items()])


def _scenes(s, d):
    return _rounded(I.leave_one_out(X.scores(s, d), "site", "sc_cfar", "cfar_detect"), "event_id", "site")


def _months(s, d):
    return _rounded(I.leave_month_out(X.scores(s, d), "site", "acq_date", "sc_cfar", "cfar_detect"), "site", "month", "n_scenes", "top")


def _points(s, d):
    return I.roc_points(X.pairs(s, d)).withColumns({c: F.round(c, 6) for c in ("tpr", "fpr", "precision", "f1")})


def _sensors(s, d):
    x = X.scores(s, d).select(F.col("sc_cfar").alias("score"), F.when(F.col("cloud") % 4 > 0, F.col("cloud") / 10.0).alias("enhancement"))
    return I.sensor_sensitivity(x, [-0.10, -0.05, 0.05, 0.10], [-2.0, -1.0, 1.0, 2.0])


def _releases(s, d):
    l = s.read.parquet(f"{d}/lineitem.parquet")
    k, truth = F.col("l_orderkey"), (F.col("l_quantity") * 1000).cast("double")
    x = l.select(
        F.when(k % 9 > 0, F.col("l_returnflag")).alias("regime"), F.when(k % 11 == 0, "failed").otherwise("ok").alias("status"), (k % 5 > 0).alias("quantified"), F.col("l_extendedprice").cast("double").alias("estimate"),
        F.when(k % 7 > 0, truth).alias("truth"), (F.col("l_extendedprice") > truth).alias("detected"),
    )
    return I.release_table(x)


def _state(s, d):
    x = X.scores(s, d).join(F.broadcast(X.sites(s, d).where("site < 10").select("site", "ecoregion")), "site", "left")  # ten rows
    tau = X.scores(s, d).where("status = 'ok' and cloud < 50").groupBy().agg(F.count("sc_cfar").alias("n"))
    return I.calibration_state(x, tau)


QUERIES = {
    "f19_scene_influence": _scenes,
    "f20_month_influence": _months,
    "f6_roc_points": _points,
    "f18_sensor_sensitivity": _sensors,
    "e18_release_table": _releases,
    "e28_calibration_state": _state,
    "j10_portfolio_tornado": lambda s, d: I.portfolio_tornado(plans_risk.paths(s, d), X.scores(s, d), "orderly", YEARS),
}

_LOO = """ SELECT {keep}, g.n, g.k, round(g.k / g.n::DOUBLE, 6) AS rate, round(CASE WHEN g.k > 1 THEN (g.k - 1) / (g.n - 1)::DOUBLE ELSE 0 END, 6) AS loo_rate, round(CASE WHEN g.k > 1 THEN (g.k - 1) / (g.n - 1)::DOUBLE ELSE 0 END - g.k / g.n::DOUBLE, 6) AS delta_rate,
 round(o.m, 7) AS loo_mean, round(o.md, 5) AS loo_median, round(abs(g.k / g.n::DOUBLE - CASE WHEN g.k > 1 THEN (g.k - 1) / (g.n - 1)::DOUBLE ELSE 0 END) / (g.k / g.n::DOUBLE), 6) AS influence_rate, round(CASE WHEN g.m <> 0 THEN abs(g.m - o.m) / abs(g.m) END, 6) AS influence_mean
 FROM h JOIN g ON g.site = h.site LEFT JOIN (SELECT a.id, avg(b.x) AS m, median(b.x) AS md FROM h a JOIN h b ON a.site = b.site AND a.id <> b.id GROUP BY a.id) o ON o.id = h.id"""
_GROUPS = "g AS (SELECT site, count(*) AS n, count(*) FILTER (hit) AS k, avg(x) FILTER (hit) AS m FROM u GROUP BY site), h AS (SELECT * FROM u WHERE hit)"


def _tornado() -> str:
    """All 21 runs drawn one by one: no run shares another's draws, and nothing is scaled afterwards."""
    base = {n: b for n, b, _, _ in I.PARAMETERS}
    runs = [("base", "base", base)] + [(n, tag, base | {n: v}) for n, _, low, high in I.PARAMETERS for tag, v in (("low", low), ("high", high))]
    values = ", ".join(f"('{n}', '{t}', " + ", ".join(f"{r[k]!r}::DOUBLE" for k in base) + f", {r[n] if n != 'base' else 0.0!r}::DOUBLE)" for n, t, r in runs)
    u, z = plans_risk._u, plans_risk._z
    mult = "CASE year " + " ".join(f"WHEN {y} THEN {float(R.interpolated(R.SCENARIOS['orderly']['multiplier'], y))}::DOUBLE" for y in range(2024, 2024 + YEARS)) + " END"
    wl = "(p + z * z / (2 * n)) / (1 + z * z / n) {s} z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)"
    return f""", ru(parameter, level, {", ".join(base)}, value) AS (VALUES {values}),
 de AS (SELECT parameter, level, site, any_value(uncertainty_pct) / 100 AS sd, count(*) AS n, count(*) FILTER (sc_cfar > sc_threshold + cfar_k * cv) / count(*)::DOUBLE AS p, avg(sc_cfar) FILTER (sc_cfar > sc_threshold + cfar_k * cv) AS m, 1.645::DOUBLE AS z FROM v_scores, ru WHERE status = 'ok' AND sc_cfar IS NOT NULL AND cv IS NOT NULL GROUP BY ALL),
 wi AS (SELECT *, greatest(least(1.0, {wl.format(s="+")}) - greatest(0.0, {wl.format(s="-")}), 0.01) / 3.92::DOUBLE AS bd, greatest(0.0, coalesce(m, 1.0) - 1) * 25 AS flow FROM de), bk AS (SELECT *, p * (1 - p) / greatest(bd * bd, 1e-6) - 1 AS k FROM wi),
 bs AS (SELECT parameter, level, site, sd, CASE WHEN p >= 1 THEN 10 WHEN p > 0 THEN greatest(p * k, 0.5) END AS a, CASE WHEN p >= 1 THEN 1 WHEN p > 0 THEN greatest((1 - p) * k, 0.5) END AS b, CASE WHEN flow > 0 THEN ln(flow) - sd * sd / 2 END AS mu FROM bk),
 {plans_risk._price_steps("orderly", YEARS)}, dr AS (SELECT bs.*, path, {u("path", "site", "1")} AS u1, {u("path", "site", "2")} AS u2 FROM bs, y0), {plans_risk._AB},
 a6 AS (SELECT parameter, level, site, path, coalesce(CASE WHEN b = 1 THEN pow(u1, 1 / a) ELSE aa / (aa + bb * exp(2 * w)) END, 0) * coalesce(exp(mu + sd * {z("u2")}), 0) * 8760 * 0.85::DOUBLE / 1000 AS t FROM a5),
 fo AS (SELECT path, rate, sum(price * {mult}) FILTER (year = {2023 + YEARS}) AS last, sum(price * {mult} / pow(1 + rate, year - 2023)) AS npv FROM pp, (SELECT DISTINCT discount_rate AS rate FROM ru) GROUP BY ALL),
 co AS (SELECT parameter, level, site, t * gwp100 * wind / plume_length / (sensitivity / 4e-7) * (price_eur / 65) * multiplier * last AS last, t * gwp100 * wind / plume_length / (sensitivity / 4e-7) * (price_eur / 65) * multiplier * npv AS npv FROM a6 JOIN ru USING (parameter, level) JOIN fo ON fo.path = a6.path AND fo.rate = discount_rate),
 si AS (SELECT parameter, level, site, quantile_cont(last, 0.95) AS v, avg(npv) AS n FROM co GROUP BY ALL), su AS (SELECT parameter, level, sum(v) AS v, sum(n) AS n FROM si GROUP BY ALL),
 de2 AS (SELECT s.*, s.v - b.v AS dv, s.n - b.n AS dn FROM su s, su b WHERE b.level = 'base' AND s.level <> 'base'), mo AS (SELECT parameter, rank() OVER (ORDER BY round(max(abs(dv)), 2) DESC) AS place FROM de2 GROUP BY parameter)
 SELECT parameter, level, value, round(v, 2) AS var95, round(n, 2) AS npv, round(dv, 2) AS delta_var95, round(dn, 2) AS delta_npv, CAST(place AS INTEGER) AS place FROM de2 JOIN mo USING (parameter) JOIN ru USING (parameter, level)"""


SQL = {
    "f19_scene_influence": ", u AS (SELECT event_id AS id, site, sc_cfar AS x, cfar_detect AS hit FROM v_scores WHERE sc_cfar IS NOT NULL), " + _GROUPS + _LOO.format(keep="h.id AS event_id, h.site"),
    "f20_month_influence": """, u AS (SELECT site, date_trunc('month', acq_date)::DATE AS month, count(*) FILTER (cfar_detect) AS n_scenes, max(sc_cfar) FILTER (cfar_detect) AS x, bool_or(cfar_detect) AS hit, site || ' ' || date_trunc('month', acq_date) AS id FROM v_scores WHERE sc_cfar IS NOT NULL GROUP BY site, date_trunc('month', acq_date)), """
    + _GROUPS + _LOO.format(keep="h.site, h.month, h.n_scenes, h.x AS top"),
    "f6_roc_points": """, p AS (SELECT y, score FROM v_pairs WHERE score IS NOT NULL AND y IN (0, 1)), t AS (SELECT DISTINCT score::DOUBLE AS threshold FROM p UNION SELECT 0.0::DOUBLE UNION SELECT max(score) + 1 FROM p),
 c AS (SELECT threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn FROM t, p GROUP BY threshold),
 r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS tpr, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fpr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr FROM c)
 SELECT threshold, tp, fp, fn, tn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(pr, 6) AS precision, round(CASE WHEN pr + tpr > 0 THEN 2 * pr * tpr / (pr + tpr) ELSE 0 END, 6) AS f1 FROM r""",
    "f18_sensor_sensitivity": ", w AS (SELECT sc_cfar AS s, CASE WHEN cloud % 4 > 0 THEN cloud / 10.0 END AS e FROM v_scores), k(parameter, base, value) AS (VALUES " + ", ".join([f"('score', 1.15::DOUBLE, {1.15 + x!r}::DOUBLE)" for x in (-0.10, -0.05, 0.05, 0.10)] + [f"('enhancement', 5.0::DOUBLE, {5.0 + x!r}::DOUBLE)" for x in (-2.0, -1.0, 1.0, 2.0)]) + """),
 c AS (SELECT parameter, base, value, count(*) FILTER (CASE parameter WHEN 'score' THEN s >= 1.15::DOUBLE ELSE s >= 1.15::DOUBLE AND e >= base END) AS n_base, count(*) FILTER (CASE parameter WHEN 'score' THEN s >= value ELSE s >= 1.15::DOUBLE AND e >= value END) AS n FROM w, k GROUP BY ALL)
 SELECT *, round((n - n_base) / greatest(n_base, 1)::DOUBLE * 100, 1) AS change_pct FROM c""",
    "e18_release_table": """, r AS (SELECT CASE WHEN l_orderkey % 9 > 0 THEN l_returnflag END AS regime, l_extendedprice::DOUBLE AS q, l_quantity * 1000::DOUBLE AS t, l_orderkey % 11 > 0 AND l_orderkey % 5 > 0 AND l_orderkey % 7 > 0 AS ok, CASE WHEN l_orderkey % 7 > 0 THEN 1 END AS has FROM lineitem),
 a AS (SELECT 'all' AS part, * FROM r UNION ALL SELECT regime, * FROM r WHERE regime IS NOT NULL)
 SELECT nullif(part, 'all') AS regime, count(*) AS n_scenes, count(*) FILTER (ok) AS n_quantified, count(*) FILTER (q > t) AS n_detected, round(count(*) FILTER (q > t) / count(*)::DOUBLE, 3) AS rate, round(sqrt(avg((q - t) * (q - t)) FILTER (ok)), 3) AS rmse, round(avg(q - t) FILTER (ok), 3) AS bias,
 round(avg(abs(q - t)) FILTER (ok), 3) AS mae, round(count(*) FILTER (ok AND t BETWEEN q * 0.7::DOUBLE AND q * 1.3::DOUBLE) / count(*) FILTER (ok)::DOUBLE, 3) AS ci80, round(count(*) FILTER (ok AND t BETWEEN q * (1 - 0.46::DOUBLE) AND q * 1.46::DOUBLE) / count(*) FILTER (ok)::DOUBLE, 3) AS ci95 FROM a GROUP BY part""",
    "e28_calibration_state": """, w AS (SELECT status = 'ok' AS ok, sc_cfar, cloud, coalesce(ecoregion, 'unknown') AS e FROM v_scores LEFT JOIN v_sites USING (site)), v AS (SELECT count(*) FILTER (ok AND sc_cfar IS NOT NULL) AS valid, count(*) FILTER (ok AND sc_cfar IS NOT NULL AND cloud < 50) AS known FROM w)
 SELECT 'state' AS section, 'all' AS value, count(*) AS n FROM w UNION ALL SELECT 'state', 'ok', count(*) FROM w WHERE ok UNION ALL SELECT 'state', 'valid', valid FROM v UNION ALL SELECT 'state', 'no_score', count(*) FROM w WHERE ok AND sc_cfar IS NULL UNION ALL SELECT 'state', 'failed', count(*) FROM w WHERE NOT ok
 UNION ALL SELECT 'stale', 'new_scores', valid - known FROM v UNION ALL SELECT 'ecoregion', e, count(*) FROM w WHERE ok AND sc_cfar IS NOT NULL GROUP BY e""",
    "j10_portfolio_tornado": _tornado(),
}
