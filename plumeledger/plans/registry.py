"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.functions import scalars as S
from plumeledger.operators import detection as D
from plumeledger.operators import joins as J
from plumeledger.operators import pixels as P
from plumeledger.operators import validation as V
from plumeledger.plans import assessments, calibration, conversions, footprints, influence, matching, portfolios, rasters, reports, retrievals, risk, scenes, screening, soundings
from plumeledger.sources import fixtures as X

FLAGSHIP = "b13_e14_production_rule_audit"
ALPHAS = [0.05, 0.1, 0.2]


def _tau(spark, d):
    return D.conformal_threshold(X.scores(spark, d), [0.1])


def _issuers(spark, d):
    return X.exposures(spark, d).groupBy("ticker").agg((F.sum("exposure") * 2).alias("debt"), F.lit(1000.0).alias("t_co2e"))


def _labels(spark, d):
    s = X.scores(spark, d)
    return s.select("event_id", S.cloud_quality(F.col("cloud")).alias("quality"), S.strength_label(F.col("sc_cfar")).alias("strength"))


def _winds(spark, d):
    w = X.wind(spark, d)
    speed, direction = S.wind_speed(F.col("u"), F.col("v")), S.wind_direction(F.col("u"), F.col("v"))
    away = S.angular_difference(direction, F.lit(90.0))
    return w.select("event_id", F.round(speed, 4).alias("speed"), F.round(direction, 3).alias("dir"), F.round(away, 3).alias("away"), S.wind_regime(speed).alias("regime"))


def _full_risk(spark, d):
    """Site risk with quantified flows of even sites, a second sensor, and scenes left out."""
    x = X.scores(spark, d)
    flows = x.where("site % 2 = 0").select("site", (F.col("cloud") * 3.0).alias("flow"))
    second = x.groupBy("site").agg((F.max(F.col("cloud") % 3) / 3.0).alias("score"))
    return D.site_risk(x, flows, second, "cloud % 9 = 0")


_NEAR = {"n": (-3, 0), "s": (3, 0), "e": (0, 3), "w": (0, -3)}


def _centres(spark, d):
    return X.pixels(spark, d).select("scene", F.lit(0).alias("site"), F.lit(4).alias("row"), F.lit(4).alias("col")).distinct()


def _corners(spark, d):
    """Two sites a scene, some off the scene and most with controls off it."""
    s = X.pixels(spark, d).select("scene").distinct()
    return s.select("scene", F.explode(F.array(F.lit(1), F.lit(2))).alias("site")).select("scene", "site", (F.col("scene") * F.col("site") % 10).cast("int").alias("row"), (F.col("scene") * 3 % 8).cast("int").alias("col"))


def queries() -> dict:
    return {
        "b13_e14_production_rule_audit": lambda s, d: D.rule_audit(D.production_rule(X.scores(s, d), _tau(s, d))),
        "b13_production_rule": lambda s, d: D.production_rule(X.scores(s, d), _tau(s, d)).select("event_id", "class"),
        "f1_conformal_threshold": lambda s, d: D.conformal_threshold(X.scores(s, d), ALPHAS),
        "f2_mondrian_threshold": lambda s, d: D.mondrian_threshold(X.scores(s, d), "site").select("site", "n", "tau", "lo", "hi", F.round("mean", 4).alias("mean"), "small_n"),
        "f3_empirical_fpr": lambda s, d: D.empirical_fpr(X.scores(s, d), D.conformal_threshold(X.scores(s, d), ALPHAS)).select("alpha", F.round("fpr", 6).alias("fpr"), F.round("fpr_classic", 6).alias("fpr_classic")),
        "e1_site_risk": lambda s, d: D.site_risk(X.scores(s, d)),
        "e3_e6_site_risk_full": _full_risk,
        "e9_annualise": lambda s, d: D.annualise(X.scores(s, d)),
        "e16_describe": lambda s, d: D.describe(X.scores(s, d), "site", "sc_cfar"),
        "f19_loo_scene": lambda s, d: D.loo_scene(X.scores(s, d)),
        "g1_best_scene": lambda s, d: D.best_scene(X.scores(s, d)).select("site", "acq_date", "event_id"),
        "g2_top_n_scenes": lambda s, d: D.best_scene(X.scores(s, d), 3, 40).select("site", "acq_date", "event_id", F.col("place").cast("long").alias("place")),
        "g5_best_overpass": lambda s, d: D.best_overpass(X.scores(s, d)),
        "b1_b20_labels": _labels,
        "i7_wind": _winds,
        "f6_roc_curve": lambda s, d: V.roc_curve(X.pairs(s, d)).withColumns({"tpr": F.round("tpr", 6), "fpr": F.round("fpr", 6)}),
        "f7_auc": lambda s, d: V.auc(X.pairs(s, d)),
        "f8_auroc": lambda s, d: V.auroc(X.pairs(s, d)),
        "f9_average_precision": lambda s, d: V.average_precision(X.pairs(s, d)),
        "f13_calibration_bins": lambda s, d: V.calibration_bins(X.pairs(s, d)),
        "f13_calibration_errors": lambda s, d: V.calibration_errors(X.pairs(s, d)),
        "f15_concordance": lambda s, d: V.concordance(X.pairs(s, d)),
        "c4_site_contrast": lambda s, d: P.site_contrast(X.pixels(s, d), _centres(s, d), 2, _NEAR).select("scene", "site_mean", "sc_ratio", "sc_cfar", "cv", "thresh", "detect"),
        "c4_contrast_at_edges": lambda s, d: P.site_contrast(X.pixels(s, d), _corners(s, d), 2, _NEAR),
        "c8_threshold_sweep": lambda s, d: P.threshold_sweep(X.pixels(s, d)),
        "c10_scene_detect": lambda s, d: P.scene_detect(X.pixels(s, d), 0.18, 15),
        "c13_downsample": lambda s, d: P.downsample(X.pixels(s, d)).select("scene", "row", "col", F.round("prob", 5).alias("prob")),
        "c15_band_retrieval": lambda s, d: P.band_retrieval(X.pixels(s, d), least_background=8),
        "d1_nearest_site": lambda s, d: J.nearest_within(X.sites(s, d), X.sites(s, d), 60.0, same=True),
        "d16_financed_emissions": lambda s, d: J.financed_emissions(X.exposures(s, d), _issuers(s, d)),
        "e8_bank_summary": lambda s, d: J.bank_summary(J.financed_emissions(X.exposures(s, d), _issuers(s, d))),
        **screening.QUERIES,
        **conversions.QUERIES,
        **risk.QUERIES,
        **scenes.QUERIES,
        **rasters.QUERIES,
        **assessments.QUERIES,
        **retrievals.QUERIES,
        **calibration.QUERIES,
        **soundings.QUERIES,
        **matching.QUERIES,
        **reports.QUERIES,
        **footprints.QUERIES,
        **influence.QUERIES,
        **portfolios.QUERIES,
    }


_TAU = """n0 AS (SELECT count(sc_cfar) AS n FROM v_scores), al AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS alpha),
rk AS (SELECT sc_cfar AS s, row_number() OVER (ORDER BY sc_cfar) AS r FROM v_scores WHERE sc_cfar IS NOT NULL),
taus AS (SELECT alpha, n, s AS tau FROM al, n0, rk WHERE r = least(ceil((n + 1) * (1 - alpha)), n))"""
_CLASS = """cl AS (SELECT event_id, site, CASE WHEN status <> 'ok' THEN 'NOT_OK' WHEN sc_cfar IS NULL THEN 'NO_COVERAGE' WHEN sc_cfar <= tau THEN 'SUB_TAU'
 WHEN cfar_detect THEN 'DETECTION' ELSE 'CFAR_SUPPRESSED' END AS class FROM v_scores, (SELECT tau FROM taus WHERE alpha = 0.1))"""
_ROC = """c AS (SELECT score AS threshold, sum(CAST(y = 1 AS INT)) AS p, sum(CAST(y = 0 AS INT)) AS q FROM v_pairs GROUP BY 1),
r AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS n1, CAST(sum(q) OVER () AS BIGINT) AS n0 FROM c WINDOW w AS (ORDER BY threshold DESC))"""
_FIN = """e AS (SELECT bank, ticker, sum(exposure) AS exposure FROM v_exposures GROUP BY 1, 2), i AS (SELECT ticker, sum(exposure) * 2 AS debt FROM v_exposures GROUP BY 1),
f AS (SELECT bank, ticker, round(exposure, 2) AS exposure, round(exposure / debt, 6) AS share, round(exposure / debt * 1000.0, 2) AS financed_t, round(exposure / debt * 1000.0 * 65, 0) AS eur FROM e JOIN i USING (ticker))"""
_BINS = """, b AS (SELECT 1 / (1 + exp(-0.5 * (score - 1.15))) AS p, y FROM v_pairs), g AS (SELECT CAST(least(floor(p * 5), 4) AS INTEGER) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM b GROUP BY 1),
bi AS (SELECT CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(predicted, (k + 0.5) / 5::DOUBLE), 6) AS predicted, round(coalesce(observed, 0), 6) AS observed FROM range(5) t(k) LEFT JOIN g ON g.bin = k)"""
_WL = "(p0 + z*z/(2*n_valid) {s} z*sqrt(p0*(1-p0)/n_valid + z*z/(4*n_valid*n_valid))) / (1 + z*z/n_valid)"


def _risk(flow: str = "NULL::DOUBLE", has_flow: str = "false", second: str = "NULL::DOUBLE", bad: str = "false") -> str:
    """Site risk; flow and second are aggregates that stand for the tables of quantified flows and of the second sensor."""
    ok = f"status = 'ok' AND sc_cfar IS NOT NULL AND NOT ({bad})"
    return f""", g AS (SELECT site, count(*) FILTER ({ok}) AS n_valid, count(*) FILTER ({ok} AND sc_cfar > 1.15) AS n_detect,
 round(avg(CASE WHEN {ok} AND sc_cfar > 1.15 THEN sc_cfar END), 3) AS mean_sc, CASE WHEN {has_flow} THEN {flow} END AS given, {second} AS second FROM v_scores GROUP BY site), h AS (SELECT *, n_detect / n_valid::DOUBLE AS p0, 1.645::DOUBLE AS z FROM g),
 k AS (SELECT site, n_valid, n_detect, mean_sc, second, CASE WHEN n_valid > 0 THEN round(p0, 4) ELSE 0.0 END AS p, CASE WHEN n_valid = 0 THEN 0.0 ELSE round(greatest(0.0, {_WL.format(s='-')}), 4) END AS p_lo,
 CASE WHEN n_valid = 0 THEN 0.0 ELSE round(least(1.0, {_WL.format(s='+')}), 4) END AS p_hi, coalesce(given, round(greatest(0.0, coalesce(mean_sc, 1.0) - 1) * 25, 1)) AS flow, CASE WHEN given IS NULL THEN 'estimated' ELSE 'quantified' END AS flow_source FROM h),
 t AS (SELECT *, round(p * flow * 8760 * 0.85 * 29.8 / 1000, 1) AS t_co2e, round(p_lo * flow * 0.7 * 8760 * 0.85 * 29.8 / 1000, 1) AS t_lo, round(p_hi * flow * 1.3 * 8760 * 0.85 * 29.8 / 1000, 1) AS t_hi FROM k)
 SELECT * EXCLUDE (second), round(t_co2e * 65, 0) AS eur, round(t_lo * 65, 0) AS eur_lo, round(t_hi * 65, 0) AS eur_hi,
 CASE WHEN n_valid = 0 THEN 'NO_DATA' WHEN p >= 0.6 THEN 'HIGH' WHEN p >= 0.3 AND second >= 0.5 THEN 'HIGH_DUAL_SENSOR' WHEN p >= 0.3 THEN 'MEDIUM' WHEN p > 0 THEN 'LOW' ELSE 'UNDETECTED' END AS tier FROM t"""


_BODY = {
    "b13_e14_production_rule_audit": f", {_TAU}, {_CLASS} SELECT site, " + ", ".join(f"CAST(sum(CAST(class = '{c}' AS INT)) AS BIGINT) AS {c.lower()}" for c in D.CLASSES) + ", count(*) AS total FROM cl GROUP BY site",
    "b13_production_rule": f", {_TAU}, {_CLASS} SELECT event_id, class FROM cl",
    "f1_conformal_threshold": f", {_TAU} SELECT alpha, n, tau FROM taus",
    "f2_mondrian_threshold": ", r AS (SELECT *, count(*) OVER (PARTITION BY site) AS n, row_number() OVER (PARTITION BY site ORDER BY sc_cfar) AS k FROM v_scores WHERE sc_cfar IS NOT NULL) SELECT site, max(n) AS n, max(CASE WHEN k = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n) THEN sc_cfar END) AS tau, min(sc_cfar) AS lo, max(sc_cfar) AS hi, round(avg(sc_cfar), 4) AS mean, max(n) < 5 AS small_n FROM r GROUP BY site",
    "f3_empirical_fpr": f", {_TAU} SELECT alpha, round(avg(CAST(sc_cfar > tau AS INT)), 6) AS fpr, round(avg(CAST(sc_cfar > 1.15 AS INT)), 6) AS fpr_classic FROM v_scores, taus WHERE sc_cfar IS NOT NULL GROUP BY alpha",
    "e1_site_risk": _risk(),
    "e3_e6_site_risk_full": _risk("avg(cloud) * 3", "site % 2 = 0", "max(cloud % 3) / 3.0", "cloud % 9 = 0"),
    "e9_annualise": ", m AS (SELECT site, acq_date, max(CASE WHEN status = 'ok' AND cfar_detect THEN sc_cfar * 100 END) AS q FROM v_scores GROUP BY 1, 2) SELECT site, count(*) AS n_obs, count(q) AS n_det, round(avg(q), 4) AS mean_q, round(quantile_cont(q, 0.5), 4) AS median_q, round(avg(coalesce(q, 300.0)), 4) AS imputed_q, round(avg(coalesce(q, 0.0)), 4) AS lower_q FROM m GROUP BY site",
    "e16_describe": " SELECT site, count(sc_cfar) AS n, round(avg(sc_cfar), 4) AS mean, round(quantile_cont(sc_cfar, 0.5), 4) AS median, round(stddev_pop(sc_cfar), 4) AS sd, round(quantile_cont(sc_cfar, 0.25), 4) AS p25, round(quantile_cont(sc_cfar, 0.75), 4) AS p75, round(min(sc_cfar), 4) AS lo, round(max(sc_cfar), 4) AS hi FROM v_scores GROUP BY site",
    "f19_loo_scene": ", x AS (SELECT *, count(*) OVER w AS n, sum(CAST(cfar_detect AS INT)) OVER w AS k, sum(CASE WHEN cfar_detect THEN sc_cfar END) OVER w AS s FROM v_scores WINDOW w AS (PARTITION BY site)) SELECT event_id, site, round((k - 1) / (n - 1)::DOUBLE, 6) AS rate, round((s - sc_cfar) / (k - 1), 4) AS mean FROM x WHERE cfar_detect AND k > 1",
    "g1_best_scene": " SELECT site, acq_date, event_id FROM v_scores QUALIFY row_number() OVER (PARTITION BY site, acq_date ORDER BY coalesce(nullif(cloud, 0), 99), event_id) = 1",
    "g2_top_n_scenes": " SELECT site, acq_date, event_id, row_number() OVER (PARTITION BY site, acq_date ORDER BY coalesce(nullif(cloud, 0), 99), event_id) AS place FROM v_scores WHERE cloud <= 40 QUALIFY place <= 3",
    "g5_best_overpass": " SELECT site, acq_date, max(sc_cfar) AS best, max(event_id) FILTER (sc_cfar = top) AS event_id FROM (SELECT *, max(sc_cfar) OVER (PARTITION BY site, acq_date) AS top FROM v_scores) GROUP BY 1, 2",
    "b1_b20_labels": " SELECT event_id, CASE WHEN cloud IS NULL THEN 'unknown' WHEN cloud <= 10 THEN 'optimal' WHEN cloud <= 30 THEN 'acceptable' ELSE 'poor' END AS quality, CASE WHEN sc_cfar >= 1.5 THEN 'strong' WHEN sc_cfar >= 1.1 THEN 'elevated' WHEN sc_cfar >= 0.9 THEN 'neutral' ELSE 'suppressed' END AS strength FROM v_scores",
    "i7_wind": ", w AS (SELECT event_id, sqrt(u*u + v*v) AS sp, ((270 - degrees(atan2(v, u))) % 360 + 360) % 360 AS dir FROM v_wind) SELECT event_id, round(sp, 4) AS speed, round(dir, 3) AS dir, round(least((dir - 90 + 360) % 360, 360 - (dir - 90 + 360) % 360), 3) AS away, CASE WHEN sp IS NULL THEN 'unknown' WHEN sp < 3 THEN 'low' WHEN sp >= 7 THEN 'high' ELSE 'moderate' END AS regime FROM w",
    "f6_roc_curve": f", {_ROC} SELECT threshold, tp, fp, n1 - tp AS fn, n0 - fp AS tn, round(tp / n1::DOUBLE, 6) AS tpr, round(fp / n0::DOUBLE, 6) AS fpr FROM r",
    "f7_auc": f", {_ROC}, s AS (SELECT tp / n1::DOUBLE AS t, fp / n0::DOUBLE AS f, threshold FROM r), l AS (SELECT t, f, coalesce(lag(t) OVER (ORDER BY threshold DESC), 0) AS t0, coalesce(lag(f) OVER (ORDER BY threshold DESC), 0) AS f0 FROM s) SELECT round(sum((f - f0) * (t + t0) / 2), 6) AS auc FROM l",
    "f8_auroc": " SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auroc FROM v_pairs a, v_pairs b WHERE a.y = 1 AND b.y = 0",
    "f9_average_precision": ", r AS (SELECT y, sum(y) OVER w AS tp, count(*) OVER w AS k FROM v_pairs WINDOW w AS (ORDER BY score DESC, y DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT round(sum(CASE WHEN y = 1 THEN tp / k::DOUBLE END) / sum(y), 6) AS ap FROM r",
    "f13_calibration_bins": f"{_BINS} SELECT bin, n, predicted, observed FROM bi",
    "f13_calibration_errors": f"{_BINS} SELECT CAST(sum(n) AS BIGINT) AS n, round((SELECT avg((p - y) * (p - y)) FROM b), 5) AS brier, round(sum(n * abs(predicted - observed)) / sum(n), 5) AS ece FROM bi",
    "f15_concordance": ", a AS (SELECT avg(CAST(y = y2 AS INT)) AS po, avg(y) AS a, avg(y2) AS b FROM v_pairs), k AS (SELECT po, a * b + (1 - a) * (1 - b) AS pe FROM a) SELECT round(po, 6) AS agreement, round(CASE WHEN abs(1 - pe) < 1e-12 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k",
    "c4_site_contrast": """, g AS (SELECT scene, avg(prob) FILTER ("row" BETWEEN 3 AND 4 AND col BETWEEN 3 AND 4) AS site_mean, avg(prob) FILTER ("row" < 2 AND col BETWEEN 3 AND 4) AS n, avg(prob) FILTER ("row" > 5 AND col BETWEEN 3 AND 4) AS s,
 avg(prob) FILTER ("row" BETWEEN 3 AND 4 AND col > 5) AS e, avg(prob) FILTER ("row" BETWEEN 3 AND 4 AND col < 2) AS w FROM v_pixels GROUP BY scene), h AS (SELECT *, (n + s + e + w) / 4 AS mu FROM g),
 k AS (SELECT *, sqrt(((n-mu)*(n-mu) + (s-mu)*(s-mu) + (e-mu)*(e-mu) + (w-mu)*(w-mu)) / 4) / mu AS cv FROM h)
 SELECT scene, round(site_mean, 4) AS site_mean, round(site_mean / n, 4) AS sc_ratio, round(site_mean / mu, 4) AS sc_cfar, round(cv, 4) AS cv, round(1.15 + 3 * cv, 4) AS thresh, site_mean / mu > 1.15 + 3 * cv AS detect FROM k""",
    "c4_contrast_at_edges": """, st AS (SELECT scene, site, scene * site % 10 AS r, scene * 3 % 8 AS c FROM (SELECT DISTINCT scene FROM v_pixels), (SELECT unnest([1, 2]) AS site)),
 o AS (SELECT * FROM (VALUES ('site', 0, 0, 0), ('n', 1, -3, 0), ('s', 2, 3, 0), ('e', 3, 0, 3), ('w', 4, 0, -3)) t(d, k, dr, dc)),
 wi AS (SELECT scene, site, d, k, r + dr - 1 AS r0, c + dc - 1 AS c0 FROM st, o WHERE r + dr - 1 BETWEEN 0 AND 6 AND c + dc - 1 BETWEEN 0 AND 6),
 m AS (SELECT scene, site, d, k, avg(prob) AS m FROM wi JOIN v_pixels USING (scene) WHERE "row" BETWEEN r0 AND r0 + 1 AND col BETWEEN c0 AND c0 + 1 GROUP BY ALL),
 g AS (SELECT scene, site, max(m) FILTER (d = 'site') AS sm, count(*) FILTER (d <> 'site') AS n, first(d ORDER BY k) FILTER (d <> 'site') AS direction, first(m ORDER BY k) FILTER (d <> 'site') AS f, avg(m) FILTER (d <> 'site') AS mu, stddev_pop(m) FILTER (d <> 'site') AS sd FROM m GROUP BY ALL),
 e AS (SELECT st.scene, st.site, sm, coalesce(n, 0) AS n, direction, sm / f AS ratio, sm / mu AS cfar, sd / mu AS cv, CASE WHEN sm IS NULL THEN 'site_oob' WHEN n = 0 THEN 'all_directions_oob' END AS error FROM st LEFT JOIN g ON g.scene = st.scene AND g.site = st.site)
 SELECT CAST(scene AS BIGINT) AS scene, site, round(sm, 4) AS site_mean, n AS n_controls, CASE WHEN error IS NULL THEN direction END AS direction, CASE WHEN error IS NULL THEN round(ratio, 4) END AS sc_ratio, CASE WHEN error IS NULL THEN round(cfar, 4) END AS sc_cfar, CASE WHEN error IS NULL THEN round(cv, 4) END AS cv,
 CASE WHEN error IS NULL THEN round(1.15 + 3 * cv, 4) END AS thresh, CASE WHEN error IS NULL THEN round(cfar - (1.15 + 3 * cv), 4) END AS margin, CASE WHEN error IS NULL THEN cfar > 1.15 + 3 * cv END AS detect, error FROM e""",
    "c8_threshold_sweep": " SELECT scene, t, CAST(sum(CAST(prob >= t AS INT)) AS BIGINT) AS above, round(100 * sum(CAST(prob >= t AS INT)) / count(*), 4) AS pct FROM v_pixels, (SELECT unnest([0.18::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS t) GROUP BY scene, t",
    "c10_scene_detect": ' SELECT scene, CAST(sum(CAST(prob >= 0.18 AS INT)) AS BIGINT) AS n_px, sum(CAST(prob >= 0.18 AS INT)) >= 15 AS has_plume, round(coalesce(max(prob) FILTER (prob >= 0.18), 0.0), 4) AS top, round(avg("row") FILTER (prob >= 0.18), 4) AS r, round(avg(col) FILTER (prob >= 0.18), 4) AS c FROM v_pixels GROUP BY scene',
    "c13_downsample": ' SELECT scene, CAST("row" // 2 AS INTEGER) AS "row", CAST(col // 2 AS INTEGER) AS col, round(prob, 5) AS prob FROM v_pixels WHERE "row" % 2 = 0 AND col % 2 = 0',
    "c15_band_retrieval": """, f AS (SELECT scene, sum(b11 * b12) FILTER (NOT prob >= 0.3) / sum(b12 * b12) FILTER (NOT prob >= 0.3) AS c, count(*) FILTER (NOT prob >= 0.3) AS bg, count(*) FILTER (prob >= 0.3) AS n_px, sum(b12 * b12) FILTER (NOT prob >= 0.3) AS yy, avg(b11) FILTER (NOT prob >= 0.3) AS m11 FROM v_pixels GROUP BY scene),
 v AS (SELECT *, coalesce(bg >= 8 AND yy >= 1e-12 AND m11 >= 1e-6, false) AS ok FROM f),
 g AS (SELECT scene, sum(greatest(0.0, -((c * b12 - b11) / b11) / 4e-7) * (1e-9 * 2.1e25::DOUBLE * 0.016 / 6.022e23 * 400)) AS mass, greatest(max("row") - min("row"), max(col) - min(col)) AS ext FROM v_pixels JOIN v USING (scene) WHERE prob >= 0.3 AND ok GROUP BY scene)
 SELECT v.scene, n_px, CASE WHEN ok THEN round(coalesce(mass, 0), 4) END AS mass_kg, CASE WHEN ok AND mass > 0 THEN round(mass / (greatest(ext * 20, 1) / 3.5::DOUBLE) * 3600, 2) ELSE 0 END AS flow_kgh FROM v LEFT JOIN g ON v.scene = g.scene""",
    "d1_nearest_site": ", k AS (SELECT a.site, b.site AS asset, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM v_sites a, v_sites b WHERE a.site <> b.site) SELECT site, asset, round(km, 3) AS km FROM k WHERE km <= 60 QUALIFY row_number() OVER (PARTITION BY site ORDER BY km, asset) = 1",
    "d16_financed_emissions": f", {_FIN} SELECT * FROM f",
    "e8_bank_summary": f", {_FIN} SELECT bank, round(sum(financed_t), 2) AS financed_t, round(sum(eur), 0) AS eur, round(sum(exposure), 2) AS exposure, count(*) AS n_issuers FROM f GROUP BY ROLLUP (bank)",
}


# Queries of the other module whose SQL builds on what is here.
risk.finish(_BODY["e1_site_risk"])
portfolios.finish(_BODY["e1_site_risk"])
scenes.finish(_BODY["e1_site_risk"], risk._erfc)
_BODY |= screening.SQL | conversions.SQL | risk.SQL | scenes.SQL | rasters.SQL | assessments.SQL | retrievals.SQL | calibration.SQL | soundings.SQL | matching.SQL | reports.SQL | footprints.SQL | influence.SQL | portfolios.SQL
_BODY["k2_k8_online_rule"] = _BODY["b13_production_rule"]
_TIERS = "['HIGH_DUAL_SENSOR', 'HIGH', 'MEDIUM', 'LOW', 'UNDETECTED', 'NO_DATA']"
_BODY["e7_portfolio_risk"] = f""", ri AS ({_BODY["e1_site_risk"].replace(", g AS (", "WITH g AS (", 1)}), j AS (SELECT ticker, ri.site AS s, eur, t_co2e, list_position({_TIERS}, coalesce(tier, 'NO_DATA')) AS r FROM v_sites LEFT JOIN ri USING (site))
 SELECT ticker, count(*) AS n_sites, count(s) AS n_covered, round(sum(coalesce(eur, 0)), 0) AS eur, round(sum(coalesce(t_co2e, 0)), 1) AS t_co2e, {_TIERS}[CAST(min(r) AS INT)] AS tier, round(100 * count(s) / count(*)::DOUBLE, 2) AS coverage_pct FROM j GROUP BY ticker"""


def oracle_sql() -> dict[str, str]:
    return {k: X.SQL + v for k, v in _BODY.items()}
