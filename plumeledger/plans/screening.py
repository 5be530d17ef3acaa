"""Queries over screening, summaries, ranking intervals and streams, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import screening as C
from plumeledger.operators import summaries as M
from plumeledger.operators import validation as V
from plumeledger.sources import fixtures as X
from plumeledger.sources.scratch import scratch_dir
from plumeledger.streaming import monitor as T

ALPHAS = [0.05, 0.1, 0.2]
STEPS = [-0.1, -0.05, 0.05, 0.1]


def _reasons(s, d):
    x, k = X.scores(s, d), F.col("cloud")
    mean, control = F.col("sc_cfar") / 20, F.when(k % 10 == 0, F.col("sc_cfar") / 20).otherwise(k / 100000.0)
    q, sc = F.col("sc_cfar") * 100, F.col("sc_cfar") * 4
    return x.withColumns({"q": q, "reason": C.exclude_reason(mean, control, F.col("cv"), sc, q), "kept_out": C.calibration_exclusion(k / 100000.0, F.col("cv"), sc)})


_REASONS = """, rs AS (SELECT *, sc_cfar * 100 AS q, CASE WHEN mean > 0 AND abs(mean - control) < 1e-4 THEN 'uniform_field'
 WHEN (abs(sc - 1) < 1e-6 AND coalesce(abs(cv), 0) < 1e-9) OR abs(mean - control) < 1e-6 THEN 'partial_swath' WHEN mean < 0.05 THEN 'low_site_mean'
 WHEN sc_cfar * 100 < 200 THEN 'low_flow' WHEN sc > 20 THEN 'high_ratio' END AS reason,
 CASE WHEN cloud / 100000.0::DOUBLE < 5e-4 AND sc > 20 THEN 'denominator_artifact' WHEN cv > 1.5 AND sc > 5.5 THEN 'terrain_confound' END AS kept_out
 FROM (SELECT *, sc_cfar / 20 AS mean, sc_cfar * 4 AS sc, CASE WHEN cloud % 10 = 0 THEN sc_cfar / 20 ELSE cloud / 100000.0::DOUBLE END AS control FROM v_scores))"""


def _flagged(s, d):
    k, e = F.col("cloud"), F.col("event_id")
    x = X.scores(s, d).withColumns({"wind_source": F.when(e % 7 == 0, "Climatological_fallback_3.5ms").otherwise("ERA5_reanalysis"), "era5_offset_h": (k % 13 - 6).cast("double"),
                                    "bitemporal_missing": e % 5 == 0, "solar_zenith": F.col("sc_cfar") * 8})
    return C.governance(x)


_FLAGS = """, fl AS (SELECT event_id, [x FOR x IN [CASE WHEN event_id % 7 = 0 THEN 'WIND_FALLBACK' END, CASE WHEN abs(cloud % 13 - 6) > 4 THEN 'ERA5_STALE' END,
 CASE WHEN event_id % 5 = 0 THEN 'BITEMPORAL_MISSING' END, CASE WHEN cloud > 15 THEN 'CLOUD_FRACTION_HIGH' END, CASE WHEN sc_cfar * 8 > 70 THEN 'SOLAR_ZENITH_EXTREME' END] IF x IS NOT NULL] AS flags,
 coalesce(cloud > 15, false) AS excluded FROM v_scores)"""


def _splits(s, d):
    a, b = C.window_of(F.col("acq_date"))
    return X.scores(s, d).select("event_id", C.split_of(F.col("acq_date")).alias("split"), a.alias("first_day"), b.alias("last_day"))


def _releases(s, d):
    l = s.read.parquet(f"{d}/lineitem.parquet")
    truth = F.col("l_quantity") * 1000
    return l.select(F.col("l_returnflag").alias("regime"), F.col("l_extendedprice").alias("estimate"), truth.alias("truth"), (F.col("l_extendedprice") > truth).alias("detected"))


def _emitters(s, d):
    t = X.sites(s, d).select("site", "lat", "lon")
    return C.merge_emitters(t.where("site % 3 = 0"), t, "site")


def _labelled(s, d):
    t = s.read.parquet(f"{d}/labels.parquet")
    return t.select(F.col("toxic").cast("int").alias("label"), F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))


def _versioned(s, d):
    """The rule by two versions of tau, which the test writes as a table."""
    e = T.event_stream(s, f"{d}/events.parquet")
    folder = scratch_dir(s, "tau-versions")
    v = X.scores(s, d).select(F.explode(F.array(*[F.struct(F.lit(t).cast("timestamp").alias("since"), F.lit(x).alias("tau")) for t, x in (("2024-01-05", 2.0), ("2024-01-20", 3.0))])).alias("v")).select("v.*").distinct()
    v.write.parquet(folder)
    scores = X.score_columns(e.select("event_id", "user_id", "ts", "value", "event_type", "props"))
    return T.versioned_rule(scores.withColumn("ts", F.col("acq_date").cast("timestamp")), folder)


QUERIES = {
    "b15_exclude_reason": lambda s, d: _reasons(s, d).select("event_id", "reason"),
    "b14_calibration_exclusion": lambda s, d: _reasons(s, d).select("event_id", "kept_out"),
    "b12_is_detection": lambda s, d: C.is_detection(X.scores(s, d), X.sites(s, d).where("site % 2 = 0")).select("event_id", "detected"),
    "b17_degradation_flags": lambda s, d: _flagged(s, d).select("event_id", F.array_join("flags", ",").alias("flags"), "excluded"),
    "e20_governance_summary": lambda s, d: C.governance_summary(_flagged(s, d)),
    "b24_b25_split_and_window": _splits,
    "b26_daily_calendar": lambda s, d: C.daily_calendar(X.scores(s, d), "site", "acq_date"),
    "g3_ceiling_fallback": lambda s, d: C.ceiling_fallback(X.scores(s, d), ["site", "acq_date"], [20, 40]).select("event_id", "level"),
    "g6_nearest_dates": lambda s, d: C.nearest_dates(X.scores(s, d), "site", "2024-01-15", 5).select("site", "event_id", "days_away", "place"),
    "h2_emitter_merge": _emitters,
    "e7_portfolio_risk": lambda s, d: M.portfolio_risk(X.scores(s, d), X.sites(s, d)),
    "e11_annualise_qc": lambda s, d: M.annualise_qc(_reasons(s, d)),
    "e15_site_by_month": lambda s, d: M.site_by_month(X.scores(s, d), [1, 2, 3]),
    "e18_release_errors": lambda s, d: M.release_errors(_releases(s, d)),
    "e23_dataset_stats": lambda s, d: M.dataset_stats(_labelled(s, d)),
    "e26_best_per_site": lambda s, d: M.best_per_site(X.scores(s, d), 15.0),
    "e28_calibration_health": lambda s, d: M.calibration_health(X.scores(s, d)),
    "f5_sample_size": lambda s, d: M.sample_size(X.scores(s, d), "site", ALPHAS),
    "f11_auc_interval": lambda s, d: V.auc_interval(X.pairs(s, d)),
    "f12_optimal_threshold": lambda s, d: V.optimal_threshold(X.pairs(s, d)),
    "f18_threshold_sensitivity": lambda s, d: M.threshold_sensitivity(X.scores(s, d), STEPS),
    "f20_loo_month": lambda s, d: M.loo_month(X.scores(s, d)),
    "f22_flow_outliers": lambda s, d: M.flow_outliers(X.scores(s, d)),
    "k2_k8_online_rule": T.online_rule,
    "k5_running_status": T.running_status,
    "k5_tier_changes": lambda s, d: T.tier_changes(X.score_columns(T.event_stream(s, f"{d}/events.parquet"))),
    "k8_versioned_rule": _versioned,
}

_STATUS = ", st AS (SELECT site, CAST(sum(CAST(status = 'ok' AND sc_cfar IS NOT NULL AS INT)) AS BIGINT) AS n_valid, CAST(sum(CAST(status = 'ok' AND sc_cfar > 1.15 AS INT)) AS BIGINT) AS n_detect, max(acq_date) AS last_day FROM v_scores GROUP BY site), sp AS (SELECT *, CASE WHEN n_valid > 0 THEN round(n_detect / n_valid::DOUBLE, 4) ELSE 0 END AS p FROM st)"
_TIER = "CASE WHEN n_valid = 0 THEN 'NO_DATA' WHEN p >= 0.6 THEN 'HIGH' WHEN p >= 0.3 THEN 'MEDIUM' WHEN p > 0 THEN 'LOW' ELSE 'UNDETECTED' END"

SQL = {
    "b15_exclude_reason": f"{_REASONS} SELECT event_id, reason FROM rs",
    "b14_calibration_exclusion": f"{_REASONS} SELECT event_id, kept_out FROM rs",
    "b12_is_detection": " SELECT event_id, coalesce(CASE WHEN site IN (SELECT site FROM v_sites WHERE site % 2 = 0) THEN sc_cfar > 1.15 ELSE cfar_detect END, false) AS detected FROM v_scores",
    "b17_degradation_flags": f"{_FLAGS} SELECT event_id, coalesce(array_to_string(flags, ','), '') AS flags, excluded FROM fl",
    "e20_governance_summary": f"{_FLAGS} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM fl UNION ALL SELECT 'ANY' FROM fl WHERE len(flags) > 0 UNION ALL SELECT 'TOTAL' FROM fl) GROUP BY 1",
    "b24_b25_split_and_window": " SELECT event_id, CASE WHEN day(acq_date) % 5 = 0 THEN 'val' ELSE 'train' END AS split, CAST(date_trunc('month', acq_date) AS DATE) + 14 - 30 AS first_day, CAST(date_trunc('month', acq_date) AS DATE) + 14 + 30 AS last_day FROM v_scores",
    "b26_daily_calendar": """, e AS (SELECT site, min(acq_date) AS a, max(acq_date) AS b FROM v_scores GROUP BY 1), c AS (SELECT site, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS acq_date FROM e)
 SELECT c.site, c.acq_date, count(v.event_id) AS n FROM c LEFT JOIN v_scores v ON v.site = c.site AND v.acq_date = c.acq_date GROUP BY 1, 2""",
    "g3_ceiling_fallback": ", l AS (SELECT *, CASE WHEN cloud <= 20 THEN 0 WHEN cloud <= 40 THEN 1 END AS level FROM v_scores) SELECT event_id, level FROM l WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY site, acq_date)",
    "g6_nearest_dates": ", a AS (SELECT *, CAST(abs(acq_date - DATE '2024-01-15') AS INTEGER) AS days_away FROM v_scores) SELECT site, event_id, days_away, CAST(row_number() OVER (PARTITION BY site ORDER BY days_away, acq_date, event_id) AS INTEGER) AS place FROM a QUALIFY place <= 5",
    "h2_emitter_merge": " SELECT site, lat, lon, CASE WHEN site % 3 = 0 THEN 'builtin' ELSE 'file' END AS _source FROM v_sites",
    "e11_annualise_qc": f"{_REASONS}, m AS (SELECT site, date_trunc('month', acq_date) AS mo, max(q) AS q FROM rs WHERE reason IS NULL GROUP BY 1, 2) SELECT site, count(q) AS n_months, round(avg(q), 4) AS mean_q FROM m GROUP BY 1",
    "e15_site_by_month": " SELECT site, " + ", ".join(f"round(max(sc_cfar) FILTER (month(acq_date) = {m}), 4) AS max_{m}, coalesce(bool_or(cfar_detect) FILTER (month(acq_date) = {m}), false) AS any_{m}" for m in (1, 2, 3)) + " FROM v_scores GROUP BY site",
    "e18_release_errors": ", r AS (SELECT l_returnflag AS regime, l_extendedprice - l_quantity * 1000 AS e FROM lineitem) SELECT regime, count(e) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias, round(avg(abs(e)), 4) AS mae, round(avg(CAST(e > 0 AS INT)), 6) AS rate FROM r GROUP BY ROLLUP (regime)",
    "e23_dataset_stats": ", t AS (SELECT CAST(toxic AS INTEGER) AS label, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM labels) SELECT label, split, count(*) AS n, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 6) AS share FROM t GROUP BY CUBE (label, split)",
    "e26_best_per_site": ", b AS (SELECT site, event_id, sc_cfar FROM v_scores QUALIFY row_number() OVER (PARTITION BY site ORDER BY sc_cfar IS NULL, event_id) = 1) SELECT * FROM b WHERE sc_cfar < 15",
    "e28_calibration_health": " SELECT status, count(*) AS n, count(sc_cfar) AS n_valid, count(*) - count(sc_cfar) AS n_null FROM v_scores GROUP BY status",
    "f5_sample_size": ", g AS (SELECT site, count(sc_cfar) AS n FROM v_scores GROUP BY 1), a AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS alpha) SELECT site, alpha, n, CAST(least(ceil((n + 1) * (1 - alpha)), n) AS BIGINT) AS rank, CAST(ceil(1 / alpha - 1e-9) - 1 AS BIGINT) AS min_n, n >= ceil(1 / alpha - 1e-9) - 1 AS adequate FROM g, a",
    "f11_auc_interval": """, u AS (SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS a FROM v_pairs a, v_pairs b WHERE a.y = 1 AND b.y = 0),
 c AS (SELECT sum(CAST(y = 1 AS INT)) AS n1, sum(CAST(y = 0 AS INT)) AS n0 FROM v_pairs), s AS (SELECT a, sqrt((a * (1 - a) + (n1 - 1) * (a / (2 - a) - a * a) + (n0 - 1) * (2 * a * a / (1 + a) - a * a)) / (n1::DOUBLE * n0)) AS se FROM u, c)
 SELECT a AS auc, round(se, 6) AS se, round(greatest(0, a - 1.645::DOUBLE * se), 6) AS lo, round(least(1, a + 1.645::DOUBLE * se), 6) AS hi FROM s""",
    "f12_optimal_threshold": """, t AS (SELECT DISTINCT score AS threshold FROM v_pairs), c AS (SELECT threshold, sum(CAST(score >= threshold AND y = 1 AS INT)) AS tp, sum(CAST(score >= threshold AND y = 0 AS INT)) AS fp, sum(CAST(score < threshold AND y = 1 AS INT)) AS fn FROM t, v_pairs GROUP BY 1)
 SELECT threshold, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c ORDER BY 2 * tp / (2 * tp + fp + fn)::DOUBLE DESC, threshold LIMIT 1""",
    "f18_threshold_sensitivity": ", s AS (SELECT unnest([-0.1::DOUBLE, -0.05::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS step), b AS (SELECT count(*) AS b FROM v_scores WHERE sc_cfar > 1.15::DOUBLE), c AS (SELECT step, count(*) FILTER (sc_cfar > 1.15::DOUBLE + step) AS n FROM s, v_scores GROUP BY 1) SELECT step, n, round(100 * (n - b) / b::DOUBLE, 4) AS change_pct FROM c, b",
    "f20_loo_month": """, m AS (SELECT site, CAST(date_trunc('month', acq_date) AS DATE) AS month, max(sc_cfar) FILTER (cfar_detect) AS q FROM v_scores GROUP BY 1, 2), g AS (SELECT *, count(*) OVER w AS n, count(q) OVER w AS k, sum(q) OVER w AS s FROM m WINDOW w AS (PARTITION BY site))
 SELECT site, month, round((k - CAST(q IS NOT NULL AS INT)) / nullif(n - 1, 0)::DOUBLE, 6) AS rate, round((coalesce(s, 0) - coalesce(q, 0)) / nullif(k - CAST(q IS NOT NULL AS INT), 0), 4) AS mean FROM g""",
    "f22_flow_outliers": ", g AS (SELECT *, quantile_cont(sc_cfar, 0.5) OVER (PARTITION BY site) AS mid FROM v_scores) SELECT event_id, site, sc_cfar FROM g WHERE sc_cfar > 2.5 * mid",
    "k5_running_status": f"{_STATUS} SELECT site, n_valid, n_detect, last_day, p, {_TIER} AS tier FROM sp",
    "k5_tier_changes": f"{_STATUS} SELECT site, n_valid, n_detect, p, {_TIER} AS tier, NULL AS before FROM sp",
    "k8_versioned_rule": """, x AS (SELECT *, CASE WHEN acq_date >= DATE '2024-01-20' THEN 3.0 WHEN acq_date >= DATE '2024-01-05' THEN 2.0 END::DOUBLE AS tau FROM v_scores) SELECT event_id, tau, CASE WHEN status <> 'ok' THEN 'NOT_OK' WHEN sc_cfar IS NULL THEN 'NO_COVERAGE' WHEN tau IS NULL THEN 'UNCALIBRATED' WHEN sc_cfar <= tau THEN 'SUB_TAU' WHEN cfar_detect THEN 'DETECTION' ELSE 'CFAR_SUPPRESSED' END AS class FROM x""",
}
