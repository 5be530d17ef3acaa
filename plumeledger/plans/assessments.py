"""Queries over assessments and distance joins, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.functions import scalars as S
from plumeledger.operators import assessments as A
from plumeledger.operators import joins as J
from plumeledger.operators import rasters as R
from plumeledger.operators import screening as C
from plumeledger.plans import risk, screening
from plumeledger.sources import fixtures as X

DRAWS = 200


def _r(df, *cols, places=4):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _flows(s, d):
    hit = (F.col("status") == "ok") & F.col("cfar_detect")
    return X.scores(s, d).withColumn("q", F.when(hit & (F.col("site") < 5), F.col("sc_cfar") * 100))


def _leak(s, d):
    x = X.scores(s, d).select("site", F.col("acq_date").alias("day"), F.col("event_id").alias("id"), "cloud")
    return A.leakage(x.where("cloud % 2 = 0"), x.where("id % 97 = 0"), 3)


def _wind(s, d):
    w = X.wind(s, d)
    return w.select((F.col("event_id") % 10).alias("site"), F.pmod(F.col("event_id") * 7, F.lit(360)).cast("double").alias("bearing"), F.round(S.wind_direction(F.col("u"), F.col("v")), 6).alias("wind_from"))


def _neighbours(s, d):
    p = X.sites(s, d)
    j = p.withColumn("other", F.col("site") + 1).join(p.select(F.col("site").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).hint("merge"), "other")
    return j.select("site", F.round(A.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("bearing"))


def _suppliers(s, d):
    """The calibration set: a score a supplier, keys from 0."""
    return s.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") - 1).alias("key"), F.col("s_acctbal").cast("double").alias("score"))


def _reason(s, d):
    k, x = F.col("cloud"), screening._reasons(s, d)
    mean = F.col("sc_cfar") / 20
    x = x.withColumns({"mean": mean, "control": F.when(k % 10 == 0, mean).otherwise(k / 100000.0), "sc": F.col("sc_cfar") * 4})
    return x.select("event_id", C.exclude_reason(F.col("mean"), F.col("control"), F.col("cv"), F.col("sc"), F.col("q"), F.col("status") == "ok").alias("reason"))


def _macro(s, d):
    px = X.pixels(s, d)
    m = R.pixel_confusion(px, F.col("prob") >= 0.3, F.col("b12") > 0.25)
    return _r(A.macro_metrics(m, F.expr("tp + fn >= 5"), F.expr("tp + fp >= 10")), "iou", "precision", "recall", "f1", "scene_recall", "fpr")


def _union(s, d):
    x = X.scores(s, d)
    return A.union_tagged({"a": x.where("site < 5").select("event_id", "cloud"), "b": x.where("site >= 3").select("event_id", "sc_cfar")})


def _merge(s, d):
    x = X.scores(s, d).groupBy("site", "acq_date").agg(F.count("*").alias("n"))
    return A.merge_days(x, x.where("site % 2 = 0").withColumn("n", -F.col("n")), ["site", "acq_date"])


def _places(s, d):
    x = X.sites(s, d).select("site", (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"))
    row, col = A.world_to_pixel(F.col("x"), F.col("y"), -6000.0, 56000.0, 4.0)
    cut, _ = A.world_to_pixel(F.col("x"), F.col("y"), -6000.0, 56000.0, 4.0, "cut")
    to, moved = A.clamp_pixel(row, 1500, 200, 4.0)
    return x.select("site", row.alias("row"), col.alias("col"), cut.alias("cut"), to.alias("to"), moved.alias("moved"))


QUERIES = {
    "b15_reason_of_quantified": _reason,
    "b23_training_role": lambda s, d: X.sites(s, d).select("site", A.training_role(F.col("site") % 5 == 0, F.col("site") % 3 == 0, F.col("site") % 2 == 0).alias("role")),
    "d7_temporal_leakage": _leak,
    "d9_spatial_exclusion": lambda s, d: _r(J.pairs_within(X.sites(s, d), X.sites(s, d), 50.0, same=True), "km", places=3),
    "d10_separation_flag": lambda s, d: J.separation_flag(X.sites(s, d), X.sites(s, d), same=True),
    "d11_near_counts": lambda s, d: J.near_counts(X.sites(s, d), X.sites(s, d), (20, 40, 80), same=True),
    "d17_model_pairing": lambda s, d: _r(A.model_pairing(X.scores(s, d).select("event_id", F.col("cfar_detect").alias("detected")), X.scores(s, d).where("cloud % 3 > 0").select("event_id", (F.col("sc_cfar") > 1.5).alias("detected")), "event_id"), "agreement", "rate_a", "rate_b"),
    "e5_dual_score": lambda s, d: X.scores(s, d).groupBy("site").agg(A.dual_score(F.count_if(F.expr("cfar_detect and cloud % 2 = 0")), F.count_if(F.col("status") == "ok")).alias("score")),
    "e9_annual_by_month": lambda s, d: _r(A.annual_by_month(_flows(s, d)), "upper", "median", "lo", "hi", "imputed", "lower"),
    "e12_swath_rate": lambda s, d: _r(A.swath_rate(X.scores(s, d).select("site", F.col("cfar_detect").alias("detected"), F.when(F.col("cloud") % 3 > 0, F.col("cloud") % 3 == 1).alias("partial_swath"))), "rate"),
    "e15_site_years": lambda s, d: _r(A.site_years(X.scores(s, d)), "best"),
    "e21_wind_alignment": lambda s, d: _r(A.wind_alignment(_wind(s, d), "site"), "aligned", "mean", "median"),
    "e24_event_density": lambda s, d: X.scores(s, d).groupBy("site").agg(F.round(A.event_density(F.count_if("cfar_detect"), F.max("cloud") * 100), 4).alias("density")),
    "e25_macro_metrics": _macro,
    "f4_bootstrap_thresholds": lambda s, d: _r(A.bootstrap_thresholds(_suppliers(s, d), DRAWS, 0.1), "mean", "sd", "p05", "p95"),
    "h1_union_tagged": _union,
    "h5_merge_days": _merge,
    "i3_world_to_pixel": _places,
    "i5_bearing": _neighbours,
}

_KM = ", k AS (SELECT a.site, b.site AS asset, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM v_sites a, v_sites b WHERE a.site <> b.site)"
_Q = "CASE WHEN status = 'ok' AND cfar_detect AND site < 5 THEN sc_cfar * 100 END"
_CONF = ", k AS (SELECT scene, count(*) FILTER (prob >= 0.3 AND b12 > 0.25) AS tp, count(*) FILTER (prob >= 0.3 AND NOT b12 > 0.25) AS fp, count(*) FILTER (NOT prob >= 0.3 AND b12 > 0.25) AS fn FROM v_pixels GROUP BY scene), m AS (SELECT tp + fn >= 5 AS pos, CAST(tp + fp >= 10 AS INT) AS hit, tp / nullif(tp + fp + fn, 0)::DOUBLE AS i, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM k)"
SQL = {
    "b15_reason_of_quantified": f"{screening._REASONS} SELECT event_id, CASE WHEN status = 'ok' OR reason IN ('uniform_field', 'partial_swath') THEN reason END AS reason FROM rs",
    "b23_training_role": " SELECT site, CASE WHEN site % 5 = 0 THEN 'positive' WHEN site % 6 = 0 THEN 'negative+synthetic' WHEN site % 3 = 0 THEN 'negative' WHEN site % 2 = 0 THEN 'synthetic_only' ELSE 'held_out' END AS role FROM v_sites",
    "d7_temporal_leakage": ", t AS (SELECT DISTINCT site, acq_date AS d FROM v_scores WHERE event_id % 97 = 0), e AS (SELECT event_id AS id, min(abs(acq_date - d)) AS nearest FROM v_scores LEFT JOIN t USING (site) WHERE cloud % 2 = 0 GROUP BY 1) SELECT id, CAST(nearest AS INT) AS nearest, coalesce(nearest < 3, false) AS leak FROM e",
    "d9_spatial_exclusion": _KM + " SELECT site, asset, round(km, 3) AS km FROM k WHERE km <= 50",
    "d10_separation_flag": _KM + ", m AS (SELECT v_sites.site, round(min(km), 3) AS km FROM v_sites LEFT JOIN k ON k.site = v_sites.site AND km <= 60 GROUP BY 1) SELECT site, km, CASE WHEN km < 30 THEN 'HARD_EXCLUDE' WHEN km < 60 THEN 'WARN_CLOSE' ELSE 'OK' END AS flag FROM m",
    "d11_near_counts": _KM + " SELECT v_sites.site, " + ", ".join(f"count(*) FILTER (km <= {r}) AS n_{r}" for r in (20, 40, 80)) + " FROM v_sites LEFT JOIN k USING (site) GROUP BY 1",
    "d17_model_pairing": " SELECT count(*) AS n, round(avg(CAST(cfar_detect = (sc_cfar > 1.5) AS INT)), 4) AS agreement, round(avg(CAST(cfar_detect AS INT)), 4) AS rate_a, round(avg(CAST(sc_cfar > 1.5 AS INT)), 4) AS rate_b FROM v_scores WHERE cloud % 3 > 0",
    "e5_dual_score": " SELECT site, round(count(*) FILTER (cfar_detect AND cloud % 2 = 0) / nullif(count(*) FILTER (status = 'ok'), 0)::DOUBLE, 3) AS score FROM v_scores GROUP BY site",
    "e9_annual_by_month": f", m AS (SELECT site, date_trunc('month', acq_date) AS mo, avg({_Q}) AS q FROM v_scores GROUP BY 1, 2) SELECT site, count(*) AS n_obs, count(q) AS n_det, count(*) - count(q) AS n_non, round(avg(q), 4) AS upper, round(quantile_cont(q, 0.5), 4) AS median, round(min(q), 4) AS lo, round(max(q), 4) AS hi, round(avg(coalesce(q, 300.0)), 4) AS imputed, round(avg(coalesce(q, 0.0)), 4) AS lower FROM m GROUP BY site",
    "e12_swath_rate": " SELECT site, count(*) AS n_obs, count(*) FILTER (cfar_detect) AS n_det, round(count(*) FILTER (cfar_detect) / count(*)::DOUBLE, 4) AS rate FROM v_scores WHERE cloud % 3 = 2 GROUP BY site",
    "e15_site_years": ", y AS (SELECT site, CAST(year(acq_date) AS INT) AS year, max(sc_cfar) AS best, coalesce(bool_or(cfar_detect), false) AS hit FROM v_scores GROUP BY 1, 2), l AS (SELECT site, string_agg(year::VARCHAR, ',' ORDER BY year) FILTER (hit) AS ys FROM y GROUP BY site) SELECT site, year, round(best, 4) AS best, hit AS any_detect, coalesce(ys, '') AS detect_years FROM y JOIN l USING (site)",
    "e21_wind_alignment": ", w AS (SELECT event_id % 10 AS site, event_id * 7 % 360 AS b, (round(((270 - degrees(atan2(v, u))) % 360 + 360) % 360, 6) + 180) % 360 AS dn FROM v_wind), x AS (SELECT site, least((b - dn + 720) % 360, 360 - (b - dn + 720) % 360) AS d FROM w) SELECT site, count(*) AS n, round(avg(CAST(d < 45 AS INT)), 4) AS aligned, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.5), 4) AS median FROM x WHERE d IS NOT NULL GROUP BY site",
    "e24_event_density": " SELECT site, round(count(*) FILTER (cfar_detect) / nullif(max(cloud) * 100, 0)::DOUBLE * 1000, 4) AS density FROM v_scores GROUP BY site",
    "e25_macro_metrics": _CONF + " SELECT count(*) FILTER (pos) AS n_pos, round(avg(i) FILTER (pos), 4) AS iou, round(avg(p) FILTER (pos), 4) AS \"precision\", round(avg(r) FILTER (pos), 4) AS recall, round(avg(2 * p * r / nullif(p + r, 0)) FILTER (pos), 4) AS f1, round(avg(hit) FILTER (pos), 4) AS scene_recall, round(avg(hit) FILTER (NOT pos), 4) AS fpr FROM m",
    "f4_bootstrap_thresholds": f", s AS (SELECT s_suppkey - 1 AS key, CAST(s_acctbal AS DOUBLE) AS score FROM supplier), z AS (SELECT count(*) AS n FROM s), p AS (SELECT b, CAST(floor({risk._u('b', 'i')} * n) AS BIGINT) AS key FROM (SELECT unnest(range({DRAWS})) AS b) CROSS JOIN (SELECT n, unnest(range(n)) AS i FROM z)), r AS (SELECT b, score, row_number() OVER (PARTITION BY b ORDER BY score) AS k FROM p JOIN s USING (key)), t AS (SELECT b, min(score) AS tau FROM r, z WHERE k >= least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n) GROUP BY b) SELECT any_value(n) AS n, round(avg(tau), 4) AS mean, round(stddev_samp(tau), 4) AS sd, round(quantile_cont(tau, 0.05), 4) AS p05, round(quantile_cont(tau, 0.95), 4) AS p95 FROM t, z",
    "h1_union_tagged": " SELECT event_id, cloud, NULL::DOUBLE AS sc_cfar, 'a' AS _source FROM v_scores WHERE site < 5 UNION ALL SELECT event_id, NULL, sc_cfar, 'b' FROM v_scores WHERE site >= 3",
    "h5_merge_days": " SELECT site, acq_date, count(*) * CASE WHEN site % 2 = 0 THEN -1 ELSE 1 END AS n FROM v_scores GROUP BY 1, 2",
    "i3_world_to_pixel": ", x AS (SELECT site, (56000.0 - lat * 1000) / 4 AS r, (lon * 1000 + 6000.0) / 4 AS c FROM v_sites), y AS (SELECT site, CAST(round_even(r, 0) AS INT) AS \"row\", CAST(round_even(c, 0) AS INT) AS col, CAST(trunc(r) AS INT) AS cut FROM x) SELECT *, greatest(200, least(1299, \"row\")) AS \"to\", (greatest(200, least(1299, \"row\")) - \"row\") * 4.0::DOUBLE AS moved FROM y",
    "i5_bearing": " SELECT a.site, round((degrees(atan2((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), b.lat - a.lat)) + 360) % 360, 3) AS bearing FROM v_sites a JOIN v_sites b ON b.site = a.site + 1",
}
