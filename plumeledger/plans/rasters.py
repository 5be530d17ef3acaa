"""Queries over rasters, stores and event windows, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import rasters as R
from plumeledger.sources import fixtures as X
from plumeledger.sources import stores as O
from plumeledger.sources.scratch import scratch_dir
from plumeledger.streaming import monitor
from plumeledger.streaming import windows as T

CORNERS = [(0.5, 0.5), (6.5, 1.0), (5.0, 6.5), (1.5, 4.0)]
RECORD = "event_id long, site long, sc double, status string"


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def _stream(s, d):
    return monitor.event_stream(s, f"{d}/events.parquet")


def _bands(s, d):
    byte = lambda c: F.floor(F.col(c) * 255).cast("int")
    return X.pixels(s, d).withColumns({"b11": byte("b11"), "b12": byte("b12")})


def _diff(s, d):
    px = _bands(s, d)
    return R.bitemporal_diff(px, px.withColumn("scene", F.col("scene") + 1), ["b11", "b12"])


def _profile(s, d):
    return R.ring_profile(X.pixels(s, d), F.sqrt(F.pow(F.col("row") - 3, 2) + F.pow(F.col("col") - 3, 2)), 1.0, 8)


def _gradient(s, d):
    g = R.ring_gradient(_profile(s, d))
    kind = F.when(F.col("scene") % 3 == 0, "control").when(F.col("scene") % 3 == 1, "emitter").otherwise("other")
    return _r(g.withColumn("verdict", R.gradient_verdict(kind, F.round("score", 6), F.round("near_far", 6))), "slope", "intercept", "r2", "near_far", places=4).select("scene", "n_rings", "slope", "intercept", "r2", "near_far", "verdict")


def _scenes(s, d):
    x = X.pixels(s, d).where("scene % 2 = 0").select("scene").distinct()
    return x.select("scene", (F.col("scene") + 1).alias("clean"))


def _timeseries(s, d):
    path = scratch_dir(s, "timeseries")
    x = X.scores(s, d).select(F.struct(F.array(F.struct("event_id", "site", F.col("sc_cfar").alias("sc"), "status", F.lit("x").alias("note"))).alias("records")).alias("r"))
    x.select("r.*").write.json(path)
    return O.scan_timeseries(s, path, RECORD, lines=True)


def _multidate(s, d):
    path = scratch_dir(s, "multidate")
    x = O.latest(X.scores(s, d).select("site", "acq_date", "event_id", F.col("sc_cfar").alias("sc")), ["site", "acq_date"], "event_id")
    day = F.create_map(F.date_format("acq_date", "yyyyMMdd"), F.struct("event_id", "sc"))
    x.select(F.to_json(F.create_map(F.col("site").cast("string"), day))).write.text(path)
    return O.scan_multidate(s, path, "event_id long, sc double", lines=True)


def _quantifications(s, d):
    path = scratch_dir(s, "quantifications")
    k = F.col("event_id")
    x = X.scores(s, d).select(F.col("site").cast("string").alias("site"), (k % 50).cast("string").alias("scene_id"), F.col("sc_cfar").alias("flow_rate_kgh"), F.when(k % 3 > 0, k % 3 == 2).alias("excluded"), k.alias("ingest_seq"), F.lit(1).alias("unknown"))
    x.write.json(path)
    return O.load_quantifications(s, path).select("site", "scene_id", "flow_rate_kgh", "exclude_reason", "ingest_seq")


def _assets(s, d):
    path = scratch_dir(s, "assets")
    k = F.col("site")
    capacity = F.when(k % 3 == 0, "").when(k % 7 == 0, "n/a").otherwise(k.cast("string"))
    x = X.sites(s, d).select(k.alias("gppd_idnr"), F.col("ticker").alias("name"), F.when(k % 5 == 0, "?").otherwise(F.col("lat").cast("string")).alias("latitude"), F.col("lon").alias("longitude"), capacity.alias("capacity_mw"))
    x.write.option("header", True).csv(path)
    return O.load_assets(s, path, "wri").select("asset_id", "name", "lat", "lon", "capacity_mw", "source")


def _inventory(s, d):
    path = scratch_dir(s, "inventory")
    k = F.col("event_id")
    gas = F.when(k % 2 == 0, " CH4 ").otherwise("co2")
    X.scores(s, d).select(gas.alias("gas"), F.date_format("acq_date", "yyyy-MM-dd HH:mm:ss").alias("start_time"), k.alias("emissions_quantity")).write.option("header", True).csv(path)
    return O.load_inventory(s, path).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


def _log(s, d):
    path = scratch_dir(s, "event-log")
    x = X.scores(s, d).select("event_id", "sc_cfar")
    for part in range(2):  # two appends to one log
        O.append_event_log(x.where(F.col("event_id") % 2 == part), path)
    return s.read.schema("logged_at timestamp, event_id long, sc_cfar double, pixel_area_m2 int").json(path).select("event_id", "sc_cfar", "pixel_area_m2", F.col("logged_at").isNotNull().alias("logged"))


def _upsert(s, d):
    x = X.scores(s, d).select("site", (F.col("event_id") % 500).alias("scene_id"), "event_id", F.col("sc_cfar").alias("sc"))
    old = O.write_snapshot(O.latest(x.where("event_id % 4 > 0"), ["site", "scene_id"], "event_id"), "snapshot")
    return O.write_snapshot(O.upsert(old, x.where("event_id % 4 = 0"), ["site", "scene_id"], "event_id"), "snapshot")


def _refresh(s, d):
    x = X.scores(s, d).select("event_id", "sc_cfar", "site", F.year("acq_date").alias("year"))
    path = scratch_dir(s, "partitioned")
    O.refresh_partitions(x, path, ["site", "year"])
    O.refresh_partitions(x.where("site % 2 = 0 and event_id % 3 = 0").withColumn("sc_cfar", F.col("sc_cfar") + 1), path, ["site", "year"])
    return s.read.schema(x.schema).parquet(path)


def _corrections(s, d):
    x = _stream(s, d).select((F.col("user_id") % 100).alias("site"), F.to_date("ts").alias("day"), "event_id", F.col("value").alias("flow"), "event_type")
    return T.upsert_stream(x, "corrected", ["site", "day"], "event_id", T.flagged_before_write(F.col("flow"), F.col("event_type") == "error"))


def _near(s, d):
    x = _stream(s, d)
    return monitor.drain(T.near_in_time(x.where("event_type = 'error'"), _stream(s, d).where("event_type = 'view'"), "user_id", 60), "near-in-time")


QUERIES = {
    "c1_normalize_band": lambda s, d: X.pixels(s, d).select("scene", "row", "col", R.normalize_band((F.col("b11") - 0.15) * 12000).alias("byte")),
    "c2_tiles": lambda s, d: R.tiles(X.pixels(s, d), 8, 8, 3, 1).select("scene", "row", "col", "tile_row", "tile_col"),
    "c3_stitch": lambda s, d: _r(R.stitch(R.tiles(X.pixels(s, d), 8, 8, 4, 2).select("scene", "tile_row", "tile_col", (F.col("row") - 2 * F.col("tile_row")).alias("row"), (F.col("col") - 2 * F.col("tile_col")).alias("col"), "prob"), 2), "prob"),
    "c5_valid_fraction": lambda s, d: _r(R.valid_fraction(_bands(s, d).withColumn("b11", F.when(F.col("b11") > 50, F.col("b11"))).withColumn("b12", F.when(F.col("b12") > 40, F.col("b12")).otherwise(0)), ["b11", "b12"], F.col("row").between(2, 5)), "valid_frac"),
    "c6_ring_profile": lambda s, d: _r(_profile(s, d), "mean_prob"),
    "c7_ring_gradient": _gradient,
    "c9_extract_events": lambda s, d: _r(R.extract_events(X.pixels(s, d), 0.18, 4), "top", "mean"),
    "c11_bitemporal_diff": lambda s, d: _diff(s, d).select("scene", "row", "col", "b11", "b12"),
    "c12_delta_stats": lambda s, d: _r(R.delta_stats(_diff(s, d), ["b11", "b12"]), "b11_mean", "b12_mean"),
    "c14_polygon_mask": lambda s, d: X.pixels(s, d).where(R.in_polygon(F.col("col"), F.col("row"), CORNERS)).groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean")),
    "c19_geometric_flow": lambda s, d: X.pixels(s, d).where("prob >= 0.3").groupBy("scene").agg((F.count("*") * 400).alias("area"), ((F.max("row") - F.min("row")) * 20).alias("length")).select("scene", F.round(R.geometric_flow(F.col("area"), F.col("length"), F.col("scene") % 5 / 2), 4).alias("flow")),
    "c20_weighted_centroid": lambda s, d: _r(R.weighted_centroid(X.pixels(s, d), 3, 4, 2, 0.1), "row", "col"),
    "c22_pixel_confusion": lambda s, d: _r(R.pixel_confusion(X.pixels(s, d), F.col("prob") >= 0.3, F.col("b12") > 0.25), "iou", "precision", "recall", "f1"),
    "c23_prob_stats": lambda s, d: _r(R.prob_stats(X.pixels(s, d), 10), "mean", "top", "p95"),
    "c31_scene_contrast": lambda s, d: _r(R.scene_contrast(X.pixels(s, d), _scenes(s, d), [0.1, 0.18, 0.3]), "ratio"),
    "c32_blob_stats": lambda s, d: _r(R.blob_stats(X.pixels(s, d), 0.3), "mean", "top", "pct"),
    "a1_scan_timeseries": _timeseries,
    "a2_scan_multidate": _multidate,
    "a4_load_quantifications": _quantifications,
    "a5_load_assets": _assets,
    "a6_load_inventory": _inventory,
    "a13_event_log": _log,
    "a14_upsert": _upsert,
    "a16_partial_refresh": _refresh,
    "k1_log_stream": lambda s, d: T.log_stream(_stream(s, d).select("event_id", "user_id", "value"), "log-stream"),
    "k3_daily_counts": lambda s, d: T.final(T.tumbling_counts(_stream(s, d), "event_type"), "daily").withColumn("start", F.to_date("start")),
    "k3_monthly_counts": lambda s, d: T.final(T.monthly_counts(_stream(s, d), "event_type"), "monthly"),
    "k3_sliding_counts": lambda s, d: T.final(T.tumbling_counts(_stream(s, d), "event_type", size="30 days", slide="1 day"), "sliding").withColumn("start", F.to_date("start")),
    "k3_sessions": lambda s, d: T.final(T.sessions(_stream(s, d).where("event_type = 'click'"), "user_id", "6 hours"), "sessions").select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("last").alias("last"), "n"),
    "k4_near_in_time": _near,
    "k6_k7_corrections": _corrections,
}

_REACH = """, h AS (SELECT scene, "row" AS r, col AS c, prob FROM v_pixels WHERE prob {op} {t}),
 e AS (WITH RECURSIVE w AS (SELECT scene, r, c, r AS r0, c AS c0 FROM h UNION SELECT h.scene, h.r, h.c, w.r0, w.c0 FROM w JOIN h ON h.scene = w.scene AND abs(h.r - w.r) + abs(h.c - w.c) = 1)
  SELECT scene, r, c, min(r0::BIGINT * 4294967296 + c0) AS event FROM w GROUP BY 1, 2, 3)"""
_BYTES = ', q AS (SELECT scene, "row", col, CAST(floor(b11 * 255) AS INT) AS b11, CAST(floor(b12 * 255) AS INT) AS b12 FROM v_pixels), df AS (SELECT a.scene, a."row", a.col, greatest(0, least(255, a.b11 - b.b11 + 128)) AS b11, greatest(0, least(255, a.b12 - b.b12 + 128)) AS b12 FROM q a JOIN q b ON a.scene = b.scene + 1 AND a."row" = b."row" AND a.col = b.col)'
_RING = ', rg AS (SELECT scene, CAST(floor(sqrt(("row" - 3) * ("row" - 3) + (col - 3) * (col - 3))) AS INT) AS ring, prob FROM v_pixels), rp AS (SELECT s.scene, k.ring, k.ring::DOUBLE AS inner_km, k.ring + 1::DOUBLE AS outer_km, count(prob) AS n, avg(prob) AS mean_prob FROM (SELECT DISTINCT scene FROM v_pixels) s CROSS JOIN (SELECT unnest(range(8))::INT AS ring) k LEFT JOIN rg ON rg.scene = s.scene AND rg.ring = k.ring GROUP BY 1, 2, 3, 4)'
_TILE = '(SELECT unnest(range(3)) AS {n})'
_GRAD = """ , g AS (SELECT scene, count(*) AS n_rings, regr_slope(ln(mean_prob), ring + 0.5) AS slope, regr_intercept(ln(mean_prob), ring + 0.5) AS intercept, CASE WHEN var_pop(ln(mean_prob)) > 0 THEN pow(corr(ln(mean_prob), ring + 0.5), 2) ELSE 0 END AS r2, arg_min(mean_prob, ring) / arg_max(mean_prob, ring) AS nf FROM rp WHERE mean_prob > 0 GROUP BY scene HAVING count(*) >= 3)
 SELECT scene, n_rings, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r2, round(nf, 4) AS near_far, CASE scene % 3 WHEN 0 THEN CASE WHEN -1000 * slope > 1 THEN 'control fires' ELSE 'quiet' END WHEN 1 THEN CASE WHEN -1000 * slope > 2 AND nf > 1.5 THEN 'strong' WHEN -1000 * slope > 0.5 OR nf > 1.2 THEN 'weak' ELSE 'none' END END AS verdict FROM g"""


def _crossed() -> str:
    return " + ".join(f"CAST((({ay} > \"row\") <> ({by} > \"row\")) AND (col < {bx - ax} * (\"row\" - {ay}) / {by - ay}::DOUBLE + {ax}) AS INT)" for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:] + CORNERS[:1]))


SQL = {
    "c1_normalize_band": ' SELECT scene, "row", col, CAST(floor(greatest(0.0, least(255.0, (b11 - 0.15::DOUBLE) * 12000 / 10000 * 255))) AS INT) AS byte FROM v_pixels',
    "c2_tiles": f' SELECT scene, "row", col, CAST(i AS INT) AS tile_row, CAST(j AS INT) AS tile_col FROM v_pixels, {_TILE.format(n="i")}, {_TILE.format(n="j")} WHERE "row" BETWEEN i * 2 AND i * 2 + 2 AND col BETWEEN j * 2 AND j * 2 + 2',
    "c3_stitch": ' SELECT scene, "row", col, round(prob, 6) AS prob FROM v_pixels',
    "c5_valid_fraction": ' SELECT scene, round(avg(CAST(floor(b11 * 255) > 50 OR floor(b12 * 255) > 40 AS INT)), 6) AS valid_frac FROM v_pixels WHERE "row" BETWEEN 2 AND 5 GROUP BY scene',
    "c6_ring_profile": _RING + " SELECT scene, ring, inner_km, outer_km, n, round(mean_prob, 6) AS mean_prob FROM rp",
    "c7_ring_gradient": _RING + _GRAD,
    "c9_extract_events": _REACH.format(op=">=", t="0.18::DOUBLE") + " SELECT scene, event, count(*) AS area_px, CAST(floor(avg(r)) AS BIGINT) AS \"row\", CAST(floor(avg(c)) AS BIGINT) AS col, round(max(prob), 6) AS top, round(avg(prob), 6) AS mean FROM e JOIN h USING (scene, r, c) GROUP BY 1, 2 HAVING count(*) >= 4",
    "c11_bitemporal_diff": _BYTES + ' SELECT scene, "row", col, b11, b12 FROM df',
    "c12_delta_stats": _BYTES + " SELECT scene, count(*) AS n_px, " + ", ".join(f"min({b} - 128) AS {b}_min, max({b} - 128) AS {b}_max, round(avg({b} - 128), 6) AS {b}_mean" for b in ("b11", "b12")) + " FROM df GROUP BY scene",
    "c14_polygon_mask": f" SELECT scene, count(*) AS n, round(avg(prob), 6) AS mean FROM v_pixels WHERE ({_crossed()}) % 2 = 1 GROUP BY scene",
    "c19_geometric_flow": ' SELECT scene, round(CASE WHEN l < 1 THEN 0.0::DOUBLE ELSE a * 0.003::DOUBLE / (l / greatest(scene % 5 / 2::DOUBLE, 0.5::DOUBLE)) * 3600 END, 4) AS flow FROM (SELECT scene, count(*) * 400 AS a, (max("row") - min("row")) * 20 AS l FROM v_pixels WHERE prob >= 0.3 GROUP BY scene)',
    "c20_weighted_centroid": ' SELECT scene, count(*) AS n_px, round(sum(prob * "row") / sum(prob), 6) AS "row", round(sum(prob * col) / sum(prob), 6) AS col FROM v_pixels WHERE "row" BETWEEN 1 AND 5 AND col BETWEEN 2 AND 6 AND prob > 0.1 GROUP BY scene HAVING count(*) >= 10',
    "c22_pixel_confusion": ", k AS (SELECT scene, count(*) FILTER (prob >= 0.3 AND b12 > 0.25) AS tp, count(*) FILTER (prob >= 0.3 AND NOT b12 > 0.25) AS fp, count(*) FILTER (NOT prob >= 0.3 AND b12 > 0.25) AS fn, count(*) FILTER (NOT prob >= 0.3 AND NOT b12 > 0.25) AS tn FROM v_pixels GROUP BY scene), m AS (SELECT *, tp / nullif(tp + fp + fn, 0)::DOUBLE AS i, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM k) SELECT scene, tp, fp, fn, tn, round(i, 6) AS iou, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM m",
    "c23_prob_stats": " SELECT scene, round(avg(prob), 6) AS mean, round(max(prob), 6) AS top, round(quantile_cont(prob, 0.95), 6) AS p95, count(*) FILTER (prob > 0.1) AS n10, count(*) FILTER (prob > 0.3) AS n30, count(*) FILTER (prob > 0.3) >= 10 AS detected FROM v_pixels GROUP BY scene",
    "c31_scene_contrast": ", n AS (SELECT scene, t, count(*) FILTER (prob > t) AS n FROM v_pixels, (SELECT unnest([0.1::DOUBLE, 0.18::DOUBLE, 0.3::DOUBLE]) AS t) GROUP BY 1, 2) SELECT a.scene, b.scene AS clean, t, a.n AS n_scene, b.n AS n_clean, round(a.n / nullif(b.n, 0)::DOUBLE, 6) AS ratio FROM n a JOIN n b USING (t) WHERE a.scene % 2 = 0 AND b.scene = a.scene + 1",
    "c32_blob_stats": _REACH.format(op=">", t="0.3::DOUBLE") + ", b AS (SELECT scene, count(*) AS n_blobs, max(n) AS largest FROM (SELECT scene, event, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY scene) SELECT scene, round(avg(prob), 6) AS mean, round(max(prob), 6) AS top, round(100 * avg(CAST(prob > 0.3 AS INT)), 6) AS pct, coalesce(any_value(n_blobs), 0) AS n_blobs, coalesce(any_value(largest), 0) AS largest FROM v_pixels LEFT JOIN b USING (scene) GROUP BY scene",
    "a1_scan_timeseries": " SELECT event_id, site, sc_cfar AS sc, status FROM v_scores",
    "a2_scan_multidate": " SELECT CAST(site AS VARCHAR) AS site, acq_date, max(event_id) AS event_id, arg_max(sc_cfar, event_id) AS sc FROM v_scores GROUP BY site, acq_date",
    "a4_load_quantifications": " SELECT CAST(site AS VARCHAR) AS site, CAST(event_id % 50 AS VARCHAR) AS scene_id, arg_max(sc_cfar, event_id) AS flow_rate_kgh, '' AS exclude_reason, max(event_id) AS ingest_seq FROM v_scores WHERE event_id % 3 < 2 GROUP BY site, event_id % 50",
    "a5_load_assets": " SELECT CAST(site AS VARCHAR) AS asset_id, ticker AS name, lat, lon, CASE WHEN site % 3 > 0 THEN site::DOUBLE END AS capacity_mw, 'wri' AS source FROM v_sites WHERE site % 5 > 0 AND (site % 3 = 0 OR site % 7 > 0)",
    "a6_load_inventory": " SELECT CAST(year(acq_date) AS INT) AS year, CAST(month(acq_date) AS INT) AS month, count(*) AS n, sum(event_id)::DOUBLE AS quantity FROM v_scores WHERE event_id % 2 = 0 GROUP BY 1, 2",
    "a13_event_log": " SELECT event_id, sc_cfar, 400 AS pixel_area_m2, true AS logged FROM v_scores",
    "a14_upsert": " SELECT site, event_id % 500 AS scene_id, event_id, sc_cfar AS sc FROM v_scores QUALIFY row_number() OVER (PARTITION BY site, event_id % 500 ORDER BY event_id % 4 = 0 DESC, event_id DESC) = 1",
    "a16_partial_refresh": " SELECT event_id, sc_cfar + CASE WHEN site % 2 = 0 THEN 1 ELSE 0 END AS sc_cfar, site, CAST(year(acq_date) AS INT) AS year FROM v_scores WHERE site % 2 = 1 OR event_id % 3 = 0",
    "k1_log_stream": " SELECT event_id, user_id, value FROM events",
    "k3_daily_counts": " SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "k3_monthly_counts": " SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "k3_sliding_counts": " SELECT CAST(ts AS DATE) - CAST(i AS INT) AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(30)) AS i) GROUP BY 1, 2",
    "k3_sessions": ", o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE event_type = 'click'), z AS (SELECT *, sum(CAST(p IS NULL OR ts > p + INTERVAL 6 HOURS AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, count(*) AS n FROM z GROUP BY user_id, k",
    "k4_near_in_time": " SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'error' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 60 MINUTES AND a.ts + INTERVAL 60 MINUTES",
    "k6_k7_corrections": " SELECT user_id % 100 AS site, CAST(ts AS DATE) AS day, event_id, value AS flow, event_type, event_type = 'error' AS flagged, value * CASE WHEN event_type = 'error' THEN 0.30::DOUBLE ELSE 0.15::DOUBLE END AS uncertainty FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 100, CAST(ts AS DATE) ORDER BY event_id DESC) = 1",
}
