"""Queries over product names, scene rules and joins of scene records, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import detection as D
from plumeledger.operators import scenes as N
from plumeledger.sources import fixtures as X

LEVELS = [(3, 20.0, False), (7, 30.0, False), (7, 30.0, True), (15, 60.0, True), (40, 100.0, True)]
TAUS = {"t10": 3.5796, "t20": 2.4901, "rule": 4.1052}


def _products(s, d):
    x, k = X.scores(s, d), F.col("cloud")
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = F.concat(F.lit("S2A_MSIL1C_"), stamp("acq_date"), F.lit("T"), two(k % 24), F.lit("1531_N0500_R022_T"), two(F.col("site") + 30), F.lit("UXX_"), stamp(F.date_add("acq_date", 1)), F.lit("T120000"))
    return x.withColumn("name", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("crop_"), F.date_format("acq_date", "yyyy-MM-dd"))).otherwise(name))


_PRODUCTS = """, pr AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'crop_' || strftime(acq_date, '%Y-%m-%d') ELSE 'S2A_MSIL1C_' || strftime(acq_date, '%Y%m%d') || 'T' || lpad((cloud % 24)::VARCHAR, 2, '0') || '1531_N0500_R022_T' || lpad((site + 30)::VARCHAR, 2, '0') || 'UXX_' || strftime(acq_date + 1, '%Y%m%d') || 'T120000' END AS name FROM v_scores)"""


def _names(s, d):
    n = F.col("name")
    start = N.orbit_start(n)
    parts = N.product_parts(n)
    return _products(s, d).select("event_id", *[c.alias(k) for k, c in parts.items()], N.acquisition_date(n).alias("acquired"), N.loose_date(n).alias("loose"), N.acquisition_key(n).alias("key"), F.hour(start).alias("hour"), F.coalesce(N.is_daytime(start), F.lit(False)).alias("daytime"))


def _ruled(s, d):
    x, k = X.scores(s, d), F.col("cloud")
    mean, control = F.col("sc_cfar") / 20, F.when(k % 10 == 0, F.col("sc_cfar") / 20).otherwise(k / 100000.0)
    sc = F.when(k % 6 == 0, 1.0).otherwise(F.col("sc_cfar") * 4)
    return x.withColumns({"mean": mean, "control": control, "sc": sc})


_RULED = """, rl AS (SELECT *, sc_cfar / 20 AS mean, CASE WHEN cloud % 10 = 0 THEN sc_cfar / 20 ELSE cloud / 100000.0::DOUBLE END AS control, CASE WHEN cloud % 6 = 0 THEN 1.0::DOUBLE ELSE sc_cfar * 4 END AS sc FROM v_scores),
 rf AS (SELECT *, abs(sc - 1) < 1e-6 AND abs(cv) < 1e-9 AS flat, abs(mean - control) < 1e-6 AS eq FROM rl)"""


def _rules(s, d):
    a = [F.col(c) for c in ("mean", "control", "cv", "sc")]
    return _ruled(s, d).select("event_id", N.is_bad_scene(a[0]).alias("bad"), N.uniform_field(*a[:2]).alias("uniform"), N.partial_swath(*a).alias("partial"), N.partial_swath(*a, strict=True).alias("degenerate"))


def _repair(s, d):
    a = [F.col(c) for c in ("mean", "control", "cv", "sc")]
    x = _ruled(s, d).withColumns({"degenerate": N.partial_swath(*a), "valid_frac": F.when(F.col("cloud") % 4 > 0, (F.col("cloud") % 4) / 4.0)})
    return N.repair_coverage(x, ["sc", "cv"]).select("event_id", "status", "sc", "cv", "fixed")


def _masks(s, d):
    r = X.sites(s, d).select("site", F.when(F.col("site") % 3 == 0, "bitemporal").when(F.col("site") % 3 == 1, "skip").otherwise("other").alias("policy"))
    return N.mask_select(X.scores(s, d).withColumn("has_bitemporal", F.col("cloud") % 2 == 0), r).select("event_id", "mask_source", "bitemporal_missing")


def _verdicts(s, d):
    k = F.col("cloud")
    return _ruled(s, d).select("event_id", N.bitemporal_verdict(F.col("sc_cfar"), F.col("sc_cfar") * (k % 5) / 2, F.col("site") % 2 == 0).alias("verdict"), N.dual_sensor(F.col("mean"), F.col("cfar_detect"), F.when(k % 7 > 0, (k % 12).cast("double"))).alias("assessment"), *[c.alias(n) for n, c in N.flags_at(F.col("sc_cfar"), TAUS).items()])


def _excluded(s, d):
    r = D.site_risk(X.scores(s, d)).select("site", "eur", "t_co2e", "tier")
    return N.exclude_sites(r, X.sites(s, d).where("site % 4 = 1"), ["eur", "t_co2e"])


def _cascade(s, d):
    x = X.scores(s, d).withColumns({"days_away": F.abs(F.datediff("acq_date", F.lit("2024-01-15").cast("date"))), "exact_tile": F.col("event_id") % 3 == 0})
    return N.search_cascade(x, ["site"], LEVELS).select("event_id", "site", "level")


def _inventory(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select((F.col("o_custkey") % 10).alias("site"), F.lit(2024).alias("year"), (F.month("o_orderdate") % 3 + 1).alias("month"), F.col("o_totalprice").alias("value"))


def _months(s, d):
    x = X.scores(s, d)
    return N.month_join(x, _inventory(s, d)).select("event_id", F.size("values").cast("long").alias("n"), F.round(F.try_element_at("values", F.lit(1)), 2).alias("least"))


def _obs(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("site"), F.col("ts").cast("timestamp").alias("at"), ((F.col("event_id") % 20) / 10.0).alias("lat"), ((F.col("event_id") % 30) / 10.0).alias("lon"), (F.col("value") / 100 - 2).alias("u"), (F.get_json_object("props", "$.k").cast("int") / 50.0 - 1).alias("v"), "event_type")


def _asof(s, d):
    x = _obs(s, d)
    g = N.wind_asof(x.where("event_type <> 'view'"), x.where("event_type = 'view'"))
    return g.select("id", F.round("speed", 4).alias("speed"), F.round("direction", 3).alias("direction"), "source")


def _window(s, d):
    x = _obs(s, d)
    g = N.wind_window(x.where("event_type = 'error'"), x.where("event_type = 'view'"))
    return g.select("id", "n", F.round("speed", 4).alias("speed"), F.round("direction", 3).alias("direction"))


_OBS = """, ob AS (SELECT event_id AS id, user_id % 10 AS site, ts AS at, (event_id % 20) / 10.0::DOUBLE AS lat, (event_id % 30) / 10.0::DOUBLE AS lon, value / 100 - 2 AS u, CAST(json_extract_string(props, '$.k') AS INTEGER) / 50.0::DOUBLE - 1 AS v, event_type FROM events)"""


def _winner(s, d):
    x = X.scores(s, d).select(F.col("event_id").alias("key"), F.col("sc_cfar").alias("q"), "cloud")
    new = x.where("key % 3 = 0").select("key", (F.col("q") * 2).alias("q"), F.when(F.col("cloud") % 2 == 0, "quantified").otherwise("failed").alias("status"))
    return N.merge_winner(x.select("key", "q"), new)


def _monthly(s, d):
    x = X.scores(s, d)
    return x.groupBy("site", F.trunc("acq_date", "week").alias("month")).agg(F.max(F.when(F.col("cfar_detect"), F.col("sc_cfar") * 100)).alias("q"))


def _stability(s, d):
    l = D.loo_scene(X.scores(s, d))
    base = X.scores(s, d).groupBy(F.col("site").alias("_s")).agg(F.avg(F.col("cfar_detect").cast("double")).alias("base"))
    return N.stability_verdict(l.join(base.hint("merge"), F.col("site") == F.col("_s")), "site", "rate", "base")


QUERIES = {
    "b2_b6_product_names": _names,
    "b7_catalogue_search": lambda s, d: N.catalogue_search(X.scores(s, d), "2024-01-05", "2024-01-20", 30, 50).select("event_id", "acq_date", "cloud"),
    "b8_b10_scene_rules": _rules,
    "b11_repair_coverage": _repair,
    "b16_mask_select": _masks,
    "b21_b22_b27_verdicts": _verdicts,
    "b28_excluded_sites": _excluded,
    "g4_search_cascade": _cascade,
    "g7_event_query": lambda s, d: N.event_query(X.scores(s, d), X.sites(s, d).withColumn("ticker", F.when(F.col("site") % 2 == 0, "A").otherwise("B")), "A", 2.0, "2024-01-05", "2024-01-25", 200).select("event_id", "site", "acq_date"),
    "d3_month_join": _months,
    "d5_wind_asof": _asof,
    "d6_wind_window": _window,
    "d12_a15_todo": lambda s, d: X.scores(s, d).select("event_id").join(X.scores(s, d).where("status = 'ok'").select("event_id").hint("merge"), "event_id", "left_anti"),
    "d13_merge_winner": _winner,
    "d18_shared_tiles": lambda s, d: N.shared_tiles(X.scores(s, d).select(F.col("event_id").alias("id"), F.col("site").alias("tile"), F.col("acq_date").alias("day"))),
    "d19_flow_vs_inventory": lambda s, d: N.flow_vs_inventory(_monthly(s, d)),
    "e10_annualise_ci": lambda s, d: N.annualise_ci(_monthly(s, d), [300.0, 0.0]),
    "e17_enhancement_buckets": lambda s, d: N.enhancement_buckets(X.scores(s, d).withColumn("e", F.when(F.col("cloud") % 5 > 0, F.col("sc_cfar") * 3))),
    "e22_held_out": lambda s, d: N.held_out(X.scores(s, d), 3.5796),
    "e27_combined_detections": lambda s, d: N.combined_detections([X.scores(s, d).where("event_id % 2 = 0"), X.scores(s, d).where("event_id % 3 = 0")], 3.5796),
    "f14_hosmer_lemeshow": lambda s, d: N.hosmer_lemeshow(X.pairs(s, d)),
    "f16_kupiec": lambda s, d: N.kupiec(X.pairs(s, d)),
    "f21_stability_verdict": _stability,
    "h3_co_detected_months": lambda s, d: X.scores(s, d).where("cfar_detect").select("site", "acq_date").intersect(X.scores(s, d).where("cloud > 50").select("site", "acq_date")),
}

_CAS = "CASE " + " ".join(f"WHEN away <= {a} AND cloud <= {c} AND ({str(t).lower()} OR event_id % 3 = 0) THEN {i}" for i, (a, c, t) in enumerate(LEVELS)) + " END"
_T = "CASE " + " ".join(f"WHEN n <= {k} THEN {v}" for k, v in {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776, 6: 2.571, 7: 2.447, 8: 2.365, 9: 2.306, 10: 2.262, 15: 2.145, 20: 2.093, 25: 2.064, 30: 2.045, 40: 2.021, 60: 2.000, 120: 1.980}.items()) + " ELSE 1.96 END::DOUBLE"
_MONTHLY = ", mo AS (SELECT site, CAST(date_trunc('week', acq_date) AS DATE) AS month, max(CASE WHEN cfar_detect THEN sc_cfar * 100 END) AS q FROM v_scores GROUP BY 1, 2)"
SQL = {
    "b2_b6_product_names": f"""{_PRODUCTS}, sp AS (SELECT *, string_split(name, '_') AS p, nullif(regexp_extract(name, '_(\\d{{8}})T', 1), '') AS day8, nullif(regexp_extract(name, '_(\\d{{8}}T\\d{{6}})', 1), '') AS st, nullif(regexp_replace(regexp_extract(name, '(\\d{{4}})[-_]?(\\d{{2}})[-_]?(\\d{{2}})'), '[-_]', '', 'g'), '') AS lo FROM pr),
 ts AS (SELECT *, CAST(try_strptime(day8, '%Y%m%d') AS DATE) AS acquired, try_strptime(st, '%Y%m%dT%H%M%S') AS tm FROM sp)
 SELECT event_id, p[1] AS satellite, coalesce(p[2], 'unknown') AS level, coalesce(p[6], 'unknown') AS tile, acquired, CAST(try_strptime(lo, '%Y%m%d') AS DATE) AS loose, concat_ws('/', strftime(acquired, '%Y-%m-%d'), left(name, 60)) AS key, CAST(hour(tm) AS INTEGER) AS hour, coalesce(hour(tm) BETWEEN 11 AND 13, false) AS daytime FROM ts""",
    "b7_catalogue_search": " SELECT event_id, acq_date, cloud FROM v_scores WHERE acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND cloud <= 30 ORDER BY acq_date DESC, event_id LIMIT 50",
    "b8_b10_scene_rules": f"{_RULED} SELECT event_id, abs(mean - 0.4257) < 0.01 AS bad, mean > 0 AND abs(mean - control) < 1e-4 AS uniform, flat OR eq AS partial, flat AND eq AS degenerate FROM rf",
    "b11_repair_coverage": f"{_RULED}, b AS (SELECT *, (flat OR eq) AND (cloud % 4 = 0 OR (cloud % 4) / 4.0::DOUBLE < 0.5) AS bad FROM rf) SELECT event_id, CASE WHEN bad THEN 'no_coverage' ELSE status END AS status, CASE WHEN NOT bad THEN sc END AS sc, CASE WHEN NOT bad THEN cv END AS cv, bad AS fixed FROM b",
    "b16_mask_select": ", s AS (SELECT v.*, t.site IS NOT NULL AS known FROM v_scores v LEFT JOIN v_sites t ON t.site = v.site) SELECT event_id, CASE WHEN known AND site % 3 = 1 THEN 'none' WHEN known AND site % 3 = 0 AND cloud % 2 = 0 THEN 'bitemporal' ELSE 'original' END AS mask_source, known AND site % 3 = 0 AND cloud % 2 <> 0 AS bitemporal_missing FROM s",
    "b21_b22_b27_verdicts": f"""{_RULED}, x AS (SELECT *, sc_cfar * (cloud % 5) / 2 AS a, cloud % 7 > 0 AND cloud % 12 >= 5 AS o FROM rf) SELECT event_id, CASE WHEN site % 2 = 0 THEN CASE WHEN a > 1.15 THEN 'detected' ELSE 'missed' END WHEN sc_cfar > 1.15 AND NOT a > 1.15 THEN 'fp_suppressed' WHEN sc_cfar > 1.15 AND a > sc_cfar THEN 'fp_amplified'
 WHEN sc_cfar > 1.15 THEN 'fp_persists' WHEN a > 1.15 THEN 'fp_amplified' ELSE 'clean_negative' END AS verdict, CASE WHEN abs(mean - 0.4257) < 0.01 THEN 'bad_scene' WHEN cfar_detect AND o THEN 'dual' WHEN cfar_detect THEN 's2_only' WHEN o THEN 'tropomi_only' ELSE 'none' END AS assessment,
 sc_cfar > 3.5796 AS above_t10, sc_cfar > 2.4901 AS above_t20, sc_cfar > 4.1052 AS above_rule FROM x""",
    "g4_search_cascade": f", l AS (SELECT event_id, site, {_CAS} AS level FROM (SELECT *, abs(acq_date - DATE '2024-01-15') AS away FROM v_scores)) SELECT event_id, site, CAST(level AS INTEGER) AS level FROM l WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY site)",
    "g7_event_query": " SELECT event_id, site, acq_date FROM v_scores WHERE sc_cfar >= 2 AND acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND site IN (SELECT site FROM v_sites WHERE site % 2 = 0) ORDER BY acq_date DESC, event_id LIMIT 200",
    "d3_month_join": ", i AS (SELECT o_custkey % 10 AS site, 2024 AS y, month(o_orderdate) % 3 + 1 AS m, count(*) AS n, min(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3) SELECT event_id, coalesce(n, 0) AS n, round(v, 2) AS least FROM v_scores s LEFT JOIN i ON i.site = s.site AND i.y = year(acq_date) AND i.m = month(acq_date)",
    "d5_wind_asof": f"""{_OBS}, o AS (SELECT id, date_trunc('hour', "at" + INTERVAL 30 MINUTE) AS h, lat, lon FROM ob WHERE event_type <> 'view'), w AS (SELECT date_trunc('hour', "at") AS h, lat, lon, u, v FROM ob WHERE event_type = 'view'),
 g AS (SELECT id, avg(u) AS u, avg(v) AS v FROM o LEFT JOIN w ON o.h = w.h AND abs(o.lat - w.lat) <= 0.25 AND abs(o.lon - w.lon) <= 0.25 GROUP BY id) SELECT id, round(coalesce(sqrt(u * u + v * v), 3.5), 4) AS speed, round(((270 - degrees(atan2(v, u))) % 360 + 360) % 360, 3) AS direction, CASE WHEN u IS NULL THEN 'fallback' ELSE 'era5' END AS source FROM g""",
    "d6_wind_window": f"""{_OBS}, j AS (SELECT o.id, w.u, w.v, ((270 - degrees(atan2(w.v, w.u))) % 360 + 360) % 360 AS d FROM ob o JOIN ob w ON o.site = w.site AND o.event_type = 'error' AND w.event_type = 'view' AND abs(epoch(date_trunc('second', w.at)) - epoch(date_trunc('second', o.at))) <= 3600)
 SELECT id, count(*) AS n, round(avg(sqrt(u * u + v * v)), 4) AS speed, round((degrees(atan2(avg(sin(radians(d))), avg(cos(radians(d))))) % 360 + 360) % 360, 3) AS direction FROM j GROUP BY id""",
    "d12_a15_todo": " SELECT event_id FROM v_scores WHERE event_id NOT IN (SELECT event_id FROM v_scores WHERE status = 'ok')",
    "d13_merge_winner": " SELECT event_id AS key, CASE WHEN event_id % 3 = 0 AND cloud % 2 = 0 THEN sc_cfar * 2 ELSE sc_cfar END AS q, CASE WHEN event_id % 3 <> 0 THEN 'untouched' WHEN cloud % 2 = 0 THEN 'replaced' ELSE 'kept' END AS outcome FROM v_scores",
    "d18_shared_tiles": ", f AS (SELECT event_id AS id, min(event_id) OVER (PARTITION BY site, acq_date) AS scene FROM v_scores) SELECT id, scene, CASE WHEN id = scene THEN 'first' ELSE 'shared' END AS status FROM f",
    "d19_flow_vs_inventory": f"{_MONTHLY}, t AS (SELECT site, month, q * 24 * day(last_day(month)) / 1000 AS t FROM mo) SELECT site, month, round(t, 4) AS tonnes, round(t * 0.7::DOUBLE, 4) AS low, round(t * 1.3::DOUBLE, 4) AS high FROM t",
    "e10_annualise_ci": f"""{_MONTHLY}, r AS (SELECT site, 'upper' AS framing, q AS x FROM mo UNION ALL SELECT site, 'floor_300', coalesce(q, 300) FROM mo UNION ALL SELECT site, 'floor_0', coalesce(q, 0) FROM mo),
 g AS (SELECT site, framing, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM r WHERE x IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, s / sqrt(n) AS e, CASE WHEN n > 1 THEN {_T} END AS t FROM g)
 SELECT site, framing, n, round(m, 4) AS mean, round(s, 4) AS sd, round(e, 4) AS sem, t, round(m - t * e, 4) AS low, round(m + t * e, 4) AS high FROM k""",
    "e17_enhancement_buckets": """, e AS (SELECT site, acq_date, sc_cfar * 3 AS e FROM v_scores WHERE cloud % 5 > 0) SELECT site, count(*) AS n, count(*) FILTER (e >= 10) AS n_high, count(*) FILTER (e >= 5 AND e < 10) AS n_mid, max(e) AS best, round(avg(e) FILTER (e >= 10), 4) AS mean_high, min(acq_date) AS first, max(acq_date) AS last,
 coalesce(string_agg(DISTINCT acq_date::VARCHAR, ',' ORDER BY acq_date::VARCHAR) FILTER (e >= 10), '') AS days FROM e GROUP BY site""",
    "e22_held_out": ", g AS (SELECT site, count(*) FILTER (status = 'ok' AND sc_cfar IS NOT NULL) AS n_valid, count(*) FILTER (status = 'ok' AND sc_cfar > 3.5796) AS n_above, count(*) FILTER (status = 'ok' AND sc_cfar > 3.5796 AND cfar_detect) AS n_pass FROM v_scores GROUP BY 1) SELECT *, CASE WHEN n_valid = 0 THEN 'no_data' WHEN n_pass > 0 THEN 'detected' WHEN n_above > 0 THEN 'suppressed' ELSE 'quiet' END AS category FROM g",
    "e27_combined_detections": ", u AS (SELECT *, 0 AS run FROM v_scores WHERE event_id % 2 = 0 UNION ALL SELECT *, 1 FROM v_scores WHERE event_id % 3 = 0) SELECT site, acq_date, CAST(run AS INTEGER) AS run, event_id, sc_cfar, round(0.7::DOUBLE * sc_cfar, 6) AS low, round(1.3::DOUBLE * sc_cfar, 6) AS high FROM u WHERE sc_cfar > 3.5796 QUALIFY row_number() OVER (PARTITION BY site, acq_date ORDER BY run, event_id, sc_cfar) = 1",
    "f14_hosmer_lemeshow": """, x AS (SELECT y, 1 / (1 + exp(-0.5::DOUBLE * (score - 1.15::DOUBLE))) AS p, doc_id FROM v_pairs), g AS (SELECT y, p, ntile(5) OVER (ORDER BY p, doc_id) AS g FROM x), s AS (SELECT g, count(*) AS m, sum(y) AS o, sum(p) AS e FROM g GROUP BY 1), t AS (SELECT sum((o - e) * (o - e) / (e * (1 - e / m))) AS s FROM s WHERE e > 0 AND e < m)
 SELECT round(s, 4) AS stat, round(CASE WHEN s < 3 THEN 0.5 + 0.5 * (1 - s / 3) ELSE greatest(0.001, exp(-0.5::DOUBLE * (s - 3))) END, 4) AS p_value FROM t""",
    "f21_stability_verdict": """, w AS (SELECT site, count(*) AS n, sum(CAST(cfar_detect AS INT)) AS k FROM v_scores GROUP BY 1), m AS (SELECT site, 100 * abs(round((k - 1) / (n - 1)::DOUBLE, 6) - k / n::DOUBLE) AS most FROM w WHERE k > 1)
 SELECT site, round(most, 4) AS most, CASE WHEN most < 2 THEN 'stable' WHEN most < 5 THEN 'moderate' ELSE 'unstable' END AS verdict FROM m""",
    "h3_co_detected_months": " SELECT site, acq_date FROM v_scores WHERE cfar_detect INTERSECT SELECT site, acq_date FROM v_scores WHERE cloud > 50",
}


def finish(site_risk_sql: str, erfc) -> None:
    """SQL that builds on that of other modules."""
    SQL["b28_excluded_sites"] = f""", ri AS ({site_risk_sql.replace(", g AS (", "WITH g AS (", 1)}), x AS (SELECT site, eur, t_co2e, tier, site IN (SELECT site FROM v_sites WHERE site % 4 = 1) AS o FROM ri)
 SELECT site, CASE WHEN NOT o THEN eur END AS eur, CASE WHEN NOT o THEN t_co2e END AS t_co2e, CASE WHEN o THEN 'EXCLUDED' ELSE tier END AS tier FROM x"""
    SQL["f16_kupiec"] = f""", g AS (SELECT count(*) AS t, count(*) FILTER (y = 0) AS n1 FROM v_pairs WHERE score >= 1.15), p AS (SELECT *, least(greatest(n1 / t::DOUBLE, 1e-10), 1 - 1e-10) AS p FROM g), l AS (SELECT *, -2 * (n1 * ln({1 - 0.95!r}::DOUBLE / p) + (t - n1) * ln({1 - (1 - 0.95)!r}::DOUBLE / (1 - p))) AS lr FROM p),
 v AS (SELECT *, {erfc("sqrt(greatest(lr, 0) / 2)")} AS pv FROM l) SELECT t AS t_n, n1, round(n1 / t::DOUBLE, 4) AS p_obs, round(lr, 4) AS lr, round(pv, 4) AS p_value, pv < {1 - 0.95!r}::DOUBLE AS reject FROM v"""
