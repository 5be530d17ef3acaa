"""Queries over retrievals and their uncertainty, with the SQL of each: brute force, a row a pixel and variant."""

from __future__ import annotations

from plumeledger.operators import retrievals as R
from plumeledger.sources import fixtures as X

#: The test scenes have 8 x 8 pixels, so a background of 8 must do.
FEW = 8

QUERIES = {
    "c16_legacy_retrieval": lambda s, d: R.legacy_retrieval(X.pixels(s, d), least_background=FEW),
    "c24_mask_threshold_sweep": lambda s, d: R.mask_threshold_sweep(X.pixels(s, d), 0.18, least_background=FEW),
    "c25_background_jackknife": lambda s, d: R.background_jackknife(X.pixels(s, d), least_background=FEW),
    "c26_crop_fallback": lambda s, d: R.crop_fallback(X.pixels(s, d), (8, 6, 4), least_background=FEW),
}

_KG = "(1e-9::DOUBLE * 2.1e25 * 0.016 / 6.022e23 * 400)"
_FLOW = f"round(above / (m11 * 4e-7) * {_KG} / (greatest(ext * 20.0, 20.0) / 3.5) * 3600, 4)"


def _figures(least: int) -> str:
    return f"coalesce(n, 0) AS n_valid, CASE WHEN n >= {least} THEN round(mean, 2) END AS mean_flow, CASE WHEN n >= {least} THEN round(sd, 2) END AS std_flow, CASE WHEN n >= {least} THEN round(100 * sd / mean, 1) END AS sigma_pct"


_MARKED = f"""b AS (SELECT *, avg(b11) FILTER (NOT m) OVER w AS m11, avg(b12 - 0.5 * b11) FILTER (NOT m) OVER w AS my, count(*) FILTER (NOT m) OVER w AS bg FROM a WINDOW w AS (PARTITION BY scene, v)),
e AS (SELECT scene, v, any_value(m11) AS m11, any_value(bg) AS bg, count(*) FILTER (m) AS n_px, sum(greatest(0.0, b12 - 0.5 * b11 - my)) FILTER (m) AS above, greatest(max("row") FILTER (m) - min("row") FILTER (m), max(col) FILTER (m) - min(col) FILTER (m)) AS ext FROM b GROUP BY scene, v)"""

SQL = {
    "c16_legacy_retrieval": f""", a AS (SELECT *, prob >= 0.3 AS m, 0 AS v FROM v_pixels), {_MARKED}, w AS (SELECT *, CASE WHEN bg < {FEW} THEN 'too_few_background' WHEN m11 < 1e-6 THEN 'dark_background' WHEN n_px < 4 THEN 'empty_plume' END AS warning FROM e)
 SELECT scene, n_px, CASE WHEN warning IS NULL THEN round(above / (m11 * 4e-7) * {_KG}, 4) ELSE 0 END AS mass_kg, CASE WHEN warning IS NULL THEN {_FLOW} ELSE 0 END AS flow_kgh, warning FROM w""",
    "c24_mask_threshold_sweep": f""", t AS (SELECT i AS v, 0.054::DOUBLE * pow(0.5::DOUBLE / 0.054, i / 49.0::DOUBLE) AS t FROM range(50) x(i)), a AS (SELECT *, prob >= t AS m FROM v_pixels, t), {_MARKED},
 fl AS (SELECT scene, {_FLOW} AS flow FROM e WHERE bg >= {FEW} AND m11 >= 1e-6 AND n_px >= 4 AND {_FLOW} > 0), g AS (SELECT scene, count(flow) AS n, avg(flow) AS mean, stddev_samp(flow) AS sd FROM fl GROUP BY scene)
 SELECT scene, {_figures(4)} FROM (SELECT DISTINCT scene FROM v_pixels) LEFT JOIN g USING (scene)""",
    "c25_background_jackknife": f""", c AS (SELECT scene, avg("row") AS cr, avg(col) AS cc FROM v_pixels WHERE prob >= 0.3 GROUP BY scene),
 k AS (SELECT * FROM v_pixels JOIN c USING (scene), unnest(['n', 's', 'w', 'e']) x(v)),
 a AS (SELECT *, prob >= 0.3 AS m FROM k WHERE prob >= 0.3 OR NOT CASE v WHEN 'n' THEN "row" < cr WHEN 's' THEN "row" >= cr WHEN 'w' THEN col < cc ELSE col >= cc END), {_MARKED},
 fl AS (SELECT scene, v, {_FLOW} AS flow FROM e WHERE bg >= {FEW} AND m11 >= 1e-6 AND n_px >= 4 AND {_FLOW} > 0), g AS (SELECT scene, count(flow) AS n, avg(flow) AS mean, stddev_samp(flow) AS sd, {", ".join(f"max(flow) FILTER (v = '{h}') AS flow_{h}" for h in "nswe")} FROM fl GROUP BY scene)
 SELECT scene, {_figures(2)}, {", ".join(f"flow_{h}" for h in "nswe")} FROM (SELECT DISTINCT scene FROM v_pixels) LEFT JOIN g USING (scene)""",
    "c26_crop_fallback": f""", z AS (SELECT unnest([8, 6, 4]) AS crop), a AS (SELECT * FROM v_pixels, z WHERE greatest(abs("row" + 0.5 - 4), abs(col + 0.5 - 4)) <= crop / 2),
 f AS (SELECT scene, crop, sum(b11 * b12) FILTER (NOT prob >= 0.3) / sum(b12 * b12) FILTER (NOT prob >= 0.3) AS c, count(*) FILTER (NOT prob >= 0.3) AS bg, sum(b12 * b12) FILTER (NOT prob >= 0.3) AS yy, avg(b11) FILTER (NOT prob >= 0.3) AS m11 FROM a GROUP BY ALL),
 q AS (SELECT scene, crop, sum(greatest(0.0, -((c * b12 - b11) / b11) / 4e-7) * {_KG}) AS mass, count(*) AS n_px, greatest(max("row") - min("row"), max(col) - min(col)) AS ext FROM a JOIN f USING (scene, crop) WHERE prob >= 0.3 GROUP BY ALL),
 r AS (SELECT scene, crop, n_px, round(mass, 4) AS mass_kg, round(mass / (greatest(ext * 20.0, 1.0) / 3.5) * 3600, 2) AS flow_kgh, bg, m11, yy FROM f LEFT JOIN q USING (scene, crop)),
 st AS (SELECT *, CASE WHEN bg < {FEW} THEN 'few_background' WHEN m11 < 1e-6 OR yy < 1e-12 THEN 'dark' WHEN flow_kgh > 0 THEN 'quantified' ELSE 'no_plume' END AS said FROM r),
 w AS (SELECT * FROM st WHERE said = 'quantified' QUALIFY row_number() OVER (PARTITION BY scene ORDER BY crop DESC) = 1)
 SELECT s.scene, w.crop, coalesce(w.n_px, 0) AS n_px, coalesce(w.mass_kg, 0) AS mass_kg, coalesce(w.flow_kgh, 0) AS flow_kgh, attempts FROM (SELECT scene, string_agg(crop || ':' || said, ' ' ORDER BY crop DESC) AS attempts FROM st GROUP BY scene) s LEFT JOIN w USING (scene)""",
}
