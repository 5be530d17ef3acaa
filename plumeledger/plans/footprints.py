"""Queries of events' places, component counts, polygons, shapes and the catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import footprints as P
from plumeledger.operators import rasters as R
from plumeledger.plans.rasters import _REACH
from plumeledger.sources import fixtures as X

LEAST = 4
SWEEP = (0.18, 0.3, 0.5)


def _sweep(s, d):
    return P.component_sweep(X.pixels(s, d), SWEEP, LEAST)


def _places(s, d):
    """Every event back on its raster: the place is projected again and must lie in the pixel it came from."""
    from plumeledger.functions import utm

    px = X.pixels(s, d)
    k = F.col("scene")
    east, north = 400_000.0 + (k % 50) * 4000, 5_000_000.0 + (k % 31) * 5000
    geo = px.select("scene").distinct().select("scene", (30 + k % 4).cast("int").alias("zone"), F.lit(True).alias("northern"), F.array(F.lit(20.0), F.lit(0.0), east, F.lit(0.0), F.lit(-20.0), north).alias("transform"))
    e = P.event_places(R.extract_events(px, 0.18, LEAST), geo)
    back = utm.to_utm(F.col("lat"), F.col("lon"), (30 + k % 4).cast("int"))
    e = e.withColumn("back", back)
    return e.select("scene", "event", "area_px", "row", "col", F.round((F.col("back.easting") - east) / 20).cast("long").alias("col_again"), F.round((north - F.col("back.northing")) / 20).cast("long").alias("row_again"), "event_id")


def _located(s, d):
    k = F.col("scene")
    return X.pixels(s, d).select("scene", "row", "col", "prob", (F.col("col") * 0.0007 + 10 + k % 40).alias("x"), (F.col("row") * 0.0005 + 40 + k % 20).alias("y"))


def _squares(s, d):
    k = F.col("scene")
    of = X.pixels(s, d).select("scene").distinct()
    halves = F.explode(F.array(F.lit(90.0), F.lit(150.0))).alias("half")
    polygons = of.select("scene", halves).select("scene", F.col("half").cast("int").alias("polygon"), P.square(40.0016 + k % 20, 10.0019 + k % 40, F.col("half")).alias("corners"))
    m = P.polygon_mask(_located(s, d), polygons)
    return m.groupBy("scene", "polygon").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean"))


def _two_sides(s, d):
    px = X.pixels(s, d).select("scene", "row", "col", F.floor(F.col("b11") * 255).cast("int").alias("b11"), F.floor(F.col("b12") * 255).cast("int").alias("b12"))
    return px.where("scene % 6 <> 1 or row <> 3"), px.where("scene % 5 <> 2 or col < 6").withColumn("b11", F.col("b11") - F.col("row"))


def _skipped(s, d):
    t, r = _two_sides(s, d)
    return P.checked_diff(t, r, ["b11"], "skip").select("scene", "row", "col", "b11", "b12")


def _catalogue(s, d):
    k = F.col("event_id")
    p = X.scores(s, d).select(
        k.alias("id"), F.when(k % 3 == 0, "SENTINEL-2").otherwise("SENTINEL-5P").alias("collection"), F.col("acq_date").cast("string").alias("start"), F.when(k % 10 > 0, F.col("cloud")).alias("cloud"),
        (k * 37 % 360 - 180).cast("double").alias("west"), (k * 11 % 140 - 70).cast("double").alias("south"), ((k * 37 + 25) % 360 - 180).cast("double").alias("east"), (k * 11 % 140 - 50).cast("double").alias("north"),
    )
    return P.boxed_search(p, "2024-01-03", "2024-01-25", (170.0, -20.0, -150.0, 35.0), "SENTINEL-2", 60, 100).select("id", "start", "cloud", "west", "east")


QUERIES = {
    "c8_component_sweep": _sweep,
    "c9_event_places": _places,
    "c14_squares": _squares,
    "c11_shape_report": lambda s, d: P.shape_report(*_two_sides(s, d)),
    "c11_checked_diff": _skipped,
    "b7_boxed_search": _catalogue,
}

_TWO = ', q AS (SELECT scene, "row" AS r, col AS c, CAST(floor(b11 * 255) AS INT) AS b11, CAST(floor(b12 * 255) AS INT) AS b12 FROM v_pixels), ta AS (SELECT * FROM q WHERE scene % 6 <> 1 OR r <> 3), re AS (SELECT * REPLACE (b11 - r AS b11) FROM q WHERE scene % 5 <> 2 OR c < 6)'
_ONE = "SELECT scene, {t} AS t, count(*) AS events FROM (SELECT scene FROM e{i} GROUP BY scene, event HAVING count(*) >= 4) GROUP BY scene"


def _reach(i: int, t: float) -> str:
    """The connected pixels of one threshold as e<i>, from the fragment that labels one."""
    return _REACH.format(op=">=", t=f"{t}::DOUBLE").replace(", h AS", f", h{i} AS").replace("e AS (WITH", f"e{i} AS (WITH").replace("FROM h UNION", f"FROM h{i} UNION").replace("JOIN h ON", f"JOIN h{i} AS h ON")


SQL = {
    "c8_component_sweep": "".join(_reach(i, t) for i, t in enumerate(SWEEP)) + ", ev AS (" + " UNION ALL ".join(_ONE.format(i=i, t=f"{t}::DOUBLE") for i, t in enumerate(SWEEP)) + f"""), n AS (SELECT scene, t, count(*) FILTER (prob >= t) AS above, round(100 * count(*) FILTER (prob >= t) / count(*)::DOUBLE, 4) AS pct FROM v_pixels, (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in SWEEP)}]) AS t) GROUP BY scene, t)
 SELECT n.scene, n.t, above, pct, coalesce(events, 0) AS events FROM n LEFT JOIN ev ON ev.scene = n.scene AND ev.t = n.t""",
    "c9_event_places": _REACH.format(op=">=", t="0.18::DOUBLE") + """, g AS (SELECT scene, event, count(*) AS area_px, CAST(floor(avg(r)) AS BIGINT) AS r, CAST(floor(avg(c)) AS BIGINT) AS c FROM e GROUP BY 1, 2 HAVING count(*) >= 4)
 SELECT scene, event, area_px, r AS "row", c AS col, c AS col_again, r AS row_again, 'evt-' || substr(sha256(scene || ':' || event), 1, 12) AS event_id FROM g""",
    "c14_squares": """, p AS (SELECT scene, prob, col * 0.0007::DOUBLE - 0.0019 AS dx, "row" * 0.0005::DOUBLE - 0.0016 AS dy, 40.0016::DOUBLE + scene % 20 AS lat FROM v_pixels)
 SELECT scene, h AS polygon, count(*) AS n, round(avg(prob), 6) AS mean FROM p, (SELECT unnest([90, 150]) AS h) WHERE abs(dy) < h / 111320.0::DOUBLE AND abs(dx) < h / (111320.0::DOUBLE * cos(radians(lat))) GROUP BY 1, 2""",
    "c11_shape_report": _TWO + " SELECT coalesce(ta.scene, re.scene) AS scene, count(*) FILTER (ta.scene IS NOT NULL AND re.scene IS NOT NULL) AS n_both, count(*) FILTER (re.scene IS NULL) AS n_target_only, count(*) FILTER (ta.scene IS NULL) AS n_reference_only, count(*) FILTER (re.scene IS NULL OR ta.scene IS NULL) = 0 AS matches FROM ta FULL JOIN re ON ta.scene = re.scene AND ta.r = re.r AND ta.c = re.c GROUP BY 1",
    "c11_checked_diff": _TWO + ' SELECT ta.scene, ta.r AS "row", ta.c AS col, greatest(0, least(255, ta.b11 - re.b11 + 128)) AS b11, ta.b12 FROM ta JOIN re ON ta.scene = re.scene AND ta.r = re.r AND ta.c = re.c WHERE ta.scene % 6 <> 1 AND ta.scene % 5 <> 2',
    "b7_boxed_search": """, p AS (SELECT event_id AS id, acq_date, CASE WHEN event_id % 10 > 0 THEN cloud END AS cloud, (event_id * 37 % 360 - 180)::DOUBLE AS west, ((event_id * 37 + 25) % 360 - 180)::DOUBLE AS east, event_id * 11 % 140 - 70 AS south FROM v_scores WHERE event_id % 3 = 0)
 SELECT id, strftime(acq_date, '%Y-%m-%d') AS start, cloud, west, east FROM p WHERE acq_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND cloud <= 60 AND south <= 35 AND south + 20 >= -20
 AND EXISTS (SELECT 1 FROM (SELECT unnest(range(170, 211)) AS lon) WHERE lon BETWEEN west AND west + 25 OR lon - 360 BETWEEN west AND west + 25 OR lon BETWEEN west + 360 AND west + 385) ORDER BY acq_date DESC, id LIMIT 100""",
}
