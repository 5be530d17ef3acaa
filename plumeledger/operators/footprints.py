"""Events with their places, component counts by threshold, polygons by table, and whether rasters fit each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.functions import utm
from plumeledger.operators.rasters import AT, bitemporal_diff, connected_events


def component_sweep(px: DataFrame, thresholds: tuple[float, ...] = (0.18, 0.3, 0.5), least: int = 115) -> DataFrame:
    """(scene, t, above, pct, events) of every scene and threshold: pixels at or above it, their share, and connected components of `least` pixels or more.

    A pixel joins the layers of the thresholds it reaches, and all layers are labelled in one run, with (scene, threshold) as the
    scene. Scenes without a pixel above have zeros. Null probabilities count as pixels below; a pixel listed twice counts once.
    """
    one = px.groupBy(*AT).agg(F.max("prob").alias("prob"))
    reached = F.filter(F.array(*[F.when(F.col("prob") >= t, F.lit(float(t))) for t in thresholds]), lambda t: t.isNotNull())
    layers = one.select(F.col("scene").alias("_scene"), "row", "col", "prob", F.explode(reached).alias("_t")).select(F.struct("_scene", "_t").alias("scene"), "row", "col", "prob")
    sizes = connected_events(layers, F.lit(True)).groupBy("scene", "event").agg(F.count("*").alias("n"))
    counts = sizes.groupBy("scene").agg(F.count_if(F.col("n") >= least).alias("events")).select(F.col("scene._scene").alias("_scene"), F.col("scene._t").alias("_t"), "events")
    g = one.groupBy("scene").agg(F.count("*").alias("n"), *[F.count_if(F.col("prob") >= t).alias(f"n{i}") for i, t in enumerate(thresholds)])
    rows = g.select("scene", "n", F.inline(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"n{i}").alias("above")) for i, t in enumerate(thresholds)])))
    j = rows.join(counts.hint("merge"), (F.col("scene") == F.col("_scene")) & (F.col("t") == F.col("_t")), "left")
    return j.select("scene", "t", "above", F.round(100 * F.col("above") / F.col("n"), 4).alias("pct"), F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def event_places(events: DataFrame, geo: DataFrame) -> DataFrame:
    """extract_events() rows with x, y, lat, lon (six places) and event_id, from geo (scene, zone, northern, transform).

    transform is the six numbers a to f of x = a * col + b * row + c, y = d * col + e * row + f. An event's id is of its scene and first pixel, so it is the same
    in every run. Events of a scene without geo, or with a null in it, keep nulls; of several geo rows of a scene the least by zone, then transform counts.
    """
    g = geo.groupBy(F.col("scene").alias("_scene")).agg(F.min(F.struct("zone", "transform", "northern")).alias("_g"))
    j = events.join(g.hint("merge"), F.col("scene") == F.col("_scene"), "left")
    t = lambda i: F.col("_g.transform")[i]
    x, y = t(0) * F.col("col") + t(1) * F.col("row") + t(2), t(3) * F.col("col") + t(4) * F.col("row") + t(5)
    j = j.withColumns({"x": x, "y": y})
    at = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), utm.from_utm(F.col("x"), F.col("y"), F.col("_g.zone"), F.col("_g.northern")))
    j = j.withColumn("_at", at).withColumns({"lat": F.round("_at.lat", 6), "lon": F.round("_at.lon", 6)})
    return j.withColumn("event_id", F.concat(F.lit("evt-"), F.substring(F.sha2(F.concat_ws(":", F.col("scene").cast("string"), F.col("event").cast("string")), 256), 1, 12))).drop("_scene", "_g", "_at")


def square(lat: Column, lon: Column, half_m: Column | float) -> Column:
    """Corners (array of x = longitude, y = latitude) of the box of so many metres to each side: 111,320 metres a degree of latitude, its cosine of it one of longitude."""
    half = F.lit(half_m) if isinstance(half_m, (int, float)) else half_m
    up, out = half / 111_320, half / (111_320 * F.cos(F.radians(lat)))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(lon - out, lat + up), corner(lon + out, lat + up), corner(lon + out, lat - up), corner(lon - out, lat - up))


def inside(x: Column, y: Column, corners: Column) -> Column:
    """Whether a place lies in a polygon by the even-odd rule, behind its bounding box. corners: array of (x, y), closed or not.

    A level edge is never crossed. Fewer than three corners hold nothing; unknown places and polygons are false.
    """
    xs, ys = F.transform(corners, lambda c: c["x"]), F.transform(corners, lambda c: c["y"])
    boxed = x.between(F.array_min(xs), F.array_max(xs)) & y.between(F.array_min(ys), F.array_max(ys))

    def crossing(i: Column) -> Column:
        a, b = F.get(corners, i), F.get(corners, (i + 1) % F.size(corners))
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    places = F.sequence(F.lit(0), F.size(corners) - 1)
    odd = F.aggregate(places, F.lit(0), lambda n, i: n + crossing(i)) % 2 == 1
    return F.coalesce(F.when((F.size(corners) > 2) & boxed, odd).otherwise(F.lit(False)), F.lit(False))


def polygon_mask(px: DataFrame, polygons: DataFrame) -> DataFrame:
    """The pixels (scene, x, y, ...) within each polygon (scene, polygon, corners) of their scene, once a polygon, with its name; a pixel meets its own scene's polygons only."""
    p = polygons.select(F.col("scene").alias("_scene"), "polygon", F.col("corners").alias("_corners"))
    j = px.join(p.hint("merge"), F.col("scene") == F.col("_scene"))
    return j.where(inside(F.col("x"), F.col("y"), F.col("_corners"))).drop("_scene", "_corners")


def shape_report(target: DataFrame, reference: DataFrame) -> DataFrame:
    """(scene, n_both, n_target_only, n_reference_only, matches) of every scene of either side; pixels listed twice count once."""
    t, r = target.select(*AT, F.lit(1).alias("side")).distinct(), reference.select(*AT, F.lit(2).alias("side")).distinct()
    sides = t.unionByName(r).groupBy(*AT).agg(F.sum("side").alias("side"))
    g = sides.groupBy("scene").agg(*[F.count_if(F.col("side") == v).alias(n) for n, v in (("n_both", 3), ("n_target_only", 1), ("n_reference_only", 2))])
    return g.withColumn("matches", (F.col("n_target_only") == 0) & (F.col("n_reference_only") == 0))


def checked_diff(target: DataFrame, reference: DataFrame, bands: list[str], mismatch: str = "fail") -> DataFrame:
    """bitemporal_diff() where both sides have the same pixels. mismatch: "fail" stops the run, naming a scene that differs; "skip" leaves such scenes out, to be found in shape_report()."""
    if mismatch not in ("fail", "skip"):
        raise ValueError(f"mismatch: {mismatch}")
    report = shape_report(target, reference)
    if mismatch == "fail":
        bad = report.where("not matches").first()
        if bad is not None:
            raise ValueError(f"scene {bad.scene}: {bad.n_target_only} pixels of the target and {bad.n_reference_only} of the reference have no partner")
        return bitemporal_diff(target, reference, bands)
    good = report.where("matches").select(F.col("scene").alias("_scene"))
    return bitemporal_diff(target.join(good.hint("merge"), F.col("scene") == F.col("_scene"), "left_semi"), reference, bands)


def boxed_search(products: DataFrame, start: str, end: str, box: tuple[float, float, float, float], collection: str, ceiling: float | None = None, limit: int = 1000) -> DataFrame:
    """Products (id, collection, start, cloud, west, south, east, north) of a collection, from start to end, whose box meets the given one (west, south, east, north), newest first, so many at most.

    Touching edges meet. A box whose west is beyond its east goes across 180 degrees, on either side. Ties go to the least id; an unknown cloud fails a ceiling, an unknown box never meets.
    """
    west, south, east, north = box
    parts = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    across = F.col("west") > F.col("east")
    meets = F.lit(False)
    for w, e in parts:
        meets = meets | F.when(across, (F.col("west") <= e) | (F.col("east") >= w)).otherwise((F.col("west") <= e) & (F.col("east") >= w))
    p = products.where((F.col("collection") == collection) & F.col("start").between(start, end) & (F.col("south") <= north) & (F.col("north") >= south) & meets)
    p = p if ceiling is None else p.where(F.col("cloud") <= ceiling)
    return p.orderBy(F.col("start").desc(), "id").limit(limit)
