"""Operators over pixel tables (scene, row, col, b11, b12, prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.functions import scalars as S

KG_PER_COLUMN = 1e-9 * 2.1e25 * 0.016 / 6.022e23 * 400


def scene_detect(px: DataFrame, t: float = 0.18, least: int = 115) -> DataFrame:
    """Pixels at or above t of each scene, their mean place and greatest value, and whether they are `least` or more. A scene without any has 0 pixels, value 0 and no place."""
    hit = F.col("prob") >= t
    g = px.groupBy("scene").agg(F.sum(hit.cast("long")).alias("n_px"), F.max(F.when(hit, F.col("prob"))).alias("top"), F.avg(F.when(hit, F.col("row"))).alias("r"), F.avg(F.when(hit, F.col("col"))).alias("c"))
    return g.select("scene", "n_px", (F.col("n_px") >= least).alias("has_plume"), F.round(F.coalesce("top", F.lit(0.0)), 4).alias("top"), F.round("r", 4).alias("r"), F.round("c", 4).alias("c"))


def threshold_sweep(px: DataFrame, ts: tuple[float, ...] = (0.18, 0.3, 0.5)) -> DataFrame:
    """Pixels above each threshold and their share: one pass, a column each, then rows."""
    g = px.groupBy("scene").agg(F.count("*").alias("n"), *[F.sum((F.col("prob") >= t).cast("long")).alias(f"n{i}") for i, t in enumerate(ts)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"n{i}").alias("above")) for i, t in enumerate(ts)]))
    return g.select("scene", "n", rows.alias("x")).select("scene", "x.t", "x.above", F.round(100 * F.col("x.above") / F.col("n"), 4).alias("pct"))


DIRECTIONS = ("n", "s", "e", "w")


def site_contrast(px: DataFrame, sites: DataFrame, crop: int = 100, offsets: dict[str, tuple[int, int]] | None = None, edge: str = "drop", least: int = 20) -> DataFrame:
    """Mean of the crop around each site (scene, site, row, col) against those of control crops around it.

    Columns: scene, site, site_mean, n_controls, direction, sc_ratio, sc_cfar, cv, thresh, margin, detect, error. offsets: rows and columns from
    the site to each control, by default two crops to each side. A crop is crop x crop pixels with the site's pixel as the
    first of its second half. One that is not wholly on the scene is dropped; edge="clamp" cuts it to the scene, if `least` pixels each way are left.
    sc_ratio is against the first direction of n, s, e, w that has a crop, sc_cfar against the mean of all; both are infinite where
    that is 0. cv is the population deviation of the controls over their mean, 0 for one. error: site_oob or all_directions_oob.
    A pixel meets only the crops whose cells, crop pixels wide, it lies in. Null prob is left out of means.
    """
    offsets = offsets or {"n": (-2 * crop, 0), "s": (2 * crop, 0), "e": (0, 2 * crop), "w": (0, -2 * crop)}
    size = px.groupBy(F.col("scene").alias("_scene")).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    s = sites.select("scene", "site", "row", "col").distinct()
    s = s.join(size.hint("merge"), F.col("scene") == F.col("_scene"), "left").drop("_scene")
    windows = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("rank"), (F.col("row") + o[0] - crop // 2).alias("r0"), (F.col("col") + o[1] - crop // 2).alias("c0")) for i, (d, o) in enumerate([("site", (0, 0)), *((d, offsets[d]) for d in DIRECTIONS if d in offsets)])])
    v = s.select("scene", "site", "h", "w", F.explode(windows).alias("x")).select("scene", "site", "h", "w", "x.*")
    v = v.withColumns({"r1": F.col("r0") + crop, "c1": F.col("c0") + crop})
    if edge == "clamp":
        v = v.withColumns({"r0": F.greatest("r0", F.lit(0)), "c0": F.greatest("c0", F.lit(0)), "r1": F.least("r1", "h"), "c1": F.least("c1", "w")})
        v = v.where((F.col("r1") - F.col("r0") >= least) & (F.col("c1") - F.col("c0") >= least))
    else:
        v = v.where("r0 >= 0 and c0 >= 0 and r1 <= h and c1 <= w")
    cells = F.explode(F.flatten(F.transform(F.sequence(F.floor(F.col("r0") / crop), F.floor((F.col("r1") - 1) / crop)), lambda r: F.transform(F.sequence(F.floor(F.col("c0") / crop), F.floor((F.col("c1") - 1) / crop)), lambda c: F.struct(r.alias("cr"), c.alias("cc"))))))
    v = v.select(F.col("scene").alias("_scene"), "site", "d", "rank", "r0", "r1", "c0", "c1", cells.alias("cell")).select("*", "cell.cr", "cell.cc").drop("cell")
    p = px.select("scene", "row", "col", "prob", F.floor(F.col("row") / crop).alias("pr"), F.floor(F.col("col") / crop).alias("pc"))
    inside = (F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r1")) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c1"))
    j = p.join(v.hint("merge"), (F.col("scene") == F.col("_scene")) & (F.col("pr") == F.col("cr")) & (F.col("pc") == F.col("cc")) & inside)
    m = j.groupBy("scene", "site", "d", "rank").agg(F.avg("prob").alias("m")).where("m is not null")
    control = F.col("d") != "site"
    g = m.groupBy(F.col("scene").alias("_scene"), F.col("site").alias("_site")).agg(
        F.max(F.when(~control, F.col("m"))).alias("site_mean"), F.count_if(control).alias("n_controls"), F.min_by(F.when(control, F.col("d")), F.when(control, F.col("rank"))).alias("direction"),
        F.min_by(F.when(control, F.col("m")), F.when(control, F.col("rank"))).alias("first"), F.avg(F.when(control, F.col("m"))).alias("mu"), F.stddev_pop(F.when(control, F.col("m"))).alias("sd"),
    )
    g = s.select("scene", "site").join(g.hint("merge"), (F.col("scene") == F.col("_scene")) & (F.col("site") == F.col("_site")), "left")
    over = lambda c: F.when(F.col(c) > 1e-9, F.col("site_mean") / F.col(c)).otherwise(F.lit(float("inf")))
    error = F.when(F.col("site_mean").isNull(), "site_oob").when(F.col("n_controls") == 0, "all_directions_oob")
    g = g.withColumn("error", error)
    ok = F.col("error").isNull()
    g = g.withColumns({"sc_ratio": F.when(ok, over("first")), "sc_cfar": F.when(ok, over("mu")), "cv": F.when(ok, F.when(F.col("mu") > 1e-9, F.col("sd") / F.col("mu")).otherwise(0.0))})
    g = g.withColumn("thresh", 1.15 + 3 * F.col("cv"))
    shown = {c: F.round(c, 4) for c in ("site_mean", "sc_ratio", "sc_cfar", "cv", "thresh")}
    return g.select("scene", "site", shown["site_mean"].alias("site_mean"), F.coalesce("n_controls", F.lit(0)).cast("long").alias("n_controls"), F.when(ok, F.col("direction")).alias("direction"), *[shown[c].alias(c) for c in ("sc_ratio", "sc_cfar", "cv", "thresh")], F.round(F.col("sc_cfar") - F.col("thresh"), 4).alias("margin"), (F.col("sc_cfar") > F.col("thresh")).alias("detect"), "error")


def downsample(px: DataFrame) -> DataFrame:
    """Every second pixel of every second row."""
    return px.where("row % 2 = 0 and col % 2 = 0").withColumns({"row": F.floor(F.col("row") / 2).cast("int"), "col": F.floor(F.col("col") / 2).cast("int")})


def band_retrieval(px: DataFrame, mask: str = "prob >= 0.3", wind_ms: float = 3.5, least_background: int = 100) -> DataFrame:
    """(scene, n_px, mass_kg, flow_kgh) of every scene: background fit, column mass over the mask, plume length and flow.

    A scene is invalid with fewer than least_background pixels outside the mask, or a mean b11 (under 1e-6) or sum of squares of b12
    (under 1e-12) of these near 0: its mass is null and its flow 0. Without a pixel in the mask both are 0. Null conditions are false.
    The sum over the mask needs the fit of its own scene: fits are a row a scene and are joined back by scene.
    """
    m = F.coalesce(F.expr(mask), F.lit(False))
    fit = px.groupBy("scene").agg(F.sum(F.when(~m, F.col("b11") * F.col("b12"))).alias("xy"), F.sum(F.when(~m, F.col("b12") * F.col("b12"))).alias("yy"), F.avg(F.when(~m, F.col("b11"))).alias("m11"), F.count_if(~m).alias("bg"), F.count_if(m).alias("n_px"))
    valid = (F.col("bg") >= least_background) & (F.col("m11") >= 1e-6) & (F.col("yy") >= 1e-12)
    fit = fit.select(F.col("scene").alias("fs"), "n_px", F.when(valid, F.col("xy") / F.col("yy")).alias("c"))
    j = px.where(m).join(fit.where("c is not null").select("fs", "c").hint("merge"), px.scene == F.col("fs"))
    dx = F.greatest(F.lit(0.0), -((F.col("c") * F.col("b12") - F.col("b11")) / F.col("b11")) / 4e-7)
    g = j.groupBy("scene").agg(F.sum(dx * KG_PER_COLUMN).alias("mass"), plume_length().alias("length"))
    g = fit.join(g.hint("merge"), F.col("fs") == F.col("scene"), "left").select(F.col("fs").alias("scene"), "n_px", F.when(F.col("c").isNotNull(), F.coalesce("mass", F.lit(0.0))).alias("mass"), "length")
    flow = F.when(F.col("mass") > 0, S.flow_kgh(F.col("mass"), F.col("length"), F.lit(wind_ms))).otherwise(0.0)
    return g.select("scene", "n_px", F.round("mass", 4).alias("mass_kg"), F.round(flow, 2).alias("flow_kgh"))


def plume_length(pixel_m: float = 20.0, least: float = 1.0) -> Column:
    """Metres of a group of pixels: its greater extent in rows or columns, `least` at least."""
    return F.greatest(F.greatest(F.max("row") - F.min("row"), F.max("col") - F.min("col")) * pixel_m, F.lit(least)).cast("double")
