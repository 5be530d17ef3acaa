"""Retrieval by the mean-centred formula and the uncertainty of a flow: other masks, other backgrounds, other crops.

Pixel tables are (scene, row, col, b11, b12, prob). A pixel of a plume counts by how far y = b12 - b11 / 2 lies above
that of the background, so a flow needs of the background its number of pixels and sums of b11 and b12 only, and of the plume a sum of
what lies above. Background sums are additive: they are taken once by parts and put together for each variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.operators.pixels import KG_PER_COLUMN

#: Reflectance per column of the gas, metres a pixel, and the pixels that a background and a plume need.
SENSITIVITY, PIXEL_M, LEAST_BACKGROUND, LEAST_PLUME = 4e-7, 20.0, 50, 4


def _y() -> Column:
    return F.col("b12") - 0.5 * F.col("b11")


def _flow(above: Column, mean_b11: Column, extent: Column, wind_ms: float, places: int = 4) -> Column:
    """kg/h of a plume whose pixels lie `above` the background together."""
    length = F.greatest(extent * PIXEL_M, F.lit(PIXEL_M))
    return F.round(above / (mean_b11 * SENSITIVITY) * KG_PER_COLUMN / (length / max(wind_ms, 0.5)) * 3600, places)


def _extent(where: Column) -> Column:
    span = lambda c: F.max(F.when(where, F.col(c))) - F.min(F.when(where, F.col(c)))
    return F.greatest(span("row"), span("col"))


def legacy_retrieval(px: DataFrame, mask: str = "prob >= 0.3", background: str | None = None, wind_ms: float = 3.5, least_background: int = LEAST_BACKGROUND, least_plume: int = LEAST_PLUME) -> DataFrame:
    """(scene, n_px, mass_kg, flow_kgh, warning) of every scene; background: a condition, by default all outside the mask.

    An invalid scene has mass and flow 0 and a warning: too_few_background, dark_background or empty_plume, checked in that
    order. Null conditions are false.
    """
    m = F.coalesce(F.expr(mask), F.lit(False))
    b = ~m if background is None else F.coalesce(F.expr(background), F.lit(False))
    fit = px.groupBy("scene").agg(F.count_if(b).alias("bg"), F.avg(F.when(b, F.col("b11"))).alias("m11"), F.avg(F.when(b, _y())).alias("my"), F.count_if(m).alias("n_px"), _extent(m).alias("extent"))
    plume = px.where(m).join(fit.select(F.col("scene").alias("s"), "my").hint("merge"), F.col("scene") == F.col("s"))
    plume = plume.groupBy(F.col("scene").alias("s")).agg(F.sum(F.greatest(F.lit(0.0), _y() - F.col("my"))).alias("above"))
    got = fit.join(plume.hint("merge"), F.col("scene") == F.col("s"), "left")
    warning = F.when(F.col("bg") < least_background, "too_few_background").when(F.col("m11") < 1e-6, "dark_background").when(F.col("n_px") < least_plume, "empty_plume")
    mass = F.when(warning.isNull(), F.col("above") / (F.col("m11") * SENSITIVITY) * KG_PER_COLUMN).otherwise(0.0)
    flow = F.when(warning.isNull(), _flow(F.col("above"), F.col("m11"), F.col("extent"), wind_ms)).otherwise(0.0)
    return got.select("scene", "n_px", F.round(mass, 4).alias("mass_kg"), flow.alias("flow_kgh"), warning.alias("warning"))


def geometric(lo: float, hi: float, n: int) -> list[float]:
    """n numbers from lo to hi, each the same multiple of the one before."""
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)] if n > 1 else [lo]


def mask_threshold_sweep(px: DataFrame, canonical: float, wind_ms: float = 3.5, n: int = 50, least_background: int = LEAST_BACKGROUND, least_plume: int = LEAST_PLUME) -> DataFrame:
    """(scene, n_valid, mean_flow, std_flow, sigma_pct): flows with the mask drawn at n geometric thresholds of prob.

    Thresholds run from 0.3 to 10 times the canonical one, 0.5 at most. A threshold counts if its flow is valid and above 0; with
    fewer than four there are no figures. Pixels are counted once by the highest threshold they reach; sums from the top
    down give each threshold's plume and background. What lies above a background is summed by two places: that threshold, and how many
    of the scene's n backgrounds the pixel exceeds. So no pixel is repeated for each threshold. Null prob reaches none.
    """
    ts = geometric(0.3 * canonical, min(10 * canonical, 0.5), n)
    reach = F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t <= F.coalesce("prob", F.lit(-1.0))))
    p = px.select("scene", "row", "col", "b11", _y().alias("y"), reach.alias("reach"))
    sums = [F.count(F.lit(1)).alias("c"), F.sum("b11").alias("b11"), F.sum("y").alias("y"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")]
    part = p.groupBy("scene", "reach").agg(*sums)
    levels = part.select("scene").distinct().select("scene", F.explode(F.array(*[F.lit(i) for i in range(n + 1)])).alias("reach"))
    part = levels.join(part.hint("merge"), ["scene", "reach"], "left")
    below, here = W.partitionBy("scene").orderBy("reach").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("scene").orderBy(F.desc("reach"))  # n + 1 rows a scene
    step = part.select("scene", "reach", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(a) for c, a in (("c", "bg"), ("b11", "s11"), ("y", "sy"))], F.coalesce(F.sum("c").over(here), F.lit(0)).alias("n_px"), *[f(c).over(here).alias(c) for f, c in ((F.min, "r0"), (F.max, "r1"), (F.min, "c0"), (F.max, "c1"))])
    step = step.where("reach > 0").withColumns({"m11": F.try_divide("s11", "bg"), "my": F.try_divide("sy", "bg")})
    step = step.where((F.col("bg") >= least_background) & (F.col("m11") >= 1e-6) & (F.col("n_px") >= least_plume))
    backs = step.groupBy(F.col("scene").alias("s")).agg(F.array_sort(F.collect_list("my")).alias("backs"))  # n numbers at most
    over = F.size(F.filter("backs", lambda m: m < F.col("y")))
    cells = p.where("reach > 0").join(backs.hint("merge"), F.col("scene") == F.col("s")).groupBy("scene", "reach", over.alias("over")).agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("ky"))
    cells = cells.select(F.col("scene").alias("s"), F.col("reach").alias("at"), "over", "k", "ky")
    lower = F.count(F.lit(1)).over(W.partitionBy("scene").orderBy("my").rangeBetween(W.unboundedPreceding, W.currentRow)) - F.count(F.lit(1)).over(W.partitionBy("scene", "my"))
    own = step.withColumn("lower", lower)
    both = own.join(cells.hint("merge"), (F.col("scene") == F.col("s")) & (F.col("at") >= F.col("reach")) & (F.col("over") > F.col("lower")))
    above = both.groupBy("scene", "reach").agg(F.sum(F.col("ky") - F.col("k") * F.col("my")).alias("above"), F.first("m11").alias("m11"), F.first(F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0"))).alias("extent"))
    flows = above.select(F.col("scene").alias("s"), _flow(F.col("above"), F.col("m11"), F.col("extent"), wind_ms).alias("flow")).where("flow > 0")
    return _spread(px, flows, 4)


def _spread(px: DataFrame, flows: DataFrame, least: int) -> DataFrame:
    """Number, mean, deviation and relative deviation of the flows (s, flow) of each scene of px."""
    g = flows.groupBy("s").agg(F.count("flow").alias("n_valid"), F.avg("flow").alias("mean"), F.stddev_samp("flow").alias("sd"))
    got = px.select("scene").distinct().join(g.hint("merge"), F.col("scene") == F.col("s"), "left")
    enough = F.col("n_valid") >= least
    figures = [F.when(enough, F.round(x, k)).alias(a) for x, k, a in ((F.col("mean"), 2, "mean_flow"), (F.col("sd"), 2, "std_flow"), (100 * F.col("sd") / F.col("mean"), 1, "sigma_pct"))]
    return got.select("scene", F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid"), *figures)


def background_jackknife(px: DataFrame, mask: str = "prob >= 0.3", wind_ms: float = 3.5, compat: bool = False, least_background: int = LEAST_BACKGROUND, least_plume: int = LEAST_PLUME) -> DataFrame:
    """(scene, n_valid, mean_flow, std_flow, sigma_pct, flow_n, flow_s, flow_w, flow_e): flows without the background's pixels in one half.

    Halves are cut at the mean row and column of the plume. The background without a half is all of it less that half, from one
    pass of sums. compat=True keeps pixels that are in any half not dropped, which is all of them, so sigma is 0. A flow
    that is invalid or 0 is null; with fewer than two there are no figures.
    """
    m = F.coalesce(F.expr(mask), F.lit(False))
    plume = px.where(m).groupBy(F.col("scene").alias("s")).agg(F.avg("row").alias("cr"), F.avg("col").alias("cc"), F.count(F.lit(1)).alias("n_px"), F.greatest(F.max("row") - F.min("row"), F.max("col") - F.min("col")).alias("extent")).where(F.col("n_px") >= least_plume)
    inside = {"n": F.col("row") < F.col("cr"), "s": F.col("row") >= F.col("cr"), "w": F.col("col") < F.col("cc"), "e": F.col("col") >= F.col("cc")}
    j = px.where(~m).join(plume.hint("merge"), F.col("scene") == F.col("s"))
    parts = {"c": F.lit(1), "x": F.col("b11"), "y": _y()}
    total = [F.sum(v).alias(f"{k}_all") for k, v in parts.items()]
    each = [F.coalesce(F.sum(F.when(w, v)), F.lit(0)).alias(f"{k}_{h}") for h, w in inside.items() for k, v in parts.items()]
    bg = j.groupBy("s").agg(F.first("extent").alias("extent"), *total, *each)
    left = lambda k, h: F.col(f"{k}_all") - (F.lit(0) if compat else F.col(f"{k}_{h}"))
    cols = [x for h in inside for x in (left("c", h).alias(f"bg_{h}"), F.try_divide(left("x", h), left("c", h)).alias(f"m11_{h}"), F.try_divide(left("y", h), left("c", h)).alias(f"my_{h}"))]
    fit = bg.select("s", "extent", *cols)
    k = px.where(m).join(fit.hint("merge"), F.col("scene") == F.col("s"))
    k = k.groupBy("s").agg(*[F.first(c).alias(c) for c in fit.columns if c != "s"], *[F.sum(F.greatest(F.lit(0.0), _y() - F.col(f"my_{h}"))).alias(f"above_{h}") for h in inside])
    ok = {h: (F.col(f"bg_{h}") >= least_background) & (F.col(f"m11_{h}") >= 1e-6) for h in inside}
    flow = {h: F.when(ok[h], F.nullif(_flow(F.col(f"above_{h}"), F.col(f"m11_{h}"), F.col("extent"), wind_ms), F.lit(0.0))) for h in inside}
    flows = k.select("s", *[v.alias(f"flow_{h}") for h, v in flow.items()])
    long = flows.select("s", F.explode(F.array(*[f"flow_{h}" for h in inside])).alias("flow")).where("flow is not null")
    per = flows.select(F.col("s").alias("s2"), *[f"flow_{h}" for h in inside])
    return _spread(px, long, 2).join(per.hint("merge"), F.col("scene") == F.col("s2"), "left").drop("s2")


def crop_fallback(px: DataFrame, sizes: tuple[int, ...] = (750, 500, 250), mask: str = "prob >= 0.3", wind_ms: float = 3.5, least_background: int = 100) -> DataFrame:
    """(scene, crop, n_px, mass_kg, flow_kgh, attempts): the background-fit retrieval on nested centred crops; the first size that gives a flow wins.

    A pixel's ring is the smallest crop that holds it; sums of the background are taken by ring and added up from the
    centre outwards. attempts: `size:status` of every size in order, of which quantified, few_background, dark, no_plume. Without a
    flow, crop is null and mass and flow are 0. The centre is half the greatest row and column of the scene.
    """
    sizes = tuple(sorted(sizes, reverse=True))
    m = F.coalesce(F.expr(mask), F.lit(False))
    mid = px.groupBy(F.col("scene").alias("s")).agg(((F.max("row") + 1) / 2.0).alias("mr"), ((F.max("col") + 1) / 2.0).alias("mc"))
    away = F.greatest(F.abs(F.col("row") + 0.5 - F.col("mr")), F.abs(F.col("col") + 0.5 - F.col("mc")))
    ring = F.size(F.filter(F.array(*[F.lit(x / 2.0) for x in sizes]), lambda x: x >= away))  # of how many sizes
    p = px.join(mid.hint("merge"), F.col("scene") == F.col("s")).select("scene", "row", "col", "b11", "b12", m.alias("plume"), ring.alias("ring")).where("ring > 0")
    rings = p.where("not plume").groupBy("scene", "ring").agg(F.sum(F.col("b11") * F.col("b12")).alias("xy"), F.sum(F.col("b12") * F.col("b12")).alias("yy"), F.sum("b11").alias("x"), F.count(F.lit(1)).alias("bg"))
    wide = rings.groupBy(F.col("scene").alias("s")).agg(*[F.coalesce(F.sum(F.when(F.col("ring") >= i + 1, F.col(c))), F.lit(0)).alias(f"{c}{i}") for i in range(len(sizes)) for c in ("xy", "yy", "x", "bg")])
    wide = p.select("scene").distinct().join(wide.hint("merge"), F.col("scene") == F.col("s"), "left").drop("s")
    status = [F.when(F.coalesce(F.col(f"bg{i}"), F.lit(0)) < least_background, "few_background").when((F.col(f"x{i}") / F.col(f"bg{i}") < 1e-6) | (F.col(f"yy{i}") < 1e-12), "dark") for i in range(len(sizes))]
    fit = wide.select(F.col("scene").alias("s"), *[F.when(st.isNull(), F.col(f"xy{i}") / F.col(f"yy{i}")).alias(f"f{i}") for i, st in enumerate(status)], *[st.alias(f"st{i}") for i, st in enumerate(status)])
    plume = p.where("plume").join(fit.hint("merge"), F.col("scene") == F.col("s"))
    agg = []
    for i in range(len(sizes)):
        held = F.col("ring") >= i + 1
        dx = F.greatest(F.lit(0.0), -((F.col(f"f{i}") * F.col("b12") - F.col("b11")) / F.col("b11")) / SENSITIVITY)
        agg += [F.sum(F.when(held, dx * KG_PER_COLUMN)).alias(f"mass{i}"), F.count_if(held).alias(f"n{i}"), _extent(held).alias(f"e{i}")]
    g = plume.groupBy(F.col("scene").alias("s3")).agg(*agg)
    r = fit.join(g.hint("merge"), F.col("s") == F.col("s3"), "left")
    tries = []
    for i, size in enumerate(sizes):
        length = F.greatest(F.col(f"e{i}") * PIXEL_M, F.lit(1.0))
        flow = F.round(F.col(f"mass{i}") / (length / max(wind_ms, 0.5)) * 3600, 2)
        said = F.coalesce(F.col(f"st{i}"), F.when(F.coalesce(F.col(f"n{i}"), F.lit(0)) == 0, "no_plume").when(flow > 0, "quantified").otherwise("no_plume"))
        tries.append(F.struct(F.lit(size).alias("crop"), F.col(f"n{i}").alias("n_px"), F.round(f"mass{i}", 4).alias("mass_kg"), flow.alias("flow_kgh"), said.alias("said")))
    r = r.select("s", F.array(*tries).alias("tries"))
    won = F.get(F.filter("tries", lambda t: t["said"] == "quantified"), F.lit(0))
    attempts = F.array_join(F.transform("tries", lambda t: F.concat(t["crop"].cast("string"), F.lit(":"), t["said"])), " ")
    r = r.select(F.col("s").alias("scene"), won.alias("w"), attempts.alias("attempts"))
    return r.select("scene", "w.crop", F.coalesce("w.n_px", F.lit(0)).alias("n_px"), F.coalesce("w.mass_kg", F.lit(0.0)).alias("mass_kg"), F.coalesce("w.flow_kgh", F.lit(0.0)).alias("flow_kgh"), "attempts")


def difference_retrieval(target: DataFrame, reference: DataFrame, thresholds: list[float], wind_ms: float = 3.5, least_background: int = 100, least_plume: int = 10) -> DataFrame:
    """(scene, threshold, n_px, mass_kg, flow_kgh, warning) of every scene and threshold, from bands less those of a reference scene.

    Plume pixels have prob above the threshold in the target; null and NaN are background. The plume counts by how far the differences' y lies
    above the background's, over the target's own mean b11 of the background; its length is the square root of its area. Invalid ones have mass and flow 0 and a
    warning: shape_mismatch (a pixel that one side lacks), too_few_plume, too_few_background, dark_background. Pixels are distinct in each
    table. The background's sums are taken by level (how many thresholds a pixel is above), and a pixel meets all thresholds in one row.
    """
    t = sorted(set(map(float, thresholds)))
    r = reference.select(F.col("scene").alias("s"), F.col("row").alias("r"), F.col("col").alias("c"), F.col("b11").alias("r11"), F.col("b12").alias("r12"))
    x = target.join(r.hint("merge"), (F.col("scene") == F.col("s")) & (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")), "full")
    lacks = F.col("scene").isNull() | F.col("s").isNull()
    level = F.when(F.isnan("prob"), 0).otherwise(sum((F.coalesce((F.col("prob") > v).cast("int"), F.lit(0)) for v in t), F.lit(0)))
    y = (F.col("b12") - F.col("r12")) - 0.5 * (F.col("b11") - F.col("r11"))
    x = x.select(F.coalesce("scene", "s").alias("scene"), level.alias("level"), y.alias("y"), F.col("b11").alias("raw"), lacks.alias("lacks"))
    below = [F.col("level") < k for k in range(1, len(t) + 1)]
    fit = x.groupBy(F.col("scene").alias("f")).agg(F.max("lacks").alias("lacks"), F.count("*").alias("n"), *[a for k, b in enumerate(below) for a in (F.count_if(b).alias(f"bg{k}"), F.avg(F.when(b, F.col("y"))).alias(f"y{k}"), F.avg(F.when(b, F.col("raw"))).alias(f"m{k}"))])
    plume = x.join(fit.hint("merge"), F.col("scene") == F.col("f"))
    plume = plume.groupBy(F.col("scene").alias("p")).agg(*[F.sum(F.when(~b, F.greatest(F.lit(0.0), F.col("y") - F.col(f"y{k}")))).alias(f"a{k}") for k, b in enumerate(below)])
    each = F.array(*[F.struct(F.lit(v).alias("threshold"), F.col(f"bg{k}").alias("bg"), F.col(f"m{k}").alias("m11"), F.col(f"a{k}").alias("above")) for k, v in enumerate(t)])
    got = fit.join(plume.hint("merge"), F.col("f") == F.col("p")).select(F.col("f").alias("scene"), "lacks", "n", F.inline(each)).withColumn("n_px", F.col("n") - F.col("bg"))
    warning = F.when(F.col("lacks"), "shape_mismatch").when(F.col("n_px") < least_plume, "too_few_plume").when(F.col("bg") < least_background, "too_few_background").when(F.coalesce(F.col("m11") < 1e-6, F.lit(True)), "dark_background")
    mass = F.coalesce("above", F.lit(0.0)) / (F.col("m11") * SENSITIVITY) * KG_PER_COLUMN
    flow = F.coalesce(mass * wind_ms / F.sqrt(F.col("n_px") * PIXEL_M**2) * 3600, F.lit(0.0))
    return got.select("scene", "threshold", "n_px", F.when(warning.isNull(), F.round(mass, 4)).otherwise(0.0).alias("mass_kg"), F.when(warning.isNull(), F.round(flow, 1)).otherwise(0.0).alias("flow_kgh"), warning.alias("warning"))


def crop_stats(px: DataFrame, sites: DataFrame, height: int, width: int, size: int = 500, least: int = 100) -> DataFrame:
    """(scene, site, n_rows, n_cols, edge, b11_mean, b12_mean, ratio) of the crop of `size` pixels around each site (scene, site, row, col).

    A crop that the scene's edge cuts is taken as far as it goes, if it keeps `least` rows and columns; sites with less, or on scenes without pixels there, have no row. ratio: mean b12 over
    mean b11, the latter at least 1.
    """
    half = size // 2
    clip = lambda c, most: (F.greatest(F.lit(0), F.col(c) - half), F.least(F.lit(most), F.col(c) + half))
    (r0, r1), (c0, c1) = clip("row", height), clip("col", width)
    s = sites.select(F.col("scene").alias("s"), "site", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1")).distinct()
    s = s.where((F.col("r1") - F.col("r0") >= least) & (F.col("c1") - F.col("c0") >= least))
    inside = (F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r1")) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c1"))
    j = px.join(s.hint("merge"), (F.col("scene") == F.col("s")) & inside)
    g = j.groupBy("scene", "site", (F.col("r1") - F.col("r0")).alias("n_rows"), (F.col("c1") - F.col("c0")).alias("n_cols")).agg(F.avg("b11").alias("x"), F.avg("b12").alias("y"))
    edge = (F.col("n_rows") < 2 * half) | (F.col("n_cols") < 2 * half)
    return g.select("scene", "site", "n_rows", "n_cols", edge.alias("edge"), F.round("x", 2).alias("b11_mean"), F.round("y", 2).alias("b12_mean"), F.round(F.col("y") / F.greatest("x", F.lit(1.0)), 4).alias("ratio"))
