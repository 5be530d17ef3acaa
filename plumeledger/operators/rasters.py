"""Rasters as rows (scene, row, col, bands, prob): tiles, rings, masks, differences and connected events.

Nulls: a null band or probability is no hit and is left out of means. Empty tables give empty results. A pixel is expected once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumeledger.sources.scratch import scratch_dir

AT = ["scene", "row", "col"]
TILE = 32


def normalize_band(x: Column) -> Column:
    """Reflectance of 0 to 10,000 as 0 to 255, cut off at both ends and truncated."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x / 10000 * 255))).cast("int")


def tiles(px: DataFrame, height: int, width: int, size: int = 100, overlap: int = 0) -> DataFrame:
    """Pixels with the tile (tile_row, tile_col) that holds each; only full tiles, and a pixel in each of several that overlap."""
    step = size - overlap
    if step < 1:
        raise ValueError("tiles must overlap by less than their size")

    def holding(c: str, n: int) -> Column:
        last = (n - size) // step  # negative: not one full tile
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - (size - 1)) / step)).cast("int")
        end = F.least(F.lit(last), F.floor(F.col(c) / step)).cast("int")
        return F.when(first <= end, F.sequence(first, end))

    return px.withColumn("tile_row", F.explode(holding("row", height))).withColumn("tile_col", F.explode(holding("col", width)))


def stitch(tiled: DataFrame, step: int) -> DataFrame:
    """Mean probability of each scene pixel over the tiles (tile_row, tile_col, row and col within the tile) that cover it."""
    at = {"row": F.col("tile_row") * step + F.col("row"), "col": F.col("tile_col") * step + F.col("col")}
    return tiled.select("scene", *[c.alias(k) for k, c in at.items()], "prob").groupBy(*AT).agg(F.avg("prob").alias("prob"))


def valid_fraction(px: DataFrame, bands: list[str], inside: Column) -> DataFrame:
    """Share of a scene's pixels inside that have a band other than 0; a null band counts as 0."""
    some = F.greatest(*[F.coalesce(F.abs(F.col(b)), F.lit(0.0)) for b in bands]) != 0
    return px.where(inside).groupBy("scene").agg(F.avg(some.cast("int")).alias("valid_frac"))


def ring_profile(px: DataFrame, distance: Column, step: float = 5.0, rings: int = 8) -> DataFrame:
    """(scene, ring, inner_km, outer_km, n, mean_prob) of every ring, empty ones too: a pair of aggregates a ring, one pass."""
    ring = F.floor(distance / step)
    g = px.withColumn("_ring", ring).groupBy("scene").agg(*[f(F.when(F.col("_ring") == i, F.col("prob"))).alias(f"{k}{i}") for i in range(rings) for k, f in (("n", F.count), ("m", F.avg))])
    rows = [F.struct(F.lit(i).alias("ring"), F.lit(i * step).alias("inner_km"), F.lit((i + 1) * step).alias("outer_km"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean_prob")) for i in range(rings)]
    return g.select("scene", F.inline(F.array(*rows)))


def ring_gradient(profile: DataFrame) -> DataFrame:
    """Line through ln(mean_prob) by mid distance of the rings above 0; scenes with fewer than three such rings are left out."""
    x, y = (F.col("inner_km") + F.col("outer_km")) / 2, F.log("mean_prob")
    g = profile.where("mean_prob > 0").groupBy("scene").agg(
        F.count("*").alias("n_rings"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"),
        F.var_pop(y).alias("spread"), F.min_by("mean_prob", x).alias("near"), F.max_by("mean_prob", x).alias("far"),
    )
    r2 = F.when(F.col("spread") > 0, F.col("r") * F.col("r")).otherwise(0.0)
    return g.where("n_rings >= 3").select("scene", "n_rings", "slope", "intercept", r2.alias("r2"), (-1000 * F.col("slope")).alias("score"), (F.col("near") / F.col("far")).alias("near_far"))


def gradient_verdict(kind: Column, score: Column, near_far: Column) -> Column:
    """Of controls: fires or quiet; of emitters: strong, weak or none; other kinds: null."""
    emitter = F.when((score > 2) & (near_far > 1.5), "strong").when((score > 0.5) | (near_far > 1.2), "weak").otherwise("none")
    return F.when(kind == "control", F.when(score > 1, "control fires").otherwise("quiet")).when(kind.isin("emitter", "emitter_miss"), emitter)


def bitemporal_diff(target: DataFrame, reference: DataFrame, bands: list[str]) -> DataFrame:
    """The named bands as target - reference + 128 within 0 to 255; other columns are the target's. Pixels that one side lacks are left out."""
    r = reference.select(*AT, *[F.col(b).alias(f"_{b}") for b in bands])
    j = target.join(r.hint("merge"), AT)
    return j.withColumns({b: F.greatest(F.lit(0), F.least(F.lit(255), F.col(b) - F.col(f"_{b}") + 128)) for b in bands}).drop(*[f"_{b}" for b in bands])


def delta_stats(diff: DataFrame, bands: list[str]) -> DataFrame:
    """Least, greatest and mean difference (the shift of 128 taken off) of each band."""
    aggs = [f(F.col(b) - 128).alias(f"{b}_{k}") for b in bands for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return diff.groupBy("scene").agg(F.count("*").alias("n_px"), *aggs)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule behind the bounding box; corners are a short fixed list."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay != by:  # a level edge is never crossed
            crossed = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            crossings = crossings + crossed.cast("int")
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def geometric_flow(area_m2: Column, length_m: Column, wind_ms: Column) -> Column:
    """kg an hour of a plume of 3 g a square metre that crosses its length at the wind's speed; 0 for lengths under 1 m."""
    return F.when(length_m < 1, 0.0).otherwise(area_m2 * 0.003 / (length_m / F.greatest(wind_ms, F.lit(0.5))) * 3600)


def weighted_centroid(px: DataFrame, row: int, col: int, radius: int, floor: float, least: int = 10) -> DataFrame:
    """Centre of probability within a box; pixels at the floor or below have no weight, scenes with too few pixels no row."""
    near = px.where(F.col("row").between(row - radius, row + radius) & F.col("col").between(col - radius, col + radius) & (F.col("prob") > floor))
    w = F.sum("prob")
    g = near.groupBy("scene").agg(F.count("*").alias("n_px"), (F.sum(F.col("prob") * F.col("row")) / w).alias("row"), (F.sum(F.col("prob") * F.col("col")) / w).alias("col"))
    return g.where(F.col("n_px") >= least)


def pixel_confusion(px: DataFrame, predicted: Column, true: Column) -> DataFrame:
    """Counts and rates by scene; a rate over nothing is null."""
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(true, F.lit(False))
    g = px.groupBy("scene").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    g = g.withColumns({"iou": F.try_divide("tp", F.expr("tp + fp + fn")), "precision": F.try_divide("tp", F.expr("tp + fp")), "recall": F.try_divide("tp", F.expr("tp + fn"))})
    return g.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def prob_stats(px: DataFrame, least: int = 115) -> DataFrame:
    """Of each crop: mean, greatest, 95th percentile, pixels above 0.10 and 0.30, and whether the latter are enough for a detection."""
    g = px.groupBy("scene").agg(
        F.avg("prob").alias("mean"), F.max("prob").alias("top"), F.percentile("prob", 0.95).alias("p95"), F.count_if(F.col("prob") > 0.10).alias("n10"), F.count_if(F.col("prob") > 0.30).alias("n30")
    )
    return g.withColumn("detected", F.col("n30") >= least)


def scene_contrast(px: DataFrame, pairs: DataFrame, ts: list[float]) -> DataFrame:
    """(scene, clean, t, n_scene, n_clean, ratio): pixels above each threshold in a scene and in its clean partner of pairs(scene, clean)."""
    n = px.groupBy("scene").agg(F.array(*[F.count_if(F.col("prob") > t) for t in ts]).alias("n"))
    j = pairs.join(n.hint("merge"), "scene").join(n.select(F.col("scene").alias("clean"), F.col("n").alias("m")).hint("merge"), "clean")
    x = j.select("scene", "clean", F.posexplode("n").alias("i", "n_scene"), "m")
    t = F.element_at(F.array(*[F.lit(float(t)) for t in ts]), F.col("i") + 1)
    return x.select("scene", "clean", t.alias("t"), "n_scene", F.get("m", "i").alias("n_clean")).withColumn("ratio", F.try_divide("n_scene", "n_clean"))


def _tile_groups():
    """Of each tile, an array of places row * TILE + col: the least place of the group that each is 4-connected to, in the same order."""

    @F.arrow_udf("array<int>")
    def of(tiles: pa.Array) -> pa.Array:
        n, size = np.asarray(tiles.value_lengths(), np.int64), TILE * TILE
        at = np.asarray(tiles.flatten(), np.int64)
        keys, back = np.unique(np.repeat(np.arange(len(n)), n) * size + at, return_inverse=True)
        a, b = [], []
        for step, inside in ((1, keys % TILE < TILE - 1), (TILE, keys % size < size - TILE)):
            x = np.flatnonzero(inside)
            y = np.minimum(np.searchsorted(keys, keys[x] + step), len(keys) - 1)
            met = keys[y] == keys[x] + step
            a.append(x[met])
            b.append(y[met])
        a, b, to = np.concatenate(a), np.concatenate(b), np.arange(len(keys))
        while True:
            p, q = to[a], to[b]
            if np.array_equal(p, q):
                break
            np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(to, to[to]):
                to = to[to]
        ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array((keys[to][back] % size).astype(np.int32)))

    return of


def connected_events(px: DataFrame, hit: Column) -> DataFrame:
    """Hit pixels (scene, row, col, prob) with the event they belong to: the least place row * 2^32 + col of the 4-connected group.

    Pixels are first grouped within tiles of TILE by TILE; a tile's groups, named by their least place, are the nodes, and touching pixels
    of adjacent tiles their edges; without such edges, as in scenes of one tile, that is all. Each round
    joins a node to its neighbour of least hash, under a hash of that round, which leaves a fixed share of the nodes on
    average whatever the shape; the tables of a round are written, so lost executors cost no earlier round.
    """
    spark = px.sparkSession

    def put(df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    inner = (F.pmod(F.col("row"), F.lit(TILE)) * TILE + F.pmod(F.col("col"), F.lit(TILE))).cast("int")
    own = px.where(hit).where("scene is not null and row is not null and col is not null")
    own = own.groupBy("scene", tile("row").alias("_i"), tile("col").alias("_j")).agg(F.collect_list(F.struct("row", "col", "prob", inner.alias("at"))).alias("x"))
    own = own.withColumn("to", _tile_groups()(F.col("x.at")))
    of = own.select("scene", "_i", "_j", F.inline(F.arrays_zip("x", "to")))
    run = (F.col("_i") * TILE + F.floor(F.col("to") / TILE)) * (1 << 32) + F.col("_j") * TILE + F.col("to") % TILE
    hits = put(of.select("scene", "x.row", "x.col", "x.prob", run.alias("run")), "event-runs")
    one = None
    for c in ("row", "col"):
        ends = hits.where(F.pmod(F.col(c), F.lit(TILE)) == TILE - 1).withColumn(c, F.col(c) + 1).select(*AT, F.col("run").alias("a"))
        starts = hits.where(F.pmod(F.col(c), F.lit(TILE)) == 0).select(*AT, F.col("run").alias("b"))
        met = ends.join(starts.hint("merge"), AT).select("scene", "a", "b")
        one = met if one is None else one.unionAll(met)
    one = one.distinct()
    edges = put(one, "event-edges")
    if edges.isEmpty():
        return hits.select(*AT, "prob", F.col("run").alias("event"))
    names, turn = put(hits.select("scene", "run", F.col("run").alias("event")).distinct(), "event-names"), 0
    while not edges.isEmpty():
        both = edges.unionAll(edges.select("scene", F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64("scene", c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        to = put(both.groupBy("scene", "a").agg(F.least(F.min(order("b")), order("a"))["v"].alias("to")), "event-step")
        names = put(names.join(to.select("scene", F.col("a").alias("event"), "to").hint("merge"), ["scene", "event"], "left").select("scene", "run", F.coalesce("to", "event").alias("event")), "event-names")
        end = edges.join(to.select("scene", "a", F.col("to").alias("p")).hint("merge"), ["scene", "a"]).join(to.select("scene", F.col("a").alias("b"), F.col("to").alias("q")).hint("merge"), ["scene", "b"])
        edges, turn = put(end.where("p <> q").select("scene", F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "event-edges"), turn + 1
    least = names.groupBy("scene", "event").agg(F.min("run").alias("first"))
    known = names.join(least.hint("merge"), ["scene", "event"]).select("scene", "run", F.col("first").alias("event"))
    return hits.join(known.hint("merge"), ["scene", "run"]).select(*AT, "prob", "event")


def extract_events(px: DataFrame, t: float = 0.18, least: int = 115) -> DataFrame:
    """One row a connected event of enough pixels: area, whole-number centre, greatest and mean probability."""
    g = connected_events(px, F.col("prob") >= t).groupBy("scene", "event").agg(
        F.count("*").alias("area_px"), F.floor(F.avg("row")).alias("row"), F.floor(F.avg("col")).alias("col"), F.max("prob").alias("top"), F.avg("prob").alias("mean")
    )
    return g.where(F.col("area_px") >= least)


def blob_stats(px: DataFrame, t: float = 0.18) -> DataFrame:
    """Of each crop: mean, greatest, per cent above t, number of connected blobs above t and the largest one's pixels."""
    blobs = connected_events(px, F.col("prob") > t).groupBy("scene", "event").agg(F.count("*").alias("n")).groupBy("scene").agg(F.count("*").alias("n_blobs"), F.max("n").alias("largest"))
    g = px.groupBy("scene").agg(F.avg("prob").alias("mean"), F.max("prob").alias("top"), (100 * F.avg((F.col("prob") > t).cast("int"))).alias("pct"))
    return g.join(blobs.hint("merge"), "scene", "left").fillna(0, ["n_blobs", "largest"])
