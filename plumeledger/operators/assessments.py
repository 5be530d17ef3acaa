"""Assessments of sites and models: annual figures, leakage, agreement, alignment, resampled thresholds, calibration blocks.

Nulls are left out of means and counts of values; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumeledger.functions import hazard as H
from plumeledger.functions import scalars as S
from plumeledger.functions.running import with_few
from plumeledger.sources.scratch import kept


def annual_by_month(df: DataFrame, floor: float = 300.0) -> DataFrame:
    """Of each site: months observed, with and without detection; upper (detections alone), floor-imputed and lower mean flow of a month.

    df: site, acq_date, q (null: no detection). A month's flow is the mean of its detections.
    """
    m = df.groupBy("site", F.trunc("acq_date", "month").alias("month")).agg(F.avg("q").alias("q"))
    return m.groupBy("site").agg(
        F.count("*").alias("n_obs"), F.count("q").alias("n_det"), F.count_if(F.col("q").isNull()).alias("n_non"),
        F.avg("q").alias("upper"), F.percentile("q", F.lit(0.5)).alias("median"), F.min("q").alias("lo"), F.max("q").alias("hi"),
        F.avg(F.coalesce("q", F.lit(floor))).alias("imputed"), F.avg(F.coalesce("q", F.lit(0.0))).alias("lower"),
    )


def swath_rate(df: DataFrame) -> DataFrame:
    """Detections over observations whose swath is known to be whole; an unknown swath is no observation."""
    whole = df.where(F.col("partial_swath").eqNullSafe(False))
    return whole.groupBy("site").agg(F.count("*").alias("n_obs"), F.count_if("detected").alias("n_det")).withColumn("rate", F.try_divide("n_det", "n_obs"))


def site_years(df: DataFrame) -> DataFrame:
    """(site, year, best, any_detect, detect_years): the greatest ratio and any detection of each year, with all years of the site that have one."""
    y = df.where("acq_date is not null").groupBy("site", F.year("acq_date").alias("year")).agg(F.max("sc_cfar").alias("best"), F.coalesce(F.bool_or("cfar_detect"), F.lit(False)).alias("any_detect"))
    all_ = F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("any_detect"), F.col("year"))).over(W.partitionBy("site"))).cast("array<string>"))
    return y.withColumn("detect_years", all_)  # a row a year


def dual_score(n_dual: Column, n_valid: Column) -> Column:
    """Share of valid records that both sensors saw; null without any."""
    return F.when(n_valid > 0, F.round(n_dual / n_valid, 3))


def leakage(evaluated: DataFrame, trained: DataFrame, days: int = 14) -> DataFrame:
    """(id, nearest, leak): days to the nearest training day of the site, and whether it is under `days`; null and false without one.

    The training days before and after come from windows over the sites' days (a site has some hundreds a year), so neither pairs nor the
    rows of a site meet. Both windows run up to the current day: one that runs from it to the end works out every row's end anew.
    """
    t = trained.select("site", "day").distinct().select("site", "day", F.col("day").alias("t"))
    days_of = evaluated.select("site", "day").distinct().withColumn("t", F.lit(None).cast("date")).unionByName(t)
    upto = lambda order: W.partitionBy("site").orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    near = days_of.withColumns({"before": F.last("t", True).over(upto(F.col("day"))), "after": F.last("t", True).over(upto(F.col("day").desc()))})
    near = near.where("t is null").select(F.col("site").alias("_site"), F.col("day").alias("_day"), F.least(F.datediff("day", "before"), F.datediff("after", "day")).alias("gap"))
    j = with_few(evaluated, kept(near, "site-days"), F.col("site").eqNullSafe(F.col("_site")) & (F.col("day") == F.col("_day")), "left")
    return j.select("id", F.col("gap").alias("nearest"), F.coalesce(F.col("gap") < days, F.lit(False)).alias("leak"))


def model_pairing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: crops that both models have, agreement, and the rate of each; models come with a column detected."""
    j = a.select(key, F.col("detected").cast("int").alias("x")).join(b.select(key, F.col("detected").cast("int").alias("y")).hint("merge"), key)
    g = j.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("int")).alias("agreement"), F.avg("x").alias("rate_a"), F.avg("y").alias("rate_b"))
    return g


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north on a local plane at the mean latitude; 0 for equal places."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(dx, lat2 - lat1)), F.lit(360.0))


def wind_alignment(df: DataFrame, by: str, most: float = 45.0) -> DataFrame:
    """Of plume bearings against the downwind direction: number, share within `most` degrees, mean and median difference."""
    x = df.withColumn("d", S.angular_difference(F.col("bearing"), F.pmod(F.col("wind_from") + 180, F.lit(360.0)))).where("d is not null")
    return x.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("d") < most).cast("int")).alias("aligned"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"))


def bootstrap_thresholds(scores: DataFrame, draws: int, alpha: float, score: str = "score") -> DataFrame:
    """(n, mean, sd, p05, p95) of the conformal threshold over resamples with replacement, one task a resample and more.

    scores: key (from 0, without gaps) and score. Each place of a resample picks a key by a hash of (draw, place); equal
    picks are counted before the ranking, and the calibration set is small by its nature.
    """
    n = scores.count()
    if n == 0:
        return scores.sparkSession.createDataFrame([], "n long, mean double, sd double, p05 double, p95 double")
    spark = scores.sparkSession
    place = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    picks = place.select("draw", F.floor(H.uniform(F.col("draw"), F.col("i")) * n).alias("key"))
    j = picks.join(scores.hint("shuffle_hash"), "key").groupBy("draw", score).agg(F.count("*").alias("c"))
    upto = j.withColumn("upto", F.sum("c").over(W.partitionBy("draw").orderBy(score)))
    rank = F.least(F.ceil((F.lit(n) + 1) * (1 - F.lit(alpha))), F.lit(n))
    tau = upto.where(F.col("upto") >= rank).groupBy("draw").agg(F.min(score).alias("tau"))
    return tau.agg(F.lit(n).cast("long").alias("n"), F.avg("tau").alias("mean"), F.stddev_samp("tau").alias("sd"), F.percentile("tau", 0.05).alias("p05"), F.percentile("tau", 0.95).alias("p95"))


def event_density(n: Column, area_km2: Column) -> Column:
    """Events per 1,000 square kilometres; null for no area."""
    return F.when(area_km2 > 0, n / area_km2 * 1000)


def macro_metrics(per_crop: DataFrame, positive: Column, detected: Column) -> DataFrame:
    """Mean pixel metrics over positive crops (nulls left out), the share of them that is detected, and the share of others that is."""
    pos = F.coalesce(positive, F.lit(False))
    hit = F.coalesce(detected, F.lit(False)).cast("int")
    means = [F.avg(F.when(pos, F.col(c))).alias(c) for c in ("iou", "precision", "recall", "f1")]
    return per_crop.agg(F.count_if(pos).alias("n_pos"), *means, F.avg(F.when(pos, hit)).alias("scene_recall"), F.avg(F.when(~pos, hit)).alias("fpr"))


def world_to_pixel(x: Column, y: Column, origin_x: float, origin_y: float, size_m: float, whole: str = "round") -> tuple[Column, Column]:
    """(row, col) of a place; halves go to the even pixel, or whole="cut" truncates."""
    row, col = (origin_y - y) / size_m, (x - origin_x) / size_m
    return tuple((F.bround(c) if whole == "round" else c).cast("int") for c in (row, col))


def clamp_pixel(v: Column, n: int, margin: int = 200, size_m: float = 10.0) -> tuple[Column, Column]:
    """A pixel moved to within the margin of a tile of n pixels, and the metres it was moved by."""
    to = F.greatest(F.lit(margin), F.least(F.lit(n - 1 - margin), v))
    return to, (to - v) * size_m


def union_tagged(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of all sources with _source; a column that a source lacks is null."""
    out = None
    for name, df in sources.items():
        one = df.withColumn("_source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def merge_days(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Days of both; where both have one, the new row."""
    have = new.select(*keys).distinct()
    return old.join(have.hint("merge"), keys, "left_anti").unionByName(new)


def training_role(positive: Column, negative: Column, synthetic: Column) -> Column:
    """The first that holds of a site: positive, negative with synthetic, negative, synthetic alone, held out."""
    return F.when(positive, "positive").when(negative & synthetic, "negative+synthetic").when(negative, "negative").when(synthetic, "synthetic_only").otherwise("held_out")
