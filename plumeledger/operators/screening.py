"""Screening of scene records: quality reasons, exclusions, governance flags, splits and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exclude_reason(site_mean: Column, control_mean: Column, cv: Column, sc: Column, q: Column, quantified: Column | None = None) -> Column:
    """The first reason that holds, null if none: uniform field, partial swath, low mean, low flow, high ratio.

    quantified: where it is not true, the last three do not apply; without it they apply to all.
    """
    uniform = (site_mean > 0) & (F.abs(site_mean - control_mean) < 1e-4)
    partial = ((F.abs(sc - 1) < 1e-6) & (F.coalesce(F.abs(cv), F.lit(0.0)) < 1e-9)) | (F.abs(site_mean - control_mean) < 1e-6)
    q_ok = F.lit(True) if quantified is None else quantified
    return (
        F.when(uniform, "uniform_field").when(partial, "partial_swath").when(q_ok & (site_mean < 0.05), "low_site_mean")
        .when(q_ok & (q < 200), "low_flow").when(q_ok & (sc > 20), "high_ratio")
    )


def calibration_exclusion(control_mean: Column, cv: Column, sc: Column) -> Column:
    """Why a scene is kept out of calibration, null if it is not; the first reason wins."""
    artifact = (control_mean < 5e-4) & (sc > 20)
    return F.when(artifact, "denominator_artifact").when((cv > 1.5) & (sc > 5.5), "terrain_confound")


def is_detection(df: DataFrame, classic_sites: DataFrame) -> DataFrame:
    """df with detected: ratio above 1.15 at the sites of classic_sites (one column, site), else the CFAR flag."""
    classic = classic_sites.select(F.col("site").alias("_site"), F.lit(True).alias("_classic")).distinct()
    j = df.join(classic.hint("shuffle_hash"), F.col("site") == F.col("_site"), "left")
    flag = F.when(F.col("_classic"), F.col("sc_cfar") > 1.15).otherwise(F.col("cfar_detect"))
    return j.withColumn("detected", F.coalesce(flag, F.lit(False))).drop("_site", "_classic")


def governance(df: DataFrame) -> DataFrame:
    """df (wind_source, era5_offset_h, bitemporal_missing, cloud, solar_zenith) with flags and excluded.

    Unknown values raise no flag; excluded rows are kept out of aggregates.
    """
    marks = {
        "WIND_FALLBACK": F.lower("wind_source").rlike("fallback|climatological"),
        "ERA5_STALE": F.abs("era5_offset_h") > 4,
        "BITEMPORAL_MISSING": F.col("bitemporal_missing"),
        "CLOUD_FRACTION_HIGH": F.col("cloud") > 15,
        "SOLAR_ZENITH_EXTREME": F.col("solar_zenith") > 70,
    }
    flags = F.filter(F.array(*[F.when(c, k) for k, c in marks.items()]), lambda x: x.isNotNull())
    return df.withColumns({"flags": flags, "excluded": F.coalesce(marks["CLOUD_FRACTION_HIGH"], F.lit(False))})


def governance_summary(flagged: DataFrame) -> DataFrame:
    """(flag, n) for every flag that occurs, with rows ANY and TOTAL; one pass, combined before the shuffle."""
    some = F.when(F.size("flags") > 0, F.array(F.lit("ANY"))).otherwise(F.array().cast("array<string>"))
    marks = F.concat(F.col("flags"), some, F.array(F.lit("TOTAL")))
    return flagged.select(F.explode(marks).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def split_of(day: Column) -> Column:
    """val where the day of the month is divisible by 5, else train; unknown dates are train."""
    return F.when(F.day(day) % 5 == 0, "val").otherwise("train")


def window_of(day: Column, days: int = 30) -> tuple[Column, Column]:
    """First and last day within so many days of the 15th of the month."""
    middle = F.date_add(F.trunc(day, "month"), 14)
    return F.date_sub(middle, days), F.date_add(middle, days)


def daily_calendar(df: DataFrame, by: str, day: str) -> DataFrame:
    """(by, day, n): every day from a group's first to its last, with the number of rows on it, zero included."""
    per_day = df.where(F.col(day).isNotNull()).groupBy(by, day).agg(F.count("*").alias("n"))
    ends = per_day.groupBy(F.col(by).alias("_by")).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = ends.select("_by", F.explode(F.sequence("a", "b")).alias("_day"))
    j = days.join(per_day.hint("merge"), (F.col("_by").eqNullSafe(F.col(by))) & (F.col("_day") == F.col(day)), "left")
    return j.select(F.col("_by").alias(by), F.col("_day").alias(day), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ceiling_fallback(df: DataFrame, by: list[str], ceilings: list[float]) -> DataFrame:
    """Rows under the first of the ceilings (least first) that any row of their group meets; a group that meets none is left out."""
    level = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(ceilings))):
        level = F.when(F.col("cloud") <= c, i).otherwise(level)
    d = df.withColumn("level", level).where("level is not null")
    least = d.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.min("level").alias("_level"))
    on = F.col("level") == F.col("_level")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return d.join(least.hint("merge"), on, "left_semi")


def nearest_dates(df: DataFrame, by: str, anchor: str, n: int) -> DataFrame:
    """The n rows of each group whose acq_date is nearest to the anchor date; ties by date, then event_id."""
    away = F.abs(F.datediff("acq_date", F.lit(anchor).cast("date")))
    w = W.partitionBy(by).orderBy(away.asc_nulls_last(), "acq_date", "event_id")
    return df.withColumns({"days_away": away, "place": F.row_number().over(w)}).where(F.col("place") <= n)


def merge_emitters(known: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """known, and those rows of more whose key known does not have; _source tells them apart."""
    unseen = more.join(known.select(key).distinct().hint("merge"), key, "left_anti")
    return known.withColumn("_source", F.lit("builtin")).unionByName(unseen.withColumn("_source", F.lit("file")))
