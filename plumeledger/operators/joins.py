"""Spatial and financial joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.functions import scalars as S


def pairs_within(points: DataFrame, assets: DataFrame, max_km: float, same: bool = False) -> DataFrame:
    """(site, asset, km): all assets within max_km of each point. same: both are one table, and a row does not meet its own id.

    Cells of latitude rows and longitude columns are joined by equality: an asset goes to its own cell, a point to those around
    it in its own row and the two beside. A row is max_km high and has as many columns as max_km fits into a circle of
    latitude there; a row from which the pole is within max_km is one cell all around. Columns close up at 180 degrees. So
    only neighbours meet, however many rows there are and wherever they lie. Rows without a place meet nothing.
    """
    reach = max_km / 6371.0  # radians
    height = math.degrees(reach) * 1.001

    def columns(row: Column) -> Column:
        """Columns of a row, from how far in longitude max_km reaches at its side next to the pole."""
        side = F.radians(F.least(F.lit(90.0), F.greatest(F.abs(row * height), F.abs((row + 1) * height))))
        wide = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(reach, math.pi / 2)) / F.greatest(F.cos(side), F.lit(1e-12)))))
        return F.when(side + reach >= math.pi / 2, 1).otherwise(F.greatest(F.lit(1), F.floor(360.0 / (wide * 1.001)))).cast("int")

    def column(row: Column) -> Column:
        return F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / (360.0 / columns(row))).cast("int")

    row = F.floor(F.col("lat") / height).cast("int")
    a = assets.where("lat is not null and lon is not null").select(F.col("site").alias("asset"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), row.alias("r"), column(row).alias("c"))
    around = F.array_distinct(F.array(*[F.struct((row + i).alias("r"), F.pmod(column(row + i) + j, columns(row + i)).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = points.where("lat is not null and lon is not null").select("site", "lat", "lon", F.explode(around).alias("x")).select("site", "lat", "lon", "x.r", "x.c")
    j = p.join(a.hint("merge"), ["r", "c"])
    j = j.where("asset <> site") if same else j
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"))
    return j.withColumn("km", km).where(F.col("km") <= max_km).select("site", "asset", "km")


def nearest_within(points: DataFrame, assets: DataFrame, max_km: float, same: bool = False) -> DataFrame:
    """(site, asset, km): the nearest asset of each point within max_km, the least id of equally near ones; as pairs_within()."""
    j = pairs_within(points, assets, max_km, same)
    return j.groupBy("site").agg(F.min_by("asset", F.struct("km", "asset")).alias("asset"), F.round(F.min("km"), 3).alias("km"))


def separation_flag(points: DataFrame, emitters: DataFrame, same: bool = False) -> DataFrame:
    """(site, km, flag) of every point: nearest emitter under 30 km is a hard exclusion, under 60 km a warning; km is null beyond."""
    near = nearest_within(points, emitters, 60.0, same).select(F.col("site").alias("_s"), "km")
    j = points.select("site").join(near.hint("merge"), F.col("site") == F.col("_s"), "left")
    return j.select("site", "km", F.when(F.col("km") < 30, "HARD_EXCLUDE").when(F.col("km") < 60, "WARN_CLOSE").otherwise("OK").alias("flag"))


def near_counts(plants: DataFrame, events: DataFrame, radii: tuple[int, ...] = (5, 10, 20), same: bool = False) -> DataFrame:
    """(site, n_R for each radius) of every plant: events within each radius in km."""
    j = pairs_within(plants, events, float(max(radii)), same)
    g = j.groupBy(F.col("site").alias("_s")).agg(*[F.count_if(F.col("km") <= r).alias(f"n_{r}") for r in radii])
    out = plants.select("site").join(g.hint("merge"), F.col("site") == F.col("_s"), "left").drop("_s")
    return out.fillna(0, [f"n_{r}" for r in radii])


def financed_emissions(exposures: DataFrame, issuers: DataFrame, price: float = 65.0) -> DataFrame:
    """Attribution of issuer emissions to each (bank, ticker) by exposure over debt; debts unknown count as attribution 1."""
    e = exposures.groupBy("bank", "ticker").agg(F.sum("exposure").alias("exposure"))
    j = e.join(issuers.hint("merge"), "ticker")
    share = F.coalesce(F.col("exposure") / F.col("debt"), F.lit(1.0))
    return j.select("bank", "ticker", F.round("exposure", 2).alias("exposure"), F.round(share, 6).alias("share"), F.round(share * F.col("t_co2e"), 2).alias("financed_t"), F.round(share * F.col("t_co2e") * price, 0).alias("eur"))


def bank_summary(financed: DataFrame) -> DataFrame:
    """Sums of the rounded rows of each bank, and the grand total under a null bank."""
    return financed.rollup("bank").agg(F.round(F.sum("financed_t"), 2).alias("financed_t"), F.round(F.sum("eur"), 0).alias("eur"), F.round(F.sum("exposure"), 2).alias("exposure"), F.count("*").alias("n_issuers"))
