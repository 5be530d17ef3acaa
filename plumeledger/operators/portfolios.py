"""Governance of quantified records, portfolios by ticker, flows against several inventories, months of several sensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeledger.functions import hazard as H
from plumeledger.operators.summaries import TIERS

# What a flag adds to an uncertainty, in points of per cent, and the uncertainties without a record.
WIND_FALLBACK, WIND_STALE, NO_REFERENCE, LOW_SUN = 30.0, 10.0, 15.0, 5.0
DEFAULTS = {"sigma_wind": 20.0, "sigma_coeff": 15.0, "sigma_mask": 0.0, "sigma_background": 0.0}
CLOUDY = ("high_cloud", "partly_cloudy", "cloudy")


def degradation(df: DataFrame) -> DataFrame:
    """df with input_degradation, a struct of flags (array), any_degradation and the points added to wind, mask and coefficient, and exclude_from_aggregates.

    df: wind_source, era5_offset_h, bitemporal_missing, cloud, cloud_quality, solar_zenith. Unknown values raise no flag. Of a fallback and a
    stale wind the greater addition counts; cloud by number or by label keeps a record out of aggregates.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    fallback = known(F.lower("wind_source").rlike("fallback|climatological"))
    stale = known(F.abs("era5_offset_h") > 4)
    missing = known(F.col("bitemporal_missing"))
    cloudy = known(F.col("cloud") > 15) | known(F.col("cloud_quality").isin(*CLOUDY))
    low_sun = known(F.col("solar_zenith") > 70)
    marks = {"WIND_FALLBACK": fallback, "BITEMPORAL_MISSING": missing, "CLOUD_FRACTION_HIGH": cloudy, "SOLAR_ZENITH_EXTREME": low_sun, "ERA5_STALE": stale}
    flags = F.filter(F.array(*[F.when(c, k) for k, c in marks.items()]), lambda x: x.isNotNull())
    points = lambda c, p: F.when(c, p).otherwise(0.0)
    block = F.struct(
        flags.alias("flags"), reduce(lambda a, b: a | b, marks.values()).alias("any_degradation"), F.greatest(points(fallback, WIND_FALLBACK), points(stale, WIND_STALE)).alias("delta_sigma_wind_pp"),
        points(missing, NO_REFERENCE).alias("delta_sigma_mask_pp"), points(low_sun, LOW_SUN).alias("delta_sigma_coeff_pp"),
    )
    return df.withColumns({"input_degradation": block, "exclude_from_aggregates": cloudy})


def inflated(df: DataFrame, n: int = 10_000) -> DataFrame:
    """degradation() rows with governance_sigma_inflated and governance_inflated, a struct of the effective uncertainties and what n draws make of them.

    df also has sigma_wind, sigma_coeff, sigma_mask, sigma_background in per cent (unknown ones: the defaults; NaN counts as 0) and flow.
    The struct is null without a flag. mc_pct and quad_pct are the combined uncertainty by draws and by the root of the sum of squares; p5 and p95
    the draws' percentiles over the flow, lo and hi these times a flow above 0, else null. Draws depend on their number alone, so
    records of equal uncertainties have equal figures: they are drawn once for each distinct set of four (a state holds
    n numbers), and joined back by a sorted merge, whose hot keys adaptive execution splits.
    """
    d, names = F.col("input_degradation"), list(DEFAULTS)
    added = {"sigma_wind": d["delta_sigma_wind_pp"], "sigma_coeff": d["delta_sigma_coeff_pp"], "sigma_mask": d["delta_sigma_mask_pp"], "sigma_background": F.lit(0.0)}
    flagged = d["any_degradation"]
    x = df.withColumns({f"_e{i}": F.when(flagged, F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(DEFAULTS[c])), F.lit(0.0)) + added[c]) for i, c in enumerate(names)})
    keys = [f"_e{i}" for i in range(4)]
    sets = x.where(flagged).select(*keys).distinct()
    draws = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    factor = F.lit(1.0)
    for k, c in enumerate(keys):
        factor = factor * F.greatest(F.lit(0.01), 1 + F.col(c) / 100 * H.normal_point(H.uniform(F.col("i"), F.lit(k))))
    p = lambda q: F.percentile("f", F.lit(q))
    g = draws.withColumn("f", factor).groupBy(*keys).agg(F.avg("f").alias("m"), F.stddev_samp("f").alias("s"), p(0.05).alias("p5"), p(0.95).alias("p95"))
    g = g.select(*[F.col(k).alias(f"k{k}") for k in keys], F.round(100 * F.col("s") / F.col("m"), 1).alias("_mc"), F.round("p5", 4).alias("_p5"), F.round("p95", 4).alias("_p95"))
    j = x.join(g.hint("merge"), reduce(lambda a, b: a & b, [F.col(k) == F.col(f"k{k}") for k in keys]), "left")
    flow = lambda c: F.when(F.col("flow") > 0, F.round(F.col("flow") * F.col(c), 2))
    block = F.struct(
        *[F.round(k, 1).alias(f"effective_{c}") for k, c in zip(keys, names)], F.col("_mc").alias("mc_pct"), F.round(100 * H.quadrature(*[F.col(k) / 100 for k in keys]), 1).alias("quad_pct"),
        F.col("_p5").alias("p5"), F.col("_p95").alias("p95"), flow("_p5").alias("lo"), flow("_p95").alias("hi"),
    )
    out = j.withColumns({"governance_sigma_inflated": flagged, "governance_inflated": F.when(flagged, block)})
    return out.drop(*keys, *[f"k{k}" for k in keys], "_mc", "_p5", "_p95")


_SUMS = {"t_co2e": 1, "t_lo": 1, "t_hi": 1, "eur": 0, "eur_lo": 0, "eur_hi": 0}


def portfolio_members(tickers: DataFrame, sites: DataFrame, risk: DataFrame) -> DataFrame:
    """A row a requested ticker and site of it (ticker, site, tier, n_valid, p and the sums' columns of site_risk()); a ticker without sites has one row of nulls.

    Tickers and sites count once however often they are listed; null ones are left out. A site without risk is NO_DATA with nulls.
    """
    t = tickers.where("ticker is not null").select("ticker").distinct()
    m = sites.where("ticker is not null and site is not null").select(F.col("ticker").alias("_t"), "site").distinct()
    r = risk.select(F.col("site").alias("_s"), "tier", "n_valid", "p", *_SUMS)
    j = t.join(m.hint("merge"), F.col("ticker") == F.col("_t"), "left").join(r.hint("merge"), F.col("site") == F.col("_s"), "left")
    tier = F.when(F.col("site").isNotNull(), F.coalesce("tier", F.lit("NO_DATA")))
    return j.select("ticker", "site", tier.alias("tier"), "n_valid", "p", *_SUMS)


def portfolio_by_ticker(members: DataFrame, nested: bool = False) -> DataFrame:
    """(ticker, n_sites, sums, tier, matched): portfolio_members() by ticker, unknown figures as 0, with the worst tier of its sites; unmatched tickers have no tier.

    nested adds sites, the ticker's rows as an array ordered by site: for tickers of some thousand sites, as one row holds them all;
    members are the same as a table.
    """
    rank = F.when(F.col("site").isNotNull(), F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")))
    more = [F.array_sort(F.collect_list(F.when(F.col("site").isNotNull(), F.struct("site", "tier", "n_valid", "p", *_SUMS)))).alias("sites")] if nested else []
    g = members.groupBy("ticker").agg(F.count("site").alias("n_sites"), *[F.round(F.sum(F.coalesce(c, F.lit(0.0))), p).alias(c) for c, p in _SUMS.items()], F.min(rank).cast("int").alias("_rank"), *more)
    tier = F.when(F.col("_rank").isNotNull(), F.element_at(F.array(*map(F.lit, TIERS)), F.col("_rank")))
    return g.withColumn("tier", tier).withColumn("matched", F.col("n_sites") > 0).drop("_rank")


def portfolio_total(by_ticker: DataFrame) -> DataFrame:
    """One row: n_tickers, n_unmatched, coverage_pct (matched tickers, 0 without any), and total tonnes and EUR with bounds."""
    matched = F.count_if("matched")
    share = F.round(F.coalesce(F.try_divide(100 * matched, F.count("*")), F.lit(0.0)), 1)
    return by_ticker.agg(F.count("*").alias("n_tickers"), F.count_if(~F.col("matched")).alias("n_unmatched"), share.alias("coverage_pct"), *[F.round(F.coalesce(F.sum(c), F.lit(0.0)), p).alias(c) for c, p in _SUMS.items()])


def flow_against_inventory(monthly: DataFrame, inventory: DataFrame, half: float = 0.3) -> DataFrame:
    """monthly (site, month, flow in kg an hour) with tonnes, low, high, and for each inventory that knows the month its tonnes, the ratio to it and whether it lies between low and high.

    inventory: name, site, month, tonnes; of several rows of one name, site and month the sum counts. Months that no inventory knows stay with nulls;
    months are first days. A null flow has null tonnes.
    """
    days = F.dayofmonth(F.last_day("month"))
    t = monthly.select("site", F.trunc("month", "month").alias("month"), (F.col("flow") * 24 * days / 1000).alias("tonnes"))
    i = inventory.groupBy("name", F.col("site").alias("_site"), F.trunc("month", "month").alias("_month")).agg(F.sum("tonnes").alias("inventory"))
    j = t.join(i.hint("merge"), (F.col("site") == F.col("_site")) & (F.col("month") == F.col("_month")), "left")
    lo, hi = F.col("tonnes") * (1 - half), F.col("tonnes") * (1 + half)
    return j.select("site", "month", "name", "tonnes", lo.alias("low"), hi.alias("high"), "inventory", F.try_divide("tonnes", "inventory").alias("ratio"), F.col("inventory").between(lo, hi).alias("within"))


def co_detected_months(*sources: DataFrame) -> DataFrame:
    """(site, month) in which every source (site, day) has a row; any number of sources. One shuffle: each source is first reduced to its months."""
    m = [s.where("site is not null and day is not null").select("site", F.trunc("day", "month").alias("month"), F.lit(i).alias("source")).distinct() for i, s in enumerate(sources)]
    g = reduce(DataFrame.unionByName, m).groupBy("site", "month").agg(F.count("*").alias("n"))
    return g.where(F.col("n") == len(sources)).drop("n")
