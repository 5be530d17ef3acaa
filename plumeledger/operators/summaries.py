"""Summaries by site, ticker, month and class over scene records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeledger.functions.running import order_statistics
from plumeledger.operators.detection import site_risk

TIERS = ["HIGH_DUAL_SENSOR", "HIGH", "MEDIUM", "LOW", "UNDETECTED", "NO_DATA"]


def portfolio_risk(scores: DataFrame, sites: DataFrame, quantified: DataFrame | None = None, dual: DataFrame | None = None) -> DataFrame:
    """(ticker, n_sites, n_covered, eur, t_co2e, tier, coverage_pct): sums over a ticker's sites, unknown ones as 0, and its worst tier. quantified and dual as in site_risk()."""
    risk = site_risk(scores, quantified, dual).select(F.col("site").alias("_site"), "eur", "t_co2e", "tier", "n_valid")
    j = sites.select("ticker", "site").join(risk.hint("merge"), F.col("site") == F.col("_site"), "left")
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.coalesce("tier", F.lit("NO_DATA")))
    g = j.groupBy("ticker").agg(
        F.count("*").alias("n_sites"), F.count("_site").alias("n_covered"), F.round(F.sum(F.coalesce("eur", F.lit(0.0))), 0).alias("eur"),
        F.round(F.sum(F.coalesce("t_co2e", F.lit(0.0))), 1).alias("t_co2e"), F.min(rank).cast("int").alias("rank"),
    )
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("rank"))
    return g.select("ticker", "n_sites", "n_covered", "eur", "t_co2e", tier.alias("tier"), F.round(100 * F.col("n_covered") / F.col("n_sites"), 2).alias("coverage_pct"))


def annualise_qc(df: DataFrame) -> DataFrame:
    """(site, n_months, mean_q): the greatest flow q of each month, of rows without reason, averaged."""
    m = df.where("reason is null").groupBy("site", F.trunc("acq_date", "month").alias("month")).agg(F.max("q").alias("q"))
    return m.groupBy("site").agg(F.count("q").alias("n_months"), F.round(F.avg("q"), 4).alias("mean_q"))


def site_by_month(df: DataFrame, months: list[int]) -> DataFrame:
    """A row a site: for each of the months the greatest ratio (max_<m>) and whether anything was detected (any_<m>)."""
    at = F.month("acq_date")
    best = [F.round(F.max(F.when(at == m, F.col("sc_cfar"))), 4).alias(f"max_{m}") for m in months]
    found = [F.coalesce(F.bool_or(F.when(at == m, F.col("cfar_detect"))), F.lit(False)).alias(f"any_{m}") for m in months]
    return df.groupBy("site").agg(*best, *found)


def release_errors(df: DataFrame) -> DataFrame:
    """(regime, n, rmse, bias, mae, rate) of estimates against truth, by regime and over all (regime null)."""
    e = F.col("estimate") - F.col("truth")
    return df.rollup("regime").agg(
        F.count(e).alias("n"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(e), 4).alias("bias"), F.round(F.avg(F.abs(e)), 4).alias("mae"),
        F.round(F.avg(F.col("detected").cast("double")), 6).alias("rate"),
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """(label, split, n, share) for every combination and all totals; n of the whole is the greatest."""
    c = df.cube("label", "split").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return c.crossJoin(F.broadcast(total)).select("label", "split", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))  # one row


def best_per_site(df: DataFrame, ceiling: float = 1.15) -> DataFrame:
    """One row a site, one with a score before one without, then the first seen (least event_id); only ratios below the ceiling stay."""
    first = F.min_by(F.struct("event_id", "sc_cfar"), F.struct(F.col("sc_cfar").isNull(), F.col("event_id"))).alias("r")
    return df.groupBy("site").agg(first).select("site", "r.event_id", "r.sc_cfar").where(F.col("sc_cfar") < ceiling)


def calibration_health(df: DataFrame) -> DataFrame:
    """(status, n, n_valid, n_null) of the stored scores."""
    return df.groupBy("status").agg(F.count("*").alias("n"), F.count("sc_cfar").alias("n_valid"), F.count_if(F.col("sc_cfar").isNull()).alias("n_null"))


def threshold_sensitivity(df: DataFrame, steps: list[float], base: float = 1.15) -> DataFrame:
    """(step, n, change_pct): detections above base + step, and their change against base; one pass over the data."""
    counts = df.agg(*[F.count_if(F.col("sc_cfar") > base + s).alias(str(i)) for i, s in enumerate([0.0, *steps])])
    rows = F.array(*[F.struct(F.lit(float(s)).alias("step"), F.col(str(i + 1)).alias("n")) for i, s in enumerate(steps)])
    r = counts.select(F.col("0").alias("base"), F.explode(rows).alias("r")).select("base", "r.step", "r.n")
    return r.select("step", "n", F.round(100 * F.try_divide(F.col("n") - F.col("base"), F.col("base")), 4).alias("change_pct"))


def loo_month(df: DataFrame) -> DataFrame:
    """(site, month, rate, mean) without each month: share of the other months detected, and the mean of their maxima."""
    m = df.groupBy("site", F.trunc("acq_date", "month").alias("month")).agg(F.max(F.when(F.col("cfar_detect"), F.col("sc_cfar"))).alias("q"))
    g = m.groupBy(F.col("site").alias("_site")).agg(F.count("*").alias("n"), F.count("q").alias("k"), F.sum("q").alias("s"))
    j = m.join(g.hint("merge"), F.col("site") == F.col("_site"))
    k, s = F.col("k") - F.col("q").isNotNull().cast("int"), F.coalesce("s", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))
    return j.select("site", "month", F.round(F.try_divide(k, F.col("n") - 1), 6).alias("rate"), F.round(F.try_divide(s, k), 4).alias("mean"))


def flow_outliers(df: DataFrame, times: float = 2.5) -> DataFrame:
    """(event_id, site, sc_cfar): rows above so many times their site's median, which is ranked by ranges and joined back, not windowed."""
    mid = order_statistics(df, "sc_cfar", {"mid": "(n + 1) / 2.0"}, "site").select(F.col("site").alias("_site"), "mid")
    j = df.join(mid.hint("merge"), F.col("site") == F.col("_site"))
    return j.where(F.col("sc_cfar") > times * F.col("mid")).select("event_id", "site", "sc_cfar")


def sample_size(df: DataFrame, by: str, alphas: list[float]) -> DataFrame:
    """(by, alpha, n, rank, min_n, adequate): whether a group has enough scores for a threshold at alpha."""
    g = df.groupBy(by).agg(F.count("sc_cfar").alias("n")).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    rank = F.least(F.ceil((F.col("n") + 1) * (1 - F.col("alpha"))), F.col("n"))
    least = F.ceil(1 / F.col("alpha") - 1e-9) - 1
    return g.select(by, "alpha", "n", rank.alias("rank"), least.alias("min_n"), (F.col("n") >= least).alias("adequate"))
