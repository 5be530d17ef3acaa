"""Calibration, the production rule, site risk and annualisation over scene scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.functions import scalars as S
from plumeledger.functions.running import order_statistics, running_totals

CLASSES = ["CFAR_SUPPRESSED", "DETECTION", "NOT_OK", "NO_COVERAGE", "SUB_TAU"]


def conformal_threshold(df: DataFrame, alphas: list[float], score: str = "sc_cfar") -> DataFrame:
    """(alpha, n, tau): the order statistic min(ceil((n + 1)(1 - alpha)), n) of the scores.

    Equal scores are counted first, so the ranking runs over distinct scores, by ranges of like numbers of them; nulls are left out.
    """
    c = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"))
    ranked = running_totals(c, "s", ["c"], descending=False).select("s", F.col("upto_c").alias("upto"))
    n = c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    a = df.sparkSession.createDataFrame([(x,) for x in alphas], "alpha double")
    want = a.crossJoin(F.broadcast(n)).withColumn("rank", F.least(F.ceil((F.col("n") + 1) * (1 - F.col("alpha"))), F.col("n")))  # one row
    got = ranked.join(F.broadcast(want), F.col("upto") >= F.col("rank"))  # a row an alpha
    return got.groupBy("alpha", "n").agg(F.min("s").alias("tau"))


def mondrian_threshold(df: DataFrame, by: str, alpha: float = 0.1, score: str = "sc_cfar") -> DataFrame:
    """Threshold of each group by its own order statistic, with number, range and mean; small_n marks groups of fewer than five. Scores are ranked by ranges, so a hot group is no window of one task. Null scores are left out; null groups are a group."""
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("mean"))
    tau = order_statistics(df, score, {"tau": f"least(ceil((n + 1) * {1 - alpha!r}D), n)"}, by)
    g = tau.join(g.hint("merge"), F.col(by).eqNullSafe(F.col("_by"))).select(by, "n", "tau", "lo", "hi", "mean")
    return g.withColumn("small_n", F.col("n") < 5)


def production_rule(df: DataFrame, tau: DataFrame) -> DataFrame:
    """df with class; tau is a table of one row with column tau. A score equal to tau is not above it."""
    c = F.when(F.col("status") != "ok", "NOT_OK").when(F.col("sc_cfar").isNull(), "NO_COVERAGE").when(F.col("sc_cfar") <= F.col("tau"), "SUB_TAU")
    return df.crossJoin(F.broadcast(tau.select("tau"))).withColumn("class", c.when(F.col("cfar_detect"), "DETECTION").otherwise("CFAR_SUPPRESSED"))


def rule_audit(classified: DataFrame) -> DataFrame:
    """Rows of each class by site, and all of them; null sites are a site."""
    g = classified.groupBy("site").agg(*[F.sum((F.col("class") == c).cast("long")).alias(c.lower()) for c in CLASSES], F.count("*").alias("total"))
    return g


def empirical_fpr(df: DataFrame, taus: DataFrame) -> DataFrame:
    """Share of scores above each threshold (alpha, tau), and above 1.15; null scores are left out, without scores there are no rows."""
    x = df.where("sc_cfar is not null").crossJoin(F.broadcast(taus.select("alpha", "tau")))  # a row an alpha
    return x.groupBy("alpha").agg(F.avg((F.col("sc_cfar") > F.col("tau")).cast("double")).alias("fpr"), F.avg((F.col("sc_cfar") > 1.15).cast("double")).alias("fpr_classic"))


def site_risk(df: DataFrame, quantified: DataFrame | None = None, dual: DataFrame | None = None, bad: str = "false") -> DataFrame:
    """Detection statistics, interval, flow, annual tonnes and liability with bounds, and tier of each site; rounding in the stated order.

    quantified: (site, flow) of quantified plumes, whose mean comes before the estimate from the mean score; dual: (site, score) of the
    second sensor, by which MEDIUM becomes HIGH_DUAL_SENSOR from 0.5 on; bad: a condition on scenes that are not valid.
    Several rows of a site in these tables are averaged. Bounds are those of the rate, less and plus 30 %. A site without
    valid scenes has rate and bounds 0.
    """
    bad_scene = F.coalesce(F.expr(bad), F.lit(False))
    ok = (F.col("status") == "ok") & F.col("sc_cfar").isNotNull() & ~bad_scene
    hit = ok & (F.col("sc_cfar") > 1.15)
    g = df.groupBy("site").agg(F.count_if(ok).alias("n_valid"), F.count_if(hit).alias("n_detect"), F.round(F.avg(F.when(hit, F.col("sc_cfar"))), 3).alias("mean_sc"))
    for table, value, name in ((quantified, "flow", "_flow"), (dual, "score", "_score")):
        if table is None:
            g = g.withColumn(name, F.lit(None).cast("double"))
        else:
            t = table.groupBy(F.col("site").alias("_of")).agg(F.avg(value).alias(name))
            g = g.join(t.hint("merge"), F.col("site").eqNullSafe(F.col("_of")), "left").drop("_of")
    lo, hi = S.wilson(F.col("n_detect"), F.col("n_valid"))
    g = g.withColumn("p", F.round(F.when(F.col("n_valid") > 0, F.col("n_detect") / F.col("n_valid")).otherwise(0.0), 4)).withColumn("p_lo", F.round(lo, 4)).withColumn("p_hi", F.round(hi, 4))
    estimate = F.floor(F.greatest(F.lit(0.0), F.coalesce("mean_sc", F.lit(1.0)) - 1) * 25 * 10 + 0.5) / 10  # one place, half up on the scaled double
    g = g.withColumn("flow", F.coalesce("_flow", estimate)).withColumn("flow_source", F.when(F.col("_flow").isNotNull(), "quantified").otherwise("estimated"))
    tonnes = lambda p, k: F.round(F.col(p) * F.col("flow") * k * 8760 * 0.85 * 29.8 / 1000, 1)
    g = g.withColumns({"t_co2e": tonnes("p", 1.0), "t_lo": tonnes("p_lo", 0.7), "t_hi": tonnes("p_hi", 1.3)})
    g = g.withColumns({e: F.round(F.col(t) * 65, 0) for e, t in (("eur", "t_co2e"), ("eur_lo", "t_lo"), ("eur_hi", "t_hi"))})
    tier = S.risk_tier(F.col("n_valid"), F.col("p"))
    return g.withColumn("tier", F.when((tier == "MEDIUM") & (F.col("_score") >= 0.5), "HIGH_DUAL_SENSOR").otherwise(tier)).drop("_flow", "_score")


def annualise(df: DataFrame, floor: float = 300.0) -> DataFrame:
    """Upper, floor-imputed and lower annual figures from monthly flows (grain here: day of observation)."""
    hit = (F.col("status") == "ok") & F.col("cfar_detect")
    m = df.groupBy("site", "acq_date").agg(F.max(F.when(hit, F.col("sc_cfar") * 100)).alias("q"))
    g = m.groupBy("site").agg(F.count("*").alias("n_obs"), F.count("q").alias("n_det"), F.avg("q").alias("mean_q"), F.percentile("q", F.lit(0.5)).alias("median_q"), F.avg(F.coalesce("q", F.lit(floor))).alias("imputed_q"), F.avg(F.coalesce("q", F.lit(0.0))).alias("lower_q"))
    return g.select("site", "n_obs", "n_det", *[F.round(c, 4).alias(c) for c in ("mean_q", "median_q", "imputed_q", "lower_q")])


def describe(df: DataFrame, by: str, x: str) -> DataFrame:
    """Number, mean, deviation, range and quartiles (inclusive, linear) of each group; groups without values have n 0 and nulls. Quartiles are ranked by ranges, so a hot group is no burden to one task."""
    g = df.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    places = {name: f"1 + (n - 1) * {q}D" for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))}
    q = order_statistics(df, x, places, by).drop("n").withColumnRenamed(by, "_of")
    j = g.join(q.hint("merge"), g[by].eqNullSafe(F.col("_of")), "left")
    return j.select(by, "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd", "p25", "p75", "lo", "hi")])


def loo_scene(df: DataFrame) -> DataFrame:
    """Rate and mean without each detection, algebraically; a row a detection."""
    w = W.partitionBy("site")
    hit = F.col("cfar_detect")
    x = df.withColumn("n", F.count("*").over(w)).withColumn("k", F.sum(hit.cast("long")).over(w)).withColumn("s", F.sum(F.when(hit, F.col("sc_cfar"))).over(w))
    x = x.where(hit & (F.col("k") > 1))
    return x.select("event_id", "site", F.round((F.col("k") - 1) / (F.col("n") - 1), 6).alias("rate"), F.round((F.col("s") - F.col("sc_cfar")) / (F.col("k") - 1), 4).alias("mean"))


def best_scene(df: DataFrame, n: int = 1, ceiling: int | None = None, grain: str = "day") -> DataFrame:
    """The n scenes of least cloud of each site and day, month or year (grain); null and zero cloud rank as 99, ties go to the earlier day, then to the least event_id."""
    d = df if ceiling is None else df.where(F.col("cloud") <= ceiling)
    w = W.partitionBy("site", F.date_trunc(grain, "acq_date")).orderBy(F.coalesce(F.nullif("cloud", F.lit(0)), F.lit(99)), "acq_date", "event_id")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def best_overpass(df: DataFrame) -> DataFrame:
    """The greatest score of each site and day and its event; of equal scores the greatest event_id. A day without scores has nulls."""
    return df.groupBy("site", "acq_date").agg(F.max("sc_cfar").alias("best"), F.max_by("event_id", F.struct("sc_cfar", "event_id")).alias("event_id"))
