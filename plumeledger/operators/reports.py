"""Owners of assets, uncertainty written back to its records, summaries and rankings for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.functions.running import running_totals


def resolve_entity(assets: DataFrame, entities: DataFrame) -> DataFrame:
    """assets with subsidiary, operator, ticker, exchange of their owner, a row for each asset.

    entities: owner, operator, ticker, exchange; owners are compared without case and outer blanks. Of several rows of an owner the
    least by (operator, ticker, exchange) counts. A null or blank owner is the subsidiary 'Unknown'; an owner that entities lack keeps its name and
    has the operator 'Unknown', without ticker and exchange.
    """
    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    e = entities.select(key(F.col("owner")).alias("_owner"), F.struct("operator", "ticker", "exchange").alias("e")).where("_owner is not null")
    e = e.groupBy("_owner").agg(F.min("e").alias("_e"))
    j = assets.join(e.hint("merge"), key(assets["owner"]) == F.col("_owner"), "left")
    name = F.coalesce(F.nullif(F.trim(assets["owner"]), F.lit("")), F.lit("Unknown"))
    return j.select(*[assets[f"`{c}`"] for c in assets.columns], name.alias("subsidiary"), F.coalesce("_e.operator", F.lit("Unknown")).alias("operator"), F.col("_e.ticker").alias("ticker"), F.col("_e.exchange").alias("exchange"))


def write_back_uncertainty(records: DataFrame, results: DataFrame, names: list[str]) -> DataFrame:
    """records with uncertainty, a struct of the named columns of the result of their scene_id.

    Only results of status 'ok' count; of several of a scene the greatest by (seq, names). Records without one keep the
    struct they have, else null; a null scene_id has none.
    """
    r = results.where("status = 'ok' and scene_id is not null").groupBy(F.col("scene_id").alias("_scene")).agg(F.max(F.struct("seq", *names)).alias("_r"))
    got = F.when(F.col("_scene").isNotNull(), F.struct(*[F.col(f"_r.{n}").alias(n) for n in names]))
    old = [F.col("uncertainty")] if "uncertainty" in records.columns else []
    j = records.join(r.hint("merge"), records["scene_id"] == F.col("_scene"), "left")
    return j.select(*[records[f"`{c}`"] for c in records.columns if c != "uncertainty"], F.coalesce(got, *old).alias("uncertainty"))


def site_summary(scores: DataFrame, tau: float | Column, inventory: DataFrame, plumes: DataFrame, uniform: str = "false") -> DataFrame:
    """A row for each site of scores: acquisitions by fate, months, co-detected months, mean enhancement of what passes, inventory by year.

    A scene is processed if its status is 'ok', and valid unless `uniform` holds; detected, above tau and cfar_pass (both) are counted
    among valid ones. inventory: site, year, quantity; plumes: site, date. Years whose total is not above 0 go. Null scores are not above tau.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    done = yes(F.col("status") == "ok")
    same = yes(F.expr(uniform))
    valid, month = done & ~same, F.trunc("acq_date", "month")
    hit, above = valid & yes(F.col("cfar_detect")), valid & yes(F.col("sc_cfar") > tau)
    g = scores.groupBy("site").agg(
        F.count_if(done).alias("processed"), F.count_if(done & same).alias("uniform_excluded"), F.count_if(valid).alias("valid"),
        F.count_if(hit).alias("detected"), F.count_if(above).alias("above_tau"), F.count_if(above & hit).alias("cfar_pass"),
        F.collect_set(F.when(valid, month)).alias("_seen"), F.collect_set(F.when(hit, month)).alias("_hit"),  # months: a bounded set
        F.round(F.avg(F.when(above & hit, F.col("sc_cfar"))), 4).alias("mean_enhancement"),
    )
    p = plumes.groupBy(F.col("site").alias("_p")).agg(F.collect_set(F.trunc("date", "month")).alias("_plumes"))
    y = inventory.groupBy("site", "year").agg(F.round(F.sum("quantity"), 2).alias("total")).where("total > 0")
    y = y.groupBy(F.col("site").alias("_y")).agg(F.sort_array(F.collect_list(F.struct("year", "total"))).alias("_years"))
    j = g.join(p.hint("merge"), F.col("site") == F.col("_p"), "left").join(y.hint("merge"), F.col("site") == F.col("_y"), "left")
    size = lambda c: F.size(c).cast("long")
    both = F.array_intersect("_hit", F.coalesce("_plumes", F.array().cast("array<date>")))
    rate = F.when(F.size("_seen") > 0, F.round(F.size("_hit") / F.size("_seen"), 4)).otherwise(0.0)
    years = F.coalesce("_years", F.array().cast(y.schema["_years"].dataType))
    return j.select("site", "processed", "uniform_excluded", "valid", "detected", "above_tau", "cfar_pass", size("_seen").alias("observed_months"), size("_hit").alias("detection_months"),
                    rate.alias("detection_rate"), size(both).alias("co_detected_months"), "mean_enhancement", years.alias("inventory_by_year"))


def recovery_ratio(records: DataFrame, inventory: DataFrame, tau: float | Column, z: float = 1.96) -> DataFrame:
    """A row for each site: records, valid ones, those above tau that the detector confirms, their mean flow, tonnes a year, and that as a percentage of the inventory, with an interval.

    records: site, status, sc_cfar, cfar_detect, flow (kg/h); a record is valid if its status is 'ok', and its flow counts if above 0. inventory: site, quantity (t a
    year, summed). The interval is z standard errors of the mean flow, not below 0, and null for fewer than two flows; the ratio is null where the inventory has
    nothing above 0.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    valid = yes(F.col("status") == "ok")
    hit = valid & yes(F.col("sc_cfar") > tau) & yes(F.col("cfar_detect"))
    flow = F.when(hit & (F.col("flow") > 0), F.col("flow"))
    g = records.groupBy("site").agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_if(hit).alias("n_hit"), F.count(flow).alias("n_flow"), F.avg(flow).alias("_m"), F.stddev_samp(flow).alias("_sd"))
    i = inventory.groupBy(F.col("site").alias("_i")).agg(F.sum("quantity").alias("_q")).where("_q > 0")
    j = g.join(i.hint("merge"), F.col("site") == F.col("_i"), "left")
    t = lambda q: q * 8760 / 1000
    half = F.when(F.col("n_flow") > 1, z * F.col("_sd") / F.sqrt("n_flow"))
    pct = lambda q: F.round(100 * t(q) / F.col("_q"), 2)
    return j.select("site", "n", "n_valid", "n_hit", "n_flow", F.round("_m", 2).alias("mean_flow"), F.round(t(F.col("_m")), 2).alias("annual_t"), pct(F.col("_m")).alias("ratio_pct"),
                    F.when(half.isNotNull(), pct(F.greatest(F.lit(0.0), F.col("_m") - half))).alias("ratio_lo"), pct(F.col("_m") + half).alias("ratio_hi"))


def dataset_profile(df: DataFrame, box: tuple[float, float, float, float], country: str, kind: str, top: int = 20) -> DataFrame:
    """(section, value, n): all rows, rows within the box (south, west, north, east), the `top` countries and all source types by number. Null values are 'unknown'; ties by value."""
    south, west, north, east = box
    inside = F.coalesce(F.col("lat").between(south, north) & F.col("lon").between(west, east), F.lit(False))
    whole = df.agg(F.count("*").alias("rows"), F.count_if(inside).alias("in_box"))
    whole = whole.select(F.inline(F.array(*[F.struct(F.lit("size").alias("section"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in ("rows", "in_box")])))
    by = lambda c, s: df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")).count().select(F.lit(s).alias("section"), "value", F.col("count").alias("n"))
    return whole.unionAll(by(country, "country").orderBy(F.desc("n"), "value").limit(top)).unionAll(by(kind, "kind"))


def ranked(df: DataFrame, value: str, absolute: bool = False) -> DataFrame:
    """df with rank: 1 more than the rows of greater value (of greater absolute value on demand), in descending order; null values have no rank and come last.

    Values are counted and their counts summed by ranges, so no task holds all rows.
    """
    v = (F.abs(F.col(value)) if absolute else F.col(value)).cast("double")
    c = df.where(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count("*").alias("_c"))
    r = running_totals(c, "_v", ["_c"]).select("_v", (F.col("upto__c") - F.col("_c") + 1).alias("rank"))
    return df.join(r.hint("merge"), v == F.col("_v"), "left").select(*[df[f"`{x}`"] for x in df.columns], "rank").orderBy(F.col("rank").asc_nulls_last())
