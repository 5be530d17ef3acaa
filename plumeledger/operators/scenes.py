"""Product names, catalogue search, scene rules, and joins of scene records with winds, inventories and other records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.functions import scalars as S

BAD_MEAN, BAD_WIDTH = 0.4257, 0.01
FALLBACK_WIND = 3.5


def product_parts(name: Column) -> dict[str, Column]:
    """satellite, level and tile of a product name, from its parts 0, 1 and 5; 'unknown' where a part is missing."""
    parts = F.split(name, "_")
    return {k: F.coalesce(F.get(parts, F.lit(i)), F.lit("unknown")) for k, i in (("satellite", 0), ("level", 1), ("tile", 5))}


def acquisition_date(name: Column) -> Column:
    """The date of the first time stamp, that of the acquisition; null without one."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"_(\d{8})T", 1), F.lit("")), "yyyyMMdd")


def loose_date(text: Column) -> Column:
    """The first YYYY-MM-DD, YYYY_MM_DD or YYYYMMDD of a text; null if there is none or no such day."""
    found = F.regexp_extract(text, r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", 0)
    return F.try_to_date(F.nullif(F.regexp_replace(found, "[-_]", ""), F.lit("")), "yyyyMMdd")


def acquisition_key(name: Column) -> Column:
    """Date of the acquisition and the first 60 characters of the name; the characters alone where there is no date."""
    return F.concat_ws("/", F.date_format(acquisition_date(name), "yyyy-MM-dd"), F.substring(name, 1, 60))


def orbit_start(name: Column) -> Column:
    """Start of an orbit from its product name; null where there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"_(\d{8}T\d{6})", 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))


def is_daytime(start: Column) -> Column:
    """Between 11 and 14 o'clock, the end excluded."""
    return F.hour(start).between(11, 13)


def catalogue_search(products: DataFrame, start: str, end: str, ceiling: float | None, limit: int) -> DataFrame:
    """Products (event_id, acq_date, cloud) of the days from start to end, newest first (ties: least event_id), so many at most; an unknown cloud fails a ceiling."""
    p = products.where(F.col("acq_date").between(start, end))
    p = p if ceiling is None else p.where(F.col("cloud") <= ceiling)
    return p.orderBy(F.col("acq_date").desc(), "event_id").limit(limit)


def is_bad_scene(site_mean: Column) -> Column:
    """Whether a scene's mean is that of a degenerate model output; null is not."""
    return F.coalesce(F.abs(site_mean - BAD_MEAN) < BAD_WIDTH, F.lit(False))


def uniform_field(site_mean: Column, control_mean: Column) -> Column:
    """Whether the site's mean is above 0 and within 1e-4 of the control's; unknown means are not."""
    return F.coalesce((site_mean > 0) & (F.abs(site_mean - control_mean) < 1e-4), F.lit(False))


def partial_swath(site_mean: Column, control_mean: Column, cv: Column, sc: Column, strict: bool = False) -> Column:
    """A flat ratio with no spread, or equal means; both where strict. Unknown values do not count."""
    flat = (F.abs(sc - 1) < 1e-6) & (F.coalesce(F.abs(cv), F.lit(0.0)) < 1e-9)
    equal = F.abs(site_mean - control_mean) < 1e-6
    flat, equal = F.coalesce(flat, F.lit(False)), F.coalesce(equal, F.lit(False))
    return flat & equal if strict else flat | equal


def repair_coverage(df: DataFrame, fields: list[str], least: float = 0.5) -> DataFrame:
    """df (degenerate, valid_frac, status) with status no_coverage and null fields where a degenerate scene has too few valid pixels, or its input is missing."""
    bad = F.col("degenerate") & (F.col("valid_frac").isNull() | (F.col("valid_frac") < least))
    cleared = {c: F.when(~bad, F.col(c)) for c in fields}
    return df.withColumns({**cleared, "status": F.when(bad, "no_coverage").otherwise(F.col("status")), "fixed": bad})


def mask_select(df: DataFrame, registry: DataFrame) -> DataFrame:
    """df (site, has_bitemporal) with mask_source: none where the registry (site, policy) skips, bitemporal where it wants and has it, else original.

    A site that the registry names several times counts once: skip comes before bitemporal, and that before others.
    """
    strength = F.when(F.col("policy") == "skip", 2).when(F.col("policy") == "bitemporal", 1).otherwise(0)
    r = registry.groupBy(F.col("site").alias("_site")).agg(F.max_by("policy", strength).alias("policy"))
    j = df.join(r.hint("shuffle_hash"), F.col("site") == F.col("_site"), "left")
    source = F.when(F.col("policy") == "skip", "none").when((F.col("policy") == "bitemporal") & F.col("has_bitemporal"), "bitemporal").otherwise("original")
    missing = (F.col("policy") == "bitemporal") & ~F.col("has_bitemporal")
    return j.withColumns({"mask_source": source, "bitemporal_missing": F.coalesce(missing, F.lit(False))}).drop("_site", "policy")


def bitemporal_verdict(before: Column, after: Column, emitter: Column, t: float = 1.15) -> Column:
    """What the second mode made of a scene: before and after are its ratios, emitter whether the site emits."""
    b, a = before > t, after > t
    clean = F.when(b & ~a, "fp_suppressed").when(b & a & (after > before), "fp_amplified").when(b & a, "fp_persists").when(a, "fp_amplified").otherwise("clean_negative")
    return F.when(emitter, F.when(a, "detected").otherwise("missed")).otherwise(clean)


def dual_sensor(site_mean: Column, detected: Column, enhancement: Column, t: float = 5.0) -> Column:
    """What both sensors say of a scene; a null enhancement is no detection of the second."""
    other = F.coalesce(enhancement >= t, F.lit(False))
    return F.when(is_bad_scene(site_mean), "bad_scene").when(detected & other, "dual").when(detected, "s2_only").when(other, "tropomi_only").otherwise("none")


def flags_at(score: Column, taus: dict[str, float]) -> dict[str, Column]:
    """A flag for each named threshold; a null score is above none."""
    return {f"above_{k}": F.coalesce(score > v, F.lit(False)) for k, v in taus.items()}


def exclude_sites(risk: DataFrame, excluded: DataFrame, money: list[str]) -> DataFrame:
    """risk with tier EXCLUDED and null money for the sites of excluded (site)."""
    e = excluded.select(F.col("site").alias("_site")).distinct().withColumn("_out", F.lit(True))
    j = risk.join(e.hint("shuffle_hash"), F.col("site") == F.col("_site"), "left")
    return j.withColumns({**{c: F.when(F.col("_out").isNull(), F.col(c)) for c in money}, "tier": F.when(F.col("_out"), "EXCLUDED").otherwise(F.col("tier"))}).drop("_site", "_out")


def search_cascade(df: DataFrame, by: list[str], levels: list[tuple[int, float, bool]]) -> DataFrame:
    """Rows (days_away, cloud, exact_tile) of the first level (days, ceiling, any tile) that any row of their group meets, with the level."""
    level = F.lit(None).cast("int")
    for i, (days, cloud, any_tile) in reversed(list(enumerate(levels))):
        level = F.when((F.col("days_away") <= days) & (F.col("cloud") <= cloud) & (F.lit(any_tile) | F.col("exact_tile")), i).otherwise(level)
    d = df.withColumn("level", level).where("level is not null")
    least = d.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.min("level").alias("_level"))
    on = F.col("level") == F.col("_level")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return d.join(least.hint("merge"), on, "left_semi")


def event_query(events: DataFrame, sites: DataFrame, ticker: str, least: float, start: str, end: str, limit: int = 1000) -> DataFrame:
    """Events of a ticker's sites with a score of `least` or more between two days, newest first, 1000 at most."""
    of = sites.where(F.col("ticker") == ticker).select(F.col("site").alias("_site"))
    j = events.where((F.col("sc_cfar") >= least) & F.col("acq_date").between(start, end)).join(of.hint("shuffle_hash"), F.col("site") == F.col("_site"), "left_semi")
    return j.orderBy(F.col("acq_date").desc(), "event_id").limit(min(limit, 1000))


def month_join(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """df (site, acq_date) with the rows of inventory (site, year, month, value) of its month as a sorted array, empty if there are none."""
    inv = inventory.groupBy(F.col("site").alias("_site"), F.col("year").alias("_y"), F.col("month").alias("_m")).agg(F.array_sort(F.collect_list("value")).alias("values"))
    on = (F.col("site") == F.col("_site")) & (F.year("acq_date") == F.col("_y")) & (F.month("acq_date") == F.col("_m"))
    j = df.join(inv.hint("merge"), on, "left")
    return j.withColumn("values", F.coalesce("values", F.array().cast("array<double>"))).drop("_site", "_y", "_m")


def wind_asof(obs: DataFrame, wind: DataFrame, box: float = 0.25) -> DataFrame:
    """obs (id, at, lat, lon) with the mean wind (at, lat, lon, u, v) of the nearest full hour within the box: speed, direction, source.

    From 30 minutes on the next hour counts, over midnight too. Without wind the speed is 3.5 m/s and the source 'fallback'.
    """
    hour = F.date_trunc("hour", F.col("at") + F.expr("INTERVAL 30 MINUTES"))
    o = obs.select("id", hour.alias("h"), "lat", "lon")
    w = wind.select(F.date_trunc("hour", "at").alias("wh"), F.col("lat").alias("wlat"), F.col("lon").alias("wlon"), "u", "v")
    near = (F.abs(F.col("lat") - F.col("wlat")) <= box) & (F.abs(F.col("lon") - F.col("wlon")) <= box)
    g = o.join(w.hint("merge"), (F.col("h") == F.col("wh")) & near, "left").groupBy("id").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    found = F.col("u").isNotNull()
    return g.select("id", F.when(found, S.wind_speed(F.col("u"), F.col("v"))).otherwise(FALLBACK_WIND).alias("speed"), F.when(found, S.wind_direction(F.col("u"), F.col("v"))).alias("direction"), F.when(found, "era5").otherwise("fallback").alias("source"))


def wind_window(obs: DataFrame, wind: DataFrame, minutes: int = 60) -> DataFrame:
    """(id, n, speed, direction): mean speed and mean direction of the winds (site, at, u, v) within so many minutes of an observation (id, site, at).

    Winds are dealt into buckets of that length, and an observation meets its bucket and the two beside it.
    """
    width = minutes * 60
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width)
    o = obs.select("id", F.col("site").alias("os"), F.col("at").alias("oat"), F.explode(F.array(*[bucket("at") + i for i in (-1, 0, 1)])).alias("b"))
    w = wind.select("site", "at", "u", "v", bucket("at").alias("wb"))
    j = o.join(w.hint("merge"), (F.col("os") == F.col("site")) & (F.col("b") == F.col("wb")) & (F.abs(F.unix_timestamp("at") - F.unix_timestamp("oat")) <= width))
    speed, direction = S.wind_speed(F.col("u"), F.col("v")), S.wind_direction(F.col("u"), F.col("v"))
    return j.groupBy("id").agg(F.count("*").alias("n"), F.avg(speed).alias("speed"), S.circular_mean(direction).alias("direction"))


def merge_winner(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, q, outcome): old (key, q) with the flow of new (key, q, status) where that is quantified: replaced, kept (the new one is not), or untouched."""
    n = new.select(F.col("key").alias("_key"), F.col("q").alias("_q"), "status")
    j = old.join(n.hint("merge"), F.col("key") == F.col("_key"), "left")
    won = F.col("status") == "quantified"
    outcome = F.when(F.col("_key").isNull(), "untouched").when(won, "replaced").otherwise("kept")
    return j.select("key", F.when(won, F.col("_q")).otherwise(F.col("q")).alias("q"), outcome.alias("outcome"))


def shared_tiles(df: DataFrame) -> DataFrame:
    """df (id, tile, day) with the id of the first of its tile and day, and status first or shared: one scene serves all of them."""
    first = df.groupBy(F.col("tile").alias("_t"), F.col("day").alias("_d")).agg(F.min("id").alias("scene"))
    j = df.join(first.hint("merge"), F.col("tile").eqNullSafe(F.col("_t")) & F.col("day").eqNullSafe(F.col("_d")))
    return j.select("id", "scene", F.when(F.col("id") == F.col("scene"), "first").otherwise("shared").alias("status"))


def flow_vs_inventory(months: DataFrame) -> DataFrame:
    """months (site, month, q) with tonnes = q * 24 * days / 1000 and 30 per cent around it."""
    t = F.col("q") * 24 * F.dayofmonth(F.last_day("month")) / 1000
    return months.select("site", "month", F.round(t, 4).alias("tonnes"), F.round(t * 0.7, 4).alias("low"), F.round(t * 1.3, 4).alias("high"))


def enhancement_buckets(df: DataFrame) -> DataFrame:
    """(site, n, n_high, n_mid, best, mean_high, first, last, days): enhancements of 10 or more and of 5 to 10, and the sorted days of the high ones."""
    high, mid = F.col("e") >= 10, (F.col("e") >= 5) & (F.col("e") < 10)
    days = F.array_join(F.array_sort(F.collect_set(F.when(high, F.col("acq_date").cast("string")))), ",")
    return df.where("e is not null").groupBy("site").agg(
        F.count("*").alias("n"), F.count_if(high).alias("n_high"), F.count_if(mid).alias("n_mid"), F.max("e").alias("best"), F.round(F.avg(F.when(high, F.col("e"))), 4).alias("mean_high"),
        F.min("acq_date").alias("first"), F.max("acq_date").alias("last"), days.alias("days"),
    )


def combined_detections(runs: list[DataFrame], tau: float) -> DataFrame:
    """The rows (site, acq_date, event_id, sc_cfar) above tau of several runs, the first run's for each site and day, with bounds 0.7 and 1.3 of the score."""
    u = None
    for i, r in enumerate(runs):
        r = r.where(F.col("sc_cfar") > tau).select("site", "acq_date", F.struct(F.lit(i).alias("run"), "event_id", "sc_cfar").alias("r"))
        u = r if u is None else u.unionByName(r)
    g = u.groupBy("site", "acq_date").agg(F.min("r").alias("r"))
    return g.select("site", "acq_date", "r.run", "r.event_id", "r.sc_cfar", F.round(0.7 * F.col("r.sc_cfar"), 6).alias("low"), F.round(1.3 * F.col("r.sc_cfar"), 6).alias("high"))


def held_out(df: DataFrame, tau: float) -> DataFrame:
    """(site, n_valid, n_above, n_pass, category) of held-out scenes."""
    ok = F.col("sc_cfar").isNotNull() & (F.col("status") == "ok")
    above = ok & (F.col("sc_cfar") > tau)
    g = df.groupBy("site").agg(F.count_if(ok).alias("n_valid"), F.count_if(above).alias("n_above"), F.count_if(above & F.col("cfar_detect")).alias("n_pass"))
    category = F.when(F.col("n_valid") == 0, "no_data").when(F.col("n_pass") > 0, "detected").when(F.col("n_above") > 0, "suppressed").otherwise("quiet")
    return g.withColumn("category", category)


def kupiec(df: DataFrame, confidence: float = 0.95, t: float = 1.15) -> DataFrame:
    """One row (t_n, n1, p_obs, lr, p_value, reject) of pairs (score, y) with scores of t or more: a row without y is an exceedance."""
    from plumeledger.functions.hazard import erfc

    p0 = 1 - confidence
    g = df.where(F.col("score") >= t).agg(F.count("*").alias("t_n"), F.count_if(F.col("y") == 0).alias("n1"))
    p = F.least(F.greatest(F.try_divide(F.col("n1"), F.col("t_n")), F.lit(1e-10)), F.lit(1 - 1e-10))
    lr = -2 * (F.col("n1") * F.log(p0 / p) + (F.col("t_n") - F.col("n1")) * F.log((1 - p0) / (1 - p)))
    g = g.withColumn("lr", lr).withColumn("pv", erfc(F.sqrt(F.greatest(F.col("lr"), F.lit(0.0)) / 2)))
    return g.select("t_n", "n1", F.round(F.try_divide(F.col("n1"), F.col("t_n")), 4).alias("p_obs"), F.round("lr", 4).alias("lr"), F.round("pv", 4).alias("p_value"), (F.col("pv") < p0).alias("reject"))


def hosmer_lemeshow(df: DataFrame, groups: int = 5) -> DataFrame:
    """One row (stat, p_value) of pairs (doc_id, score, y): equal groups by probability (ties by doc_id), the first ones larger by one.

    A row's rank comes from running totals over distinct probabilities and its place among equal ones, so no task sorts the whole table.
    """
    from plumeledger.functions.running import running_totals

    x = df.select("doc_id", "y", S.logistic(F.col("score"), 0.5, 1.15).alias("p"))
    c = running_totals(x.groupBy("p").agg(F.count("*").alias("c")), "p", ["c"], descending=False).select(F.col("p").alias("_p"), (F.col("upto_c") - F.col("c")).alias("before"))
    x = x.withColumn("k", F.row_number().over(W.partitionBy("p").orderBy("doc_id"))).join(c.hint("merge"), F.col("p") == F.col("_p"))
    n = df.agg(F.count("*").alias("n"))
    x = x.crossJoin(F.broadcast(n)).withColumn("r", F.col("before") + F.col("k") - 1)  # one row
    size, more = F.floor(F.col("n") / groups), F.col("n") % groups
    big = more * (size + 1)
    g = F.when(F.col("r") < big, F.floor(F.col("r") / (size + 1))).otherwise(more + F.floor((F.col("r") - big) / F.greatest(size, F.lit(1))))
    s = x.groupBy(g.alias("g")).agg(F.count("*").alias("m"), F.sum("y").alias("o"), F.sum("p").alias("e"))
    term = F.pow(F.col("o") - F.col("e"), 2) / (F.col("e") * (1 - F.col("e") / F.col("m")))
    t = s.agg(F.sum(F.when((F.col("e") > 0) & (F.col("e") < F.col("m")), term)).alias("stat"))
    dof = max(groups - 2, 1)
    p = F.when(F.col("stat") < dof, 0.5 + 0.5 * (1 - F.col("stat") / dof)).otherwise(F.greatest(F.lit(0.001), F.exp(-0.5 * (F.col("stat") - dof))))
    return t.select(F.round("stat", 4).alias("stat"), F.round(p, 4).alias("p_value"))


def stability_verdict(df: DataFrame, by: str, value: str, base: str) -> DataFrame:
    """(by, most, verdict): the greatest change of value against base; stable under 2 points, moderate under 5, else unstable."""
    g = df.groupBy(by).agg(F.max(100 * F.abs(F.col(value) - F.col(base))).alias("most"))
    verdict = F.when(F.col("most") < 2, "stable").when(F.col("most") < 5, "moderate").otherwise("unstable")
    return g.select(by, F.round("most", 4).alias("most"), verdict.alias("verdict"))


def annualise_ci(months: DataFrame, floors: list[float]) -> DataFrame:
    """(site, framing, n, mean, sd, sem, t, low, high) of monthly flows q: detections alone, and all months with each floor where there is none."""
    from plumeledger.functions.hazard import t_by_n

    upper = F.struct(F.lit("upper").alias("framing"), F.col("q").alias("x"))
    rest = [F.struct(F.lit(f"floor_{f:g}").alias("framing"), F.coalesce("q", F.lit(float(f))).alias("x")) for f in floors]
    g = months.select("site", F.explode(F.array(upper, *rest)).alias("r")).select("site", "r.*").where("x is not null").groupBy("site", "framing").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    g = g.withColumns({"sem": F.col("s") / F.sqrt("n"), "t": F.when(F.col("n") > 1, t_by_n(F.col("n")))})
    return g.select("site", "framing", "n", F.round("m", 4).alias("mean"), F.round("s", 4).alias("sd"), F.round("sem", 4).alias("sem"), "t", F.round(F.col("m") - F.col("t") * F.col("sem"), 4).alias("low"), F.round(F.col("m") + F.col("t") * F.col("sem"), 4).alias("high"))
