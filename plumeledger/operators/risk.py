"""Risk distributions over tables of draws: a draw is a row, and its uniforms are a function of its keys alone.

Paths come as a table with a whole-number column path, so the number of draws is the number of its rows, and adding rows
leaves the other draws as they are. Sites, scenarios and parameters are small tables, exploded into the path rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.functions import hazard as H
from plumeledger.functions.running import order_statistics, with_few
from plumeledger.sources.scratch import kept

# Carbon price in EUR a tonne and methane multiplier by anchor year, drift, volatility, and shock (year, size) of each scenario.
SCENARIOS = {
    "orderly": {
        "price": {2024: 65, 2025: 70, 2027: 80, 2030: 100, 2035: 120, 2040: 135, 2045: 145, 2050: 150},
        "multiplier": {2024: 1.0, 2026: 1.05, 2028: 1.10, 2030: 1.15, 2035: 1.25, 2040: 1.30, 2050: 1.35},
        "drift": 0.04, "vol": 0.15, "shock": (0, 0.0),
    },
    "disorderly": {
        "price": {2024: 65, 2025: 68, 2027: 72, 2029: 75, 2030: 130, 2032: 160, 2035: 195, 2040: 220, 2045: 230, 2050: 240},
        "multiplier": {2024: 1.0, 2026: 1.0, 2029: 1.0, 2030: 1.30, 2032: 1.40, 2035: 1.50, 2040: 1.50, 2050: 1.50},
        "drift": 0.03, "vol": 0.30, "shock": (2030, 0.40),
    },
    "hot_house": {
        "price": {2024: 65, 2025: 63, 2027: 60, 2030: 58, 2035: 55, 2040: 52, 2045: 50, 2050: 48},
        "multiplier": {2024: 1.0, 2030: 1.0, 2040: 1.0, 2050: 1.0},
        "drift": -0.01, "vol": 0.12, "shock": (0, 0.0),
    },
}
REVERSION, LEAST_PRICE = 0.3, 10.0
MOST_SITES = 10_000
DRAWS = 200_000

# The liability layers.
MEAN_T, LO_T, HI_T, N_OBS = 4174.0, 2987.0, 5360.0, 30
WIND_SIGMA, MASK_LO, MASK_HI, PRICE, LOG_VOL, PASS_A = 0.10, 0.85, 1.15, 70.0, 0.35, 9.0
GWP100, GWP20 = 28.0, 83.0
TAU, TAU_MEAN, TAU_SD, DETECTION_RATE, MEAN_FLOW, HOURS = 3.5796, 3.3406, 0.7056, 0.252, 476.0, 8760.0


def interpolated(anchors: dict[int, float], year: int) -> float:
    """The scenario's number of a year: linear between anchors, two places."""
    ys = sorted(anchors)
    y = min(max(year, ys[0]), ys[-1])
    lo, hi = max(a for a in ys if a <= y), min(a for a in ys if a >= y)
    return round(anchors[lo] + (anchors[hi] - anchors[lo]) * ((y - lo) / (hi - lo) if hi > lo else 0), 2)


def priced(paths: DataFrame, scenario: str, years: int = 10, first: int = 2024) -> DataFrame:
    """paths with price_0, price_1, ... of the years from `first` on.

    The first year has the scenario's price. Each year's log return is the drift, a share of the way to the scenario's price,
    the shock in its year, and noise; no price falls under the least. A step is a column of its own, so that it is worked out once.
    """
    s, later = SCENARIOS[scenario], range(1, years)
    d = paths.withColumn("_z", _yearly(first, years)(F.col("path").cast("long"))) if years > 1 else paths
    d = d.withColumn("price_0", F.lit(float(interpolated(s["price"], first))))
    for i in later:
        last, target, jump = F.col(f"price_{i - 1}"), F.lit(float(interpolated(s["price"], first + i))), F.lit(s["shock"][1] if first + i == s["shock"][0] else 0.0)
        drift = s["drift"] + REVERSION * F.log(target / last) + jump
        d = d.withColumn(f"price_{i}", F.greatest(F.lit(LEAST_PRICE), last * F.exp(drift - 0.5 * s["vol"] ** 2 + s["vol"] * F.col("_z")[i - 1])))
    return d.select(*paths.columns, *[f"price_{i}" for i in range(years)])


def price_paths(paths: DataFrame, scenario: str, years: int = 10, first: int = 2024) -> DataFrame:
    """(path, year, price) of priced(), parallel over paths."""
    years = max(years, 1)
    d = priced(paths.select("path"), scenario, years, first)
    return d.select("path", F.posexplode(F.array(*[f"price_{i}" for i in range(years)])).alias("i", "price")).select("path", (F.col("i") + first).alias("year"), "price")


def beta_point(u: Column, y: Column, a: Column, b: Column) -> Column:
    """Quantile of a beta distribution: u ** (1 / a) for b = 1, else by the normal approximation of its logit; shapes under 1 count as 1 there, unknown ones give null. y: normal_point(1 - u)."""
    a1, b1 = F.greatest(a, F.lit(1.0)), F.greatest(b, F.lit(1.0))
    p, q = 1 / (2 * a1 - 1), 1 / (2 * b1 - 1)
    h, lam = 2 / (p + q), (y * y - 3) / 6
    w = y * F.sqrt(F.greatest(h + lam, F.lit(0.0))) / h - (q - p) * (lam + 5 / 6.0 - 2 / (3 * h))
    return F.when(b == 1, F.pow(u, 1 / a)).when(a.isNotNull(), a1 / (a1 + b1 * F.exp(2 * w)))


def beta_points(u: np.ndarray, y: np.ndarray, a: float | None, b: float | None) -> np.ndarray:
    """beta_point() of arrays for one pair of shapes; 0 for unknown ones."""
    if a is None:
        return np.zeros(len(u))
    if b == 1:
        return u ** (1 / a)
    a1, b1 = max(a, 1.0), max(b, 1.0)
    p, q = 1 / (2 * a1 - 1), 1 / (2 * b1 - 1)
    h, lam = 2 / (p + q), (y * y - 3) / 6
    w = y * np.sqrt(np.maximum(h + lam, 0.0)) / h - (q - p) * (lam + 5 / 6.0 - 2 / (3 * h))
    return a1 / (a1 + b1 * np.exp(2 * w))


def site_cost_draws(paths: DataFrame, sites: DataFrame, scenario: str, years: int = 10, first: int = 2024, sigma: float = 0.30) -> DataFrame:
    """(site, ticker, path, year, cost) of sites (site, ticker, p, p_lo, p_hi, flow), a small table that every path is exploded by.

    cost = p * flow * 8760 * 0.85 / 1000 * 29.8 * price * multiplier; a site's p and flow are drawn once a path, p from a beta
    distribution (0 where p is 0), flow from a lognormal one.
    """
    p = priced(paths.where("path is not null").select("path"), scenario, years, first)
    d = _tonnes(p.select("path", _years(scenario, years, first).alias("years")), sites, sigma)
    d = d.select("site", "ticker", "path", "t_co2e", F.explode("years").alias("x"))
    return d.select("site", "ticker", "path", "x.year", (F.col("t_co2e") * F.col("x.price") * F.col("x.mult")).alias("cost"))


def site_path_costs(paths: DataFrame, sites: DataFrame, scenario: str, years: int = 10, first: int = 2024, sigma: float = 0.30, rate: float = 0.05) -> DataFrame:
    """(site, ticker, path, t, npv) of site_cost_draws(): the last year's cost and the discounted sum of all years.

    A path's years are added up before it is exploded by the sites, so no draw is shuffled and no year is a row. Paths that are listed again
    count again in the sums; sites are expected once.
    """
    years = max(years, 1)
    own = paths.where("path is not null").groupBy("path").agg(F.count("*").alias("times"))
    p = priced(own, scenario, years, first)
    of_year = _years(scenario, years, first)
    last = F.element_at(of_year, -1)
    npv = sum((F.get(of_year, F.lit(i))["price"] * F.get(of_year, F.lit(i))["mult"] / (1 + rate) ** (i + 1) for i in range(years)), F.lit(0.0))
    p = p.select("path", F.struct((last["price"] * last["mult"] * F.col("times")).alias("t"), (npv * F.col("times")).alias("npv")).alias("years"))
    d = _tonnes(p, sites, sigma)
    return d.select("site", "ticker", "path", (F.col("t_co2e") * F.col("years.t")).alias("t"), (F.col("t_co2e") * F.col("years.npv")).alias("npv"))


def _years(scenario: str, years: int, first: int) -> Column:
    """The array of (year, price, mult) of priced() rows."""
    mult = [float(interpolated(SCENARIOS[scenario]["multiplier"], y)) for y in range(first, first + years)]
    return F.array(*[F.struct(F.lit(first + i).alias("year"), F.col(f"price_{i}").alias("price"), F.lit(m).alias("mult")) for i, m in enumerate(mult)])


def _tonnes(p: DataFrame, sites: DataFrame, sigma: float) -> DataFrame:
    """(site, ticker, path, years, t_co2e): the paths (path, years) by the sites, with the tonnes drawn."""
    a, b = H.beta_moments(F.col("p"), F.col("p_lo"), F.col("p_hi"))
    d = sites.select("site", "ticker", a.alias("a"), b.alias("b"), H.lognormal_mu(F.col("flow"), sigma).alias("mu"))
    # The few sites go through the driver as one array, so that no join without a key is needed.
    rows = d.orderBy("site").take(MOST_SITES + 1)
    if len(rows) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites: run them in parts")
    few = p.sparkSession.createDataFrame(rows, d.schema).agg(F.collect_list(F.struct("*")).alias("all"))
    d = p.crossJoin(F.broadcast(few)).select("path", "years", F.explode("all").alias("x")).select("path", "years", "x.*")  # one row
    d = drawn(d)
    rate = F.coalesce(beta_point(F.col("u1"), F.col("y1"), F.col("a"), F.col("b")), F.lit(0.0))
    flow = F.coalesce(F.exp(F.col("mu") + sigma * F.col("z2")), F.lit(0.0))
    return d.select("site", "ticker", "path", "years", (rate * flow * 8760 * 0.85 / 1000 * 29.8).alias("t_co2e"))


def drawn(d: DataFrame) -> DataFrame:
    """d (path, site, ...) with u1, a path's uniform number for the rate of a site, y1 = normal_point(1 - u1), and z2, the normal number for its flow."""

    @F.arrow_udf("u1 double, y1 double, z2 double")
    def of(path: pa.Array, site: pa.Array) -> pa.Array:
        unknown = np.asarray(path.is_null()) | np.asarray(site.is_null())
        keys = [np.asarray(x.fill_null(0)) for x in (path, site)]
        return pa.StructArray.from_arrays([pa.array(x, mask=unknown) for x in site_draws(*keys)], names=["u1", "y1", "z2"])

    return d.withColumn("_draw", of(F.col("path").cast("long"), F.col("site").cast("long"))).select("*", "_draw.*").drop("_draw")


def site_draws(path: np.ndarray, site: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u1, y1, z2) of drawn()."""
    u1, u2 = H.uniforms(path, site, 1), H.uniforms(path, site, 2)
    return u1, H.normal_points(1 - u1), H.normal_points(u2)


def _yearly(first: int, years: int):
    """The normal numbers of a path in the years after the first, as an array; null for an unknown path."""

    @F.arrow_udf("array<double>")
    def of(path: pa.Array) -> pa.Array:
        keys, later = np.asarray(path.fill_null(0)), np.arange(first + 1, first + years)
        z = H.normal_points(H.uniforms(keys[:, None], later[None, :]))
        ends = pa.array(np.arange(len(keys) + 1) * len(later), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(z.ravel()), mask=path.is_null())

    return of


def loss_stats(draws: DataFrame, by: list[str], rate: float = 0.05, first: int = 2024) -> DataFrame:
    """(by, year, mean, p50, p95, p99) of the costs of each year; exact percentiles, ranked by ranges. The draws are read three times and not written, so they must be the same each time."""
    d = draws.select(F.struct(*by, "year").alias("_k"), F.col("cost").cast("double").alias("_v"))
    q = order_statistics(d, "_v", {n: _place(p) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}, "_k").drop("n")
    g = d.groupBy(F.col("_k").alias("_of")).agg(F.avg("_v").alias("mean"))
    j = g.join(q.hint("merge"), F.col("_of").eqNullSafe(F.col("_k")), "left")
    return j.select("_of.*", *[F.round(c, 2).alias(c) for c in ("mean", "p50", "p95", "p99")])


def terminal_losses(draws: DataFrame, by: list[str], rate: float = 0.05, first: int = 2024, last: int | None = None) -> DataFrame:
    """(by, mean, var95, cvar95, npv_mean, npv_p95): the last year's cost and the discounted sum of all years, by path; exact percentiles, ranked by ranges. The paths' figures are written once; the last year is looked for where it is not given."""
    if last is None:
        d = draws.join(F.broadcast(draws.agg(F.max("year").alias("last"))), F.lit(True))  # one row
    else:
        d = draws.withColumn("last", F.lit(last))
    t, npv = F.sum(F.when(F.col("year") == F.col("last"), F.col("cost"))).alias("t"), F.sum(F.col("cost") / F.pow(F.lit(1 + rate), F.col("year") - first + 1)).alias("npv")
    return path_losses(d.groupBy(*by, "path").agg(t, npv), by)


def path_losses(costs: DataFrame, by: list[str]) -> DataFrame:
    """terminal_losses() of a path's last cost t and discounted sum npv, a row a path and group; they are written once."""
    one = kept(costs.select(F.struct(*by, F.lit(0).alias("_all")).alias("_k"), "t", "npv"), "terminal-losses")
    g = one.groupBy(F.col("_k").alias("_of")).agg(F.avg("t").alias("mean"), F.avg("npv").alias("npv_mean"))
    for value, name in (("t", "var95"), ("npv", "npv_p95")):
        q = order_statistics(one, value, {name: _place(0.95)}, "_k").drop("n")
        g = g.join(q.hint("merge"), F.col("_of").eqNullSafe(F.col("_k")), "left").drop("_k")
    g = kept(g, "terminal-groups")
    tail = with_few(one.select("_k", F.col("t").alias("_t")), g.select("_of", "var95"), F.col("_k").eqNullSafe(F.col("_of"))).groupBy("_k").agg(F.avg(F.when(F.col("_t") >= F.col("var95"), F.col("_t"))).alias("cvar95"))
    out = g.join(tail.hint("merge"), F.col("_of").eqNullSafe(F.col("_k")))
    return out.select(*[F.col("_k")[b].alias(b) for b in by], *[F.round(c, 2).alias(c) for c in ("mean", "var95", "cvar95", "npv_mean", "npv_p95")])


def issuer_stress(site_losses: DataFrame, issuers: DataFrame, scenario: str) -> DataFrame:
    """A row a ticker: the sums of its sites' terminal losses (no diversification), share of earnings, credit transmission.

    issuers: ticker, equity, debt, volatility, earnings and has_market_data, which chooses between the structural model and
    the table of notches.
    """
    s = site_losses.groupBy("ticker").agg(*[F.sum(c).alias(c) for c in ("mean", "var95", "cvar95", "npv_mean", "npv_p95")], F.count("*").alias("n_sites"))
    j = s.join(issuers.hint("merge"), "ticker", "left")
    m = H.merton(F.col("equity"), F.col("debt"), F.col("volatility"), F.col("npv_mean"))
    notch = F.when(F.coalesce("has_market_data", F.lit(False)), m["notches"]).otherwise(H.notches(F.col("var95"), F.col("earnings")))
    j = j.withColumns({"notches": notch, "dd_base": F.round(m["dd_base"], 4), "dd_stressed": F.round(m["dd_stressed"], 4), "rating_base": m["rating_base"], "rating_stressed": m["rating_stressed"]})
    share = F.round(100 * F.try_divide(F.col("var95"), F.col("earnings")), 4)
    return j.select(
        "ticker", F.lit(scenario).alias("scenario"), "n_sites", *[F.round(c, 2).alias(c) for c in ("mean", "var95", "cvar95", "npv_mean", "npv_p95")], share.alias("cost_pct"), "notches",
        H.pd_bps(F.col("notches")).alias("pd_bps"), H.lgd_of(F.lit(scenario)).alias("lgd"), "dd_base", "dd_stressed", "rating_base", "rating_stressed",
    )


def portfolio_stress(issuers: DataFrame) -> DataFrame:
    """Totals of issuer_stress() rows by scenario."""
    return issuers.groupBy("scenario").agg(F.count("*").alias("n_issuers"), *[F.round(F.sum(c), 2).alias(c) for c in ("mean", "var95", "cvar95", "npv_mean")])


def liability_draws(paths: DataFrame) -> DataFrame:
    """(path, t, wind, mask, price, share, gwp100, gwp20): a year's tonnes, factors and liability in millions of EUR."""
    u = lambda k: H.uniform(F.col("path"), F.lit(k))
    sem = (HI_T - LO_T) / (2 * H.T_BY_DF[N_OBS - 1])
    below = H.normal_cdf(F.lit(-MEAN_T / sem))
    t = MEAN_T + sem * H.normal_point(below + u(1) * (1 - below))
    wind = F.least(F.greatest(1 + WIND_SIGMA * H.normal_point(u(2)), F.lit(0.5)), F.lit(2.0))
    mask = MASK_LO + (MASK_HI - MASK_LO) * u(3)
    d = paths.select("path", t.alias("t"), wind.alias("wind"), mask.alias("mask"), carbon_price(u(4)).alias("price"), F.pow(u(5), F.lit(1 / PASS_A)).alias("share"))
    base = F.col("t") * F.col("wind") * F.col("mask") * F.col("price") * F.col("share") / 1e6
    return d.withColumns({"gwp100": base * GWP100, "gwp20": base * GWP20})


def carbon_price(u: Column) -> Column:
    """Lognormal of mean PRICE."""
    import math

    return F.exp(math.log(PRICE) - 0.5 * LOG_VOL**2 + LOG_VOL * H.normal_point(u))


def _place(share: float) -> str:
    """The place of a percentile among n ordered values, between two of them linearly."""
    return f"1 + (n - 1) * {share!r}D"


def risk_metrics(draws: DataFrame, column: str) -> DataFrame:
    """One row: mean, median, var_95, var_99, es_99 (mean of what reaches var_99), p5, p25, p75, three places; nulls without draws. Draws are ranked by ranges, so no state holds them all."""
    d = draws.select(F.lit(0).alias("_g"), F.col(column).alias("_v"))
    q = order_statistics(d, "_v", {n: _place(p) for n, p in (("median", 0.5), ("var_95", 0.95), ("var_99", 0.99), ("p5", 0.05), ("p25", 0.25), ("p75", 0.75))}, "_g").drop("n", "_g")
    g = d.agg(F.avg("_v").alias("mean")).join(F.broadcast(q), F.lit(True), "left")  # one row each
    tail = draws.select(F.col(column).alias("_x")).join(F.broadcast(g), F.col("_x") >= F.col("var_99"))  # one row
    es = tail.agg(F.avg("_x").alias("es_99"))
    both = g.join(F.broadcast(es), F.lit(True))
    return both.select(*[F.round(c, 3).alias(c) for c in ("mean", "median", "var_95", "var_99", "es_99", "p5", "p25", "p75")])


def tau_sensitivity(paths: DataFrame) -> DataFrame:
    """One row: means of the drawn threshold and detection rate, and of the lower liability, with its 99th percentiles."""
    u = lambda k: H.uniform(F.col("path"), F.lit(k))
    tau = F.least(F.greatest(TAU_MEAN + TAU_SD * H.normal_point(u(11)), F.lit(1.15)), F.lit(6.0))
    d = paths.select("path", tau.alias("tau"), (carbon_price(u(12)) * F.pow(u(13), F.lit(1 / PASS_A))).alias("price"))
    slope = 0.10 / (4.34 - TAU)
    rate = DETECTION_RATE * F.when(F.col("tau") > TAU, 1 - slope * (F.col("tau") - TAU)).otherwise(1.0)
    d = d.withColumn("rate", F.least(F.greatest(rate, F.lit(0.10)), F.lit(1.0)))
    base = MEAN_FLOW * HOURS / 1e3 * F.col("rate") * F.col("price") / 1e6
    d = d.select(F.lit(0).alias("_g"), "tau", "rate", base.alias("base"), (base * GWP100).alias("a"), (base * GWP20).alias("b"))
    top = order_statistics(d, "base", {"top": _place(0.99)}, "_g").select("top")  # both liabilities are multiples of base
    g = d.agg(F.round(F.avg("tau"), 4).alias("tau_mean"), F.round(F.avg("rate"), 3).alias("rate_mean"), F.round(F.avg("a"), 3).alias("gwp100_mean"), F.round(F.avg("b"), 3).alias("gwp20_mean"))
    j = g.join(F.broadcast(top), F.lit(True), "left")  # one row each
    return j.select(*g.columns, F.round(F.col("top") * GWP100, 3).alias("gwp100_var99"), F.round(F.col("top") * GWP20, 3).alias("gwp20_var99"))


def combined_uncertainty(records: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """A row a record (record, wind, coeff, mask, background in per cent): the product of four factors over the paths under n, and the quadrature.

    Factors are normal around 1 and 0.01 at least; null and NaN are 0. A record that is listed again counts its draws again. A record's n draws are a
    row of an array in a task, some DRAWS numbers at a time, and never rows of a table.
    """
    sigma = lambda c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) / 100
    names = ("wind", "coeff", "mask", "background")
    quad = 100 * H.quadrature(*[sigma(c) for c in names])
    d = records.groupBy("record", *names).agg(F.count("*").alias("times")).select("record", F.col("record").cast("long").alias("key"), "times", *[sigma(c).alias(c) for c in names], quad.alias("quad"))
    kind = records.schema["record"].dataType.simpleString()
    g = d.mapInArrow(_factor_figures(names, n), f"record {kind}, m double, s double, p5 double, p95 double, quad double")
    return g.select("record", F.round("m", 4).alias("mean"), F.round("s", 4).alias("sd"), F.round("p5", 4).alias("p5"), F.round("p95", 4).alias("p95"), F.round(100 * F.col("s") / F.col("m"), 1).alias("mc_pct"), F.round("quad", 1).alias("quad_pct"))


def _factor_figures(names: tuple[str, ...], n: int):
    """For mapInArrow: mean, deviation and percentiles of each record's n products; null keys give nulls."""

    def figures(keys, times, sigmas):
        f = 1.0
        for k in range(len(names)):
            f = f * np.maximum(0.01, 1 + sigmas[:, k : k + 1] * H.normal_points(H.uniforms(keys[:, None], np.arange(n)[None, :], k)))
        m = f.mean(axis=1)
        count = n * times
        s = np.sqrt(((f - m[:, None]) ** 2).sum(axis=1) * times / np.where(count > 1, count - 1, np.nan))
        f.sort(axis=1)
        out = [m, s]
        for share in (0.05, 0.95):  # of n * times ordered values, each `times` over
            at = share * (count - 1)
            lo, hi = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
            row = np.arange(len(f))
            low, high = f[row, lo // times], f[row, hi // times]
            out.append(np.where(lo == hi, low, (hi - at) * low + (at - lo) * high))
        return out

    def of(batches):
        for b in batches:
            unknown = b["key"].is_null().to_numpy(zero_copy_only=False)
            keys, times = b["key"].fill_null(0).to_numpy(zero_copy_only=False), b["times"].to_numpy()
            sigmas = np.stack([b[c].to_numpy() for c in names], 1)
            step = max(1, DRAWS // n)
            for i in range(0, len(keys), step):
                got = figures(keys[i : i + step], times[i : i + step], sigmas[i : i + step])
                got = [pa.array(x, mask=unknown[i : i + step], from_pandas=True) for x in got]
                yield pa.RecordBatch.from_arrays([b["record"].slice(i, step), *got, b["quad"].slice(i, step)], names=["record", "m", "s", "p5", "p95", "quad"])

    return of


def variance_shares(sigmas: DataFrame, by: str) -> DataFrame:
    """sigmas (by, source, sigma) with total, the root of the sum of squares of its group, and share, sigma over total."""
    g = sigmas.groupBy(F.col(by).alias("_by")).agg(F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("total"))
    j = sigmas.join(g.hint("merge"), F.col(by).eqNullSafe(F.col("_by")))
    return j.select(by, "source", F.round("sigma", 6).alias("sigma"), F.round("total", 6).alias("total"), F.round(F.try_divide(F.col("sigma"), F.col("total")), 4).alias("share"))


def tornado(paths: DataFrame, parameters: list[tuple[str, float, float, float]]) -> DataFrame:
    """(param, level, var95, delta): the liability's 95th percentile with each parameter (name, base, low, high) at its low and high, and the change from the base run.

    A run multiplies every path's liability by its factor and so the percentile, which is ranked once, by ranges.
    """
    runs = [(n, tag, v / base) for n, base, low, high in parameters for tag, v in (("low", low), ("high", high))]
    d = liability_draws(paths).select(F.lit(0).alias("_g"), "gwp100")
    g = order_statistics(d, "gwp100", {"v0": _place(0.95)}, "_g")
    rows = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(t).alias("level"), (F.col("v0") * float(k)).alias("v")) for p, t, k in runs])
    return g.select("v0", F.explode(rows).alias("r")).select("r.param", "r.level", F.round("r.v", 4).alias("var95"), F.round(F.col("r.v") - F.col("v0"), 4).alias("delta"))


def convergence(draws: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """(n, var95): the 95th percentile over the paths below each size, null where there are none; ranked by ranges, a group a size."""
    reached = F.filter(F.array(*map(F.lit, sizes)), lambda n: F.col("path") < n)
    d = draws.select(F.explode(reached).alias("_n"), F.col(column).alias("_v"))
    got = order_statistics(d, "_v", {"var95": _place(0.95)}, "_n").select("_n", F.round("var95", 4).alias("var95"))
    all_ = draws.sparkSession.createDataFrame([(n,) for n in sizes], "n int")
    return all_.join(got.hint("merge"), F.col("n") == F.col("_n"), "left").select("n", "var95")


def transition_table(annual: DataFrame, prices: list[tuple[str, float]], gwp: float = GWP100) -> DataFrame:
    """(site, price_case, price, mean, lower, upper): exposure of annual tonnes (site, mean, lower, upper) at each price case, whole EUR."""
    c = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("price")) for n, p in prices])).alias("c")
    d = annual.select("site", "mean", "lower", "upper", c)
    return d.select("site", F.col("c.name").alias("price_case"), F.col("c.price").alias("price"), *[F.round(H.carbon_exposure(F.col(x), gwp, F.col("c.price")), 0).alias(x) for x in ("mean", "lower", "upper")])


def stress_table(positions: DataFrame, tiers: list[tuple[str, float, float]]) -> DataFrame:
    """(id, tier, equity, spread, combined): profit and loss of positions (id, bond, duration, equity_position) in tiers (name, shock in per cent, widening in basis points)."""
    t = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("shock"), F.lit(float(b)).alias("bp")) for n, s, b in tiers])).alias("t")
    d = positions.select("id", "bond", "duration", "equity_position", t)
    e, s = H.equity_pnl(F.col("equity_position"), F.col("t.shock")), H.spread_pnl(F.col("bond"), F.col("duration"), F.col("t.bp"))
    return d.select("id", F.col("t.name").alias("tier"), F.round(e, 0).alias("equity"), F.round(s, 0).alias("spread"), F.round(e + s, 0).alias("combined"))
