"""Queries over risk draws and credit arithmetic. The paths are the orders' keys, the sites those of the scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumeledger.functions import hazard as H
from plumeledger.operators import detection as D
from plumeledger.operators import risk as R
from plumeledger.sources import fixtures as X

YEARS = 6
PRICES = [("low", 40.0), ("central", 70.0), ("high", 120.0)]
TIERS = [("mild", -3.0, 25.0), ("moderate", -7.0, 75.0), ("severe", -15.0, 150.0)]
PARAMETERS = [("gwp100", 28.0, 27.2, 29.8), ("price", 70.0, 45.0, 100.0), ("pass_through", 0.9, 0.7, 1.0), ("mean_t", 4174.0, 2987.0, 5360.0)]
SIZES = [1000, 5000, 10000, 25000, 50000]


def paths(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("path"))


def _issuers(s, d):
    k = F.col("c_custkey")
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select(k.alias("id"), (F.col("c_acctbal") * 1e6).alias("equity"), F.when(k % 7 == 0, 0.0).otherwise((k % 50) * 1e8).alias("debt"), F.when(k % 11 > 0, (k % 9 + 1) / 20.0).alias("volatility"), ((k % 40) * 1e8).alias("liability"))


def _merton(s, d):
    i = _issuers(s, d).where("equity > 0")
    m = H.merton(*[F.col(c) for c in ("equity", "debt", "volatility", "liability")])
    return i.select("id", *[F.round(m[c], 4).alias(c) for c in ("dd_base", "dd_stressed", "edf_base", "edf_stressed")], *[m[c].alias(c) for c in ("rating_base", "rating_stressed", "notches")])


def _notches(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    e = F.when(F.col("o_orderkey") % 13 == 0, 0.0).otherwise((F.col("o_orderkey") % 97) * 20000.0)
    n = H.notches(F.col("o_totalprice"), e)
    return o.select("o_orderkey", n.alias("notches"), H.pd_bps(n).alias("pd_bps"), H.lgd_of(F.element_at(F.array(F.lit("orderly"), F.lit("disorderly"), F.lit("hot_house")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("lgd"))


def _paths_of(s, d):
    return R.price_paths(paths(s, d), "disorderly", 8).select("path", "year", F.round("price", 4).alias("price"))


def _sites(s, d):
    r = D.site_risk(X.scores(s, d))
    return r.select("site", F.concat(F.lit("T"), (F.col("site") % 4).cast("string")).alias("ticker"), "p", "p_lo", "p_hi", "flow")


def _draws(s, d, scenario="orderly"):
    return R.site_cost_draws(paths(s, d), _sites(s, d), scenario, YEARS)


def _stress(s, d):
    losses = R.path_losses(R.site_path_costs(paths(s, d), _sites(s, d), "orderly", YEARS), ["site", "ticker"])
    n = X.sites(s, d).groupBy(F.concat(F.lit("T"), (F.col("site") % 4).cast("string")).alias("ticker")).agg((F.count("*") * 1e9).alias("equity"))
    i = n.select("ticker", "equity", (F.col("equity") / 2).alias("debt"), F.lit(0.3).alias("volatility"), (F.col("equity") / 1000).alias("earnings"), (F.col("ticker") != "T0").alias("has_market_data"))
    return R.issuer_stress(losses, i, "orderly")


def _records(s, d):
    x = X.scores(s, d)
    return x.select(F.col("event_id").alias("record"), (F.col("cloud") % 40).alias("wind"), F.lit(15).alias("coeff"), F.when(F.col("cloud") % 3 > 0, F.col("cloud") % 20).alias("mask"), (F.col("cv") * 10).alias("background"))


def _sigmas(s, d):
    g = X.scores(s, d).groupBy("site").agg(F.stddev_samp("sc_cfar").alias("sd"), F.avg("sc_cfar").alias("m"), F.count("*").alias("n"))
    src = F.array(F.struct(F.lit("sampling").alias("source"), (F.col("sd") / F.sqrt("n") / F.col("m")).alias("sigma")), F.struct(F.lit("wind").alias("source"), F.lit(0.10).alias("sigma")), F.struct(F.lit("mask").alias("source"), F.lit(0.15 / math.sqrt(3)).alias("sigma")), F.struct(F.lit("price").alias("source"), F.lit(0.35).alias("sigma")))
    return g.select("site", F.explode(src).alias("x")).select("site", "x.*")


def _annual(s, d):
    g = X.scores(s, d).groupBy("site").agg((F.avg("sc_cfar") * 1000).alias("mean"), (F.min("sc_cfar") * 1000).alias("lower"), (F.max("sc_cfar") * 1000).alias("upper"))
    return R.transition_table(g, PRICES)


def _positions(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    return R.stress_table(c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 1000).alias("bond"), (F.col("c_custkey") % 10 + 1).alias("duration"), (F.col("c_acctbal") * 500).alias("equity_position")), TIERS)


def _numbers(s, d):
    e = X.scores(s, d)
    text = F.when(F.col("cloud") % 5 == 0, "NaN").when(F.col("cloud") % 5 == 1, "Infinity").when(F.col("cloud") % 5 == 2, "x1").otherwise(F.col("cloud").cast("string"))
    year = 2020 + F.col("cloud") % 35
    n = F.col("cloud") % 130 + 2
    a, b = H.beta_moments(F.col("cloud") / 200.0, F.col("cloud") / 250.0, F.col("cloud") / 150.0)
    return e.select(
        "event_id", H.safe_float(text).alias("number"), H.interp_path(year, R.SCENARIOS["disorderly"]["price"]).alias("price"), H.t_by_df(n - 1).alias("t_df"), H.t_by_n(n).alias("t_n"),
        F.round(H.quadrature(F.col("cv"), F.when(F.col("cloud") > 50, F.lit(float("nan"))).otherwise(F.col("sc_cfar")), F.lit(None)), 6).alias("quad"),
        F.round(H.normal_cdf(F.col("sc_cfar") - 2), 6).alias("cdf"), F.round(a, 4).alias("beta_a"), F.round(b, 4).alias("beta_b"), F.round(H.lognormal_mu(F.col("sc_cfar"), 0.3), 6).alias("mu"),
    )


QUERIES = {
    "i10_i21_numbers": _numbers,
    "i13_i15_merton": _merton,
    "i14_notches": _notches,
    "j1_price_paths": _paths_of,
    "j2_site_cost_draws": lambda s, d: _draws(s, d).select("site", "path", "year", F.round("cost", 2).alias("cost")),
    "j3_loss_stats": lambda s, d: R.loss_stats(_draws(s, d), ["site"]),
    "j3_terminal_losses": lambda s, d: R.path_losses(R.site_path_costs(paths(s, d), _sites(s, d), "orderly", YEARS), ["site"]),
    "j4_issuer_stress": _stress,
    "j4_portfolio_stress": lambda s, d: R.portfolio_stress(_stress(s, d)),
    "j5_liability_draws": lambda s, d: R.liability_draws(paths(s, d)).select("path", F.round("t", 3).alias("t"), F.round("gwp100", 4).alias("gwp100"), F.round("gwp20", 4).alias("gwp20")),
    "j6_risk_metrics": lambda s, d: R.risk_metrics(R.liability_draws(paths(s, d)), "gwp100"),
    "j7_tau_sensitivity": lambda s, d: R.tau_sensitivity(paths(s, d)),
    "j8_combined_uncertainty": lambda s, d: R.combined_uncertainty(_records(s, d), paths(s, d), 200),
    "j9_variance_shares": lambda s, d: R.variance_shares(_sigmas(s, d), "site"),
    "j10_tornado": lambda s, d: R.tornado(paths(s, d), PARAMETERS),
    "j11_convergence": lambda s, d: R.convergence(R.liability_draws(paths(s, d)), "gwp100", SIZES),
    "j12_transition_table": _annual,
    "j12_i20_stress_table": _positions,
}


def _u(*keys: str) -> str:
    x = "20231"
    for k in keys:
        x = f"((({x} + (({k})::BIGINT % 2147483647) + 1) * 48271) % 2147483647)"
        x = f"((({x} * {x} + 7) % 2147483647 + 11) * 69621 % 2147483647)"
    return f"(({x} + 0.5::DOUBLE) / 2147483647.0::DOUBLE)"


def _z(u: str) -> str:
    t = f"sqrt(-2 * ln(least({u}, 1 - {u})))"
    z = f"({t} - (2.515517::DOUBLE + {t} * (0.802853::DOUBLE + {t} * 0.010328::DOUBLE)) / (1 + {t} * (1.432788::DOUBLE + {t} * (0.189269::DOUBLE + {t} * 0.001308::DOUBLE))))"
    return f"(CASE WHEN {u} > 0.5::DOUBLE THEN {z} ELSE -{z} END)"


def _erfc(x: str) -> str:
    t = f"(1 / (1 + abs({x}) / 2::DOUBLE))"
    p = "0.17087277::DOUBLE"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        p = f"({c}::DOUBLE + {t} * {p})"
    r = f"({t} * exp({p} - ({x}) * ({x})))"
    return f"(CASE WHEN {x} >= 0 THEN {r} ELSE 2 - {r} END)"


def _case(x: str, table, last) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {b}::DOUBLE THEN {v}" for b, v in table) + f" ELSE {last} END"


def _interp(anchors, year: str) -> str:
    ys = sorted(anchors)
    parts = [f"WHEN {year} <= {ys[0]} THEN {anchors[ys[0]]}::DOUBLE"]
    parts += [f"WHEN {year} <= {b} THEN {anchors[a]}::DOUBLE + ({anchors[b]} - {anchors[a]}) * ({year} - {a}) / {b - a}::DOUBLE" for a, b in zip(ys, ys[1:])]
    return f"round(CASE {' '.join(parts)} ELSE {anchors[ys[-1]]}::DOUBLE END, 2)"


_SQRT2 = f"{2**0.5!r}::DOUBLE"
_EDF = [(b, i) for i, (_, b) in enumerate(H.RATINGS)]
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in H.RATINGS) + "]"


def _price_steps(scenario: str, years: int, where: str = "") -> str:
    s = R.SCENARIOS[scenario]
    out = [f"y0 AS (SELECT o_orderkey AS path, 2024 AS year, {float(R.interpolated(s['price'], 2024))}::DOUBLE AS price FROM orders {where})"]
    for i in range(1, years):
        y = 2024 + i
        jump = s["shock"][1] if y == s["shock"][0] else 0.0
        out.append(f"y{i} AS (SELECT path, {y} AS year, greatest(10.0::DOUBLE, price * exp({s['drift']}::DOUBLE + 0.3::DOUBLE * ln({float(R.interpolated(s['price'], y))}::DOUBLE / price) + {jump}::DOUBLE - 0.5::DOUBLE * {s['vol'] ** 2!r}::DOUBLE + {s['vol']}::DOUBLE * z)) AS price FROM (SELECT *, {_z('u')} AS z FROM (SELECT *, {_u('path', str(y))} AS u FROM y{i - 1})))")
    return ", ".join(out) + ", pp AS (" + " UNION ALL ".join(f"SELECT * FROM y{i}" for i in range(years)) + ")"


_SEM = (R.HI_T - R.LO_T) / (2 * H.T_BY_DF[R.N_OBS - 1])
_MU = math.log(R.PRICE) - 0.5 * R.LOG_VOL**2
_LIAB = f"""lu AS (SELECT o_orderkey AS path, {_erfc(f"({R.MEAN_T / _SEM!r}::DOUBLE / {_SQRT2})")} / 2 AS below, {", ".join(f"{_u('o_orderkey', str(k))} AS u{k}" for k in range(1, 6))} FROM orders),
lv AS (SELECT path, below + u1 * (1 - below) AS v1, u2, u3, u4, u5 FROM lu),
lw AS (SELECT path, {R.MEAN_T}::DOUBLE + {_SEM!r}::DOUBLE * {_z('v1')} AS t, least(greatest(1 + 0.1::DOUBLE * {_z('u2')}, 0.5), 2.0) AS wind, 0.85::DOUBLE + {R.MASK_HI - R.MASK_LO!r}::DOUBLE * u3 AS mask,
 exp({_MU!r}::DOUBLE + 0.35::DOUBLE * {_z('u4')}) AS price, pow(u5, {1 / R.PASS_A!r}::DOUBLE) AS share FROM lv),
li AS (SELECT *, t * wind * mask * price * share / 1e6 * 28 AS gwp100, t * wind * mask * price * share / 1e6 * 83 AS gwp20 FROM lw)"""
_SLOPE = 0.10 / (4.34 - R.TAU)
SQL = {
    "i10_i21_numbers": f""", n AS (SELECT *, cloud % 130 + 2 AS n, cloud / 200.0::DOUBLE AS p, greatest(cloud / 150.0::DOUBLE - cloud / 250.0::DOUBLE, 0.01) / 3.92::DOUBLE AS sd FROM v_scores), k AS (SELECT *, p * (1 - p) / greatest(sd * sd, 1e-6) - 1 AS k FROM n)
 SELECT event_id, CASE WHEN cloud % 5 > 2 THEN cloud::DOUBLE END AS number, {_interp(R.SCENARIOS['disorderly']['price'], '(2020 + cloud % 35)')} AS price,
 CASE n - 1 {" ".join(f"WHEN {a} THEN {b}" for a, b in H.T_BY_DF.items())} ELSE 1.96::DOUBLE + 1.14::DOUBLE / (n - 1) END::DOUBLE AS t_df, ({_case('n', H.T_BY_N.items(), 1.96)})::DOUBLE AS t_n,
 round(sqrt(cv * cv + CASE WHEN cloud > 50 THEN 0 ELSE sc_cfar * sc_cfar END), 6) AS quad, round({_erfc(f"(-(sc_cfar - 2) / {_SQRT2})")} / 2, 6) AS cdf,
 round(CASE WHEN p >= 1 THEN 10 WHEN p > 0 THEN greatest(p * k, 0.5) END, 4) AS beta_a, round(CASE WHEN p >= 1 THEN 1 WHEN p > 0 THEN greatest((1 - p) * k, 0.5) END, 4) AS beta_b,
 round(CASE WHEN sc_cfar > 0 THEN ln(sc_cfar) - 0.5::DOUBLE * 0.3 * 0.3 END, 6) AS mu FROM k""",
    "i13_i15_merton": f""", i AS (SELECT c_custkey AS id, c_acctbal * 1e6::DOUBLE AS e, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE (c_custkey % 50) * 1e8::DOUBLE END AS d, coalesce(CASE WHEN c_custkey % 11 > 0 THEN (c_custkey % 9 + 1) / 20.0::DOUBLE END, 0.30::DOUBLE) AS v, (c_custkey % 40) * 1e8::DOUBLE AS l FROM customer WHERE c_acctbal > 0),
 a AS (SELECT *, e + d AS a, CASE WHEN d > 0 THEN 0.65::DOUBLE * d ELSE 0.5::DOUBLE * e END AS t, v * e / (e + d) AS s FROM i),
 x AS (SELECT id, (ln(a / t) + (0.03::DOUBLE - s * s / 2)) / s AS d0, (ln(greatest(a - l, t * 0.01::DOUBLE) / t) + (0.03::DOUBLE - s * s / 2)) / s AS d1 FROM a),
 f AS (SELECT *, 50 * {_erfc(f'(d0 / {_SQRT2})')} AS f0, 50 * {_erfc(f'(d1 / {_SQRT2})')} AS f1 FROM x), r AS (SELECT *, {_case('f0', _EDF, 7)} AS r0, {_case('f1', _EDF, 7)} AS r1 FROM f)
 SELECT id, round(d0, 4) AS dd_base, round(d1, 4) AS dd_stressed, round(f0, 4) AS edf_base, round(f1, 4) AS edf_stressed, {_NAMES}[r0 + 1] AS rating_base, {_NAMES}[r1 + 1] AS rating_stressed, CAST(greatest(0, r1 - r0) AS INTEGER) AS notches FROM r""",
    "i14_notches": f""", o AS (SELECT o_orderkey, o_totalprice AS c, CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE (o_orderkey % 97) * 20000.0::DOUBLE END AS e FROM orders), n AS (SELECT o_orderkey, CAST(CASE WHEN e > 0 THEN {_case('c / e', H.NOTCHES, 8)} ELSE 0 END AS INTEGER) AS notches FROM o)
 SELECT o_orderkey, notches, CAST({H.PD_BPS}[least(notches, 14) + 1] AS INTEGER) AS pd_bps, CASE o_orderkey % 3 WHEN 0 THEN 0.45::DOUBLE WHEN 1 THEN 0.60::DOUBLE ELSE 0.40::DOUBLE END AS lgd FROM n""",
    "j1_price_paths": f", {_price_steps('disorderly', 8)} SELECT path, CAST(year AS INTEGER) AS year, round(price, 4) AS price FROM pp",
    "j5_liability_draws": f", {_LIAB} SELECT path, round(t, 3) AS t, round(gwp100, 4) AS gwp100, round(gwp20, 4) AS gwp20 FROM li",
    "j6_risk_metrics": f", {_LIAB}, q AS (SELECT avg(gwp100) AS mean, " + ", ".join(f"quantile_cont(gwp100, {p}) AS {n}" for n, p in (("median", 0.5), ("var_95", 0.95), ("var_99", 0.99), ("p5", 0.05), ("p25", 0.25), ("p75", 0.75))) + " FROM li) SELECT round(mean, 3) AS mean, round(median, 3) AS median, round(var_95, 3) AS var_95, round(var_99, 3) AS var_99, (SELECT round(avg(gwp100), 3) FROM li, q WHERE gwp100 >= var_99) AS es_99, round(p5, 3) AS p5, round(p25, 3) AS p25, round(p75, 3) AS p75 FROM q",
    "j7_tau_sensitivity": f""", u AS (SELECT {_u('o_orderkey', '11')} AS a, {_u('o_orderkey', '12')} AS b, {_u('o_orderkey', '13')} AS c FROM orders), t AS (SELECT least(greatest(3.3406::DOUBLE + 0.7056::DOUBLE * {_z('a')}, 1.15), 6.0) AS tau, exp({_MU!r}::DOUBLE + 0.35::DOUBLE * {_z('b')}) * pow(c, {1 / R.PASS_A!r}::DOUBLE) AS price FROM u),
 r AS (SELECT *, least(greatest(0.252::DOUBLE * CASE WHEN tau > 3.5796 THEN 1 - {_SLOPE!r}::DOUBLE * (tau - 3.5796::DOUBLE) ELSE 1 END, 0.10), 1.0) AS rate FROM t), b AS (SELECT *, 476.0::DOUBLE * 8760 / 1e3 * rate * price / 1e6 AS b FROM r)
 SELECT round(avg(tau), 4) AS tau_mean, round(avg(rate), 3) AS rate_mean, round(avg(b * 28), 3) AS gwp100_mean, round(avg(b * 83), 3) AS gwp20_mean, round(quantile_cont(b * 28, 0.99), 3) AS gwp100_var99, round(quantile_cont(b * 83, 0.99), 3) AS gwp20_var99 FROM b""",
    "j8_combined_uncertainty": f""", r AS (SELECT event_id AS record, (cloud % 40) / 100.0::DOUBLE AS s0, 0.15::DOUBLE AS s1, coalesce(CASE WHEN cloud % 3 > 0 THEN cloud % 20 END, 0) / 100.0::DOUBLE AS s2, cv * 10 / 100 AS s3 FROM v_scores), i AS (SELECT *, unnest(range(200)) AS i FROM r),
 u AS (SELECT *, {", ".join(f"{_u('record', 'i', str(k))} AS u{k}" for k in range(4))} FROM i), f AS (SELECT *, {" * ".join(f"greatest(0.01, 1 + s{k} * {_z(f'u{k}')})" for k in range(4))} AS f FROM u)
 SELECT record, round(avg(f), 4) AS mean, round(stddev_samp(f), 4) AS sd, round(quantile_cont(f, 0.05), 4) AS p5, round(quantile_cont(f, 0.95), 4) AS p95, round(100 * stddev_samp(f) / avg(f), 1) AS mc_pct, round(100 * sqrt(s0*s0 + s1*s1 + s2*s2 + s3*s3), 1) AS quad_pct FROM f GROUP BY record, s0, s1, s2, s3""",
    "j9_variance_shares": f""", g AS (SELECT site, stddev_samp(sc_cfar) / sqrt(count(*)) / avg(sc_cfar) AS x FROM v_scores GROUP BY 1), s AS (SELECT site, 'sampling' AS source, x AS sigma FROM g UNION ALL SELECT site, 'wind', 0.10 FROM g UNION ALL SELECT site, 'mask', {0.15 / math.sqrt(3)!r} FROM g UNION ALL SELECT site, 'price', 0.35 FROM g)
 SELECT site, source, round(sigma, 6) AS sigma, round(sqrt(sum(sigma * sigma) OVER w), 6) AS total, round(sigma / sqrt(sum(sigma * sigma) OVER w), 4) AS share FROM s WINDOW w AS (PARTITION BY site)""",
    "j10_tornado": f", {_LIAB}, k(param, level, k) AS (VALUES " + ", ".join(f"('{n}', '{t}', {v / b!r}::DOUBLE)" for n, b, lo, hi in PARAMETERS for t, v in (("low", lo), ("high", hi))) + "), b AS (SELECT quantile_cont(gwp100, 0.95) AS b FROM li), q AS (SELECT param, level, quantile_cont(gwp100 * k, 0.95) AS v FROM li, k GROUP BY 1, 2) SELECT param, level, round(v, 4) AS var95, round(v - b, 4) AS delta FROM q, b",
    "j11_convergence": f", {_LIAB} SELECT CAST(n AS INTEGER) AS n, round(quantile_cont(gwp100, 0.95), 4) AS var95 FROM (SELECT unnest({SIZES}) AS n), li WHERE path < n GROUP BY n",
    "j12_transition_table": ", g AS (SELECT site, avg(sc_cfar) * 1000 AS mean, min(sc_cfar) * 1000 AS lower, max(sc_cfar) * 1000 AS upper FROM v_scores GROUP BY 1), p(price_case, price) AS (VALUES " + ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in PRICES) + ") SELECT site, price_case, price, round(mean * 28 * price, 0) AS mean, round(lower * 28 * price, 0) AS lower, round(upper * 28 * price, 0) AS upper FROM g, p",
    "j12_i20_stress_table": ", t(tier, s, b) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in TIERS) + "), p AS (SELECT c_custkey AS id, tier, c_acctbal * 500 * (s / 100) AS e, -(c_acctbal * 1000 * (c_custkey % 10 + 1) * 1e-4::DOUBLE) * b AS k FROM customer, t) SELECT id, tier, round(e, 0) AS equity, round(k, 0) AS spread, round(e + k, 0) AS combined FROM p",
}

_AB = "a1 AS (SELECT *, greatest(a, 1.0) AS aa, greatest(b, 1.0) AS bb FROM dr), a2 AS (SELECT *, 1 / (2 * aa - 1) AS pa, 1 / (2 * bb - 1) AS qb, 1 - u1 AS v1 FROM a1), a3 AS (SELECT *, 2 / (pa + qb) AS h, " + _z("v1") + " AS y FROM a2), a4 AS (SELECT *, (y * y - 3) / 6 AS lam FROM a3), a5 AS (SELECT *, y * sqrt(greatest(h + lam, 0.0)) / h - (qb - pa) * (lam + 5 / 6.0::DOUBLE - 2 / (3 * h)) AS w FROM a4)"
_MULT = "CASE year " + " ".join(f"WHEN {y} THEN {float(R.interpolated(R.SCENARIOS['orderly']['multiplier'], y))}::DOUBLE" for y in range(2024, 2024 + YEARS)) + " END"


def finish(site_risk_sql: str) -> None:
    """The draws' SQL builds on that of the site risk."""
    draws = f""", ri AS ({site_risk_sql.replace(", g AS (", "WITH g AS (", 1)}),
 bm AS (SELECT site, p, flow, greatest(p_hi - p_lo, 0.01) / (2 * 1.96::DOUBLE) AS sd FROM ri), bk AS (SELECT *, p * (1 - p) / greatest(sd * sd, 1e-6) - 1 AS k FROM bm),
 bs AS (SELECT site, CASE WHEN p >= 1 THEN 10 WHEN p > 0 THEN greatest(p * k, 0.5) END AS a, CASE WHEN p >= 1 THEN 1 WHEN p > 0 THEN greatest((1 - p) * k, 0.5) END AS b, CASE WHEN flow > 0 THEN ln(flow) - 0.5::DOUBLE * 0.3 * 0.3 END AS mu FROM bk),
 {_price_steps("orderly", YEARS, "")}, dr AS (SELECT bs.*, path, {_u('path', 'site', '1')} AS u1, {_u('path', 'site', '2')} AS u2 FROM bs, y0), {_AB},
 a6 AS (SELECT site, path, coalesce(CASE WHEN b = 1 THEN pow(u1, 1 / a) ELSE aa / (aa + bb * exp(2 * w)) END, 0) * coalesce(exp(mu + 0.3::DOUBLE * {_z('u2')}), 0) * 8760 * 0.85::DOUBLE / 1000 * 29.8::DOUBLE AS t FROM a5 WHERE a IS NOT NULL),
 co AS (SELECT site, path, CAST(year AS INTEGER) AS year, t * price * {_MULT} AS cost FROM a6 JOIN pp USING (path) UNION ALL SELECT site, path, CAST(year AS INTEGER), 0.0 FROM bs, pp WHERE a IS NULL)"""
    term = f"""{draws}, tp AS (SELECT site, path, sum(CASE WHEN year = {2023 + YEARS} THEN cost END) AS t, sum(cost / pow(1.05::DOUBLE, year - 2023)) AS npv FROM co GROUP BY 1, 2),
 tg AS (SELECT site, avg(t) AS mean, quantile_cont(t, 0.95) AS var95, avg(npv) AS npv_mean, quantile_cont(npv, 0.95) AS npv_p95 FROM tp GROUP BY 1), tc AS (SELECT site, avg(t) AS cvar95 FROM tp JOIN tg USING (site) WHERE t >= var95 GROUP BY 1),
 tl AS (SELECT site, round(mean, 2) AS mean, round(var95, 2) AS var95, round(cvar95, 2) AS cvar95, round(npv_mean, 2) AS npv_mean, round(npv_p95, 2) AS npv_p95 FROM tg JOIN tc USING (site))"""
    SQL["j2_site_cost_draws"] = f"{draws} SELECT site, path, year, round(cost, 2) AS cost FROM co"
    SQL["j3_loss_stats"] = f"{draws} SELECT site, year, round(avg(cost), 2) AS mean, round(quantile_cont(cost, 0.5), 2) AS p50, round(quantile_cont(cost, 0.95), 2) AS p95, round(quantile_cont(cost, 0.99), 2) AS p99 FROM co GROUP BY 1, 2"
    SQL["j3_terminal_losses"] = f"{term} SELECT * FROM tl"
    issuers = f"""{term}, si AS (SELECT 'T' || (site % 4) AS ticker, count(*) AS n_sites, sum(mean) AS mean, sum(var95) AS var95, sum(cvar95) AS cvar95, sum(npv_mean) AS npv_mean, sum(npv_p95) AS npv_p95 FROM tl GROUP BY 1),
 ie AS (SELECT 'T' || (site % 4) AS ticker, count(*) * 1e9::DOUBLE AS e FROM v_sites GROUP BY 1), ij AS (SELECT si.*, e, e / 2 AS d, e + e / 2 AS a, 0.65::DOUBLE * (e / 2) AS t, 0.3::DOUBLE * e / (e + e / 2) AS s FROM si JOIN ie USING (ticker)),
 ix AS (SELECT *, (ln(a / t) + (0.03::DOUBLE - s * s / 2)) / s AS d0, (ln(greatest(a - npv_mean, t * 0.01::DOUBLE) / t) + (0.03::DOUBLE - s * s / 2)) / s AS d1 FROM ij), ff AS (SELECT *, 50 * {_erfc(f'(d0 / {_SQRT2})')} AS f0, 50 * {_erfc(f'(d1 / {_SQRT2})')} AS f1 FROM ix),
 ir AS (SELECT *, {_case('f0', _EDF, 7)} AS r0, {_case('f1', _EDF, 7)} AS r1 FROM ff), ino AS (SELECT *, CAST(CASE WHEN ticker <> 'T0' THEN greatest(0, r1 - r0) ELSE {_case('var95 / (e / 1000)', H.NOTCHES, 8)} END AS INTEGER) AS notches FROM ir),
 iss AS (SELECT ticker, 'orderly' AS scenario, n_sites, round(mean, 2) AS mean, round(var95, 2) AS var95, round(cvar95, 2) AS cvar95, round(npv_mean, 2) AS npv_mean, round(npv_p95, 2) AS npv_p95, round(100 * var95 / (e / 1000), 4) AS cost_pct, notches, CAST({H.PD_BPS}[least(notches, 14) + 1] AS INTEGER) AS pd_bps, 0.45::DOUBLE AS lgd,
 round(d0, 4) AS dd_base, round(d1, 4) AS dd_stressed, {_NAMES}[r0 + 1] AS rating_base, {_NAMES}[r1 + 1] AS rating_stressed FROM ino)"""
    SQL["j4_issuer_stress"] = f"{issuers} SELECT * FROM iss"
    SQL["j4_portfolio_stress"] = f"{issuers} SELECT scenario, count(*) AS n_issuers, round(sum(mean), 2) AS mean, round(sum(var95), 2) AS var95, round(sum(cvar95), 2) AS cvar95, round(sum(npv_mean), 2) AS npv_mean FROM iss GROUP BY 1"
