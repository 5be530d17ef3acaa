"""Credit and liability arithmetic as Column expressions: normal distribution, distance to default, ratings, notches, draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Greatest default frequency in per cent of each rating, best first.
RATINGS = [("Aaa", 0.02), ("Aa", 0.06), ("A", 0.19), ("Baa", 0.59), ("Ba", 1.90), ("B", 6.00), ("Caa", 20.0), ("Ca/C", 100.0)]

# Notches of a downgrade by the greatest share of earnings that a carbon cost takes; beyond the last share the last number.
NOTCHES = [(0.01, 0), (0.03, 1), (0.05, 2), (0.10, 3), (0.20, 5), (1.00, 8)]

# Default probability in basis points by notches.
PD_BPS = [1, 2, 3, 5, 8, 12, 18, 30, 50, 80, 130, 200, 350, 600, 1000]

# Loss given default by scenario, and elsewhere.
LGD = {"orderly": 0.45, "disorderly": 0.60}
LGD_ELSEWHERE = 0.40

# Two-sided 95 % points of Student's t by degrees of freedom.
T_BY_DF = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086,
    21: 2.080, 22: 2.074, 23: 2.069, 24: 2.064, 25: 2.060, 26: 2.056, 27: 2.052, 28: 2.048, 29: 2.045, 30: 2.042,
}

# The coarser table, by number of observations; the next listed number counts, 1.96 beyond the last.
T_BY_N = {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776, 6: 2.571, 7: 2.447, 8: 2.365, 9: 2.306, 10: 2.262, 15: 2.145, 20: 2.093, 25: 2.064, 30: 2.045, 40: 2.021, 60: 2.000, 120: 1.980}

RISK_FREE = 0.03


def _steps(x: Column, table: list[tuple], last) -> Column:
    """The value of the first entry (bound, value) whose bound x does not exceed."""
    out = F.lit(last)
    for bound, value in reversed(table):
        out = F.when(x <= bound, value).otherwise(out)
    return out


def let(x: Column, body) -> Column:
    """body(x) with x worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def erfc(x: Column) -> Column:
    """Complementary error function, to 1.2e-7 of its value everywhere (rational approximation in 1 / (1 + |x| / 2))."""
    # Coefficients of the polynomial, constant first.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]

    def tail(x: Column, t: Column) -> Column:
        p = F.lit(c[-1])
        for k in reversed(c[:-1]):
            p = k + t * p
        return t * F.exp(p - x * x)

    return let(x, lambda x: let(let(1 / (1 + F.abs(x) / 2), lambda t: tail(x, t)), lambda r: F.when(x >= 0, r).otherwise(2 - r)))


def normal_cdf(x: Column) -> Column:
    return erfc(-x / 2**0.5) / 2


def normal_point(u: Column) -> Column:
    """Standard normal quantile of u in (0, 1), to 4.5e-4 (rational approximation of the tail)."""
    size = lambda t: t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return let(u, lambda u: let(F.sqrt(-2 * F.log(F.least(u, 1 - u))), size) * F.when(u > 0.5, 1.0).otherwise(-1.0))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys (whole numbers from 0) alone, so a draw is the same however the rows lie.

    Multiplications modulo 2^31 - 1 with squares between them; every step stays within 64 bits.
    """
    m = F.lit(2_147_483_647).cast("long")
    x = F.lit(20_231).cast("long")
    for k in keys:
        x = F.pmod((x + F.pmod(k.cast("long"), m) + 1) * 48_271, m)
        x = F.pmod((let(x, lambda y: F.pmod(y * y + 7, m)) + 11) * 69_621, m)
    return (x + 0.5) / 2_147_483_647.0


def uniforms(*keys) -> np.ndarray:
    """uniform() of arrays of whole numbers, the same numbers."""
    m, x = 2_147_483_647, np.int64(20_231)
    for k in keys:
        x = (x + np.mod(k, m) + 1) * 48_271 % m
        x = ((x * x + 7) % m + 11) * 69_621 % m
    return (x + 0.5) / 2_147_483_647.0


def normal_points(u: np.ndarray) -> np.ndarray:
    """normal_point() of an array."""
    t = np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    t = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return np.where(u > 0.5, t, -t)


def default_frequency(distance: Column) -> Column:
    """Per cent."""
    return 50 * erfc(distance / 2**0.5)


def distance_to_default(assets: Column, threshold: Column, sigma: Column, years: float = 1.0) -> Column:
    """-10 where the assets or the threshold are not positive."""
    d = (F.log(assets / threshold) + (RISK_FREE - sigma * sigma / 2) * years) / (sigma * years**0.5)
    return F.when((assets > 0) & (threshold > 0), d).otherwise(-10.0)


def merton(equity: Column, debt: Column, volatility: Column, liability: Column) -> dict[str, Column]:
    """Distance, default frequency, rating and its index before and after a liability, and the notches between, 0 at least.

    Nulls take the defaults 5e9, 5e9 and 0.30. Assets are equity and debt; the threshold is 0.65 of the debt, or half the
    equity where there is no debt; the assets' volatility is the equity's less the leverage. After the liability
    a hundredth of the threshold is left at least.
    """
    e, d, v = F.coalesce(equity, F.lit(5e9)), F.coalesce(debt, F.lit(5e9)), F.coalesce(volatility, F.lit(0.30))
    assets, threshold = e + d, F.when(d > 0, 0.65 * d).otherwise(0.5 * e)
    sigma = v * e / assets
    before = distance_to_default(assets, threshold, sigma)
    after = distance_to_default(F.greatest(assets - liability, threshold * 0.01), threshold, sigma)
    f0, f1 = default_frequency(before), default_frequency(after)
    return {
        "dd_base": before, "dd_stressed": after, "edf_base": f0, "edf_stressed": f1, "rating_base": rating_of(f0), "rating_stressed": rating_of(f1),
        "notches": F.greatest(F.lit(0), rating_index(f1) - rating_index(f0)),
    }


def rating_of(edf_pct: Column) -> Column:
    return F.when(edf_pct.isNotNull(), _steps(edf_pct, [(b, n) for n, b in RATINGS], RATINGS[-1][0]))


def rating_index(edf_pct: Column) -> Column:
    return F.when(edf_pct.isNotNull(), _steps(edf_pct, [(b, i) for i, (_, b) in enumerate(RATINGS)], len(RATINGS) - 1))


def notches(cost: Column, earnings: Column) -> Column:
    """Notches by the share of earnings that a cost takes; 0 where earnings are not positive or unknown."""
    return F.when(earnings > 0, _steps(cost / earnings, NOTCHES, NOTCHES[-1][1])).otherwise(0)


def pd_bps(notch: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PD_BPS)), F.least(notch, F.lit(len(PD_BPS) - 1)).cast("int") + 1)


def lgd_of(scenario: Column) -> Column:
    out = F.lit(LGD_ELSEWHERE)
    for k, v in LGD.items():
        out = F.when(scenario == k, v).otherwise(out)
    return out


def t_by_df(df: Column) -> Column:
    """The table's point; beyond it 1.96 + 1.14 / df."""
    points = F.create_map(*[F.lit(x) for kv in T_BY_DF.items() for x in kv])
    return F.coalesce(F.try_element_at(points, df.cast("int")), 1.96 + 1.14 / df)


def t_by_n(n: Column) -> Column:
    return _steps(n, list(T_BY_N.items()), 1.96)


def interp_path(year: Column, anchors: dict[int, float]) -> Column:
    """Linear between anchor years, flat outside them, two places (half up)."""
    ys = sorted(anchors)
    out = F.lit(float(anchors[ys[-1]]))
    for a, b in reversed(list(zip(ys, ys[1:]))):
        out = F.when(year <= b, anchors[a] + (anchors[b] - anchors[a]) * (year - a) / float(b - a)).otherwise(out)
    return F.round(F.when(year <= ys[0], float(anchors[ys[0]])).otherwise(out), 2)


def quadrature(*sigmas: Column) -> Column:
    """Root of the sum of squares, nulls and NaN as 0."""
    total = F.lit(0.0)
    for s in sigmas:
        x = F.nanvl(F.coalesce(s.cast("double"), F.lit(0.0)), F.lit(0.0))
        total = total + x * x
    return F.sqrt(total)


def safe_float(text: Column) -> Column:
    """The finite number that a text has; null for what is none, NaN and infinities."""
    x = text.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def carbon_exposure(t_ch4: Column, gwp: float, price: Column) -> Column:
    return t_ch4 * gwp * price


def cr01(notional: Column, duration: Column) -> Column:
    return notional * duration * 1e-4


def spread_pnl(notional: Column, duration: Column, bp: Column) -> Column:
    return -cr01(notional, duration) * bp


def equity_pnl(notional: Column, shock_pct: Column) -> Column:
    return notional * (shock_pct / 100.0)


def beta_moments(p: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """(a, b) of the beta distribution of mean p whose deviation is that of the 95 % interval; 0.5 each at least. (10, 1) where p is 1 or more; null where it is 0."""
    sd = F.greatest(hi - lo, F.lit(0.01)) / (2 * 1.96)
    k = p * (1 - p) / F.greatest(sd * sd, F.lit(1e-6)) - 1
    of = lambda m, sure: F.when(p >= 1, sure).when(p > 0, F.greatest(m * k, F.lit(0.5)))
    return of(p, 10.0), of(1 - p, 1.0)


def lognormal_mu(mean: Column, sigma: float) -> Column:
    """Mean of the logarithm of a lognormal variable of this mean; null where it is not positive."""
    return F.when(mean > 0, F.log(mean) - 0.5 * sigma * sigma)
