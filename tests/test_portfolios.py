"""Governance, portfolios, inventories and co-detected months: unknown values, ties, repeats and empty tables."""

import datetime
import math

import pytest

from plumeledger.operators import portfolios as P

RECORD = "id int, wind_source string, era5_offset_h double, bitemporal_missing boolean, cloud double, cloud_quality string, solar_zenith double, sigma_wind double, sigma_coeff double, sigma_mask double, sigma_background double, flow double"


def test_governance_marks(spark):
    rows = [
        (1, None, None, None, None, None, None, None, None, None, None, 100.0),
        (2, "CLIMATOLOGICAL", -4.5, True, 15.0, "clear", 70.5, 20.0, 15.0, float("nan"), None, 100.0),
        (3, "ERA5", 4.0, False, 15.1, None, 70.0, 20.0, 15.0, 0.0, 0.0, 0.0),
        (4, "ERA5", -4.1, False, 1.0, "partly_cloudy", None, 20.0, 15.0, 0.0, 0.0, None),
    ]
    df = P.inflated(P.degradation(spark.createDataFrame(rows, RECORD)), 400)
    got = {r.id: r for r in df.collect()}
    assert len(got) == 4
    assert got[1].input_degradation.flags == [] and not got[1].governance_sigma_inflated and got[1].governance_inflated is None
    two = got[2]
    assert two.input_degradation.flags == ["WIND_FALLBACK", "BITEMPORAL_MISSING", "SOLAR_ZENITH_EXTREME", "ERA5_STALE"]
    assert (two.input_degradation.delta_sigma_wind_pp, two.input_degradation.delta_sigma_mask_pp, two.input_degradation.delta_sigma_coeff_pp) == (30.0, 15.0, 5.0)
    assert not two.exclude_from_aggregates
    i = two.governance_inflated
    assert (i.effective_sigma_wind, i.effective_sigma_coeff, i.effective_sigma_mask, i.effective_sigma_background) == (50.0, 20.0, 15.0, 0.0)
    assert i.quad_pct == round(100 * math.sqrt(0.5**2 + 0.2**2 + 0.15**2), 1)
    assert i.lo == pytest.approx(100 * i.p5, abs=0.01) and i.lo < 100 < i.hi and i.mc_pct == pytest.approx(i.quad_pct, rel=0.25)
    assert got[3].input_degradation.flags == ["CLOUD_FRACTION_HIGH"] and got[3].exclude_from_aggregates and got[3].governance_inflated.lo is None
    assert got[4].input_degradation.flags == ["CLOUD_FRACTION_HIGH", "ERA5_STALE"] and got[4].input_degradation.delta_sigma_wind_pp == 10.0
    assert P.inflated(P.degradation(spark.createDataFrame([], RECORD)), 10).count() == 0


def test_equal_uncertainties_have_equal_draws(spark):
    rows = [(i, "fallback", None, None, None, None, None, 20.0, 15.0, 0.0, 0.0, 10.0) for i in range(5)]
    got = P.inflated(P.degradation(spark.createDataFrame(rows, RECORD)), 100).collect()
    assert len(got) == 5 and len({tuple(r.governance_inflated) for r in got}) == 1


RISK = "site int, tier string, n_valid long, p double, t_co2e double, t_lo double, t_hi double, eur double, eur_lo double, eur_hi double"


def test_portfolio_of_repeats_unknown_and_unmatched(spark):
    tickers = spark.createDataFrame([("A",), ("A",), ("B",), ("Z",), (None,)], "ticker string")
    sites = spark.createDataFrame([("A", 2), ("A", 1), ("A", 1), ("B", 3), ("B", None), ("C", 1), (None, 1)], "ticker string, site int")
    risk = spark.createDataFrame([(1, "LOW", 4, 0.1, 10.0, 5.0, 15.0, 650.0, 325.0, 975.0), (2, "HIGH", 4, 0.7, 1.5, 1.0, None, 98.0, 65.0, None)], RISK)
    m = P.portfolio_members(tickers, sites, risk)
    assert sorted((r.ticker, r.site, r.tier) for r in m.where("site is not null").collect()) == [("A", 1, "LOW"), ("A", 2, "HIGH"), ("B", 3, "NO_DATA")]
    b = P.portfolio_by_ticker(m, nested=True)
    got = {r.ticker: r for r in b.collect()}
    assert set(got) == {"A", "B", "Z"}
    assert (got["A"].n_sites, got["A"].t_co2e, got["A"].t_hi, got["A"].eur, got["A"].tier, [x.site for x in got["A"].sites]) == (2, 11.5, 15.0, 748.0, "HIGH", [1, 2])
    assert (got["B"].tier, got["B"].eur, got["B"].matched) == ("NO_DATA", 0.0, True)
    assert (got["Z"].tier, got["Z"].sites, got["Z"].matched) == (None, [], False)
    t = P.portfolio_total(b).first()
    assert (t.n_tickers, t.n_unmatched, t.coverage_pct, t.t_co2e) == (3, 1, 66.7, 11.5)
    e = P.portfolio_total(P.portfolio_by_ticker(P.portfolio_members(tickers.where("false"), sites, risk))).first()
    assert (e.n_tickers, e.coverage_pct, e.eur) == (0, 0.0, 0.0)


def test_flow_against_several_inventories(spark):
    day = lambda m, d=1: datetime.date(2024, m, d)
    monthly = spark.createDataFrame([(1, day(2, 9), 143.0), (1, day(3), None), (2, day(2), 10.0)], "site int, month date, flow double")
    inv = spark.createDataFrame([("x", 1, day(2, 5), 60.0), ("x", 1, day(2, 20), 40.0), ("y", 1, day(2), 500.0), ("x", 1, day(3), 1.0)], "name string, site int, month date, tonnes double")
    got = {(r.site, r.month.month, r.name): r for r in P.flow_against_inventory(monthly, inv).collect()}
    assert set(got) == {(1, 2, "x"), (1, 2, "y"), (1, 3, "x"), (2, 2, None)}
    x = got[1, 2, "x"]
    assert x.tonnes == pytest.approx(143 * 24 * 29 / 1000) and x.inventory == 100.0 and x.within and not got[1, 2, "y"].within
    assert got[1, 3, "x"].tonnes is None and got[1, 3, "x"].within is None and got[2, 2, None].inventory is None
    assert P.flow_against_inventory(monthly.where("false"), inv).count() == 0


def test_co_detected_months(spark):
    day = datetime.date
    s = lambda rows: spark.createDataFrame(rows, "site int, day date")
    a = s([(1, day(2024, 1, 1)), (1, day(2024, 1, 30)), (1, day(2024, 2, 1)), (None, day(2024, 1, 1)), (2, None)])
    b = s([(1, day(2024, 1, 15)), (1, day(2023, 2, 1)), (2, day(2024, 1, 1))])
    assert [tuple(r) for r in P.co_detected_months(a, b).collect()] == [(1, day(2024, 1, 1))]
    assert P.co_detected_months(a).count() == 2 and P.co_detected_months(a, b, s([])).count() == 0
