"""Steps whose work must not grow faster than their rows, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeledger.functions import hazard as H
from plumeledger.functions import running
from plumeledger.operators import assessments as A
from plumeledger.operators import risk as R


def plan(df):
    return df._jdf.queryExecution().toString()


def test_only_bins_of_a_place_are_ranked(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, rng.choice([-1, 1]) * math.exp(rng.gauss(0, 4))) for g in ("a", None) for _ in range(4000)]
    rows += [("flat", 7.0)] * 50 + [("wide", v) for v in (float("-inf"), -1.0, 0.0, 1e-300, 5.0, float("inf"))] + [("one", -2.5), ("none", None)]
    ranked, plain = [], running.running_totals
    monkeypatch.setattr(running, "running_totals", lambda df, *a, **k: ranked.append(df.count()) or plain(df, *a, **k))
    got = {r.g: r for r in running.order_statistics(spark.createDataFrame(rows, "g string, v double"), "v", {"p5": "1 + (n - 1) * 0.05D", "p50": "1 + (n - 1) * 0.5D", "p99": "1 + (n - 1) * 0.99D"}, "g").collect()}
    assert ranked[-1] < 500  # of 8,008 values
    assert set(got) == {"a", None, "flat", "wide", "one"}
    for g in ("a", None, "flat", "one"):
        v = [x for h, x in rows if h == g]
        assert got[g].n == len(v)
        for share, name in ((5, "p5"), (50, "p50"), (99, "p99")):
            assert got[g][name] == pytest.approx(np.percentile(v, share))
    assert (got["wide"].n, got["wide"].p50) == (6, pytest.approx(5e-301))


def test_combined_uncertainty_without_a_row_a_draw(spark):
    rows = [(5, 20.0, 15.0, None, 3.0), (6, 0.0, 0.0, 0.0, 0.0), (6, 0.0, 0.0, 0.0, 0.0), (7, 300.0, 15.0, 2.0, float("nan")), (7, 300.0, 15.0, 2.0, float("nan")), (None, 1.0, 1.0, 1.0, 1.0)]
    df = R.combined_uncertainty(spark.createDataFrame(rows, "record long, wind double, coeff double, mask double, background double"), None, 40)
    assert "Generate" not in plan(df)
    got = {r.record: r for r in df.collect()}
    u = spark.range(40).select(*[H.uniform(F.lit(7), F.col("id"), F.lit(k)).alias(f"u{k}") for k in range(4)])
    u = [list(r) for r in u.select(*[H.normal_point(F.col(c)).alias(c) for c in u.columns]).collect()]
    f = 2 * [math.prod(max(0.01, 1 + s * z) for s, z in zip((3.0, 0.15, 0.02, 0.0), r)) for r in u]
    assert (got[7].mean, got[7].sd) == (pytest.approx(np.mean(f), abs=6e-5), pytest.approx(np.std(f, ddof=1), abs=6e-5))
    assert (got[7].p5, got[7].p95) == (pytest.approx(np.percentile(f, 5), abs=6e-5), pytest.approx(np.percentile(f, 95), abs=6e-5))
    assert (got[6].mean, got[6].sd, got[6].quad_pct, got[None].mean, len(got)) == (1.0, 0.0, 0.0, None, 4)


def test_leakage_windows_run_over_days(spark):
    rng = random.Random(5)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(60))
    e = [(rng.choice([1, 2, None]), day() if rng.random() > 0.1 else None, i) for i in range(300)] + [(3, day(), 300)]
    t = [(rng.choice([1, 2, None]), day() if i else None) for i in range(9)]
    df = A.leakage(spark.createDataFrame(e, "site int, day date, id int"), spark.createDataFrame(t, "site int, day date"), 5)
    assert "unboundedfollowing" not in plan(df).lower()
    got = {r.id: (r.nearest, r.leak) for r in df.collect()}
    assert len(got) == 301
    for site, d, i in e:
        gaps = [abs((d - x).days) for s, x in t if s == site and x and d]
        assert got[i] == (min(gaps, default=None), bool(gaps) and min(gaps) < 5)


def test_draws_are_not_joined(spark):
    sites = spark.createDataFrame([(s, "T", 0.3, 0.2, 0.4, 20.0) for s in range(3)] + [(9, "T", 0.0, 0.0, 0.1, 5.0)], "site int, ticker string, p double, p_lo double, p_hi double, flow double")
    paths = spark.range(50).withColumnRenamed("id", "path")
    d = R.site_cost_draws(paths, sites, "disorderly", 4)
    assert "SortMergeJoin" not in plan(d)
    rows = d.collect()
    assert len(rows) == 800 and all(r.cost == 0 for r in rows if r.site == 9) and {r.year for r in rows} == {2024, 2025, 2026, 2027}
    prices = {(r.path, r.year): r.price for r in R.price_paths(paths, "disorderly", 4).collect()}
    cost = {(r.site, r.path, r.year): r.cost for r in rows}
    mult = {y: R.interpolated(R.SCENARIOS["disorderly"]["multiplier"], y) for y in range(2024, 2028)}
    for s, p, y in cost:
        assert cost[s, p, y] / (prices[p, y] * mult[y]) == pytest.approx(cost[s, p, 2024] / (prices[p, 2024] * mult[2024]))


def test_tornado_holds_no_state_of_all_draws(spark):
    df = R.tornado(spark.range(500).withColumnRenamed("id", "path"), [("price", 70.0, 35.0, 140.0)])
    assert "percentile(" not in plan(df)
    v = [r.gwp100 for r in R.liability_draws(spark.range(500).withColumnRenamed("id", "path")).collect()]
    got = {r.level: r for r in df.collect()}
    base = np.percentile(v, 95)
    assert (got["low"].var95, got["high"].delta) == (pytest.approx(base / 2, abs=1e-4), pytest.approx(base, abs=1e-4))


def test_tornado_draws_are_arrays_and_paths_are_dealt_out(spark, monkeypatch):
    from plumeledger.operators import influence as I

    plans, plain = {}, I.kept
    monkeypatch.setattr(I, "TASK_DRAWS", 2500)  # of 9,000
    monkeypatch.setattr(I, "kept", lambda df, name: plans.update({name: plan(df)}) or plain(df, name))
    rows = [(s, "ok", 1.0 + (i * 7 % 11) / 4 if s == 1 else 4.0 if s == 2 else 1.0, 0.1) for s in (1, 2, 3, None) for i in range(12)]  # some, all and no detections; an unknown site
    scores = spark.createDataFrame(rows, "site int, status string, sc_cfar double, cv double")
    known = spark.range(3000).select(F.col("id").alias("path"))
    paths = known.unionAll(spark.sql("select cast(null as bigint) from range(500)")).coalesce(1)  # unknown paths are no draws, as in the SQL
    got = {(r.parameter, r.level): r for r in I.portfolio_tornado(paths, scores, years=1).collect()}
    assert "MapInArrow" in plans["tornado-bins"] and "RoundRobinPartitioning(4)" in plans["tornado-bins"] and "Generate inline" not in plans["tornado-bins"]
    d = I._detections(scores.where("site is not null"), [(1.15, 3.0)])
    a, b = H.beta_moments(F.col("p"), F.col("p_lo"), F.col("p_hi"))
    d = R.drawn(known.crossJoin(d.select("site", a.alias("a"), b.alias("b"), H.lognormal_mu(F.col("flow"), 0.3).alias("mu"))))
    share, flow = F.coalesce(R.beta_point(F.col("u1"), F.col("y1"), F.col("a"), F.col("b")), F.lit(0.0)), F.coalesce(F.exp(F.col("mu") + 0.3 * F.col("z2")), F.lit(0.0))
    t = d.select("site", (share * flow * 8760 * 0.85 / 1000 * 29.8 * 65).alias("t")).toPandas().groupby("site").t
    assert len(t) == 3 and t.mean().min() == 0
    var95, npv = t.quantile(0.95).sum(), t.mean().sum() / 1.03
    wind = got["wind", "high"]
    assert (wind.var95, wind.npv, wind.delta_npv) == (pytest.approx(1.3 * var95, rel=1e-6), pytest.approx(1.3 * npv, rel=1e-6), pytest.approx(0.3 * npv, rel=1e-6))


def test_bins_of_arrays(spark):
    v = [0.0, -0.0, 1e-300, 0.3, 1.0, 7.5, 1e300, -2.5, -1e-9, float("inf"), float("-inf"), float("nan")]
    want = [r.b for r in spark.createDataFrame([(x,) for x in v], "v double").select(running._bin(F.col("v")).alias("b")).collect()]
    assert running.bins_of(np.array(v)).tolist() == want
