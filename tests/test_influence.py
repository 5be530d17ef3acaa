"""Leave-one-out figures against brute force, ends of the curve, sensor steps, release intervals, state of the calibration, tornado without rows."""

import statistics

import pytest

from plumeledger.operators import influence as I

SCENES = "id int, site string, day date, score double, hit boolean"


def _scenes(spark, rows):
    return spark.createDataFrame(rows, SCENES)


def test_leave_one_out_against_brute_force(spark):
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [(i, "a", day, float(i * 7 % 5), i % 3 > 0) for i in range(23)]  # ties
    rows += [(100 + i, "b", day, 2.0, True) for i in range(4)]  # one value only
    rows += [(200, "c", day, 5.0, True), (201, "c", day, 1.0, False), (202, "c", day, None, True)]  # one hit; a hit without score
    rows += [(300, None, day, 3.0, True), (301, None, day, 4.0, True), (302, None, day, 9.0, None)]  # null group, null flag
    rows += [(400, "d", day, 1.0, False)]  # no hit
    got = {r.id: r for r in I.leave_one_out(_scenes(spark, rows), "site", "score", "hit").collect()}
    used = [r for r in rows if r[3] is not None]
    assert set(got) == {r[0] for r in used if r[4]}
    for i, r in got.items():
        group = [x for x in used if x[1] == r.site]
        hits = [x for x in group if x[4]]
        left = [x[3] for x in hits if x[0] != i]
        rate = len(left) / (len(group) - 1) if left else 0.0
        assert (r.n, r.k, r.loo_rate) == (len(group), len(hits), pytest.approx(rate))
        assert r.delta_rate == pytest.approx(rate - len(hits) / len(group))
        assert r.loo_mean == (pytest.approx(statistics.mean(left)) if left else None)
        assert r.loo_median == (pytest.approx(statistics.median(left)) if left else None)
        full = statistics.mean(x[3] for x in hits)
        assert r.influence_mean == (pytest.approx(abs(full - statistics.mean(left)) / full) if left and full else None)


def test_leave_one_out_without_rows_and_by_month(spark):
    import datetime

    assert I.leave_one_out(_scenes(spark, []), "site", "score", "hit").count() == 0
    assert I.leave_month_out(_scenes(spark, []), "site", "day", "score", "hit").count() == 0
    at = lambda m, d: datetime.date(2024, m, d)
    rows = [(1, "a", at(1, 2), 2.0, True), (2, "a", at(1, 9), 4.0, True), (3, "a", at(1, 11), 8.0, False), (4, "a", at(2, 1), 3.0, True), (5, "a", at(3, 1), 1.0, False), (6, "a", at(4, 1), None, True)]
    got = {r.month.month: r for r in I.leave_month_out(_scenes(spark, rows), "site", "day", "score", "hit").collect()}
    assert {m: (r.n_scenes, r.top, r.n, r.k, r.loo_rate, r.loo_median) for m, r in got.items()} == {1: (2, 4.0, 3, 2, 0.5, 3.0), 2: (1, 3.0, 3, 2, 0.5, 4.0)}


def test_roc_points_have_both_ends(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, -1.0), (1, None), (None, 0.7), (3, 0.7)], "y int, score double")
    got = [(r.threshold, r.tp, r.fp, r.fn, r.tn, round(r.precision, 4), round(r.f1, 4)) for r in I.roc_points(df).orderBy("threshold").collect()]
    assert got == [(-1.0, 2, 2, 0, 0, 0.5, 0.6667), (0.0, 2, 1, 0, 1, 0.6667, 0.8), (0.5, 2, 1, 0, 1, 0.6667, 0.8), (0.9, 1, 0, 1, 2, 1.0, 0.6667), (1.9, 0, 0, 2, 2, 0.0, 0.0)]
    assert I.roc_points(df.where("y = 5")).count() == 0
    zero = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, score double")  # a score of 0 is not doubled
    assert sorted(r.threshold for r in I.roc_points(zero).collect()) == [0.0, 1.0, 2.0]


def test_sensor_steps(spark):
    df = spark.createDataFrame([(1.15, 5.0), (1.2, 4.0), (1.1, 9.0), (None, 9.0), (2.0, None)], "score double, enhancement double")
    got = {(r.parameter, round(r.value, 2)): (r.n_base, r.n, r.change_pct) for r in I.sensor_sensitivity(df, [-0.05, 0.05], [-1.0, 1.0]).collect()}
    assert got == {("score", 1.1): (3, 4, 33.3), ("score", 1.2): (3, 2, -33.3), ("enhancement", 4.0): (1, 2, 100.0), ("enhancement", 6.0): (1, 0, -100.0)}
    assert [r.n for r in I.sensor_sensitivity(df.where("false"), [0.1], []).collect()] == [0]


def test_release_intervals(spark):
    rows = [("low", "ok", True, True, 100.0, 120.0), ("low", "ok", True, False, 100.0, 200.0), ("low", "ok", False, True, 100.0, 5.0), ("high", "failed", True, True, 1.0, 1.0), (None, "ok", True, True, 50.0, 50.0), ("mid", "ok", True, False, None, 9.0)]
    df = spark.createDataFrame(rows, "regime string, status string, quantified boolean, detected boolean, truth double, estimate double")
    got = {r.regime: r for r in I.release_table(df).collect()}
    assert set(got) == {None, "low"}  # a regime without a measured row is left out
    assert (got["low"].n_scenes, got["low"].n_quantified, got["low"].rate, got["low"].bias, got["low"].ci80) == (3, 2, 0.667, 60.0, 0.5)
    assert (got[None].n_scenes, got[None].n_quantified, got[None].ci80) == (6, 3, 0.667)
    assert I.release_table(df.where("false")).count() == 0


def test_state_of_the_calibration(spark):
    df = spark.createDataFrame([("ok", 1.0, "alps"), ("ok", 2.0, None), ("ok", None, "alps"), ("failed", 3.0, "alps"), (None, 1.0, "alps")], "status string, sc_cfar double, ecoregion string")
    stored = lambda rows: spark.createDataFrame(rows, "n long")
    got = {(r.section, r.value): r.n for r in I.calibration_state(df, stored([(1,), (0,)])).collect()}
    assert got == {("state", "all"): 5, ("state", "ok"): 3, ("state", "valid"): 2, ("state", "no_score"): 1, ("state", "failed"): 2, ("stale", "new_scores"): 1, ("ecoregion", "alps"): 1, ("ecoregion", "unknown"): 1}
    assert {r.n for r in I.calibration_state(df, stored([(9,)])).where("section = 'stale'").collect()} == {0}
    assert {r.n for r in I.calibration_state(df, stored([])).where("section = 'stale'").collect()} == {2}


def test_tornado_of_one_site(spark):
    paths = spark.range(50).withColumnRenamed("id", "path")
    scores = spark.createDataFrame([(1, "ok", 5.0, 0.1), (1, "ok", 1.0, 0.1), (1, "failed", 9.0, 0.1), (1, "ok", None, 0.1)], "site int, status string, sc_cfar double, cv double")
    rows = {(r.parameter, r.level): r for r in I.portfolio_tornado(paths, scores, years=3, parameters=[("price_eur", 65.0, 32.5, 130.0), ("discount_rate", 0.03, 0.0, 0.5), ("cfar_k", 3.0, 2.9, 3.1)]).collect()}
    low, high = rows["price_eur", "low"], rows["price_eur", "high"]
    assert high.var95 == pytest.approx(4 * low.var95, rel=1e-6) and high.delta_var95 == pytest.approx(-2 * low.delta_var95, rel=1e-4)
    assert rows["discount_rate", "high"].delta_var95 == 0 and rows["discount_rate", "high"].delta_npv < 0 < rows["discount_rate", "low"].delta_npv
    assert rows["cfar_k", "low"].delta_var95 == 0  # neither threshold lies between the scores
    assert {n: r.place for (n, _), r in rows.items()} == {"price_eur": 1, "discount_rate": 2, "cfar_k": 2}
    assert I.portfolio_tornado(paths.where("false"), scores, years=3).count() == 0


def test_percentiles_of_draws_are_exact_and_stand_empty_tables(spark):
    import numpy as np

    from plumeledger.operators import risk

    v = [float(i * 37 % 101 // 3) for i in range(101)]  # ties
    d = spark.createDataFrame([(i, x, "a", 2024 + i % 2) for i, x in enumerate(v)], "path long, cost double, site string, year int")
    m = risk.risk_metrics(d, "cost").first()
    assert (m.median, m.var_95, m.var_99, m.p25) == tuple(pytest.approx(np.percentile(v, p), abs=1e-3) for p in (50, 95, 99, 25))
    assert m.es_99 == pytest.approx(np.mean([x for x in v if x >= np.percentile(v, 99)]), abs=1e-3)
    assert {r.n: r.var95 for r in risk.convergence(d, "cost", [10, 50]).collect()} == {n: pytest.approx(np.percentile(v[:n], 95), abs=1e-4) for n in (10, 50)}
    got = {r.year: r.p95 for r in risk.loss_stats(d, ["site"]).collect()}
    assert got == {y: pytest.approx(np.percentile([x for i, x in enumerate(v) if i % 2 == y - 2024], 95), abs=1e-2) for y in (2024, 2025)}
    t = risk.terminal_losses(d.withColumn("year", d.year * 0 + 2024), ["site"]).first()
    assert (t.site, t.var95) == ("a", pytest.approx(np.percentile(v, 95), abs=1e-2))
    none = d.where("false")
    assert risk.risk_metrics(none, "cost").first().median is None and risk.loss_stats(none, ["site"]).count() == 0 and risk.terminal_losses(none, ["site"]).count() == 0
    assert [r.var95 for r in risk.convergence(none, "cost", [10]).collect()] == [None]
