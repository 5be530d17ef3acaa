import math
import random

import pytest

from plumeledger.operators import detection as D
from plumeledger.operators import reports as R
from plumeledger.operators import retrievals as T
from plumeledger.operators import soundings as N
from plumeledger.sources import stores

PX = "scene int, row int, col int, b11 double, b12 double, prob double"


def test_owners(spark):
    a = spark.createDataFrame([(1, " acme "), (2, None), (3, " "), (4, "Zed"), (4, "Zed"), (5, "ACME")], "id int, owner string")
    e = spark.createDataFrame([("Acme", "B", "T2", "X"), ("acme", "A", "T1", None), (None, "N", "N", "N"), ("", "N", "N", "N")], "owner string, operator string, ticker string, exchange string")
    got = sorted(map(tuple, R.resolve_entity(a, e).select("id", "subsidiary", "operator", "ticker").collect()))
    assert got == [(1, "acme", "A", "T1"), (2, "Unknown", "Unknown", None), (3, "Unknown", "Unknown", None), (4, "Zed", "Unknown", None), (4, "Zed", "Unknown", None), (5, "ACME", "A", "T1")]
    assert R.resolve_entity(a.limit(0), e).count() == 0 and R.resolve_entity(a, e.limit(0)).count() == 6


def test_write_back_keeps_what_has_no_result(spark):
    rec = spark.createDataFrame([("a", (1.0,)), ("b", (2.0,)), (None, None), ("c", None)], "scene_id string, uncertainty struct<sigma: double>")
    res = spark.createDataFrame([("a", 1, "ok", 5.0), ("a", 2, "ok", 6.0), ("a", 3, "failed", 7.0), ("b", 1, None, 8.0), (None, 1, "ok", 9.0)], "scene_id string, seq int, status string, sigma double")
    got = {r.scene_id: r.uncertainty and r.uncertainty.sigma for r in R.write_back_uncertainty(rec, res, ["sigma"]).collect()}
    assert got == {"a": 6.0, "b": 2.0, None: None, "c": None}
    assert [r.uncertainty for r in R.write_back_uncertainty(rec.drop("uncertainty"), res.limit(0), ["sigma"]).collect()] == [None] * 4


def test_rank_counts_greater_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, -3.0, -1.5, 0.0, 1.5, 2.0, rng.uniform(-5, 5)])) for i in range(300)]
    got = [(r.id, r["rank"]) for r in R.ranked(spark.createDataFrame(rows, "id int, v double"), "v", absolute=True).collect()]
    want = {i: None if v is None else 1 + sum(w is not None and abs(w) > abs(v) for _, w in rows) for i, v in rows}
    assert dict(got) == want
    known = [k for _, k in got if k is not None]
    assert known == sorted(known) and got[len(known) :] == [(i, None) for i, _ in got[len(known) :]]


def test_site_summary_and_recovery_of_odd_rows(spark):
    s = "site int, acq_date date, sc_cfar double, cfar_detect boolean, status string, flow double"
    import datetime as dt

    d = dt.date
    rows = [(1, d(2024, 1, 3), 5.0, True, "ok", 100.0), (1, d(2024, 1, 9), 4.0, True, "ok", 300.0), (1, d(2024, 2, 1), None, None, "ok", None), (1, d(2024, 3, 1), 9.0, True, None, 50.0), (2, None, 9.0, False, "ok", 10.0)]
    x = spark.createDataFrame(rows, s)
    inv = spark.createDataFrame([(1, 2024, 10.0), (1, 2024, 5.5), (1, 2023, -1.0), (3, 2024, 4.0)], "site int, year int, quantity double")
    pl = spark.createDataFrame([(1, d(2024, 1, 20)), (1, d(2024, 2, 20))], "site int, date date")
    got = {r.site: r for r in R.site_summary(x, 2.5, inv, pl).collect()}
    one = got[1]
    assert (one.processed, one.valid, one.detected, one.above_tau, one.cfar_pass, one.observed_months, one.detection_months, one.co_detected_months) == (3, 3, 2, 2, 2, 2, 1, 1)
    assert one.mean_enhancement == 4.5 and [tuple(y) for y in one.inventory_by_year] == [(2024, 15.5)]
    assert (got[2].observed_months, got[2].detection_rate, got[2].co_detected_months, got[2].inventory_by_year) == (0, 0.0, 0, [])
    rec = {r.site: r for r in R.recovery_ratio(x, inv, 2.5).collect()}
    half = 1.96 * math.sqrt(20000) / math.sqrt(2)
    assert rec[1].annual_t == pytest.approx(1752.0) and rec[1].ratio_pct == pytest.approx(100 * 1752 / 14.5, abs=0.01)
    assert rec[1].ratio_lo == pytest.approx(876 * (200 - half) / 14.5, abs=0.01)
    assert rec[2].ratio_pct is None and rec[2].n_flow == 0


def brute(target, ref, t, wind=3.5, bg_least=4, least=3):
    if set(target) != set(ref):
        return "shape_mismatch"
    plume = [k for k, v in target.items() if v[2] is not None and v[2] > t]
    bg = [k for k in target if k not in plume]
    if len(plume) < least:
        return "too_few_plume"
    if len(bg) < bg_least:
        return "too_few_background"
    y = {k: target[k][1] - ref[k][1] - 0.5 * (target[k][0] - ref[k][0]) for k in target}
    my, raw = sum(y[k] for k in bg) / len(bg), sum(target[k][0] for k in bg) / len(bg)
    mass = sum(max(0.0, y[k] - my) for k in plume) / (raw * 4e-7) * (1e-9 * 2.1e25 * 0.016 / 6.022e23 * 400)
    return mass * wind / math.sqrt(len(plume) * 400) * 3600


def test_difference_retrieval_equals_brute_force(spark):
    rng = random.Random(5)
    scenes, refs = {}, {}
    for s in range(6):
        n = 5 if s < 4 else 2
        scenes[s] = {(r, c): (rng.uniform(0.2, 1), rng.uniform(0.2, 1), rng.choice([None, rng.random(), rng.random()])) for r in range(n) for c in range(5)}
        refs[s] = {k: (rng.uniform(0.2, 1), rng.uniform(0.2, 1), 0.0) for k in scenes[s]}
    del refs[3][(0, 0)]
    refs[9] = {(0, 0): (1.0, 1.0, 0.0)}
    table = lambda d: spark.createDataFrame([(s, *k, *v) for s, px in d.items() for k, v in px.items()], PX)
    t = [0.3, 0.6, 0.9]
    got = {(r.scene, r.threshold): r for r in T.difference_retrieval(table(scenes), table(refs), t, least_background=4, least_plume=3).collect()}
    assert len(got) == 7 * 3 and got[9, 0.3].warning == "shape_mismatch"
    for s, px in scenes.items():
        for x in t:
            want, r = brute(px, refs[s], x), got[s, x]
            assert r.warning == want and r.flow_kgh == 0.0 if isinstance(want, str) else r.flow_kgh == pytest.approx(want, abs=0.06) and r.warning is None


def test_crops_at_edges(spark):
    px = spark.createDataFrame([(1, r, c, 0.5, 3.0 * r, 0.0) for r in range(8) for c in range(8)], PX)
    at = spark.createDataFrame([(1, 7, 4, 4), (1, 8, 0, 4), (1, 9, -1, 4), (1, 7, 4, 4), (2, 1, 4, 4)], "scene int, site int, row int, col int")
    got = {r.site: (r.n_rows, r.n_cols, r.edge, r.b12_mean, r.ratio) for r in T.crop_stats(px, at, 8, 8, size=4, least=2).collect()}
    assert got == {7: (4, 4, False, 10.5, 10.5), 8: (2, 4, True, 1.5, 1.5)}


def test_region_contrast_of_odd_orbits(spark):
    rows = [(1, 0.0, 0.0, 1900.0, 1.0), (1, 0.0, 1.0, 1920.0, 0.5), (1, 0.0, 1.0, 9e36, 1.0), (1, 0.0, 0.5, 10.0, 0.4), (1, 5.0, 5.0, 1800.0, 0.9), (2, 0.0, 0.0, 1900.0, 1.0), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "orbit int, lat double, lon double, xch4 double, qa double")
    got = {r.orbit: r for r in N.region_contrast(df, (-1, -1, 1, 1), (4, 4, 6, 6)).collect()}
    assert (got[1].n_a, got[1].mean_a, got[1].median_a, got[1].p25_a, got[1].n_b, got[1].enhancement, got[1].ratio, got[1].verdict) == (2, 1910.0, 1910.0, 1905.0, 1, 110.0, 1.061, "validated")
    assert (got[2].n_b, got[2].verdict) == (0, "no_data") and (got[3].n_a, got[3].verdict) == (0, "no_data")


def test_profile_and_scenes_by_grain(spark):
    df = spark.createDataFrame([(50.0, 5.0, "A", "x"), (50.0, 50.0, "B", "x"), (None, 5.0, None, None), (47.0, 0.0, "B", "y")], "lat double, lon double, country string, kind string")
    got = {(r.section, r.value): r.n for r in R.dataset_profile(df, (47, 0, 52, 10), "country", "kind", top=2).collect()}
    assert got == {("size", "rows"): 4, ("size", "in_box"): 2, ("country", "B"): 2, ("country", "A"): 1, ("kind", "x"): 2, ("kind", "y"): 1, ("kind", "unknown"): 1}
    s = spark.createDataFrame([(1, "2024-01-05", 10, 1), (1, "2024-01-02", 10, 2), (1, "2024-01-01", 0, 3), (1, "2024-02-01", None, 4)], "site int, day string, cloud int, event_id int")
    s = s.selectExpr("site", "to_date(day) acq_date", "cloud", "event_id")
    assert sorted(r.event_id for r in D.best_scene(s, grain="month").collect()) == [2, 4]
    assert [r.event_id for r in D.best_scene(s, grain="year").collect()] == [2]


def test_events_of_the_second_sensor_and_winds(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"site": "a", "date": "2024-03-02", "enhancement_ppb": 4.5, "validated": true, "product_name": "p"}, {"site": "a", "date": "2024-3"}, {"site": "a"}, {"site": "b", "date": "2024-03-02"}, {"site": "a", "date": "2024-04-01"}]')
    got = sorted((r.month, r.enhancement_ppb, r.validated, r.product_name) for r in stores.load_sat_events(spark, str(tmp_path / "e.json"), "a").collect())
    assert got == [(3, 4.5, True, "p"), (4, None, False, "")]
    w = tmp_path / "w"
    w.mkdir()
    (w / "03_02.csv").write_text("﻿Time,Wind Speed (m/s),Wind Dir\n10:00,3.5,270\n10:01:30,x,\n\n")
    (w / "10_31.csv").write_text('"WD","note, long","ws","datetime"\r\n90,"a, b",2,2024-10-31 11:00:00\r\n')
    (w / "02_31.csv").write_text("time,ws\n1:00,2\n")
    (w / "04_01.csv").write_text("time,gust\n1:00,2\n")
    (w / "05_01.csv").write_text("")
    got = sorted((str(r.date), str(r.time), r.speed, r.direction) for r in stores.load_winds(spark, str(w), 2024).collect())
    assert got == [("2024-03-02", "2024-03-02 10:00:00", 3.5, 270.0), ("2024-03-02", "2024-03-02 10:01:30", None, None), ("2024-10-31", "2024-10-31 11:00:00", 2.0, 90.0)]
