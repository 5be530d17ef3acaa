import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest

from plumeledger.functions.running import order_statistics, running_totals
from plumeledger.operators import calibration as C
from plumeledger.operators import detection as D
from plumeledger.operators import retrievals as R
from plumeledger.operators import soundings as S

PX = "scene int, row int, col int, b11 double, b12 double, prob double"
KG = 1e-9 * 2.1e25 * 0.016 / 6.022e23 * 400


def plume(scene, n, seed, dark=False):
    rng = random.Random(seed)
    out = []
    for r in range(n):
        for c in range(n):
            p = max(0.0, 0.6 - 0.07 * ((r - n / 2) ** 2 + (c - n / 3) ** 2) ** 0.5 + rng.uniform(-0.1, 0.1))
            b11 = 0.0 if dark else 0.3 + rng.uniform(0, 0.02)
            out.append((scene, r, c, b11, 0.0 if dark else 0.25 + rng.uniform(0, 0.01) + 0.05 * p, p))
    return out


def legacy(rows, plume_at, back_at, wind=3.5, least=50):
    bg = [x for x in rows if back_at(x)]
    hit = [x for x in rows if plume_at(x)]
    if len(bg) < least or len(hit) < 4:
        return None
    m11, m12 = statistics.fmean(x[3] for x in bg), statistics.fmean(x[4] for x in bg)
    if m11 < 1e-6:
        return None
    mass = sum(max(0.0, ((x[4] - m12) - 0.5 * (x[3] - m11)) / (m11 * 4e-7)) * KG for x in hit)
    span = max(max(x[1] for x in hit) - min(x[1] for x in hit), max(x[2] for x in hit) - min(x[2] for x in hit))
    return round(mass / (max(span * 20.0, 20.0) / wind) * 3600, 4)


@pytest.fixture(scope="module")
def scenes(spark):
    rows = {1: plume(1, 14, 1), 2: plume(2, 20, 2), 3: plume(3, 6, 3), 4: plume(4, 14, 4, dark=True), 5: [(5, r, c, 0.3, 0.25, 0.0) for r in range(12) for c in range(12)]}
    flat = [x for v in rows.values() for x in v]
    return rows, spark.createDataFrame(flat + [(6, 0, 0, 0.3, 0.2, None)], PX).repartition(5)


def test_legacy_retrieval(spark, scenes):
    rows, df = scenes
    got = {r.scene: r for r in R.legacy_retrieval(df).collect()}
    for k, v in rows.items():
        want = legacy(v, lambda x: x[5] >= 0.3, lambda x: x[5] < 0.3)
        assert got[k].flow_kgh == pytest.approx(want or 0.0, rel=1e-9), k
    assert (got[3].warning, got[4].warning, got[5].warning, got[6].warning) == ("too_few_background", "dark_background", "empty_plume", "too_few_background")


def test_mask_sweep_equals_brute_force(spark, scenes):
    rows, df = scenes
    got = {r.scene: r for r in R.mask_threshold_sweep(df, 0.18).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    for k, v in rows.items():
        flows = [legacy(v, lambda x, t=t: x[5] >= t, lambda x, t=t: x[5] < t) for t in np.geomspace(0.054, 0.5, 50)]
        flows = [f for f in flows if f]
        assert got[k].n_valid == len(flows)
        if len(flows) >= 4:
            assert got[k].sigma_pct == round(100 * statistics.stdev(flows) / statistics.fmean(flows), 1) and got[k].mean_flow == pytest.approx(statistics.fmean(flows), abs=0.006)
        else:
            assert got[k].sigma_pct is None


def test_jackknife(spark, scenes):
    rows, df = scenes
    got = {r.scene: r for r in R.background_jackknife(df, least_background=20).collect()}
    same = {r.scene: r for r in R.background_jackknife(df, compat=True, least_background=20).collect()}
    for k in (1, 2):
        v, hit = rows[k], [x for x in rows[k] if x[5] >= 0.3]
        cr, cc = statistics.fmean(x[1] for x in hit), statistics.fmean(x[2] for x in hit)
        out = {"n": lambda x: x[1] < cr, "s": lambda x: x[1] >= cr, "w": lambda x: x[2] < cc, "e": lambda x: x[2] >= cc}
        want = {h: legacy(v, lambda x: x[5] >= 0.3, lambda x, f=f: x[5] < 0.3 and not f(x), least=20) for h, f in out.items()}
        assert {h: got[k][f"flow_{h}"] for h in out} == pytest.approx(want, rel=1e-9)
        assert got[k].sigma_pct > 0 and same[k].sigma_pct == 0.0 and same[k].n_valid == 4
    assert got[5].n_valid == 0 and got[5].sigma_pct is None and got[6].n_valid == 0


def test_crops_fall_back(spark):
    rows = [(1, r, c, 0.3, 0.27 if (r, c) == (10, 10) else 0.25, 0.9 if (r, c) == (10, 10) else 0.1) for r in range(20) for c in range(20)]
    rows = [(s, r, c, a, (0.2 if (r, c) == (10, 10) else b), p) for s, r, c, a, b, p in rows]
    got = R.crop_fallback(spark.createDataFrame(rows + [(2, 0, 0, 0.3, 0.3, 0.1)], PX), (20, 10, 6), least_background=50)
    got = {r.scene: r for r in got.collect()}
    assert (got[1].crop, got[1].attempts) == (20, "20:quantified 10:quantified 6:few_background") and got[1].flow_kgh > 0
    assert (got[2].crop, got[2].flow_kgh, got[2].attempts) == (None, 0.0, "20:few_background 10:few_background 6:few_background")


def pav(pairs):
    """The fit by its definition: greatest over starts of the least mean over ends, ties as one."""
    keys = sorted({s for s, _ in pairs})
    n, k = [sum(s == x for s, _ in pairs) for x in keys], [sum(y for s, y in pairs if s == x) for x in keys]
    fit = [max(min(sum(k[i : e + 1]) / sum(n[i : e + 1]) for e in range(j, len(keys))) for i in range(j + 1)) for j in range(len(keys))]
    blocks = []
    for x, c, s, f in zip(keys, n, k, fit):
        if blocks and abs(blocks[-1][4] - f) < 1e-12:
            blocks[-1] = (blocks[-1][0], x, blocks[-1][2] + c, blocks[-1][3] + s, f)
        else:
            blocks.append((x, x, c, s, f))
    return blocks


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_equals_definition(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40) / 4 if seed % 2 else rng.gauss(0, 1), int(rng.random() < 0.2 + 0.15 * seed)) for _ in range(120)]
    df = spark.createDataFrame([*pairs, (None, 1), (1.0, None)], "s double, y int").repartition(4)
    got = sorted((r.lo, r.hi, r.n, r.positives, pytest.approx(r.probability)) for r in C.isotonic_blocks(df, "s", "y").collect())
    assert got == pav(pairs)
    one = C.isotonic_summary(df, "s", "y").first()
    fit = [(b, s, y) for s, y in pairs for b in pav(pairs) if b[0] <= s <= b[1]]
    assert one.n_pairs == 120 and one.mean_calibration_error == pytest.approx(statistics.fmean(abs(b[4] - y) for b, _, y in fit), abs=6e-5)
    assert one.monotone_before is False


def test_isotonic_edges(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1)], "s double, y int")
    assert tuple(C.isotonic_summary(df, "s", "y").first()) == (2, None, None, None)
    assert C.isotonic_summary(df.union(df), "s", "y").first().monotone_before is True
    assert C.isotonic_blocks(df.limit(0), "s", "y").count() == 0


def test_group_totals_and_order_statistics(spark):
    rng = random.Random(9)
    rows = [(g, round(rng.gauss(0, 5), 1)) for g in ["hot"] * 300 + ["a", "b", None, None, "one"] for _ in range(1 if g == "hot" else 7)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in order_statistics(df, "v", {"q1": "(n + 1) * 0.25D", "med": "(n + 1) * 0.5D"}, "g").collect()}
    groups = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {h for h, _ in rows}}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, v in groups.items():
        if v:
            assert got[g].n == len(v) and got[g].med == pytest.approx(statistics.median(v)) and got[g].q1 == pytest.approx(statistics.quantiles(v, n=4)[0])
    c = df.where("v is not null").groupBy("g", "v").count()
    for r in running_totals(c, "v", ["count"], descending=False, by=("g",)).collect():
        assert r.upto_count == sum(x <= r.v for x in groups[r.g])


def test_flow_audit(spark):
    flows = {"a": [100.0, 110.0, 120.0, 130.0, 900.0], "b": [5.0, 7.0], "c": [0.0, 0.0]}
    df = spark.createDataFrame([(g, q, 1.0 if q == 900 else None) for g, v in flows.items() for q in v] + [("d", None, 1.0)], "g string, q double, w double")
    got = {r.g: r for r in C.flow_audit(df, "g", "q", "w").collect()}
    a, q = got["a"], statistics.quantiles(flows["a"], n=4)
    assert (a.p25, a.median, a.p75) == (q[0], 120.0, q[2]) and (a.n_outliers, a.n_low_wind, a.clean_mean, a.recommend) == (1, 1, 115.0, "median")
    assert (got["b"].p25, got["b"].p75, got["b"].median, got["b"].recommend) == (5.0, 7.0, 6.0, "mean")
    assert got["c"].skew == 1.0 and set(got) == {"a", "b", "c"}


def test_site_risk_reads_quantified_flow(spark):
    rows = [(s, "ok", 2.0 if i < 4 else 1.0, i) for s in (1, 2, 3) for i in range(10)] + [(1, "ok", 9.0, 99)]
    df = spark.createDataFrame(rows, "site int, status string, sc_cfar double, cloud int")
    flows = spark.createDataFrame([(1, 999.0), (1, 1001.0), (2, None)], "site int, flow double")
    dual = spark.createDataFrame([(1, 0.6), (3, 0.4)], "site int, score double")
    got = {r.site: r for r in D.site_risk(df, flows, dual, "cloud = 99").collect()}
    plain = {r.site: r for r in D.site_risk(df).collect()}
    assert (got[1].flow, got[1].flow_source, got[1].n_valid, got[1].tier) == (1000.0, "quantified", 10, "HIGH_DUAL_SENSOR")
    assert (got[2].flow, got[2].flow_source, got[2].tier, got[3].tier) == (25.0, "estimated", "MEDIUM", "MEDIUM") and plain[1].n_valid == 11
    assert got[1].t_co2e == round(0.4 * 1000 * 8760 * 0.85 * 29.8 / 1000, 1) and got[1].t_lo < got[1].t_co2e < got[1].t_hi and got[1].eur == round(got[1].t_co2e * 65)


SITES = "site int, lat double, lon double"
SOUND = "orbit int, lat double, lon double, xch4 double, qa double"


def ring(orbit, lat, lon, n=12, base=1850.0, qa=1.0, near=1900.0):
    out = [(orbit, lat, lon + 0.05 if lon < 179.9 else lon + 0.05 - 360, near, qa)] if near is not None else []
    return out + [(orbit, lat + 0.5, lon - 0.3 + 0.05 * i if lon - 0.3 + 0.05 * i <= 180 else lon - 0.3 + 0.05 * i - 360, base + i, qa) for i in range(n)]


def test_annulus(spark):
    sites = spark.createDataFrame([(1, 50.0, 10.0), (2, -10.0, 179.95), (3, 0.0, 0.0), (4, None, None)], SITES)
    rows = ring(7, 50.0, 10.0) + ring(7, -10.0, 179.95) + ring(8, 50.0, 10.0, n=5) + ring(9, 50.0, 10.0, near=None) + [(7, 0.0, 0.0, None, 1.0), (7, 0.0, 0.0, 1800.0, 0.4)]
    pairs = spark.createDataFrame([(o, s) for o in (7, 8, 9) for s in (1, 2, 3, 4)] + [(7, 1)], "orbit int, site int")
    got = {(r.orbit, r.site): r for r in S.annulus_enhancement(spark.createDataFrame(rows, SOUND), sites, pairs).collect()}
    assert len(got) == 12 and got[7, 1].enhancement == round(1900 - float(np.percentile([1850 + i for i in range(12)], 20)), 2) == got[7, 2].enhancement
    assert (got[8, 1].error, got[9, 1].error, got[7, 3].error, got[7, 4].error) == ("few_background", "swath_miss", "swath_miss", "swath_miss")


def test_soundings_meet_sites_by_tile_not_as_pairs(spark):
    rng = random.Random(4)
    lon = lambda x: (x + 180) % 360 - 180
    sound = [(rng.randrange(2), round(rng.uniform(48, 52.5), 2), round(lon(rng.uniform(177.5, 182)), 2), rng.uniform(1800, 1900) if rng.random() > 0.1 else None, rng.choice([None, 0.2, 0.4, 0.9])) for _ in range(3000)]
    places = [(s, round(rng.uniform(49, 51.5), 2), round(lon(rng.uniform(178.5, 181)), 2)) for s in range(40)] + [(40, 50.0, 180.0), (41, 50.0, -180.0), (42, 50.0, 180.0)]
    d, sites = spark.createDataFrame(sound, SOUND), spark.createDataFrame(places, SITES)
    pairs = spark.createDataFrame([(o, s) for o in range(3) for s in range(43)], "orbit long, site int")
    df = S.annulus_enhancement(d, sites, pairs)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().toString()  # no row for each sounding and site
    got = {(r.orbit, r.site): r for r in df.collect()}
    box = {(r.orbit, r.site): r for r in S.box_enhancement(d, sites, pairs).collect()}
    assert len(got) == len(box) == 129
    for (o, s), r in got.items():
        _, slat, slon = places[s]
        near = [(round(a - slat, 9), round((b - slon + 180) % 360 - 180, 9), x, q) for k, a, b, x, q in sound if k == o]
        near = [p for p in near if abs(p[0]) <= 1 and abs(p[1]) <= 1]
        ok = sorted((math.hypot(a, b), a, b, x) for a, b, x, q in near if x is not None and (q or 0) >= 0.5)
        ring = [x for k, _, _, x in ok if 0.25 <= k <= 1]
        assert r.n_bg == len(ring) and (r.error == "swath_miss") == (not ok or ok[0][0] > 0.15)
        if r.error is None:
            assert (r.site_xch4, r.bg_xch4) == (pytest.approx(ok[0][3], abs=0.006), pytest.approx(np.percentile(ring, 20), abs=0.006))
        good = [x for _, _, x, q in near if (q or 0) >= 0.5]
        assert box[o, s].n_box == len(good) and (o == 2 or box[o, s].background == pytest.approx(np.median([x for x in good if x is not None]), abs=0.006))
    assert {r[2:] for r in (got[0, 40], got[0, 41], got[0, 42])} == {got[0, 40][2:]}


def test_box_relaxes(spark):
    sites = spark.createDataFrame([(1, 50.0, 10.0)], SITES)
    rows = [(1, 50.1, 10.1, 1900.0, 0.6), (1, 50.6, 10.0, 1850.0, 0.6), (1, 49.5, 10.0, 1860.0, 0.6)]  # good at once
    rows += [(2, 50.4, 10.0, 1900.0, 0.35), (2, 50.9, 10.0, 1850.0, 0.35), (2, 49.2, 10.0, 1860.0, 0.6)]  # quality 0.3, radius 0.5
    rows += [(3, 50.9, 10.0, 1850.0, 0.9)] * 3 + [(4, 50.1, 10.0, 1850.0, 0.0)] * 3  # nothing near; no quality
    pairs = spark.createDataFrame([(o, 1) for o in range(1, 6)], "orbit int, site int")
    got = {r.orbit: r for r in S.box_enhancement(spark.createDataFrame(rows, SOUND), sites, pairs).collect()}
    assert (got[1].qa_level, got[1].radius, got[1].background, got[1].enhancement, got[1].validated) == (0.5, 0.3, 1860.0, 40.0, True)
    assert (got[2].qa_level, got[2].radius, got[2].n_box) == (0.3, 0.5, 3)
    assert (got[3].error, got[4].error, got[5].error, got[3].background, got[4].background) == ("no_near_pixels", "cloudy", "orbit_miss", 1850.0, None)


def test_orbits_are_tried_in_order(spark):
    sites = spark.createDataFrame([(1, 50.0, 10.0), (2, 20.0, 10.0)], SITES)
    day, at = dt.date(2024, 1, 10), lambda d, h, m=0: dt.datetime(2024, 1, d, h, m, tzinfo=dt.timezone.utc)
    orbits = spark.createDataFrame([(1, at(10, 12, 20)), (2, at(10, 13, 30)), (3, at(11, 12, 0)), (4, at(10, 22)), (5, at(20, 12)), (6, None)], "orbit int, start timestamp")
    sound = spark.createDataFrame(ring(2, 50.0, 10.0) + ring(3, 50.0, 10.0) + ring(3, 20.0, 10.0, n=3) + ring(4, 20.0, 10.0), SOUND)
    obs = spark.createDataFrame([(1, 1, day), (2, 2, day), (3, 1, dt.date(2024, 6, 1)), (4, 1, None), (5, 1, dt.date(2024, 1, 19))], "id int, site int, date date")
    got = {r.id: (r.orbit, r.n_tried, r.error) for r in S.orbit_colocation(obs, orbits, sound, sites).collect()}
    assert got == {1: (2, 2, None), 2: (3, 3, "few_background"), 3: (None, 0, "no_orbit"), 4: (None, 0, "no_orbit"), 5: (5, 1, "swath_miss")}


def test_bootstrap_of_rank_statistics(spark):
    rng = random.Random(8)
    pairs = [(1, rng.randrange(6) / 2) for _ in range(12)] + [(0, rng.randrange(5) / 2) for _ in range(15)]
    df = spark.createDataFrame([*pairs, (None, 1.0), (1, None), (2, 9.0)], "y int, score double")
    got = {r.metric: r for r in C.stratified_bootstrap(df, 60).collect()}
    pos, neg = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    point = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert got["auroc"].point == round(point, 6) and (got["auroc"].n_draws, got["auroc"].n_pos, got["auroc"].n_neg) == (60, 12, 15)
    order = sorted(pairs, key=lambda r: (-r[1], -r[0]))
    hits = [sum(y for y, _ in order[: i + 1]) / (i + 1) for i in range(len(order)) if order[i][0]]
    assert got["ap"].point == round(statistics.fmean(hits), 6)
    for r in got.values():
        assert r.p025 <= r.p05 <= r.p25 <= r.p50 <= r.p75 <= r.p95 <= r.p975 and abs(r.mean - r.point) < 0.1 and r.sd > 0
    one = {r.metric: (r.n_draws, r.point, r.mean) for r in C.stratified_bootstrap(df.where("y = 1"), 60).collect()}
    assert one == {"auroc": (0, None, None), "ap": (0, None, None)}


def test_calibration_bins_without_rows(spark):
    from plumeledger.operators import validation as V

    df = spark.createDataFrame([(1, 20.0), (0, 20.0), (1, None)], "y int, score double")
    got = sorted(map(tuple, V.calibration_bins(df).collect()))
    assert [(b, n, p) for b, n, p, _ in got[:4]] == [(0, 0, 0.1), (1, 0, 0.3), (2, 0, 0.5), (3, 0, 0.7)] and got[4][1:2] + got[4][3:] == (2, 0.5)
    one = V.calibration_errors(df).first()
    assert one.n == 2 and one.ece == pytest.approx(0.4999, abs=1e-3) and one.brier == pytest.approx(0.5, abs=1e-3)
    assert tuple(V.calibration_errors(df.limit(0)).first()) == (0, None, None)
