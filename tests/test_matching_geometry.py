import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plumeledger.functions import utm as U
from plumeledger.operators import joins as J
from plumeledger.operators import matching as M
from plumeledger.operators import pixels as P
from plumeledger.operators import scenes as N

PLACES = "site int, lat double, lon double"


def km(a, b):
    (la, lo), (lb, lp) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("most", [5.0, 300.0])
def test_distance_join_everywhere(spark, most):
    rng = random.Random(7)
    rows = [(89.9, 0.0), (89.9, 10.0), (89.99, -170.0), (-89.98, 5.0), (90.0, 12.0), (-90.0, 0.0), (0.0, 179.99), (0.0, -179.99), (0.0, 180.0), (60.0, 180.0), (60.0, -179.95)]
    rows += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(80)] + [(rng.choice([-1, 1]) * rng.uniform(89, 90), rng.uniform(-180, 180)) for _ in range(40)]
    rows += [(la + rng.uniform(-0.05, 0.05) if abs(la) < 89.9 else la, lo) for la, lo in rows[:30]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, *p) for i, p in rows] + [(999, None, 1.0)], PLACES)
    got = {(r.site, r.asset) for r in J.pairs_within(df, df, most, same=True).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.permutations(rows, 2) if km(a, b) <= most}
    assert got == want and (0, 1) in got if most == 5.0 else got == want


def test_mask_of_a_site_that_is_listed_twice(spark):
    df = spark.createDataFrame([(1, True, 7), (2, False, 8), (3, True, 9)], "site int, has_bitemporal boolean, scene int")
    reg = spark.createDataFrame([(1, "bitemporal"), (1, "bitemporal"), (2, "other"), (2, "bitemporal"), (3, "bitemporal"), (3, "skip"), (None, "skip")], "site int, policy string")
    assert sorted(map(tuple, N.mask_select(df, reg).select("site", "mask_source", "bitemporal_missing").collect())) == [(1, "bitemporal", False), (2, "original", True), (3, "none", False)]


def test_containment_equals_brute_force(spark):
    rng = random.Random(1)
    patterns = ["".join(rng.choice("abC1") for _ in range(rng.randrange(0, 6))) for _ in range(60)] + [None, "ß", "zzz"]
    texts = ["".join(rng.choice("aBc1") for _ in range(rng.randrange(0, 12))) for _ in range(120)] + [None, "", "straße"]
    p, t = spark.createDataFrame([(x,) for x in patterns * 2], "pattern string"), spark.createDataFrame([(x,) for x in texts * 2], "text string")
    got = M.contained(p, t)
    assert sorted(map(tuple, got.collect())) == sorted({(x, y) for x in patterns for y in texts if x and y and x.lower() in y.lower()})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert M.contained(p.limit(0), t).count() == M.contained(p, t.limit(0)).count() == 0


def test_overlap_of_sites(spark):
    c = spark.createDataFrame([("Lipsk", 1), ("Lipsk", 1), ("Mokra", None), ("", 9), ("Solo", 4)], "site string, tile int")
    t = spark.createDataFrame([("LIPSK_2024", 1, "real", 1), ("LIPSK_2024", 1, "real", 1), ("a_lipsk", 2, "x/synthetic", 0), ("other", 1, "real", 0), (None, 9, "real", 3), ("mokr", None, "real", 1)], "crop string, tile int, source string, label int")
    got = {r.site: (r.in_training, r.roles, r.n_crops) for r in M.site_overlap(c, t).collect()}
    assert got == {"Lipsk": (True, "negative,positive,synthetic_substrate", 4), "Mokra": (False, "", 0), "": (True, "", 1), "Solo": (False, "", 0)}


def test_utm_round_trip(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-80, 84), rng.uniform(-180, 180)) for _ in range(400)] + [(0.0, 0.0), (52.0, 180.0), (-33.9, 18.4), (51.48, -3.0)]
    df = spark.createDataFrame(rows + [(None, 1.0)], "lat double, lon double")
    x = df.withColumn("u", U.to_utm(F.col("lat"), F.col("lon")))
    x = x.withColumn("b", U.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("u.zone"), F.col("lat") >= 0)).collect()
    for r in x[:-1]:
        assert km((r.lat, r.lon), (r.b.lat, r.b.lon)) * 1e6 < 1.0  # a millimetre
    assert x[-1].u is None
    assert (x[400].u.zone, x[401].u.zone) == (31, 60) and x[403].u.easting == pytest.approx(500000, abs=1e-6)
    # a published value: 48.8582 N 2.2945 E is 448251.8 E 5411932.7 N in zone 31
    got = df.limit(1).select(U.to_utm(F.lit(48.8582), F.lit(2.2945)).alias("u")).first().u
    assert got.easting == pytest.approx(448251.8, abs=0.2) and got.northing == pytest.approx(5411932.7, abs=0.2)
    forced = df.limit(1).select(U.to_utm(F.lit(48.8582), F.lit(2.2945), F.lit(32)).alias("u")).select(U.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("u.zone")).alias("b")).first().b
    assert forced.lat == pytest.approx(48.8582, abs=1e-7) and forced.lon == pytest.approx(2.2945, abs=1e-7)


def scene(spark, n, prob):
    return spark.createDataFrame([(1, r, c, float(prob(r, c))) for r in range(n) for c in range(n)], "scene int, row int, col int, prob double")


def test_contrast_on_a_larger_scene(spark):
    px = scene(spark, 50, lambda r, c: 0.9 if 20 <= r < 30 and 20 <= c < 30 else 0.2 + 0.01 * (r >= 40))
    sites = spark.createDataFrame([(1, "mid", 25, 25), (1, "mid", 25, 25), (1, "corner", 5, 5), (1, "off", 2, 25), (2, "none", 25, 25)], "scene int, site string, row int, col int")
    got = {r.site: r for r in P.site_contrast(px, sites, 10).collect()}
    mid = got["mid"]
    assert len(got) == 4 and (mid.n_controls, mid.direction, mid.sc_ratio) == (4, "n", 4.5)
    mu = (0.2 * 3 + 0.21) / 4
    assert mid.sc_cfar == round(0.9 / mu, 4) and mid.detect
    assert (got["corner"].n_controls, got["corner"].direction) == (2, "s") and got["off"].error == "site_oob" and got["none"].error == "site_oob"
    cut = {r.site: r for r in P.site_contrast(px, sites, 10, edge="clamp", least=5).collect()}
    assert cut["off"].error is None and cut["off"].site_mean == pytest.approx(0.2)
    wide = P.site_contrast(px, sites.where("site = 'mid'"), 10, {"n": (-100, 0)}).first()
    assert wide.error == "all_directions_oob" and wide.sc_ratio is None
    dark = P.site_contrast(scene(spark, 50, lambda r, c: 0.5 if 20 <= r < 30 else 0.0), sites.where("site = 'mid'"), 10, {"n": (-20, 0), "s": (20, 0)}).first()
    assert dark.sc_cfar == float("inf") and dark.detect


def test_band_retrieval_keeps_invalid_scenes(spark):
    rows = [(s, r, c, 0.3, 0.3 * (0.9 if s != 3 and r < 3 and c < 3 else 1.0), 0.9 if (s != 3 and r < 3 and c < 3) else 0.1) for s, n in ((1, 12), (2, 5), (3, 12)) for r in range(n) for c in range(n)]
    got = {r.scene: r for r in P.band_retrieval(spark.createDataFrame(rows, "scene int, row int, col int, b11 double, b12 double, prob double")).collect()}
    assert set(got) == {1, 2, 3} and got[1].flow_kgh > 0 and (got[2].mass_kg, got[2].flow_kgh) == (None, 0.0) and (got[3].mass_kg, got[3].flow_kgh, got[3].n_px) == (0.0, 0.0, 0)
