"""Component counts, events' places, polygons, shapes and the catalogue: ties, nulls, empty tables and the dateline."""

import random

import pytest
from pyspark.sql import functions as F

from plumeledger.functions import utm
from plumeledger.operators import footprints as P

PIXELS = "scene int, row int, col int, prob double"


def _sizes(cells):
    """Sizes of the 4-connected groups of a set of cells."""
    left, out = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            r, c = todo.pop()
            n += 1
            for at in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if at in left:
                    left.remove(at)
                    todo.append(at)
        out.append(n)
    return out


def test_component_sweep_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(s, r, c, rnd.choice([0.1, 0.18, 0.3, 0.5, 0.9])) for s in range(3) for r in range(9) for c in range(9)]
    rows += [(7, 0, 0, None), (7, 0, 1, 0.05), rows[0]]  # a scene of nothing, and a repeated pixel
    got = {(r.scene, r.t): (r.above, r.events) for r in P.component_sweep(spark.createDataFrame(rows, PIXELS), (0.18, 0.3, 0.5), 3).collect()}
    want = {}
    for s in (0, 1, 2, 7):
        for t in (0.18, 0.3, 0.5):
            cells = {(r, c) for x, r, c, p in rows if x == s and p is not None and p >= t}
            want[s, t] = (len(cells), sum(n >= 3 for n in _sizes(cells)))
    assert got == want
    assert P.component_sweep(spark.createDataFrame([], PIXELS)).count() == 0


def test_places_of_events(spark):
    at = spark.range(1).select(utm.to_utm(F.lit(50.123456), F.lit(19.5), F.lit(34)).alias("u")).first().u
    events = spark.createDataFrame([(1, 5, 10, 3), (2, 5, 10, 3), (3, 5, 10, 3), (1, 6, 0, 0)], "scene int, event long, row int, col int")
    flat = [20.0, 0.0, at.easting - 60.0, 0.0, -20.0, at.northing + 200.0]
    geo = spark.createDataFrame([(1, 34, True, flat), (1, 35, True, flat), (2, 34, True, [20.0, 0.0, None, 0.0, -20.0, 1.0])], "scene int, zone int, northern boolean, transform array<double>")
    got = {(r.scene, r.event): r for r in P.event_places(events, geo).collect()}
    assert len(got) == 4 and (got[1, 5].lat, got[1, 5].lon) == (pytest.approx(50.123456, abs=2e-6), pytest.approx(19.5, abs=2e-6))
    assert got[2, 5].lat is None and got[3, 5].lon is None
    assert len({r.event_id for r in got.values()}) == 4 and all(len(r.event_id) == 16 for r in got.values())
    assert P.event_places(events.where("false"), geo).count() == 0


def test_polygons_by_table(spark):
    corners = "array<struct<x:double,y:double>>"
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]  # a notch at the top
    polygons = spark.createDataFrame([(1, "open", shape), (1, "closed", shape + shape[:1]), (1, "line", shape[:2]), (1, "none", None), (2, "other", shape), (None, "lost", shape)], f"scene int, polygon string, corners {corners}")
    px = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 3.0), (1, 3.5, 2.0), (1, 5.0, 1.0), (1, None, 1.0), (3, 1.0, 1.0)], "scene int, x double, y double")
    got = sorted((r.polygon, r.x, r.y) for r in P.polygon_mask(px, polygons).collect())
    assert got == [(p, x, y) for p in ("closed", "open") for x, y in ((1.0, 1.0), (3.5, 2.0))]
    assert P.polygon_mask(px, polygons.where("false")).count() == 0


def test_square_is_of_metres(spark):
    c = spark.range(1).select(P.square(F.lit(60.0), F.lit(10.0), 1113.2).alias("c")).first().c
    assert [(round(p.x, 6), round(p.y, 6)) for p in c] == [(9.98, 60.01), (10.02, 60.01), (10.02, 59.99), (9.98, 59.99)]


def test_rasters_that_do_not_fit(spark):
    df = lambda rows: spark.createDataFrame(rows, "scene int, row int, col int, b11 int")
    t, r = df([(1, 0, 0, 100), (1, 0, 1, 0), (2, 0, 0, 5), (2, 0, 1, 5)]), df([(1, 0, 0, 90), (1, 0, 1, 255), (2, 0, 0, 5), (3, 0, 0, 1)])
    got = {x.scene: (x.n_both, x.n_target_only, x.n_reference_only, x.matches) for x in P.shape_report(t, r).collect()}
    assert got == {1: (2, 0, 0, True), 2: (1, 1, 0, False), 3: (0, 0, 1, False)}
    assert sorted((x.scene, x.col, x.b11) for x in P.checked_diff(t, r, ["b11"], "skip").collect()) == [(1, 0, 138), (1, 1, 0)]
    with pytest.raises(ValueError, match="have no partner"):
        P.checked_diff(t, r, ["b11"])
    assert P.checked_diff(t.where("scene = 1"), r.where("scene = 1"), ["b11"]).count() == 2
    with pytest.raises(ValueError, match="mismatch"):
        P.checked_diff(t, r, ["b11"], "guess")


def test_catalogue_across_the_dateline(spark):
    rows = [(1, "A", "2024-01-02", 10.0, 175.0, 0.0, -175.0, 10.0), (2, "A", "2024-01-03", None, 172.0, 0.0, 174.0, 10.0), (3, "A", "2024-01-03", 5.0, -179.0, 0.0, -178.0, 10.0), (4, "A", "2024-01-03", 5.0, 0.0, 0.0, 5.0, 10.0), (5, "B", "2024-01-03", 5.0, 172.0, 0.0, 174.0, 10.0), (6, "A", "2024-01-03", 5.0, None, 0.0, 174.0, 10.0)]
    p = spark.createDataFrame(rows, "id int, collection string, start string, cloud double, west double, south double, east double, north double")
    ids = lambda box, **k: [r.id for r in P.boxed_search(p, "2024-01-01", "2024-01-31", box, "A", **k).collect()]
    assert ids((171.0, -5.0, -170.0, 5.0)) == [2, 3, 1]
    assert ids((171.0, -5.0, -170.0, 5.0), ceiling=10.0) == [3, 1]
    assert ids((-178.5, -5.0, -170.0, 0.0)) == [3, 1] and ids((5.0, 10.0, 6.0, 20.0)) == [4]
    assert ids((171.0, -5.0, -170.0, 5.0), limit=1) == [2] and ids((0.0, 50.0, 1.0, 51.0)) == []
