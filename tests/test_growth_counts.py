"""Work that grows with the input alone: groups within tiles, picks that are no rows, losses without a row a year."""

import numpy as np
from pyspark.sql import functions as F

from plumeledger.operators import calibration as C
from plumeledger.operators import rasters as R
from plumeledger.operators import risk

PX = "scene long, row int, col int, prob double"


def test_events_within_and_across_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(s, int(r) - 4, int(c) - 5, 0.5) for s in range(3) for r, c in np.argwhere(rng.random((11, 12)) < 0.55)]
    px, tables, given = spark.createDataFrame(rows, PX), [], R.scratch_dir
    monkeypatch.setattr(R, "scratch_dir", lambda s, name: tables.append(name) or given(s, name))
    found = {}
    for size in (64, 3):
        monkeypatch.setattr(R, "TILE", size)
        moved = px.withColumns({"row": F.col("row") + 4, "col": F.col("col") + 5}) if size == 64 else px
        off = (4, 5) if size == 64 else (0, 0)
        got = R.connected_events(moved, F.col("prob") > 0.1).collect()
        groups = {}
        for r in got:
            groups.setdefault((r.scene, r.event), set()).add((r.row - off[0], r.col - off[1]))
        assert all((min(g)[0] + off[0]) * 2**32 + min(g)[1] + off[1] == e for (_, e), g in groups.items())
        found[size] = sorted((s, sorted(g)) for (s, _), g in groups.items())
        if size == 64:
            assert tables == ["event-runs", "event-edges"]  # scenes of one tile take no round
    assert found[64] == found[3] and "event-step" in tables
    left = {(s, r, c) for s, r, c, _ in rows}
    sought = []
    while left:
        todo, group = [left.pop()], []
        while todo:
            s, r, c = todo.pop()
            group.append((r, c))
            for x in ((s, r + 1, c), (s, r - 1, c), (s, r, c + 1), (s, r, c - 1)):
                if x in left:
                    left.remove(x)
                    todo.append(x)
        sought.append((s, sorted(group)))
    assert found[3] == sorted(sought)


def test_picks_counted_in_a_task_are_those_joined(spark, monkeypatch):
    monkeypatch.setattr(C, "PICKS", 7)
    df = spark.createDataFrame([(i % 3 % 2, float(i * 7 % 11)) for i in range(60)], "y int, score double")
    c = df.groupBy("y", F.col("score").alias("s")).agg(F.count("*").alias("c"))
    n = {r.y: r.n for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    joined = sorted(map(tuple, C._joined_picks(c, n[0], n[1], 20).collect()))
    counted = sorted(map(tuple, C._counted_picks(spark, c.orderBy("s", "y").collect(), n[0], n[1], 20).collect()))
    assert joined == counted and sum(x[2] + x[3] for x in counted) == 20 * 60


def test_losses_of_paths_are_those_of_draws(spark):
    paths = spark.createDataFrame([(i,) for i in (*range(30), 7, None)], "path long")
    sites = spark.createDataFrame([(1, "a", 0.4, 0.2, 0.6, 300.0), (2, "a", 0.0, 0.0, 0.1, 100.0), (3, "b", 1.0, 0.9, 1.0, 50.0)], "site long, ticker string, p double, p_lo double, p_hi double, flow double")
    by = ["site", "ticker"]
    a = sorted(risk.terminal_losses(risk.site_cost_draws(paths, sites, "disorderly", 4), by, last=2027).collect())
    b = sorted(risk.path_losses(risk.site_path_costs(paths, sites, "disorderly", 4), by).collect())
    assert len(a) == 3 and [r[:2] for r in a] == [r[:2] for r in b]
    assert np.allclose([r[2:] for r in a], [r[2:] for r in b], rtol=1e-9, atol=0.011)
