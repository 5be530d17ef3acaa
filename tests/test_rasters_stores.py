import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumeledger.operators import assessments as A
from plumeledger.operators import joins as J
from plumeledger.operators import rasters as R
from plumeledger.sources import stores as O
from plumeledger.streaming import windows as T

PX = "scene int, row int, col int, prob double"


def _components(cells):
    left, out = set(cells), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            r, c = todo.pop()
            seen.append((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out |= {x: min(r * 2**32 + c for r, c in seen) for x in seen}
    return out


def test_connected_events_match_flood_fill(spark):
    snake = [(r, c) for r in range(12) for c in range(12) if r % 2 == 0 or c == (11 if r % 4 == 1 else 0)]
    dots = [(r, c) for r in range(12) for c in range(12) if (r * 7 + c * 13) % 5 < 3]
    rows = [(s, r, c, 0.5) for s, cells in enumerate((snake, dots)) for r, c in cells] + [(0, 11, 5, None), (2, 0, 0, 0.01)]
    got = R.connected_events(spark.createDataFrame(rows, PX), F.col("prob") > 0.1).collect()
    for s, cells in enumerate((snake, dots)):
        assert {(x.row, x.col): x.event for x in got if x.scene == s} == _components(cells)
    assert len(got) == len(snake) + len(dots)
    assert R.extract_events(spark.createDataFrame([], PX)).count() == 0


def test_tiles_cover_only_full_ones(spark):
    px = spark.createDataFrame([(0, r, c, 0.1) for r in range(7) for c in range(7)], PX)
    whole = R.tiles(px, 7, 7, 3).groupBy("tile_row", "tile_col").count().collect()
    assert len(whole) == 4 and all(x["count"] == 9 for x in whole)
    assert len(R.tiles(px, 7, 7, 3, 1).groupBy("tile_row", "tile_col").count().collect()) == 9
    assert R.tiles(px, 7, 7, 8).count() == 0
    with pytest.raises(ValueError):
        R.tiles(px, 7, 7, 3, 3)


def test_polygon_and_rates_over_nothing(spark):
    px = spark.createDataFrame([(0, 1, 1, 0.9), (0, 5, 5, 0.9), (1, 1, 1, None)], PX)
    assert [r.row for r in px.where(R.in_polygon(F.col("col"), F.col("row"), [(0, 0), (3, 0), (3, 3), (0, 3)])).where("scene = 0").collect()] == [1]
    got = R.pixel_confusion(px.where("scene = 1"), F.col("prob") > 0.5, F.lit(False)).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.iou, got.precision, got.f1) == (0, 0, 0, 1, None, None, None)


def test_nested_stores(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"site": "x", "sc": 1.5, "more": 1}, {"site": None}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"site": "y", "sc": 2}]))
    (tmp_path / "c.json").write_text(json.dumps({"records": []}))
    got = O.scan_timeseries(spark, str(tmp_path), "site string, sc double").collect()
    assert sorted((r.site or "", r.sc) for r in got if r.sc) == [("x", 1.5), ("y", 2.0)] and len(got) == 3
    (tmp_path / "days.txt").write_text(json.dumps({"x": {"20240102": {"sc": 1.0}, "2024-01-03": {"sc": None}}, "y": {}}, indent=1))
    got = O.scan_multidate(spark, str(tmp_path / "days.txt"), "sc double").collect()
    assert sorted((r.site, r.acq_date, r.sc) for r in got) == [("x", dt.date(2024, 1, 2), 1.0), ("x", dt.date(2024, 1, 3), None)]
    day = {"sc_ratio": 1.2, "s2_detect": True}
    pairs = {"x": {"dates": {"1": day | {"tropomi": {"error": "cloudy"}}, "2": day | {"tropomi": {"enhancement": 7.0}}, "3": day, "4": day | {"is_bad_scene": True}, "5": {"sc_ratio": None}}}}
    (tmp_path / "pairs.txt").write_text(json.dumps(pairs))
    got = {r.date: (r.has_tropomi, r.enhancement) for r in O.scan_pairs(spark, str(tmp_path / "pairs.txt")).collect()}
    assert got == {"1": (False, None), "2": (True, 7.0), "3": (True, 0.0)}


def test_quantifications_last_of_a_key_and_defaults(spark, tmp_path):
    lines = [{"site": "a", "scene_id": "1", "flow_rate_kgh": 1, "ingest_seq": 1}, {"site": "a", "scene_id": "1", "flow_rate_kgh": 2, "ingest_seq": 2, "new": 1}, {"flow_rate_kgh": 3}, {"site": "b", "excluded": True}]
    (tmp_path / "q.json").write_text("\n".join(map(json.dumps, lines)))
    got = O.load_quantifications(spark, str(tmp_path / "q.json"))
    assert sorted((r.site, r.scene_id, r.flow_rate_kgh, r.excluded) for r in got.collect()) == [("a", "1", 2.0, False), ("unknown", "", 3.0, False)]
    assert O.load_quantifications(spark, str(tmp_path / "q.json"), exclude_flagged=False).count() == 3


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "jrc.csv").write_text("id,name,lat,lon,capacity_mw,fuel\n1,A,50,20,,coal\n2,,51,x,3,gas\n3,,52,21,n/a,gas\n4,,53,22,7,gas\n")
    got = O.load_assets(spark, str(tmp_path / "jrc.csv"), "jrc").collect()
    assert sorted((r.asset_id, r.name, r.capacity_mw, r.owner) for r in got) == [("1", "A", None, None), ("4", "Unknown", 7.0, None)]
    (tmp_path / "rel.csv").write_text("Date Time,Q_true,Sat\n2024-01-01 10:00:00,5,S2A\n2024-01-01 09:00:00,4,s2a\n2024-01-02 09:00:00,0,S2A\n2024-01-03 09:00:00,9,L8\n,3,S2A\n")
    names = {"time": ["timestamp", "date time"], "flow": ["q_true"], "satellite": ["sat"]}
    assert [(str(r.day), r.flow) for r in O.load_releases(spark, str(tmp_path / "rel.csv"), names, "S2A").collect()] == [("2024-01-01", 4.0)]
    with pytest.raises(ValueError):
        O.load_releases(spark, str(tmp_path / "rel.csv"), names | {"flow": ["none"]}, "S2A")
    (tmp_path / "obs.csv").write_text("datetime,rate\n2024-01-01 10:00:00+00, \n?,5\n")
    got = O.load_plume_obs(spark, str(tmp_path / "obs.csv"), ["rate"]).collect()
    assert [(str(r.datetime), r.rate) for r in got] == [("2024-01-01 10:00:00", None), ("None", 5.0)] or got[0].datetime.minute == 0
    (tmp_path / "inv.csv").write_text("gas,start_time,emissions_quantity\n CH4,2024-02-01 00:00:00,7\nco2,2024-02-01 00:00:00,8\nch4,?,9\n")
    assert [tuple(r) for r in O.load_inventory(spark, str(tmp_path / "inv.csv")).collect()] == [(2024, 2, 7.0)]


def test_labels_and_sidecars_by_name(spark, tmp_path):
    folder = tmp_path / "deep" / "set1"
    folder.mkdir(parents=True)
    (folder / "S2A_20240625T103631_T32UNE_label.json").write_text(json.dumps({"label": 1}))
    (folder / "S2A_20240626T103631_T32UNE_label.json").write_text(json.dumps({"label": 0, "date": "2024-07-01"}))
    (folder / "other.json").write_text("{}")
    (folder / "x_geo.json").write_text(json.dumps({"scene_id": "x", "width": 10, "transform": [1, 2]}))
    got = O.load_labels(spark, str(tmp_path), "label int, date string").collect()
    assert sorted((r.label, r.source_dir, r.tile, str(r.day)) for r in got) == [(0, "set1", "32UNE", "2024-07-01"), (1, "set1", "32UNE", "2024-06-25")]
    assert [(r.scene_id, r.width) for r in O.scan_sidecars(spark, str(tmp_path)).collect()] == [("x", 10)]


def test_upsert_null_keys_and_repeats(spark):
    schema = "k int, seq int, v string"
    old = spark.createDataFrame([(1, 1, "a"), (None, 1, "b"), (3, 1, "c")], schema)
    new = spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (None, 2, "z")], schema)
    got = O.upsert(old, new, ["k"], "seq").collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "z"), (1, "y"), (3, "c")]
    assert O.upsert(old, new.where("false"), ["k"], "seq").count() == 3
    done = spark.createDataFrame([(1, "ok"), (2, "failed")], "k int, status string")
    work = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert sorted(r.k for r in O.to_do(work, done, ["k"], F.col("status") == "failed").collect()) == [2, 3]


def test_pairs_across_the_date_line_and_equal_ids(spark):
    schema = "site int, lat double, lon double"
    p = spark.createDataFrame([(1, 10.0, 179.95), (2, 10.0, 0.0), (3, None, 0.0)], schema)
    a = spark.createDataFrame([(1, 10.0, -179.95), (9, 10.0, 0.01), (8, 60.0, 0.0)], schema)
    got = {r.site: r.asset for r in J.nearest_within(p, a, 60.0).collect()}
    assert got == {1: 1, 2: 9}
    assert {r.site for r in J.nearest_within(p, a, 60.0, same=True).collect()} == {2}
    assert {r.site: r.flag for r in J.separation_flag(p, a).collect()} == {1: "HARD_EXCLUDE", 2: "HARD_EXCLUDE", 3: "OK"}
    assert J.pairs_within(p.where("false"), a.where("false"), 60.0).count() == 0


def test_leakage_boundaries(spark):
    day = lambda n: dt.date(2024, 1, n)
    e = spark.createDataFrame([(1, day(15), 1), (1, day(16), 2), (2, day(1), 3), (1, None, 4)], "site int, day date, id int")
    t = spark.createDataFrame([(1, day(1)), (1, day(1))], "site int, day date")
    got = {r.id: (r.nearest, r.leak) for r in A.leakage(e, t, 15).collect()}
    assert got == {1: (14, True), 2: (15, False), 3: (None, False), 4: (None, False)}


def test_corrections_over_many_batches_and_late_ones(spark, tmp_path):
    schema = "k int, seq int, ts timestamp, flow double, bad boolean"
    for i, seq in enumerate([3, 1, 4, 2]):
        spark.createDataFrame([(0, seq, dt.datetime(2024, 1, seq), float(seq), seq == 4), (i, 1, None, 1.0, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.k: (r.seq, r.flagged, r.uncertainty) for r in T.upsert_stream(stream, "t", ["k"], "seq", T.flagged_before_write(F.col("flow"), F.col("bad"))).collect()}
    assert got == {0: (4, True, pytest.approx(1.2)), 1: (1, False, 0.15), 2: (1, False, 0.15), 3: (1, False, 0.15)}
    counts = T.final(T.tumbling_counts(stream, "k"), "t").collect()
    assert sorted(r.n for r in counts) == [1, 1, 1, 1]
