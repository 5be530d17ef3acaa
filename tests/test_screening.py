import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumeledger.functions.running import running_totals
from plumeledger.operators import screening as C
from plumeledger.operators import summaries as M
from plumeledger.operators import validation as V
from plumeledger.streaming import monitor

SCORES = "event_id int, site int, acq_date date, sc_cfar double, cloud int, cfar_detect boolean, status string"


def test_running_totals_both_ways(spark):
    rows = [(float(i), i % 7) for i in range(500)] + [(None, 3)]
    df = spark.createDataFrame(rows, "s double, c int")
    up = {r.s: r.upto_c for r in running_totals(df, "s", ["c"], descending=False).collect()}
    down = {r.s: r.upto_c for r in running_totals(df, "s", ["c"]).collect()}
    total = sum(c for _, c in rows)
    assert all(up[float(i)] == 3 + sum(j % 7 for j in range(i + 1)) for i in (0, 1, 63, 499))
    assert all(up[s] + down[s] - c == total for s, c in rows)
    assert running_totals(df.where("false"), "s", ["c"]).count() == 0


def test_average_precision_of_large_tie(spark):
    y = [1, 0, 1] + [1] * 3000 + [0] * 10
    s = [3.0, 2.0, 2.0] + [1.0] * 3010
    df = spark.createDataFrame(list(enumerate(zip(y, s))), "doc_id int, r struct<y:int,score:double>").select("doc_id", "r.*")
    ranked, tp, total = sorted(zip(s, y), reverse=True), 0, 0.0
    for k, (_, hit) in enumerate(ranked, 1):
        tp += hit
        total += hit * tp / k
    assert V.average_precision(df).first().ap == pytest.approx(total / sum(y), abs=1e-6)
    assert V.average_precision(df.where("y = 0")).first().ap is None


def test_first_reason_wins(spark):
    rows = [(0.2, 0.2, 0.0, 1.0, 1.0), (0.0, 0.0, None, 3.0, 900.0), (0.01, 0.5, 1.0, 3.0, 1.0), (0.2, 0.1, 1.0, 30.0, 199.0), (0.2, 0.1, 1.0, 30.0, 200.0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "m double, c double, cv double, sc double, q double")
    got = [r[0] for r in df.select(C.exclude_reason(*[F.col(x) for x in ("m", "c", "cv", "sc", "q")])).collect()]
    assert got == ["uniform_field", "partial_swath", "low_site_mean", "low_flow", "high_ratio", None]


def test_calendar_and_fallback_with_nulls(spark):
    d = dt.date(2024, 2, 28)
    rows = [(1, 1, d, 1.0, 30, True, "ok"), (2, 1, dt.date(2024, 3, 1), 2.0, 10, True, "ok"), (3, 2, None, None, None, None, None), (4, None, d, 1.0, 50, True, "ok"), (5, 3, d, 3.0, 35, False, "ok")]
    df = spark.createDataFrame(rows, SCORES)
    days = {(r.site, r.acq_date.day): r.n for r in C.daily_calendar(df, "site", "acq_date").collect()}
    assert days == {(1, 28): 1, (1, 29): 0, (1, 1): 1, (None, 28): 1, (3, 28): 1}
    assert {r.event_id for r in C.ceiling_fallback(df, ["site"], [20, 40]).collect()} == {2, 5}
    assert {r.event_id for r in M.best_per_site(df, 2.5).collect()} == {1, 4}
    assert C.daily_calendar(df.where("false"), "site", "acq_date").count() == 0


def test_governance_counts(spark):
    cols = "wind_source string, era5_offset_h double, bitemporal_missing boolean, cloud int, solar_zenith double"
    df = spark.createDataFrame([("Climatological_3.5ms", -5.0, True, 16, 71.0), ("era5", 4.0, False, 15, 70.0), (None,) * 5], cols)
    got = C.governance(df)
    assert [(len(r.flags), r.excluded) for r in got.collect()] == [(5, True), (0, False), (0, False)]
    assert {r.flag: r.n for r in C.governance_summary(got).collect()}["TOTAL"] == 3


def test_online_rule_of_files_out_of_order(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    days = sorted(r.d for r in events.select(F.to_date("ts").alias("d")).distinct().collect())
    newest = [(days[-7:], "a"), (days[:-14], "b"), (days[-14:-7], "c")]  # the latest days come first
    for some, name in newest:
        part = events.where(F.to_date("ts").isin(some)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = monitor.online_rule(spark, str(tmp_path), files_per_batch=1)
    assert len(days) > 14 and got.count() == events.select("event_id").distinct().count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, monitor.online_rule(spark, str(tmp_path)).collect()))


def test_flat_scene_has_no_mass(spark):
    from plumeledger.operators.pixels import band_retrieval

    px = spark.createDataFrame([(1, i // 10, i % 10, 0.2, 0.2, 0.9 if i < 12 else 0.0) for i in range(100)], "scene int, row int, col int, b11 double, b12 double, prob double")
    assert [r.mass_kg for r in band_retrieval(px, least_background=8).collect()] == [0.0]


def test_draws_depend_on_their_keys_alone(spark):
    from plumeledger.functions import hazard as H
    from plumeledger.operators import risk as R

    d = spark.range(20_000).withColumn("u", H.uniform(F.col("id"), F.lit(3)))
    a, b = d.agg(F.avg("u"), F.stddev("u")).first()
    assert a == pytest.approx(0.5, abs=0.01) and b == pytest.approx(12**-0.5, abs=0.01)
    few = {r.path: r.price for r in R.price_paths(spark.range(5).withColumnRenamed("id", "path"), "orderly", 4).where("year = 2027").collect()}
    many = {r.path: r.price for r in R.price_paths(spark.range(50).withColumnRenamed("id", "path"), "orderly", 4).where("year = 2027").collect()}
    assert few == {k: many[k] for k in few} and len(many) == 50
    assert R.price_paths(spark.range(0).withColumnRenamed("id", "path"), "orderly").count() == 0
    q = spark.range(1).select(H.erfc(F.lit(0.5)).alias("e"), H.normal_cdf(F.lit(-1.0)).alias("c"), H.rating_of(F.lit(None).cast("double")).alias("r")).first()
    assert q.e == pytest.approx(0.4795001, abs=1e-6) and q.c == pytest.approx(0.1586553, abs=1e-6) and q.r is None


def test_names_and_empty_joins(spark):
    from plumeledger.operators import scenes as N

    names = ["S2A_MSIL1C_20240230T101531_N0500_R022_T31UXX_1", "crop_2024-02-29", "x", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(N.acquisition_date(F.col("n")).alias("a"), N.loose_date(F.col("n")).alias("l"), N.product_parts(F.col("n"))["tile"].alias("t")).collect()
    assert [(r.a, r.l, r.t) for r in got] == [(None, None, "T31UXX"), (None, dt.date(2024, 2, 29), "unknown"), (None, None, "unknown"), (None, None, "unknown")]
    obs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 23, 45), 1.0, 2.0)], "id int, at timestamp, lat double, lon double")
    w = spark.createDataFrame([(dt.datetime(2024, 1, 2, 0, 0), 1.1, 2.1, 3.0, 4.0)], "at timestamp, lat double, lon double, u double, v double")
    assert [(r.speed, r.source) for r in N.wind_asof(obs, w).collect()] == [(5.0, "era5")]
    assert [(r.speed, r.direction, r.source) for r in N.wind_asof(obs, w.limit(0)).collect()] == [(3.5, None, "fallback")]
