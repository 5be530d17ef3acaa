import datetime as dt

from pyspark.sql import functions as F

from plumeledger.streaming import monitor as M
from plumeledger.streaming import windows as T

SCHEMA = "site int, event_id long, ts timestamp, status string, sc_cfar double, cfar_detect boolean"


def at(day):
    return dt.datetime(2024, 1, day, 12, tzinfo=dt.timezone.utc)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def row(site, i, score, day=1, status="ok"):
    return (site, i, at(day), status, score, score is not None and score > 1.15)


def test_tier_changes_over_batches_and_a_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [row(1, 1, 2.0), row(1, 2, 1.0), row(2, 3, None), row(None, 4, 1.0)])
    first = {r.site: (r.n_valid, r.n_detect, r.p, r.tier, r.before) for r in M.tier_changes(stream(spark, src), out).collect()}
    assert first == {1: (2, 1, 0.5, "MEDIUM", None), 2: (0, 0, 0.0, "NO_DATA", None), None: (1, 0, 0.0, "UNDETECTED", None)}
    put(spark, src, [row(1, 5, 1.0), row(2, 6, 2.0)])  # site 1 stays MEDIUM: 1 of 3
    put(spark, src, [row(1, 7, 1.0), row(2, 8, 3.0, status="failed")])  # site 1: 1 of 4, LOW; site 2 unchanged
    got = sorted((r.site or 0, r.tier, r.before or "", r.n_valid) for r in M.tier_changes(stream(spark, src), out).collect())
    assert got == [(0, "UNDETECTED", "", 1), (1, "LOW", "MEDIUM", 4), (1, "MEDIUM", "", 2), (2, "HIGH", "NO_DATA", 1), (2, "NO_DATA", "", 0)]
    assert M.tier_changes(stream(spark, src), out).count() == 5  # nothing new, nothing twice


def test_versions_of_tau_between_batches(spark, tmp_path):
    src, out, taus = (str(tmp_path / x) for x in ("in", "out", "taus"))
    versions = "since timestamp, tau double"
    spark.createDataFrame([(at(5), 2.0)], versions).write.parquet(taus)
    put(spark, src, [row(1, 1, 2.5, 6), row(1, 2, 2.5, 1), row(1, 3, None, 6), row(1, 4, 9.0, 6, "failed")])
    M.versioned_rule(stream(spark, src), taus, out)
    spark.createDataFrame([(at(10), 3.0), (at(10), 2.9), (None, 0.0)], versions).write.mode("append").parquet(taus)
    put(spark, src, [row(1, 5, 2.5, 6), row(1, 6, 2.5, 11), row(1, 7, 2.5, 10), (1, 8, None, "ok", 2.5, True)])
    got = {r.event_id: r["class"] for r in M.versioned_rule(stream(spark, src), taus, out).collect()}
    assert got == {1: "DETECTION", 2: "UNCALIBRATED", 3: "NO_COVERAGE", 4: "NOT_OK", 5: "DETECTION", 6: "SUB_TAU", 7: "SUB_TAU", 8: "UNCALIBRATED"}


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [row(s, 10, 1.0) for s in range(40)])
    first = T.upsert_stream(stream(spark, src), "u", ["site"], "event_id", at=out)
    assert first.count() == 40
    put(spark, src, [row(3, 11, 2.0), row(4, 9, 7.0), row(99, 1, 5.0)])
    got = {r.site: r.sc_cfar for r in T.upsert_stream(stream(spark, src), "u", ["site"], "event_id", at=out).collect()}
    assert len(got) == 41 and (got[3], got[4], got[99], got[5]) == (2.0, 1.0, 5.0, 1.0)
    assert M.snapshots(spark, f"{out}/out") == [0, 1]
    parts = [p.name for p in (tmp_path / "out" / "out" / "1").iterdir() if p.name.startswith("_part=")]
    assert 1 <= len(parts) <= 3  # only what the batch touched is written anew


def test_counts_and_logs_go_on_after_a_restart(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [row(1, 1, 1.0), row(2, 2, 1.0)])
    counts = lambda: {r.site: r.n for r in T.final(stream(spark, src).groupBy("site").agg(F.count("*").alias("n")), "c", str(tmp_path / "c")).collect()}
    logs = lambda: T.log_stream(stream(spark, src).select("site", "event_id"), "l", str(tmp_path / "l")).count()
    assert counts() == {1: 1, 2: 1} and logs() == 2
    put(spark, src, [row(1, 3, 1.0)])
    assert counts() == {1: 2, 2: 1} and logs() == 3
    assert counts() == {1: 2, 2: 1} and logs() == 3
    assert M.snapshots(spark, str(tmp_path / "none")) == []
