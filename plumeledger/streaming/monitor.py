"""Event streams: the production rule applied as events arrive, and the running status of sites.

The queries here read the events with availableNow: all that is there in batches, then stop. On a live source the same
functions run under another trigger.

Functions that write take `at`, the folder of a stream's output and checkpoint: a later call with the same folder goes on where the last
one stopped, also in another driver, and reads what earlier calls wrote. Without it a call has a folder of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumeledger.functions import scalars as S
from plumeledger.operators import detection as D
from plumeledger.sources import fixtures as X
from plumeledger.sources.scratch import scratch_dir


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The Parquet files of path (a folder or a file) as a stream."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: a plain path must be a folder


def first_of_each(events: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """Events without repeats of an event_id within the delay; state older than that is let go, and later events with it.

    Without a delay no event is late, in whatever order they come, and the state keeps every event_id: for a bounded replay.
    """
    if delay is None:
        return events.dropDuplicates(["event_id"])
    timed = events.withColumn("seen_at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are written whole in a folder, in order; none where it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath() for f in fs.listStatus(path) if f.isDirectory()]
    done = [p for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def drain(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Append all that is available to a Parquet sink, exactly once by its checkpoint, and read the sink."""
    spark, root = stream.sparkSession, at or scratch_dir(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def online_rule(spark: SparkSession, sf_dir: str, files_per_batch: int = 64) -> DataFrame:
    """(event_id, class) of every event: stream without repeats, joined with the present threshold (one row)."""
    tau = D.conformal_threshold(X.scores(spark, sf_dir), [0.1])
    stream = X.score_columns(first_of_each(event_stream(spark, f"{sf_dir}/events.parquet", files_per_batch), delay=None))
    return drain(D.production_rule(stream, tau).select("event_id", "class"), "online-rule")


def tau_at(events: DataFrame, versions: DataFrame) -> DataFrame:
    """events with tau: that of the last version (since, tau) which begins no later than the event's ts; null before the first.

    Versions are few (a row each time the calibration is renewed): they become one sorted array, sent to every task. Of
    versions of one time the greatest tau counts; an event without time has none.
    """
    one = versions.where("since is not null").agg(F.array_sort(F.collect_list(F.struct(F.col("since").cast("timestamp").alias("since"), "tau"))).alias("_versions"))
    held = F.filter("_versions", lambda v: v["since"] <= F.col("ts").cast("timestamp"))
    j = events.crossJoin(F.broadcast(one))  # one row
    return j.withColumn("tau", F.when(F.size(held) > 0, F.element_at(held, -1)["tau"])).drop("_versions")


def versioned_rule(stream: DataFrame, versions_path: str, at: str | None = None) -> DataFrame:
    """(event_id, tau, class) of a stream of scores (event_id, ts, status, sc_cfar, cfar_detect) by the versions of tau at hand.

    The table of versions (Parquet: since, tau) is read anew for each batch, so a version that is added between batches
    counts from the next batch on, for events of its time. Without a version an event is UNCALIBRATED. A batch writes a folder of its
    own; run again, it writes it again.
    """
    spark, root = stream.sparkSession, at or scratch_dir(stream.sparkSession, "versioned-rule")
    schema = "event_id long, tau double, class string"

    def put(batch: DataFrame, n: int) -> None:
        known = tau_at(batch, spark.read.schema("since timestamp, tau double").parquet(versions_path))
        c = F.when(F.col("status") != "ok", "NOT_OK").when(F.col("sc_cfar").isNull(), "NO_COVERAGE").when(F.col("tau").isNull(), "UNCALIBRATED").when(F.col("sc_cfar") <= F.col("tau"), "SUB_TAU")
        out = known.select(F.col("event_id").cast("long").alias("event_id"), "tau", c.when(F.col("cfar_detect"), "DETECTION").otherwise("CFAR_SUPPRESSED").alias("class"))
        out.write.mode("overwrite").parquet(f"{root}/out/{n}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    done = snapshots(spark, f"{root}/out")
    return spark.read.schema(schema).parquet(*[f"{root}/out/{n}" for n in done]) if done else spark.createDataFrame([], schema)


def running_status(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """(site, n_valid, n_detect, last_day, p, tier) of every site after the last batch.

    The state has a row a site. Each batch writes the whole status to a folder of its own, so a batch that is run
    again writes the same folder; the last is read.
    """
    s = X.score_columns(event_stream(spark, f"{sf_dir}/events.parquet"))
    valid, hit = _counted()
    status = s.groupBy("site").agg(F.count_if(valid).alias("n_valid"), F.count_if(hit).alias("n_detect"), F.max("acq_date").alias("last_day"))
    p = F.round(F.when(F.col("n_valid") > 0, F.col("n_detect") / F.col("n_valid")).otherwise(0.0), 4)
    status = status.withColumn("p", p).withColumn("tier", S.risk_tier(F.col("n_valid"), F.col("p")))
    root = at or scratch_dir(spark, "site-status")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{n}")

    status.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    done = snapshots(spark, f"{root}/out")
    return spark.read.schema(status.schema).parquet(f"{root}/out/{done[-1]}") if done else spark.createDataFrame([], status.schema)


def _counted() -> tuple[Column, Column]:
    """Whether a scene score is valid, and whether it is a detection."""
    valid = (F.col("status") == "ok") & F.col("sc_cfar").isNotNull()
    return valid, valid & (F.col("sc_cfar") > 1.15)


class _TierState(StatefulProcessor):
    """Counts and tier of a site; a row comes out only when a batch changes the tier."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "n_valid long, n_detect long, tier string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, k, before = self.state.get() if self.state.exists() else (0, 0, None)
        for part in rows:
            n, k = n + int(part["valid"].sum()), k + int(part["hit"].sum())
        p = round(k / n, 4) if n else 0.0
        tier = "NO_DATA" if not n else "HIGH" if p >= 0.6 else "MEDIUM" if p >= 0.3 else "LOW" if p > 0 else "UNDETECTED"
        self.state.update((n, k, tier))
        if tier != before:
            yield pd.DataFrame({"site": [key[0]], "n_valid": [n], "n_detect": [k], "p": [p], "tier": [tier], "before": [before]})

    def close(self) -> None:
        pass


def tier_changes(stream: DataFrame, at: str | None = None) -> DataFrame:
    """(site, n_valid, n_detect, p, tier, before) each time a batch of scores (site, status, sc_cfar) changes a site's tier; before is null the first time.

    The state of a site is its two counts and its tier, however many events it has; batches bound what a hot site brings at once. Null
    sites are a site.
    """
    spark = stream.sparkSession
    valid, hit = _counted()
    rows = stream.select(F.col("site").cast("long").alias("site"), F.coalesce(valid, F.lit(False)).cast("int").alias("valid"), F.coalesce(hit, F.lit(False)).cast("int").alias("hit"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # keyed state needs it
    try:
        out = rows.groupBy("site").transformWithStateInPandas(statefulProcessor=_TierState(), outputStructType="site long, n_valid long, n_detect long, p double, tier string, before string", outputMode="Append", timeMode="None")
        return drain(out, "tier-changes", at)
    finally:
        spark.conf.set(name, before)
