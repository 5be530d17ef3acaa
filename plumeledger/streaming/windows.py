"""Event streams: logs, counts by time window, sessions, interval joins and upserts of corrections.

Null times and null keys: an event without a time is in no window and no session; a null join key meets nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.sources import stores
from plumeledger.sources.scratch import scratch_dir
from plumeledger.streaming.monitor import snapshots


def log_stream(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Append a stream to a JSON-lines log, exactly once by its checkpoint, and read the log by the stream's schema; `at` as in monitor."""
    spark, root = stream.sparkSession, at or scratch_dir(stream.sparkSession, name)
    query = stream.writeStream.format("json").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).json(f"{root}/out")


def final(aggregate: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """The whole result of a streaming aggregate after its last batch; `at` as in monitor.

    Each batch writes a folder of its own, so a batch that runs again writes the same folder; the last whole one is found in
    the folder. Without batches: empty.
    """
    spark, root = aggregate.sparkSession, at or scratch_dir(aggregate.sparkSession, name)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{n}")

    aggregate.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    done = snapshots(spark, f"{root}/out")
    return spark.read.schema(aggregate.schema).parquet(f"{root}/out/{done[-1]}") if done else spark.createDataFrame([], aggregate.schema)


def tumbling_counts(events: DataFrame, by: str, delay: str | None = None, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events by window and class. With a delay, later events are dropped and old windows let go; a bounded replay takes none."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", delay) if delay else e
    return e.groupBy(F.window("ts", size, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def monthly_counts(events: DataFrame, by: str) -> DataFrame:
    """Events by calendar month and class."""
    return events.where("ts is not null").groupBy(F.trunc("ts", "month").alias("month"), by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, gap: str, delay: str | None = None) -> DataFrame:
    """Runs of events of a key that lie no more than gap apart: start of the run, time of its last event, events."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", delay) if delay else e
    g = e.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.select(key, F.col("w.start").alias("start"), "last", "n")


def near_in_time(left: DataFrame, right: DataFrame, key: str, minutes: int, delay: str | None = None) -> DataFrame:
    """Pairs (left_id, right_id) of one key at most so many minutes apart.

    Watermarks on both sides and the bound on time let the state go; a bounded replay takes no delay and loses nothing.
    A hot key is dealt by time slot: each left event goes to its own slot, each right event to its own and both neighbours.
    """
    width = minutes * 60
    slot = lambda c: F.floor(F.unix_timestamp(c) / width)
    side = lambda df, p: df.select(F.col("event_id").alias(f"{p}_id"), F.col(key).alias(f"{p}_key"), F.col("ts").cast("timestamp").alias(f"{p}_ts"))
    a, b = side(left, "left"), side(right, "right")
    if delay:
        a, b = a.withWatermark("left_ts", delay), b.withWatermark("right_ts", delay)
    a = a.withColumn("left_slot", slot("left_ts"))
    b = b.withColumn("right_slot", F.explode(F.sequence(slot("right_ts") - 1, slot("right_ts") + 1)))
    span = F.expr(f"interval {minutes} minutes")
    on = (F.col("left_key") == F.col("right_key")) & (F.col("left_slot") == F.col("right_slot"))
    return a.join(b, on & F.col("right_ts").between(F.col("left_ts") - span, F.col("left_ts") + span)).select("left_id", "right_id")


#: Parts of a snapshot; a batch rewrites those only that its keys are in.
PARTS = 64


def _newest(spark, out: str, before: int | None = None) -> dict[int, str]:
    """The folder of the newest whole version of each part of a snapshot, of batches before one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    found: dict[int, str] = {}
    for n in snapshots(spark, out):
        if before is None or n < before:
            path = fs_path(f"{out}/{n}")
            for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
                name = f.getPath().getName()
                if name.startswith("_part="):
                    found[int(name.removeprefix("_part="))] = f"{out}/{n}/{name}"
    return found


def upsert_stream(stream: DataFrame, name: str, keys: list[str], order: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, at: str | None = None) -> DataFrame:
    """Snapshot of the row of each key that is last by order, whatever batch it came in; prepare is applied before the write. `at` as in monitor.

    Keys are dealt into PARTS parts. A batch writes anew the parts it has keys of, from their newest versions before it, so a
    batch that runs again writes the same; other parts stay as they are. A late correction with a smaller order changes nothing.
    """
    spark, root = stream.sparkSession, at or scratch_dir(stream.sparkSession, name)
    out = f"{root}/out"
    schema = prepare(spark.createDataFrame([], stream.schema)).schema
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")

    def put(batch: DataFrame, n: int) -> None:
        new = prepare(batch)
        touched = {r["p"] for r in new.select(part.alias("p")).distinct().collect()}  # PARTS numbers at most
        old = [folder for p, folder in _newest(spark, out, n).items() if p in touched]
        if old:
            new = new.unionByName(spark.read.schema(schema).parquet(*old))
        stores.latest(new, keys, order).withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(f"{out}/{n}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    found = list(_newest(spark, out).values())
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def flagged_before_write(flow: Column, degraded: Column) -> Callable[[DataFrame], DataFrame]:
    """A prepare step: rows made of degraded inputs are marked and their uncertainty is 30 per cent instead of 15."""
    bad = F.coalesce(degraded, F.lit(False))
    return lambda df: df.withColumns({"flagged": bad, "uncertainty": flow * F.when(bad, 0.30).otherwise(0.15)})
