"""Proportional stratified interleaving: every shard has the sources in the proportions of the whole table.

The rows of a source are put in a seeded random order; row r of n has the fractional rank (r + u) / n, where u is a
seeded number of the source between 0 and 1 (so that sources of one row do not all fall in the middle). All rows are put
in order of fractional rank and cut into shards whose counts differ by one at most. A shard then holds of each source its share, give or
take two rows.

Nothing is ranked in one task: a source is dealt into ranges of its random numbers and fractional ranks into equal
cells, both about ROWS rows each by construction, however hot a source is; totals of ranges and cells (at most CELLS a source) are
added up first. Ranking moves keys of some 60 bytes a row; whole rows are shuffled twice, once to meet their place and
once into their shard's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.llm.shared import shared_dir, with_columns_of, written

SHARDS = 16
SEED = "interleave-1"
#: Rows of a range or cell, and the most of these.
ROWS, CELLS = 8_192, 65_536
#: Bytes of text a task writes.
TASK_BYTES = 32 << 20


def _number(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a whole number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _key(by: str, seed: str) -> Column:
    """Digest of id, stratum and text: rows alike in all three are alike to the operator."""
    parts = [F.lit(seed), F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("n")), _stratum(by), F.md5(F.coalesce(F.col("text"), F.lit("")))]
    return F.unhex(F.md5(F.concat_ws(":", *parts)))


def _stratum(by: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{by}`").cast("string")), F.lit("n"))


def _shard(n: int, shards: int) -> Column:
    return F.expr(f"cast((pos * {shards}) div {max(n, 1)} as int)")


def _slot(n: int, shards: int) -> Column:
    """Position less the first position of its shard."""
    return F.expr(f"pos - (((pos * {shards}) div {max(n, 1)}) * {n} + {shards - 1}) div {shards}")


def placements(docs: DataFrame, shards: int = SHARDS, by: str = "source", seed: str = SEED) -> tuple[DataFrame, int, int]:
    """((key, copy, pos, shard, slot), rows, bytes): a place for each row of docs, known by key and number among its repeats.

    pos counts all rows, slot the rows of a shard, from 0. Null sources are a source of their own. Repeated rows get a
    place each, spread over the shards like others; they are counted before they are shuffled. Ties of fractional ranks go to the lesser
    source. An empty table gives no rows.
    """
    own = docs.select(_key(by, seed).alias("key"), _stratum(by).alias("stratum"), text_size(F.col("text")).alias("size"))
    own = written(own.groupBy("key", "stratum").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("size")), "shards-keys")
    n, size = own.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    cells = min(CELLS, n // ROWS + 1)
    rows = own.select("key", "stratum", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    turn = F.md5(F.concat_ws(":", F.lit(seed), F.lower(F.hex("key")), F.col("copy").cast("string")))
    rows = rows.select("*", F.unhex(turn).alias("turn"), F.shiftright(_number(turn, 4) * cells, 16).alias("range"))

    within, all_of = W.partitionBy("stratum").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy("stratum")
    totals = rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("c"))
    totals = totals.select("stratum", "range", (F.sum("c").over(within) - F.col("c")).alias("before"), F.sum("c").over(all_of).alias("of"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("stratum", "range").orderBy("turn", "key", "copy")) - 1
    offset = (_number(F.md5(F.concat_ws(":", F.lit(seed), "stratum")), 5) + F.lit(0.5)) / F.lit(float(1 << 20))
    ranked = rows.join(totals.hint("merge"), ["stratum", "range"]).select("key", "copy", "stratum", "turn", ((rank + offset) / F.col("of")).alias("fraction"))
    ranked = ranked.withColumn("cell", F.least(F.floor(F.col("fraction") * cells), F.lit(cells - 1)).cast("int"))
    ranked = written(ranked, "shards-ranks")

    earlier = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # at most CELLS rows
    sums = ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).select(F.col("cell").alias("at"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("cell").orderBy("fraction", "stratum", "turn", "key", "copy")) - 1
    placed = ranked.join(F.broadcast(sums), F.col("cell") == F.col("at")).select("key", "copy", place.alias("pos"))
    return placed.withColumns({"shard": _shard(n, shards), "slot": _slot(n, shards)}), n, size


def _own(docs: DataFrame) -> list[str]:
    """The columns of docs that its shards keep."""
    return [c for c in dict.fromkeys(docs.columns) if c.lower() not in {"shard", "pos", "slot", "_key", "_kind", "_nth"}]


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, by: str = "source", seed: str = SEED) -> None:
    """docs with shard, pos and slot as Parquet in folder/shard=k, whose files hold runs of slots in order.

    Columns of docs called shard, pos or slot (or _key, _kind, _nth) are left out. Of rows alike in id, source and text but not in
    further columns it is undefined which takes which of their places. A shard without rows has no folder.

    Rows and places go through one shuffle: the nth row of a key comes right after the key's nth place and takes it.
    """
    d = with_columns_of(docs, *_own(docs))
    placed, n, size = placements(d, shards, by, seed)
    parts = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    places = placed.select(F.col("key").alias("_key"), F.lit(0).alias("_kind"), "pos")
    both = d.select("*", _key(by, seed).alias("_key"), F.lit(1).alias("_kind")).unionByName(places, allowMissingColumns=True)
    both = both.repartition(parts, "_key").withColumn("_nth", F.row_number().over(W.partitionBy("_key", "_kind").orderBy(F.lit(0))))
    rows = both.withColumn("pos", F.lag("pos").over(W.partitionBy("_key").orderBy("_nth", "_kind"))).where("_kind = 1").drop("_key", "_kind", "_nth")
    rows = rows.withColumns({"shard": _shard(n, shards), "slot": _slot(n, shards)})
    rows = rows.repartitionById(parts, F.expr(f"cast((pos * {parts}) div {max(n, 1)} as int)")).sortWithinPartitions("pos")
    rows.write.partitionBy("shard").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(folder)


def read_shards(spark, folder: str, like: DataFrame) -> DataFrame:
    """The rows that write_shards put there, with the columns of like, pos, slot and shard."""
    own = set(_own(like))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name in own]
    return spark.read.schema(", ".join([*kinds, "pos long", "slot long", "shard int"])).parquet(folder)


def op11_stratified_shards(spark, sf_dir) -> DataFrame:
    """Every document of the table, from the shards' files; law `rows`: counts of shards differ by one at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    folder = shared_dir(spark, "shards")
    write_shards(docs, folder)
    text = F.coalesce(F.col("text"), F.lit(""))
    got = read_shards(spark, folder, docs)
    return got.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
