"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces go, longest first, into the open bin with the least room that still fits; if
none does, the least-cost bin size is opened: each permitted length is filled, on trial, with the largest pieces
still to come, and the one of least cost a token, after downsizing, is opened. In the end each bin is downsized to the least
permitted length that holds its contents. Packings that open one length throughout are worked out too, and a shard
takes the cheapest. A bin of c tokens costs c + OVERHEAD. Shards are dealt by a hash of doc_id, so each is packed in a
task of its own; a shard of SHARD pieces loses at most a few part-filled bins against one packing of all.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.llm.shared import importable

SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
SHARD = 5000


def word_count(text: Column) -> Column:
    """Words that white space parts, and one end mark."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")).cast("long") + 1


def _trial_fill(first: int, size: int, ascending: list[int], ahead: int) -> int:
    """Tokens in a bin of `size` that holds `first` and then, each time, the largest that fits of the `ahead` shortest."""
    room = size - first
    while room > 0 and ahead > 0:
        end = bisect.bisect_right(ascending, room, 0, ahead)
        if not end:
            break
        n = ascending[end - 1]
        start = bisect.bisect_left(ascending, n, 0, end)
        room -= n * min(end - start, room // n)
        ahead = start
    return size - room


def _least_cost(first: int, ascending: list[int], ahead: int, sizes: tuple[int, ...], overhead: int) -> int:
    """The permitted size whose trial fill costs least a token; of equal ones the smallest."""
    best = None
    for c in sizes:
        if c >= first:
            f = _trial_fill(first, c, ascending, ahead)
            cost = (sizes[bisect.bisect_left(sizes, f)] + overhead) / f
            if best is None or cost < best[0]:
                best = cost, c
    return best[1]


def _pack(lengths: list[int], opened: int | None, sizes: tuple[int, ...], overhead: int) -> tuple[list[int], list[int]]:
    """Bin of each length (in descending order) and the fill of each bin. opened: the size to open (or the least that fits); None: the least-cost one of each bin."""
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    bins, fill, ascending = [], [], lengths[::-1]
    for k, n in enumerate(lengths):
        i = bisect.bisect_left(room, (n, -1))
        if i == len(room):
            b = len(fill)
            left = _least_cost(n, ascending, len(lengths) - k - 1, sizes, overhead) if opened is None else max(opened, next(c for c in sizes if c >= n))
            fill.append(0)
        else:
            left, b = room.pop(i)
        fill[b] += n
        bins.append(b)
        if left > n:
            bisect.insort(room, (left - n, b))
    return bins, fill


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], int]:
    """Bin of each length, size of each bin, and the cost. lengths: in descending order, none above the largest size."""
    sizes = tuple(sorted(sizes))
    best = None
    for opened in (None, *sizes):
        bins, fill = _pack(lengths, opened, sizes, overhead)
        final = [sizes[bisect.bisect_left(sizes, f)] for f in fill]
        cost = sum(final) + overhead * len(final)
        if best is None or cost < best[2]:
            best = bins, final, cost
    return best


RESULT = "doc_id long, piece long, n_tokens long, bin_id string, bin_size long, bin_offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.string()), ("bin_size", pa.int64()), ("bin_offset", pa.int64())])


def best_fit(docs: DataFrame, length: Column | None = None, *, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, bin_size, bin_offset) for each document.

    length: tokens of a row, by default word_count(text); null or less than 1 counts as 1 (the end mark). A document longer
    than the largest size is cut into pieces of that size and a rest; nothing is dropped. Repeated rows are
    packed each; rows of null doc_id form shards like others. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    top = max(sizes)
    n = F.greatest(F.coalesce(length if length is not None else word_count(F.col("text")), F.lit(1)).cast("long"), F.lit(1))
    d = docs.select("doc_id", n.alias("n"))
    count = F.ceil(F.col("n") / top).cast("long")
    pieces = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("n"))
    total = d.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def run(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "doc_id", "piece"))), key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2]))
        bins, size, _ = pack([r[0] for r in rows], sizes, overhead)
        at, offsets = [0] * len(size), []
        for r, b in zip(rows, bins):
            offsets.append(at[b])
            at[b] += r[0]
        name = key[0].as_py()
        columns = [[r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows], [f"{name}-{b}" for b in bins], [size[b] for b in bins], offsets]
        return pa.table([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)

    return pieces.groupBy("shard").applyInArrow(run, RESULT)


def op6_best_fit_packing(spark, sf_dir) -> DataFrame:
    """Every document of the table."""
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
