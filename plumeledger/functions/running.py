"""Running totals and ranks without a window that holds a whole table, or a whole group, in one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.sources.scratch import kept

BUCKETS = 64
MOST_BINS = 100_000


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """df with _range: which of at most BUCKETS ranges of the key a row is in, from 0; null keys are in the first.

    The bounds (63 numbers) are read by the driver from an approximate percentile: where they lie changes the work of the tasks only.
    """
    got = df.agg(F.percentile_approx(key, [i / BUCKETS for i in range(1, BUCKETS)], 1000)).first()[0] or []
    bounds = F.array(*[F.lit(float(b)) for b in sorted(set(got))]).cast("array<double>")
    return df.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(key))))


def running_totals(df: DataFrame, key: str, names: list[str], descending: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each named column, upto_<name>: its sum over this key and all before it, within its group of `by`.

    Keys are distinct within a group. They are dealt into at most BUCKETS ranges; the totals of the ranges, at most BUCKETS
    rows a group, are added to the sums within a range, so a hot group is worked on by as many tasks. Null keys count as least; null
    groups are a group.
    """
    dealt = dealt_out(df, key)
    order = (lambda c: F.col(c).desc()) if descending else F.col
    earlier = W.partitionBy(*by).orderBy(order("_range")).rowsBetween(W.unboundedPreceding, -1)  # at most BUCKETS rows a group
    sums = dealt.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    sums = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in names])
    within = W.partitionBy(*by, "_range").orderBy(order(key)).rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = dealt.withColumns({f"upto_{n}": F.sum(n).over(within) for n in names})
    same = dealt["_range"] == sums["_at"]
    for i, b in enumerate(by):
        same = same & dealt[b].eqNullSafe(sums[f"_by{i}"])
    both = dealt.join(sums.hint("merge") if by else F.broadcast(sums), same)
    return both.select(*df.columns, *[(F.col(f"upto_{n}") + F.col(f"_{n}")).alias(f"upto_{n}") for n in names])


def with_few(df: DataFrame, few: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """df joined with a written table that is mostly small: it is broadcast once its rows are counted as such, else both are shuffled."""
    return df.join(few.hint("broadcast" if few.count() <= MOST_BINS else "merge"), on, how)


def _bin(v: Column) -> Column:
    """A whole number that grows with v: the logarithm of its size in steps of 1/128, below 0 for negative values; NaN is last."""
    size = F.when(F.abs(v) == float("inf"), 10**6).otherwise(F.floor(F.log(F.abs(v)) * 128) + 200_000)  # ln of a double is within -746 and 710
    return F.when(F.isnan(v), 10**6 + 1).when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("int")


def bins_of(v: np.ndarray) -> np.ndarray:
    """_bin() of an array."""
    with np.errstate(divide="ignore"):
        size = np.floor(np.log(np.abs(v)) * 128) + 200_000
    size[np.isinf(v)] = 10**6
    size[v == 0] = 0
    b = np.where(v < 0, -size, size)
    b[np.isnan(v)] = 10**6 + 1
    return b.astype(np.int32)


def order_statistics(df: DataFrame, value: str, places: dict[str, str], by: str) -> DataFrame:
    """(by, n, <name>...) of each group: values at fractional places 1..n of the group's order, between two neighbours linearly.

    places: name -> SQL expression of n, such as "(n + 1) * 0.25"; it is held within 1 and n. Rows are first counted by bins, so that only those
    of a bin that a place falls in are ranked; a group whose values share a bin is ranked whole. Equal values are counted first and ranked by
    ranges, so no group meets in one task or one state. Null values are left out, and groups without others. df is read twice.
    """
    x = df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).withColumn("b", _bin(F.col("v")))
    bins = kept(x.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c")), "value-bins")
    return binned_statistics(bins, lambda some: with_few(x, some, x.g.eqNullSafe(F.col("g1")) & (x.b == F.col("b1")), "left_semi"), places, by)


def binned_statistics(bins: DataFrame, rows_of: Callable[[DataFrame], DataFrame], places: dict[str, str], by: str) -> DataFrame:
    """order_statistics() of rows that were counted before. bins: a written table (g, b, c) of the counts c by group and bin; rows_of: the rows (g, b, v) of a written table (g1, b1) of bins."""
    upto = running_totals(bins, "b", ["c"], descending=False, by=("g",))
    n = bins.groupBy(F.col("g").alias("g2")).agg(F.sum("c").alias("n"))
    at = F.array(*[F.struct(F.lit(k).alias("k"), F.greatest(F.lit(1.0), F.least(F.expr(e).cast("double"), F.col("n").cast("double"))).alias("at")) for k, e in places.items()])
    want = n.select("g2", "n", F.explode(at).alias("w")).select("g2", "n", "w.k", "w.at")
    # the value at rank j is the one whose running count first reaches j
    near = (F.col("upto_c") >= F.floor("at")) & (F.col("upto_c") - F.col("c") < F.floor("at") + 1)
    held = upto.join(want.hint("merge"), upto.g.eqNullSafe(F.col("g2"))).where(near)
    held = kept(held.select("g", "b", "k", "n", "at", (F.col("upto_c") - F.col("c")).alias("before")), "value-places")
    some = kept(held.select(F.col("g").alias("g1"), F.col("b").alias("b1"), "before").distinct(), "value-bins")
    c = rows_of(some).groupBy(F.struct("g", "b").alias("gb"), "v").agg(F.count(F.lit(1)).alias("c"))
    r = running_totals(kept(c, "values"), "v", ["c"], descending=False, by=("gb",))
    r = r.join(some.hint("merge"), F.col("gb.g").eqNullSafe(F.col("g1")) & (F.col("gb.b") == F.col("b1"))).select("gb", "v", "c", (F.col("upto_c") + F.col("before")).alias("upto_c"))
    want = held.select(F.col("g").alias("g2"), F.col("b").alias("b2"), "n", "k", "at")
    j = r.join(want.hint("merge"), F.col("gb.g").eqNullSafe(F.col("g2")) & (F.col("gb.b") == F.col("b2"))).where(near)
    low = F.max(F.when(F.col("upto_c") - F.col("c") < F.floor("at"), F.col("v")))
    high = F.max("v")
    share = F.first(F.col("at") - F.floor("at"))
    got = j.groupBy("g2", "n", "k").agg((low + F.when(share > 0, (high - low) * share).otherwise(0.0)).alias("x"))
    return got.groupBy("g2", "n").agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(k) for k in places]).withColumnRenamed("g2", by)
