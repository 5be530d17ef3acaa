"""Isotonic calibration, the bootstrap of rank statistics, and the audit of flows by exact quartiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.functions.hazard import uniform, uniforms
from plumeledger.functions.running import dealt_out, order_statistics, running_totals
from plumeledger.operators.validation import _reciprocals

_NAMES = ["lo", "hi", "n", "s"]
MOST_SCORES = 50_000
PICKS = 1_000_000


def pooled(blocks: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """(lo, hi, n, s) blocks in order, neighbours pooled until the means s / n rise from block to block."""
    out: list[tuple[float, float, float, float]] = []
    for b in blocks:
        while out and out[-1][3] * b[2] >= b[3] * out[-1][2]:
            a = out.pop()
            b = (a[0], b[1], a[2] + b[2], a[3] + b[3])
        out.append(b)
    return out


def _pool(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(k).to_pylist() for k in _NAMES)))
    done = list(zip(*pooled(rows))) or [()] * 4
    return pa.table([pa.array(list(x), pa.float64()) for x in done], names=_NAMES)


def isotonic_blocks(df: DataFrame, score: str, y: str) -> DataFrame:
    """(lo, hi, n, positives, probability): the blocks of the non-falling fit of a 0/1 label to a score.

    Equal scores are one observation of their number, and neighbours of equal mean are one block, so the fit does not depend on the order of
    ties. Neighbours are pooled within ranges of scores, each in a task of its own; pooling is associative, so what is left of
    all ranges is pooled once more. Few blocks are left: their means are rising fractions, and n labels have room for about n to the
    power 2/3 of these. Rows without score or label are left out; an empty table gives no blocks.
    """
    c = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).cast("double").alias("lo")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    schema = ", ".join(f"{k} double" for k in _NAMES)
    parts = dealt_out(c.withColumn("hi", F.col("lo")), "lo").groupBy("_range").applyInArrow(_pool, schema)
    b = parts.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_pool, schema)
    return b.select("lo", "hi", F.col("n").cast("long").alias("n"), F.col("s").cast("long").alias("positives"), (F.col("s") / F.col("n")).alias("probability"))


def isotonic_summary(df: DataFrame, score: str, y: str, least: int = 3) -> DataFrame:
    """One row: n_pairs, n_blocks, mean_calibration_error (mean distance of label and fit), monotone_before (no 0 above a 1). Null figures with fewer than `least` pairs."""
    b = isotonic_blocks(df, score, y)
    wrong = F.sum(F.col("positives") * (1 - F.col("probability")) + (F.col("n") - F.col("positives")) * F.col("probability"))
    g = b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count(F.lit(1)).alias("n_blocks"), wrong.alias("wrong"))
    p = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).agg(F.max(F.when(F.col(y) == 0, F.col(score))).alias("top0"), F.min(F.when(F.col(y) == 1, F.col(score))).alias("low1"))
    enough = F.col("n_pairs") >= least
    one = g.join(F.broadcast(p))  # a row each
    return one.select("n_pairs", F.when(enough, F.col("n_blocks")).alias("n_blocks"), F.when(enough, F.round(F.col("wrong") / F.col("n_pairs"), 4)).alias("mean_calibration_error"), F.when(enough, F.coalesce(F.col("top0") <= F.col("low1"), F.lit(True))).alias("monotone_before"))


def flow_audit(df: DataFrame, by: str, flow: str, wind: str, outlier: float = 2.5, low_wind: float = 1.5) -> DataFrame:
    """Quartiles, outliers and the recommended figure of each group's flows.

    Quartiles are exclusive, at places (n + 1) / 4 of the order; with fewer than four flows they are the least and greatest.
    Outliers are above `outlier` medians, low-wind ones of these blow under low_wind (null wind is not low). Of the ratio of mean and median: above 1.5 the
    median is recommended, above 1.15 both, else the mean; a median of 0 or less counts as ratio 1. clean_mean leaves outliers out. Null flows are
    left out, groups without flows too; null groups are a group.
    """
    x = df.where(F.col(flow).isNotNull()).select(F.col(by).alias("g"), F.col(flow).cast("double").alias("q"), F.col(wind).cast("double").alias("w"))
    places = {"p25": "case when n < 4 then 1 else (n + 1) * 0.25D end", "median": "(n + 1) * 0.5D", "p75": "case when n < 4 then n else (n + 1) * 0.75D end"}
    o = order_statistics(x, "q", places, "g").withColumnRenamed("g", "of")
    j = x.join(o.hint("merge"), x.g.eqNullSafe(F.col("of")))
    out = F.col("q") > outlier * F.col("median")
    a = j.groupBy("g", "n", "p25", "median", "p75").agg(
        F.min("q").alias("lo"), F.max("q").alias("hi"), F.avg("q").alias("mean"), F.coalesce(F.stddev_samp("q"), F.lit(0.0)).alias("sd"), F.count_if(out).alias("n_outliers"),
        F.count_if(out & (F.col("w") < low_wind)).alias("n_low_wind"), F.avg(F.when(~out, F.col("q"))).alias("clean_mean"),
    )
    skew = F.when(F.col("median") > 0, F.col("mean") / F.col("median")).otherwise(1.0)
    advice = F.when(skew > 1.5, "median").when(skew > 1.15, "both").otherwise("mean")
    return a.select(F.col("g").alias(by), "n", *[F.round(c, 4).alias(c) for c in ("lo", "p25", "median", "p75", "hi", "mean", "sd")], "n_outliers", "n_low_wind", F.round("clean_mean", 4).alias("clean_mean"), F.round(skew, 4).alias("skew"), advice.alias("recommend"))


def _joined_picks(c: DataFrame, n0: int, n1: int, some: int) -> DataFrame:
    """(draw, s, p, q): each draw's picks of a score, positives and negatives; a pick is a row, joined with the row it picks. c: (y, s, c)."""
    places = running_totals(c, "s", ["c"], descending=False, by=("y",))
    places = places.select("y", "s", F.explode(F.sequence(F.col("upto_c") - F.col("c"), F.col("upto_c") - 1)).alias("k"))
    picks = None
    for label, n in ((0, n0), (1, n1)):
        part = c.sparkSession.range(some).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("i"))
        part = part.select("draw", F.lit(label).alias("y"), F.floor(uniform(F.col("draw"), F.lit(label), F.col("i")) * n).alias("k"))
        picks = part if picks is None else picks.unionAll(part)
    return picks.join(places.hint("shuffle_hash"), ["y", "k"]).groupBy("draw", "s").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))


def _counted_picks(spark, counts: list, n0: int, n1: int, some: int) -> DataFrame:
    """_joined_picks() from the ordered rows (y, s, c) of a bounded number of scores: a task counts PICKS picks at a time, which are no rows."""
    sizes, pieces = (n0, n1), [(y, i, min(i + PICKS, n)) for y, n in ((0, n0), (1, n1)) for i in range(0, n, PICKS)]
    scores = [np.array([r["s"] for r in counts if r["y"] == y], np.float64) for y in (0, 1)]
    upto = [np.cumsum([r["c"] for r in counts if r["y"] == y], dtype=np.int64) for y in (0, 1)]
    total = some * len(pieces)

    def count(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                draw, (y, lo, hi) = x // len(pieces), pieces[x % len(pieces)]
                k = np.floor(uniforms(draw, y, np.arange(lo, hi)) * sizes[y]).astype(np.int64)
                n = np.bincount(np.searchsorted(upto[y], k, "right"), minlength=len(upto[y]))
                at = np.flatnonzero(n)
                none = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), draw)), pa.array(scores[y][at]), pa.array(n[at] if y else none), pa.array(none if y else n[at])], names=["draw", "s", "p", "q"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = spark.range(0, total, 1, max(1, min(total, parts, 1 + some * (n0 + n1) // PICKS))).mapInArrow(count, "draw long, s double, p long, q long")
    return one.groupBy("draw", "s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def stratified_bootstrap(df: DataFrame, draws: int = 2000, y: str = "y", score: str = "score") -> DataFrame:
    """Two rows, auroc and ap: n_draws, n_pos, n_neg, point, mean, sd and percentiles over resamples within each class.

    A resample picks as many rows of a class as it has, with replacement, by a hash of (draw, class, place); picks are counted by
    distinct score, and both statistics of a draw come from these counts. p05 to p95 is the interval of 90 %, p025 to p975 that of 95 %.
    Equal scores count half for auroc; for ap they go to positives. Rows without a score or a label of 0 or 1 are left out. With
    one class only there are no figures and n_draws is 0. The set is a validation set: draws x rows picks are made, and its
    distinct scores are held by a task for each draw. Picks are rows only where there are more than MOST_SCORES scores.
    """
    spark = df.sparkSession
    c = df.where(F.col(score).isNotNull() & F.col(y).isin(0, 1)).groupBy(F.col(y).cast("int").alias("y"), F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    sizes = {r["y"]: r["n"] for r in c.groupBy("y").agg(F.sum("c").alias("n")).collect()}  # two rows
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    some = draws if n1 and n0 else 0
    counts = c.orderBy("s", "y").take(MOST_SCORES + 1)
    both = _counted_picks(spark, counts, n0, n1, some) if len(counts) <= MOST_SCORES else _joined_picks(c, n0, n1, some)
    point = c.groupBy(F.lit(-1).cast("long").alias("draw"), "s").agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("q"))
    w = W.partitionBy("draw").orderBy("s")
    below, above = w.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("draw").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    at = both.unionAll(point).select("draw", "p", "q", zero(F.sum("q").over(below)).alias("under"), zero(F.sum("p").over(above)).alias("t"), zero(F.sum("q").over(above)).alias("f"))
    ap = F.when(F.col("p") > 0, F.col("p") - F.col("f") * _reciprocals(F.col("t") + F.col("f"), F.col("p"))).otherwise(0.0)
    d = at.groupBy("draw").agg((F.sum(F.col("p") * (F.col("under") + F.col("q") / 2)) / float(max(n1 * n0, 1))).alias("auroc"), (F.sum(ap) / float(max(n1, 1))).alias("ap"))
    rows = d.select("draw", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("auroc", "ap")])).alias("v")).select("draw", "v.*")
    drawn = F.when(F.col("draw") >= 0, F.col("x"))
    shares = {"p025": 0.025, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p975": 0.975}
    g = rows.groupBy("metric").agg(F.count(drawn).alias("n_draws"), F.max(F.when((F.col("draw") < 0) & F.lit(bool(n1 and n0)), F.col("x"))).alias("point"), F.avg(drawn).alias("mean"), F.stddev_pop(drawn).alias("sd"), *[F.percentile(drawn, F.lit(v)).alias(k) for k, v in shares.items()])
    return g.select("metric", "n_draws", F.lit(n1).cast("long").alias("n_pos"), F.lit(n0).cast("long").alias("n_neg"), F.round("point", 6).alias("point"), *[F.round(k, 4).alias(k) for k in ("mean", "sd", *shares)])
