"""Ranking metrics and calibration of scored labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeledger.functions import scalars as S
from plumeledger.functions.running import running_totals


def _counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """(s, p, q): positives and negatives at each distinct score."""
    return df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) == 0).cast("long")).alias("q"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Counts at each distinct threshold (score >= threshold is positive); equal scores are combined first."""
    return _curve(df, y, score).drop("p", "q", "n1", "n0")


def _curve(df: DataFrame, y: str, score: str) -> DataFrame:
    c = _counts(df, y, score)
    all_ = c.agg(F.sum("p").alias("n1"), F.sum("q").alias("n0"))
    c = running_totals(c, "s", ["p", "q"]).crossJoin(F.broadcast(all_))  # one row
    c = c.select(F.col("s").alias("threshold"), "p", "q", F.col("upto_p").alias("tp"), F.col("upto_q").alias("fp"), "n1", "n0")
    rate = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0)
    more = {"fn": F.col("n1") - F.col("tp"), "tn": F.col("n0") - F.col("fp"), "tpr": rate("tp", "n1"), "fpr": rate("fp", "n0")}
    return c.withColumns(more)


def auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """AUC by the trapezoid rule over roc_curve(). The point before has this one's counts less its own p and q."""
    wide = F.when(F.col("n0") > 0, F.col("q") / F.col("n0")).otherwise(0.0)
    before = F.when(F.col("n1") > 0, (F.col("tp") - F.col("p")) / F.col("n1")).otherwise(0.0)
    return _curve(df, y, score).agg(F.round(F.sum(wide * (F.col("tpr") + before) / 2), 6).alias("auc"))


def auroc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Concordant pairs and half of the ties, from counts at distinct scores; null with one class only."""
    c = running_totals(_counts(df, y, score), "s", ["q"], descending=False)
    below = F.col("upto_q") - F.col("q")
    g = c.agg(F.sum(F.col("p") * (below + F.col("q") / 2)).alias("u"), F.sum("p").alias("n1"), F.sum("q").alias("n0"))
    return g.select(F.round(F.try_divide(F.col("u"), F.col("n1") * F.col("n0")), 6).alias("auroc"))


def _reciprocals(start: Column, n: Column, exact: int = 1000) -> Column:
    """1/(start+1) + ... + 1/(start+n): the first terms one by one, the rest by the expansion of harmonic numbers."""
    first = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(exact))), F.lit(0.0), lambda a, i: a + 1 / (start + i))
    harmonic = lambda m: F.log(m) + 1 / (2 * m) - 1 / (12.0 * m * m)
    return first + F.when(n > exact, harmonic((start + n).cast("double")) - harmonic((start + exact).cast("double"))).otherwise(0.0)


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Ties go to positives; null without positives.

    Of p positives with equal score the i-th has precision (t + i) / (t + f + i), t and f being the positives and
    negatives above, so the rows need no order of their own.
    """
    c = _curve(df, y, score).where("p > 0")
    t, f = F.col("tp") - F.col("p"), F.col("fp") - F.col("q")
    return c.agg(F.round(F.sum(F.col("p") - f * _reciprocals(t + f, F.col("p"))) / F.sum("p"), 6).alias("ap"))


def optimal_threshold(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, f1): the threshold of the greatest F1; of equal ones the least."""
    c = _curve(df, y, score).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    best = c.agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))
    return best.select("threshold", F.round("f1", 6).alias("f1"))


def auc_interval(df: DataFrame, y: str = "y", score: str = "score", z: float = 1.645) -> DataFrame:
    """(auc, se, lo, hi) with the closed-form standard error of the area; bounds clipped to 0..1."""
    n = df.agg(F.sum((F.col(y) == 1).cast("long")).alias("n1"), F.sum((F.col(y) == 0).cast("long")).alias("n0"))
    a, n1, n0 = F.col("auroc"), F.col("n1"), F.col("n0")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    var = (a * (1 - a) + (n1 - 1) * (q1 - a * a) + (n0 - 1) * (q2 - a * a)) / (n1 * n0)
    g = auroc(df, y, score).crossJoin(n).withColumn("se", F.sqrt(F.greatest(var, F.lit(0.0))))  # one row each
    lo, hi = F.greatest(F.lit(0.0), a - z * F.col("se")), F.least(F.lit(1.0), a + z * F.col("se"))
    return g.select(a.alias("auc"), F.round("se", 6).alias("se"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def calibration_bins(df: DataFrame, n: int = 5) -> DataFrame:
    """Mean predicted and observed rate in n equal bins of the predicted one; a bin without rows predicts its middle and observes 0. Null scores are left out."""
    p = S.logistic(F.col("score"), 0.5, 1.15)
    b = df.where("score is not null").select(F.least(F.floor(p * n), F.lit(n - 1)).cast("int").alias("bin"), p.alias("p"), "y")
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
    bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    g = bins.join(g.hint("shuffle_hash"), "bin", "left").withColumns({"n": F.coalesce("n", F.lit(0)).cast("long"), "predicted": F.coalesce("predicted", (F.col("bin") + 0.5) / n), "observed": F.coalesce("observed", F.lit(0.0))})
    return g.select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


def calibration_errors(df: DataFrame, n: int = 5) -> DataFrame:
    """One row: n, brier (mean squared distance of prediction and label) and ece (mean distance of a bin's rates, weighted by its rows); null figures without rows."""
    brier = df.where("score is not null").agg(F.avg(F.pow(S.logistic(F.col("score"), 0.5, 1.15) - F.col("y"), F.lit(2))).alias("brier"))
    g = calibration_bins(df, n).agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))), F.sum("n")).alias("ece"))
    return g.crossJoin(F.broadcast(brier)).select("n", F.round("brier", 5).alias("brier"), F.round("ece", 5).alias("ece"))  # a row each


def concordance(df: DataFrame) -> DataFrame:
    """Agreement and chance-corrected agreement of two 0/1 labels."""
    a = df.agg(F.avg((F.col("y") == F.col("y2")).cast("double")).alias("po"), F.avg("y").alias("a"), F.avg("y2").alias("b"))
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return a.select(F.round("po", 6).alias("agreement"), F.round(F.when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))
