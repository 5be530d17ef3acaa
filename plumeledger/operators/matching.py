"""Substring containment between two tables through an index of character runs, and the overlap of candidate sites with a training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an indexed run; shorter patterns are sought by runs of their own length.
RUN = 3


def _runs(text: Column, n: int) -> Column:
    """The distinct runs of n characters; none in a shorter text."""
    last = F.length(text) - n + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))


def contained(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, text): distinct pairs of strings of which the text has the pattern in it, ignoring case.

    patterns has a column pattern, texts a column text. A pattern is sought by that of its runs of three characters which the
    fewest texts have, so it meets few texts beside those that contain it; each is then looked at in full. Null and empty patterns are
    in nothing; null texts contain nothing.
    """
    p = patterns.select("pattern").where("pattern <> ''").distinct().withColumn("low", F.lower("pattern"))
    t = texts.select("text").where("text <> ''").distinct().withColumn("lower", F.lower("text"))
    index = None
    for n in range(1, RUN + 1):
        part = t.select("text", "lower", F.explode(_runs(F.col("lower"), n)).alias("run"))
        index = part if index is None else index.unionAll(part)
    size = F.least(F.length("low"), F.lit(RUN))
    keys = p.select("pattern", "low", F.explode(F.when(size == 1, _runs(F.col("low"), 1)).when(size == 2, _runs(F.col("low"), 2)).otherwise(_runs(F.col("low"), RUN))).alias("key"))
    counts = index.groupBy(F.col("run").alias("counted")).agg(F.count(F.lit(1)).alias("c"))
    rare = keys.join(counts.hint("merge"), F.col("key") == F.col("counted"), "left")
    # a run that no text has rules the pattern out
    rare = rare.groupBy("pattern", "low").agg(F.min_by("key", F.struct(F.coalesce("c", F.lit(0)), "key")).alias("key"))
    j = rare.join(index.hint("merge"), F.col("key") == F.col("run"))
    return j.where(F.contains("lower", "low")).select("pattern", "text").distinct()


def overlap_matches(candidates: DataFrame, train: DataFrame) -> DataFrame:
    """(site, crop, source, label): the training crops (crop, tile, source, label) on a candidate's tile or with its name in theirs.

    An OR of two equalities: of tiles, and of names by contained(); a crop that meets both counts once. Repeated crops count each; null tiles are equal to
    nothing.
    """
    t = train.select("crop", "tile", "source", "label").withColumn("row", F.xxhash64("crop", "tile", "source", "label"))
    t = t.groupBy("row", "crop", "tile", "source", "label").agg(F.count(F.lit(1)).alias("times"))
    c = candidates.select("site", F.col("tile").alias("own_tile")).distinct()
    by_tile = c.join(t.hint("merge"), F.col("own_tile") == F.col("tile")).select("site", "row", "crop", "source", "label", "times")
    names = contained(candidates.select(F.col("site").alias("pattern")), train.select(F.col("crop").alias("text")))
    by_name = names.join(t.hint("merge"), F.col("text") == F.col("crop")).select(F.col("pattern").alias("site"), "row", "crop", "source", "label", "times")
    both = by_tile.unionAll(by_name).distinct()
    return both.select("site", "crop", "source", "label", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_n")).drop("_n")


def site_overlap(candidates: DataFrame, train: DataFrame) -> DataFrame:
    """(site, in_training, roles, n_crops) of each candidate (site, tile); roles: negative, positive, synthetic_substrate, sorted, joined by commas.

    A crop whose source says synthetic is a substrate whatever its label; labels other than 0 and 1 give no role.
    """
    m = overlap_matches(candidates, train)
    role = F.when(F.contains("source", F.lit("synthetic")), "synthetic_substrate").when(F.col("label") == 1, "positive").when(F.col("label") == 0, "negative")
    g = m.groupBy(F.col("site").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles"))
    j = candidates.select("site").distinct().join(g.hint("merge"), F.col("site") == F.col("of"), "left")
    return j.select("site", F.col("n").isNotNull().alias("in_training"), F.coalesce("roles", F.lit("")).alias("roles"), F.coalesce("n", F.lit(0)).cast("long").alias("n_crops"))
