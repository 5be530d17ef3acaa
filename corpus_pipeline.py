"""A corpus pipeline of five stages; each reads all that its predecessor kept, from Parquet.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. run() applies them to the table documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeledger.llm.components import join_counted
from plumeledger.llm.decontaminate import contamination
from plumeledger.llm.jaccard_join import linked_components
from plumeledger.llm.line_dedup import line_dedup
from plumeledger.llm.packing import best_fit
from plumeledger.llm.shared import importable, written
from plumeledger.llm.toxicity import score, train


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from the labelled ones among docs. Null and empty texts are scored too; repeated rows share their fate; an empty table gives no rows."""
    importable(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(score(docs, model).where("predicted = 0"), docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of duplicate lines one occurrence stays; n_chars follows the text. A document that loses its whole text goes; null, empty and blank ones stay."""
    got = line_dedup(docs, min_words=0)
    lost = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    got = got.where(~lost)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        got = got.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _columns(got, docs)


def _row_key() -> Column:
    """A string for id and text that sorts as the id does, nulls last."""
    known = F.expr("lpad(hex(cast(doc_id as bigint) ^ (-9223372036854775807 - 1)), 16, '0')")
    return F.concat(F.coalesce(known, F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts stays: that of the least doc_id, nulls last; of several texts of that id, that of the least digest.

    Rows are judged each by its own text, so of an id with several texts only those go that are copies. Of repeated rows
    one stays, of rows without id too. Null, empty and blank texts belong to no group and all stay. An empty table gives no rows.
    """
    keyed = docs.select(_row_key().alias("doc_id"), "text")
    got = linked_components(keyed, k=5, similarity=(80, 100)).where("n_shingles > 0")
    fate = got.groupBy("doc_id").agg(F.first(F.expr("component_id <> doc_id")).alias("gone"), F.count(F.lit(1)).alias("rows"))
    fate = written(fate.where("gone or rows > 1").select(F.col("doc_id").alias("row_key"), "gone"), "pipeline-fate")
    marked = join_counted(docs.withColumn("own_key", _row_key()), fate, F.col("own_key") == F.col("row_key"), "left")
    kept = _columns(marked.where("row_key is null"), docs)
    once = marked.where("not gone").dropDuplicates(["own_key"])
    return kept.unionAll(_columns(once, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark contaminates go; those without words stay."""
    got = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(got.where(~F.col("contaminated")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' places in training sequences."""
    return best_fit(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained model, SimHash candidates and the packing of shards are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
