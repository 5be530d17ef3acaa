"""The test tables in the shapes of the library: scores, sites, pairs of label and score, pixels, exposures, wind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scores(spark, d) -> DataFrame:
    return score_columns(_t(spark, d, "events"))


def score_columns(e: DataFrame) -> DataFrame:
    """Events, a table or a stream, as scene scores."""
    k = F.get_json_object("props", "$.k").cast("int")
    sc, cv = F.col("value") / 20.0, (k % 17) / 10.0
    return e.select("event_id", (F.col("user_id") % 10).alias("site"), F.to_date("ts").alias("acq_date"), sc.alias("sc_cfar"), k.alias("cloud"), cv.alias("cv"),
                    (sc > 1.15 + 3 * cv).alias("cfar_detect"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))


def sites(spark, d) -> DataFrame:
    s, n, r = _t(spark, d, "supplier"), _t(spark, d, "nation"), _t(spark, d, "region")
    key = F.col("s_suppkey")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows
    return j.select(key.alias("site"), (45 + (key * 37 % 1000) / 100.0).alias("lat"), (-5 + (key * 91 % 2500) / 100.0).alias("lon"), F.col("n_name").alias("ticker"), F.col("r_name").alias("ecoregion"))


def pairs(spark, d) -> DataFrame:
    l, t = _t(spark, d, "labels"), _t(spark, d, "documents").select("doc_id", "n_chars")
    return l.join(t, "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("y2"), ((F.col("n_chars") % 1000) / 100.0).alias("score"))


def pixels(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    x = F.abs(F.col("x").cast("double"))
    return e.select(F.col("vec_id").alias("scene"), F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).alias("col"), (0.1 + x).alias("b11"), (0.85 * (0.1 + x) * F.when(x * 2 >= 0.3, 0.9).otherwise(1.0)).alias("b12"), (x * 2).alias("prob"))  # a plume darkens band 12


def exposures(spark, d) -> DataFrame:
    o, c, n = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.select(F.col("c_mktsegment").alias("bank"), F.col("n_name").alias("ticker"), F.col("o_totalprice").cast("double").alias("exposure"))


def wind(spark, d) -> DataFrame:
    e = _t(spark, d, "events").where("event_type = 'view'")
    return e.select("event_id", (F.col("value") / 100 - 2).alias("u"), (F.get_json_object("props", "$.k").cast("int") / 50.0 - 1).alias("v"))


#: The same views for DuckDB.
SQL = """
WITH v_scores AS (SELECT event_id, user_id % 10 AS site, CAST(ts AS DATE) AS acq_date, value / 20.0 AS sc_cfar, CAST(json_extract_string(props, '$.k') AS INTEGER) AS cloud,
  (CAST(json_extract_string(props, '$.k') AS INTEGER) % 17) / 10.0 AS cv, value / 20.0 > 1.15 + 3 * ((CAST(json_extract_string(props, '$.k') AS INTEGER) % 17) / 10.0) AS cfar_detect,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events),
v_sites AS (SELECT s_suppkey AS site, 45 + (s_suppkey * 37 % 1000) / 100.0 AS lat, -5 + (s_suppkey * 91 % 2500) / 100.0 AS lon, n_name AS ticker, r_name AS ecoregion
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
v_pairs AS (SELECT doc_id, quality AS y, toxic AS y2, (n_chars % 1000) / 100.0 AS score FROM labels JOIN documents USING (doc_id)),
v_pixels AS (SELECT scene, p // 8 AS "row", p % 8 AS col, 0.1 + abs(x) AS b11, 0.85 * (0.1 + abs(x)) * CASE WHEN abs(x) * 2 >= 0.3 THEN 0.9 ELSE 1.0 END AS b12, abs(x) * 2 AS prob
  FROM (SELECT vec_id AS scene, unnest(range(64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)),
v_exposures AS (SELECT c_mktsegment AS bank, n_name AS ticker, CAST(o_totalprice AS DOUBLE) AS exposure FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
v_wind AS (SELECT event_id, value / 100 - 2 AS u, CAST(json_extract_string(props, '$.k') AS INTEGER) / 50.0 - 1 AS v FROM events WHERE event_type = 'view')
"""
