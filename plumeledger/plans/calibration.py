"""Queries over isotonic calibration and flow audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeledger.operators import calibration as C
from plumeledger.plans import risk
from plumeledger.sources import fixtures as X


def _flows(s, d):
    """Detected flows of each site with a wind speed."""
    x = X.scores(s, d).where("status = 'ok' and cfar_detect")
    return x.select("site", (F.col("sc_cfar") * F.col("sc_cfar") * 100).alias("q"), (F.col("cloud") % 10 / 2.0).alias("wind"))


QUERIES = {
    "f17_isotonic_blocks": lambda s, d: C.isotonic_blocks(X.pairs(s, d), "score", "y").withColumn("probability", F.round("probability", 9)),
    "f17_isotonic_summary": lambda s, d: C.isotonic_summary(X.pairs(s, d), "score", "y"),
    "f10_stratified_bootstrap": lambda s, d: C.stratified_bootstrap(X.pairs(s, d)),
    "e19_flow_audit": lambda s, d: C.flow_audit(_flows(s, d), "site", "q", "wind"),
}

#: By definition: the fit at a score is the greatest, over starts before it, of the least mean over ends after it.
_FIT = """, u AS (SELECT score, count(*) AS n, sum(y) AS s FROM v_pairs GROUP BY score),
c AS (SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs, row_number() OVER w AS k FROM u WINDOW w AS (ORDER BY score)),
m AS (SELECT i.k AS i, j.k AS j, (j.cs - i.cs + i.s) / (j.cn - i.cn + i.n)::DOUBLE AS m FROM c i JOIN c j ON i.k <= j.k),
l AS (SELECT i, k, min(m) AS m FROM m JOIN c ON c.k BETWEEN i AND j GROUP BY i, k), f AS (SELECT k, max(m) AS fit FROM l GROUP BY k),
b AS (SELECT min(score) AS lo, max(score) AS hi, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS positives, fit AS probability FROM f JOIN c USING (k) GROUP BY fit)"""

_SHARES = ", ".join(f"round(quantile_cont(x, {v}) FILTER (b >= 0), 4) AS {k}" for k, v in (("p025", 0.025), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p975", 0.975)))

SQL = {
    "f10_stratified_bootstrap": f""", s AS (SELECT y, score, row_number() OVER (PARTITION BY y ORDER BY score) - 1 AS k, count(*) OVER (PARTITION BY y) AS n FROM v_pairs WHERE y IN (0, 1)),
 dr AS (SELECT b, y, n, i FROM (SELECT unnest(range(2000)) AS b) CROSS JOIN (SELECT y, n, unnest(range(n)) AS i FROM (SELECT DISTINCT y, n FROM s))),
 pk AS (SELECT b, s.y, s.score FROM (SELECT b, y, CAST(floor({risk._u('b', 'y', 'i')} * n) AS BIGINT) AS k FROM dr) p JOIN s ON s.y = p.y AND s.k = p.k UNION ALL SELECT -1, y, score FROM s),
 rk AS (SELECT b, y, sum(y) OVER w AS tp, row_number() OVER w AS k, rank() OVER (PARTITION BY b ORDER BY score) AS lo, count(*) OVER (PARTITION BY b, score) AS same FROM pk WINDOW w AS (PARTITION BY b ORDER BY score DESC, y DESC ROWS UNBOUNDED PRECEDING)),
 st AS (SELECT b, sum(y) AS n1, count(*) - sum(y) AS n0, sum(CASE WHEN y = 1 THEN lo + (same - 1) / 2.0::DOUBLE END) AS ranks, sum(CASE WHEN y = 1 THEN tp / k::DOUBLE END) AS prec FROM rk GROUP BY b),
 m AS (SELECT b, n1, n0, unnest(['auroc', 'ap']) AS metric, unnest([(ranks - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0)::DOUBLE, prec / n1::DOUBLE]) AS x FROM st)
 SELECT metric, count(*) FILTER (b >= 0) AS n_draws, CAST(max(n1) AS BIGINT) AS n_pos, CAST(max(n0) AS BIGINT) AS n_neg, round(max(x) FILTER (b < 0), 6) AS point, round(avg(x) FILTER (b >= 0), 4) AS mean, round(stddev_pop(x) FILTER (b >= 0), 4) AS sd, {_SHARES} FROM m GROUP BY metric""",
    "f17_isotonic_blocks": f"{_FIT} SELECT lo, hi, n, positives, round(probability, 9) AS probability FROM b",
    "f17_isotonic_summary": f"{_FIT} SELECT CAST(sum(n) AS BIGINT) AS n_pairs, count(*) AS n_blocks, round(sum(positives * (1 - probability) + (n - positives) * probability) / sum(n), 4) AS mean_calibration_error, (SELECT coalesce(max(score) FILTER (y = 0) <= min(score) FILTER (y = 1), true) FROM v_pairs) AS monotone_before FROM b",
    "e19_flow_audit": """, x AS (SELECT site, sc_cfar * sc_cfar * 100 AS q, cloud % 10 / 2.0 AS w FROM v_scores WHERE status = 'ok' AND cfar_detect),
 s AS (SELECT site, count(*) AS n, list(q ORDER BY q) AS v FROM x GROUP BY site), p AS (SELECT *, (n + 1) * 0.25::DOUBLE AS a, (n + 1) * 0.5::DOUBLE AS h, (n + 1) * 0.75::DOUBLE AS c FROM s),
 t AS (SELECT site, n, CASE WHEN n < 4 THEN v[1] ELSE v[CAST(floor(a) AS INT)] + (a - floor(a)) * (v[CAST(floor(a) AS INT) + 1] - v[CAST(floor(a) AS INT)]) END AS p25, quantile_cont(q, 0.5) AS median, CASE WHEN n < 4 THEN v[n] ELSE v[CAST(floor(c) AS INT)] + (c - floor(c)) * (v[CAST(floor(c) AS INT) + 1] - v[CAST(floor(c) AS INT)]) END AS p75 FROM p JOIN x USING (site) GROUP BY ALL),
 g AS (SELECT site, t.n, p25, median, p75, min(q) AS lo, max(q) AS hi, avg(q) AS mean, coalesce(stddev_samp(q), 0) AS sd, count(*) FILTER (q > 2.5 * median) AS n_outliers, count(*) FILTER (q > 2.5 * median AND w < 1.5) AS n_low_wind, avg(q) FILTER (NOT q > 2.5 * median) AS clean_mean FROM x JOIN t USING (site) GROUP BY ALL)
 SELECT site, n, round(lo, 4) AS lo, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, round(hi, 4) AS hi, round(mean, 4) AS mean, round(sd, 4) AS sd, n_outliers, n_low_wind, round(clean_mean, 4) AS clean_mean, round(mean / median, 4) AS skew, CASE WHEN mean / median > 1.5 THEN 'median' WHEN mean / median > 1.15 THEN 'both' ELSE 'mean' END AS recommend FROM g""",
}
