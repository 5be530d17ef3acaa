import math
import os

import duckdb
import pytest

from plumeledger.operators import detection, validation
from plumeledger.plans import registry

DATA = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return v.isoformat()[:10] if hasattr(v, "isoformat") else f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(_value(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_conformal_rank_and_ties(spark):
    df = spark.createDataFrame([(float(i // 2),) for i in range(35)] + [(None,)], "sc_cfar double")
    got = {r.alpha: r.tau for r in detection.conformal_threshold(df, [0.05, 0.1, 0.5]).collect()}
    s = sorted(i // 2 for i in range(35))
    assert got == {a: s[min(math.ceil(36 * (1 - a)), 35) - 1] for a in got}


def test_rule_boundaries(spark):
    rows = [(1, "ok", 2.0, True), (2, "ok", 2.1, True), (3, "ok", 2.1, False), (4, "ok", None, True), (5, "failed", 9.0, True)]
    tau = spark.createDataFrame([(2.0,)], "tau double")
    got = {r.event_id: r["class"] for r in detection.production_rule(spark.createDataFrame(rows, "event_id int, status string, sc_cfar double, cfar_detect boolean"), tau).collect()}
    assert got == {1: "SUB_TAU", 2: "DETECTION", 3: "CFAR_SUPPRESSED", 4: "NO_COVERAGE", 5: "NOT_OK"}


def test_auroc_equals_area(spark):
    df = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, float(i * 7 % 11)) for i in range(60)], "doc_id int, y int, score double")
    assert validation.auroc(df).first().auroc == pytest.approx(validation.auc(df).first().auc)
    assert validation.auroc(df.where("y = 1")).first().auroc is None
