import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])
    b = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    return b.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and an extra column of a clashing name."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "a b c d e f"), (4, " \n\t "), (5, long), (6, "one two three four five six seven")]
    rows += [(7, "x"), (8, "X\ny  z <|endoftext|>"), (None, None)]
    return spark.createDataFrame([(*r, "en", None, 3, 0.5, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, key boolean")
