import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1])
    b = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    return b.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
