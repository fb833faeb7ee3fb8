import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """``evaluate(function, texts)``: the column function on each text, in order."""
    from pyspark.sql import functions as F

    def run(function, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = df.select("i", function(F.col("t")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in rows]

    return run
