import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a Column expression over texts: values(expr, texts) -> list."""
    from pyspark.sql import functions as F

    def run(expr, texts, kind="string"):
        df = spark.createDataFrame(list(enumerate(texts)), f"i int, t {kind}")
        return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]

    return run
