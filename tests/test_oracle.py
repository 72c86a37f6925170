"""Every registered query against DuckDB on the driver's smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import difference, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    assert difference(spark, con, SF, key) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.columns == ["tweet_id", "safe_text", "risk_score", "reason_code", "pred_escalate"]
