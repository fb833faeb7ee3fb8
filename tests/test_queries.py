"""Every registered query against its SQL, and the driver contract."""

import __spark_entry__ as contract
import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert difference(spark, duck, SF_DIR, name) is None


def test_contract(spark):
    assert set(contract.queries()) >= set(contract.oracle_sql())
    assert set(contract.queries()) >= set(QUERIES) >= set(ORACLES)
    df = contract.entry(spark)
    assert df.columns == ["first_seq", "scheme", "host", "port", "tag", "link"]
    assert df.count() > 0
