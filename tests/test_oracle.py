import pytest

from accessmine.plans import models, registry, tables  # noqa: F401
from tests.oracle import compared, connected

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, con, name):
    assert compared(registry.QUERIES[name](spark, DIR), registry.ORACLE[name], con) is None
