import pytest
from parity import compare

from graphweft.plans import ingest, run, structure, tools  # noqa: F401  they add their queries to the catalogue
from graphweft.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001") is None
