"""Every registered query against its SQL; the others give rows."""

import pytest

from passagekit.plans import ORACLE_SQL, QUERIES

from .compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
