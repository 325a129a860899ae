"""Training-data queries that SQL can express, against it; and the registry."""

import pytest

import __spark_entry__
from passagekit.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001") == ""


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in names}
