import pytest

from scrivener.llm import registry
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    compare(spark, "sf0.001", registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
