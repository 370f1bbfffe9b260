import pytest

from scrivener.plans import registry
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    compare(spark, "sf0.001", registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert not any(all(v is None for v in r) for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
