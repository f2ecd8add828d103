import pytest

from chunkloom.plans import registry
from oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, sf, tmp_path, name):
    only_sql, only_spark, expected, got = differences(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf, tmp_path / "out")
    assert (only_sql, only_spark) == (0, 0)
    assert expected == got


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == ["item_id", "rank", "doc_id", "chunk_idx", "score", "text"]
    assert flagship.count() == 160
