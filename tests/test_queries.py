"""Each query of the search engine against its SQL in DuckDB; those without SQL give rows."""

import pytest

from compare import rows
from lakeseek.plans import registry

SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_as_sql(key, spark, sf_dir, duck):
    mine, theirs = QUERIES[key](spark, sf_dir).toPandas(), duck.execute(SQL[key]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(key, spark, sf_dir):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "lang"]
