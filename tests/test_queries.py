"""Every registered query that has SQL gives the same rows as DuckDB on the same tables."""

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(repr, r)) for r in zip(*(table[n].to_pylist() for n in names)))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toArrow()) == rows(duck.sql(registry.SQL[name]).to_arrow_table())


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
