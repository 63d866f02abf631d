"""Every query with an oracle gives DuckDB's rows; the others give rows."""

import duckdb
import pytest

from tidegauge import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    names = sorted(frame.columns)
    plain = frame[names].astype(object).where(frame[names].notna(), None)
    return names, sorted(tuple(map(str, r)) for r in plain.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, data, duck):
    got = queries.queries()[name](spark, data).toPandas()
    if name in queries.oracle_sql():
        assert rows(got) == rows(duck.execute(queries.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_flagship(spark, data):
    assert queries.flagship(spark, data).count() == 1
