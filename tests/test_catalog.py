"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest
from conftest import SF
from riskloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame):
    columns = sorted(frame.columns)
    return sorted(str(r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected, found = con.execute(catalog.SQL[name]).df(), catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)


def test_flagship_delivers(spark):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, "/root/testdata/sf0.01").count() > 0
