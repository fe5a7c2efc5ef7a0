"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tabloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    return "" if v is None or isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small_dir, name):
    ours = catalog.QUERIES[name](spark, small_dir).toPandas()
    if name not in catalog.SQL:
        assert len(ours)
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
        theirs = con.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))
