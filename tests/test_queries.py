"""Each registered query against its SQL."""

import duckdb
import pandas as pd
import pytest

from assay import queries

TABLES = "events documents conversations labels nation region customer".split()


def plain(x):
    if x is None or (not isinstance(x, list | dict) and pd.isna(x)):
        return ""
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = c.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
