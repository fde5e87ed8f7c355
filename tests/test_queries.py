"""Every registered query of the force-trace jobs against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from forcejobs.jobs.registry import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples; numbers as floats, anything missing as None."""

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    rows = [tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got, want = queries()[name](spark, sf_dir).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert len(got) == len(want)
    for a, b in zip(canonical(got), canonical(want)):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).columns
