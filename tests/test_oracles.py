"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from melodex import plans
from melodex.plans.similarity import RANKED

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from read_parquet('{t}')")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_codes_give_every_vector_what_exact_search_gives(spark, duck):
    sql = f"{RANKED} SELECT query_id, rank, song_id, round(score,6) AS score FROM ranked WHERE rank<=10"
    assert rows(plans.QUERIES["pq_topk"](spark, DATA).toPandas()) == rows(duck.execute(sql).df())
