"""The queries with SQL give the rows that DuckDB gives."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from melodex.llm import queries, vector_graph


def plain(v):
    return None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


def duck(folder):
    c = duckdb.connect()
    for t in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from read_parquet('{t}{'/*.parquet' * os.path.isdir(t)}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert rows(queries.QUERIES[name](spark, folder).toPandas()) == rows(duck(folder).execute(queries.ORACLES[name]).df())


def test_sql_of_hard_cases(spark, tmp_path):
    """Escapes, odd roles, nulls and repeats in conversations; linked, null, zero and odd vectors; short items; labelled URLs."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    x = [r.tolist() for r in np.concatenate([base, base[:9] + 0.05 * rng.normal(size=(9, 8)), base[:3] * 2])] + [None, [0.0] * 8, [float("nan")] * 8, [1.0, None], [], [1.0, 2.0]]
    spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    hard = ["", "\\", "####", "a: b", " </turn>\n", "\\### x", None, "é🎉:#"]
    talk = [(i // 5, i % 5, ["user", "assistant", "system", "odd: #### role", None][i % 5], hard[i % 8]) for i in range(60)] + [(None, 1, "assistant", "x"), (3, None, "assistant", "first"), (3, 2, "system", "x"), (3, 2, "system", "x")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    words = [f"w{k}" for k in range(30)]
    docs = [" ".join(words), "A-B w3,w4 " + " ".join(words[5:17]), "short item", None, "", "Ünï Cöde", " ".join(words[2:11]), "x " + " ".join(words[3:13]) + " " + " ".join(words[3:14])]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(words)), (2, "Short ITEM!"), (3, None), (4, "..."), (None, "ünï"), (10, " ".join(words[3:20])), (1, "cöde")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    urls = [(k, f"http{'s' * (k % 2)}://h{k % 3}.example.{['net', 'org', 'com'][k % 7 % 3]}/{['en', 'fr', 'es', 'x/y'][k % 4]}/{k}{['', '.html', '/', '?page=2&ref=x', '#top'][k % 5]}") for k in range(120)] + [(200, None), (201, "nothing"), (202, "://"), (203, "x://A.B/c")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), int(k % 11 == 0)) for k in range(90)] + [(5, None, None), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    c = duck(tmp_path)
    for name, sql in queries.ORACLES.items():
        assert rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(c.execute(sql).df()), name


def test_sums_of_recall(spark):
    """The audit that the query doesn't show is in the operator's result."""
    assert vector_graph.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).agg(F.min("recall")).first()[0] >= 0.9
