import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmap.plans import oracles, queries

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def plain(v):
    return "none" if v is None or v != v else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_query_agrees_with_its_oracle(spark, duck, name):
    df = queries.REGISTRY[name](spark, SMALL)
    got, columns = df.collect(), sorted(df.columns)
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_top_k_is_one_bounded_sort(spark):
    plan = queries.vec_topk(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    from quillmap.operators.search import vector_search

    df = vector_search(spark.read.parquet(f"{SMALL}/embeddings.parquet"), [1.0] * 64, F.col("label") == 3, 5, "vec_id")
    assert "EqualTo(label,3)" in df._jdf.queryExecution().executedPlan().toString()
