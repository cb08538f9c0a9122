"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def run(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())


@pytest.fixture(scope="module")
def found(spark, request):
    """Results of the queries that are asked for, some at a time: small tables leave most of a session idle."""
    names = [i.callspec.params["name"] for i in request.session.items if getattr(i, "originalname", "") == "test_equals_sql"]
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(run, spark, n) for n in names} if os.path.exists(SF) else {}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(found, duck, name):
    if name not in found:
        pytest.skip("no tables")
    cols, got = found[name].result()
    asked = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in asked.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
