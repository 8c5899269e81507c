"""Every query that has an SQL twin gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from mosaik import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def sortable(row):
    return tuple((v is None, "nan" if isinstance(v, float) and math.isnan(v) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_rows_and_types_equal_those_of_sql(spark, duck, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    r = duck.sql(Q.SQL[name])
    assert sorted(r.columns) == names
    at = [r.columns.index(n) for n in names]
    kinds = dict(zip(r.columns, map(str, r.types), strict=True))
    assert {n: TYPES[t] for n, t in df.dtypes} == kinds
    got = sorted((tuple(row[n] for n in names) for row in df.collect()), key=sortable)
    want = sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=sortable)
    assert list(map(sortable, got)) == list(map(sortable, want))


@pytest.mark.parametrize("name", ["spmv_logkmeans16", "spmv_logkmeans128"])
def test_codebook_products_are_near(spark, sf_dir, name):
    plain = {r["row"]: r.y for r in Q.QUERIES["spmv_fp16"](spark, sf_dir).collect()}
    assert Q.QUERIES[name](spark, sf_dir).count() == len(plain)
