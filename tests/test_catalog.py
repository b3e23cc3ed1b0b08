"""Every query against its SQL oracle on the smallest tables: names, types and values."""

import math
import os

import duckdb
import pytest

from skylattice.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else str(round(x, 6) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_oracle(spark, duck, folder, name):
    df = catalog.queries()[name](spark, folder)
    answer = duck.execute(catalog.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in answer.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    names = [d[0] for d in answer.description]
    want = sorted(tuple(plain(v) for v in row) for row in answer.fetchall())
    got = sorted(tuple(plain(row[c]) for c in names) for row in df.collect())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
