import duckdb
import pytest

import __spark_entry__
from fieldstone import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def rows(df):
    plain = lambda v: tuple(v) if isinstance(v, list) else round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in df), key=str)


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in catalogue.QUERIES.items() if sql))
def test_query_equals_its_oracle(spark, con, name):
    f, sql = catalogue.QUERIES[name]
    df = f(spark, D)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    found = con.execute(sql)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = rows(tuple(r[k] for k in at) for r in found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
