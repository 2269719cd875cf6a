import duckdb
import pytest

import __spark_entry__
from spindrift.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet/*.parquet')" if __import__("os").path.isdir(f"{sf_dir}/{t}.parquet") else f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False, name=None))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_sql(spark, sf_dir, duck, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    if sql := catalogue.oracle_sql().get(name):
        expected = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows_of(got) == rows_of(expected)
