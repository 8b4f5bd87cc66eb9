import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from strandmill.session import local_session

    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def comparable(value):
    import decimal
    import math

    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return [comparable(v) for v in value] if isinstance(value, list) else value


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the rows and column names of a SQL result, in any order."""

    def check(df, sql):
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        order = sorted(names)
        expected = sorted(str([comparable(row[names.index(n)]) for n in order]) for row in result.fetchall())
        assert sorted(df.columns) == order
        assert sorted(str([comparable(row[n]) for n in order]) for row in df.collect()) == expected

    return check
