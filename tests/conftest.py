import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def compare():
    """Rows of a frame and of its SQL twin as sorted lists, numbers rounded."""
    import duckdb
    import pandas as pd

    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (bool, int, float)) or type(v).__module__ in ("numpy", "decimal"):
            return round(float(v), 6)
        return str(v)

    def rows(df):
        df = df[sorted(df.columns)]
        return list(df.columns), sorted(repr(tuple(map(value, r))) for r in df.itertuples(index=False, name=None))

    def run(df, sql, root):
        c = duckdb.connect()
        for f in os.listdir(root):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{root}/{f}'")
        return rows(df.toPandas()), rows(c.execute(sql).df())

    return run
