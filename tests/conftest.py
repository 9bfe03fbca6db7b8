import numbers
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallybook.session import session

    s = session("tests", 4, **{"spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _plain(v):
    """A cell in a form that both engines share: numbers by value, missing ones alike, all else as text."""
    if v is None or v is pd.NA or v != v:
        return "~"
    if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_):
        return f"{float(v):.12g}"
    return str(v)


def same_rows(left, right):
    """Two pandas frames hold the same rows, whatever their order and number types."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a, b = (sorted(tuple(map(_plain, r)) for r in f[columns].astype(object).itertuples(index=False)) for f in (left, right))
    assert a == b
