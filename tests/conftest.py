import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, float):
        return "NaN" if x != x else repr(round(x, 6) + 0.0)
    return str(x)


def same_rows(table, other):
    """Equal columns and rows, whatever their order."""
    assert sorted(table.column_names) == sorted(other.column_names)
    names = sorted(table.column_names)
    rows = [sorted(zip(*[map(_plain, t[n].to_pylist()) for n in names], strict=True)) for t in (table, other)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="session")
def compare():
    return same_rows
