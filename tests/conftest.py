from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def _plain(x):
    import pandas as pd

    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (bool, int, float)):
        return round(float(x), 6)
    return str(x).removesuffix(" 00:00:00")


@pytest.fixture(scope="session")
def rows():
    """Rows of a pandas frame, in an order of their own, with columns by name."""
    return lambda frame: (sorted(frame.columns), sorted((tuple(_plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr))
