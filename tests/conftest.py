from __future__ import annotations

import os
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _bag(df, columns):
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return Counter(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query's rows with its SQL's, by DuckDB on the same tables."""
    import duckdb

    def check(got, sql: str, sf: str = "sf0.001", tables: dict | None = None):
        con = duckdb.connect()
        for t in TABLES:
            if tables and t in tables:
                con.register(t, tables[t])
            elif os.path.exists(p := f"{DATA}/{sf}/{t}.parquet"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
        want, got = con.execute(sql).df(), got.toPandas()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert _bag(want, columns) == _bag(got, columns)

    return check
