import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Rows of a query over the tables of a scale factor, as DuckDB has them."""
    import duckdb

    def rows(sql, sf="sf0.001", tables=None):
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            if tables and t in tables:
                con.register(t, tables[t])
            else:
                con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
        got = con.sql(sql)
        return list(got.columns), got.fetchall()

    return rows
