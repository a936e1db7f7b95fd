import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def connect(sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        return con

    return connect


def normal(rows):
    """Rows as sorted tuples of comparable values."""
    cell = lambda v: "~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL."""

    def compare(function, sql, sf_dir=f"{DATA}/sf0.001"):
        df = function(spark, sf_dir)
        columns = sorted(df.columns)
        ran = duck(sf_dir).execute(sql)
        names = [d[0] for d in ran.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert normal(df.select(*columns).collect()) == normal([tuple(r[i] for i in at) for r in ran.fetchall()])

    return compare
