"""Every registered query against its SQL."""

import pytest
from pyspark.sql import functions as F

from tallyloom import registry

registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, same):
    from conftest import DATA

    if name in registry.ORACLE_SQL:
        same(registry.QUERIES[name], registry.ORACLE_SQL[name])
    else:
        assert registry.QUERIES[name](spark, f"{DATA}/sf0.001").count() >= 0


def _odd(df):
    """The rows of a table, one of nulls alone, two of them again, and one whose strings are empty."""
    one = df.limit(1)
    nulls = one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    blank = one.select(*[F.lit("").alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])
    return df.union(nulls).union(df.limit(2)).union(blank)


@pytest.mark.parametrize("made", [lambda df: df.limit(0), _odd], ids=["empty", "odd"])
def test_no_query_falls_over(spark, tmp_path, made):
    from conftest import DATA, TABLES

    for t in TABLES:
        made(spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet")).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    failed = {}
    for name, query in registry.QUERIES.items():
        try:
            query(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - all are named together
            failed[name] = str(e)[:200]
    assert not failed


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
