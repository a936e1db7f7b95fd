"""The codec's round trip on odd rows, its dense codes, masks and fixed lists."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import codec as C
from tallyloom.plans.numbering import numbered

ROWS = [(1, "b", ["x", "b", "x"]), (2, "a", []), (3, None, None), (4, "é", [None, "a", ""]), (5, "", ["b"]), (6, "b", [None])]


def test_round_trip(spark):
    rows = spark.createDataFrame(ROWS, "id int, one string, many array<string>")
    codec = C.Codec(rows, {"words": ["one", "many"]}, "id")
    assert [(r["value"], r["code"]) for r in codec.dictionaries["words"].orderBy("code").collect()] == [(v, i) for i, v in enumerate(["", "a", "b", "x", "é"])]
    assert {r["id"]: (r["one"], r["many"]) for r in codec.compact.collect()} == {1: (2, [3, 2, 3]), 2: (1, []), 3: (None, None), 4: (4, [None, 1, 0]), 5: (0, [2]), 6: (2, [None])}
    assert sorted(tuple(r) for r in codec.expand().collect()) == ROWS
    none = C.Codec(rows.where("id < 0"), {"words": ["one", "many"]}, "id")
    assert none.compact.count() == 0 and none.expand().count() == 0


def test_numbers_are_dense(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7), "v").collect()
    assert all(r["v"] == r["code"] for r in got) and len(got) == 1000


def test_masks_and_fixed_lists(spark):
    fixed = ["a", "b", "c"]
    rows = spark.createDataFrame([([],), (["a"],), (["a", "c"],), (["a", "b", "c"],), (None,)], "x array<string>")
    got = rows.select("x", C.mask(F.col("x"), fixed).alias("m")).select("x", "m", C.unmasked(F.col("m"), fixed).alias("y")).collect()
    assert [r["m"] for r in got] == [0, 1, 5, 7, None] and [r["y"] for r in got] == [r["x"] for r in got]
    one = spark.createDataFrame([("c",), (None,)], "x string").select(C.place(F.col("x"), fixed).alias("p"))
    assert [(r["p"], r["v"]) for r in one.select("p", C.value_at(F.col("p"), fixed).alias("v")).collect()] == [(2, "c"), (None, None)]
    with pytest.raises(Exception, match="no such value: z"):
        spark.createDataFrame([("z",)], "x string").select(C.place(F.col("x"), fixed)).collect()
