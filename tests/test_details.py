"""Walks over JSON of odd shapes, against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import details as D


def leaves(node, path="$", depth=0):
    if depth > 6:
        return []
    if isinstance(node, str):
        return [(path, node)] if node.strip() else []
    if isinstance(node, list):
        return [x for i, v in enumerate(node) for x in leaves(v, f"{path}[{i}]", depth + 1)]
    if isinstance(node, dict):
        return [x for k, v in node.items() for x in leaves(v, f"{path}.{k}", depth + 1)]
    return []


def tree(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return rng.choice(["", " ", "text é🙂", "a\nb", 1, 2.5, True, None])
    if kind == 4:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdef"): tree(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_leaves_equal_plain_recursion(spark):
    rng = random.Random(1)
    trees = [tree(rng, 9) for _ in range(300)]
    deep = "x"
    for _ in range(6):
        deep = {"d": [deep][0]}
    trees += [deep, [deep], "bare", 5, None, [], {}]
    texts = [json.dumps(t, ensure_ascii=False) for t in trees] + [None, "", "{", "not json", "[" * 200_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", D.string_leaves(F.col("t")).alias("s")).collect()
    want = [leaves(t) for t in trees] + [None] * 5
    assert {r["i"]: r["s"] and [tuple(x) for x in r["s"]] if r["s"] is not None else None for r in got} == dict(enumerate(want))
    assert want[300] == [("$.d.d.d.d.d.d", "x")] and want[301] == []


@pytest.mark.parametrize("value,private,want", [
    ({"note": "mail a.b@example.com or +43 660 1234567"}, False, {"note": "mail [redacted email] or [redacted phone]"}),
    ({"note": "Door code: 4711 x"}, False, {"note": "Door code [redacted]"}),
    ({"Door_Code": "4711", "n": 1, "code": 5, "codes": [1], "secret": {"a": 1}, "ok": True, "none": None}, False, {"Door_Code": "[redacted value]", "n": 1, "code": 5, "codes": "[redacted list]", "secret": "[redacted object]", "ok": True, "none": None}),
    ({"Door_Code": "47  11", "secret": {"a": [" b "]}}, True, {"Door_Code": "47 11", "secret": {"a": ["b"]}}),
    (list(range(40)), False, [*range(30), "[truncated 10 items]"]),
    ({f"a{i}": i for i in range(70)}, False, {f"a{i}": i for i in range(60)} | {"_truncatedKeys": 10}),
    ("x" * 501, False, "x" * 500 + "..."), ("x" * 500, False, "x" * 500), ({"list": [{"phone": "1"}, "pnr AB12"]}, False, {"list": [{"phone": "[redacted value]"}, "pnr [redacted]"]}),
    (None, False, None), ("", False, ""), (7, False, 7),
])
def test_redaction(spark, value, private, want):
    got = spark.createDataFrame([(json.dumps(value),)], "t string").select(D.redacted(F.col("t"), private).alias("r")).first()["r"]
    assert json.loads(got) == want


def test_what_is_no_json_is_null(spark):
    rows = spark.createDataFrame([(t,) for t in (None, "", "{", "[" * 100_000, '["a"')], "t string").select(D.redacted(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in rows] == [None] * 5
