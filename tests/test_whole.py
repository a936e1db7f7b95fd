"""Queries over whole tables against brute force on small ones."""

import datetime
import hashlib
from collections import Counter, defaultdict

import pytest

from tallyloom import registry
from tallyloom.operators import resolve

registry.load_all()


@pytest.fixture
def write(spark, tmp_path):
    """Writes rows as a table, and gives the tables' folder."""

    def one(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return one


def rows(query, spark, sf_dir):
    return sorted(tuple(r) for r in registry.QUERIES[query](spark, sf_dir).collect())


def test_small_shipments_and_all_parts_link(spark, write):
    suppliers = [(i, 1 if i < 9 else 2) for i in range(1, 13)]
    # parts 1 and 51 are no multiples of 5 and are not one part; quantities are small
    lines = [(1, 1, 1.0), (1, 2, 2.0), (51, 3, 1.0), (51, 4, 1.0), (7, 2, 1.0), (7, 9, 50.0), (10, 5, 48.0), (60, 6, 48.0), (8, 9, 1.0), (8, 10, 1.0), (9, 10, 1.0), (9, 11, 1.0)]
    write("supplier", suppliers, "s_suppkey long, s_nationkey int")
    sf_dir = write("lineitem", lines, "l_partkey long, l_suppkey long, l_quantity double")
    root, nation = {s: s for s, _ in suppliers}, dict(suppliers)
    for _ in suppliers:
        for p, a, _ in lines:
            for q, b, _ in lines:
                if p == q and nation[a] == nation[b]:
                    root[a] = root[b] = min(root[a], root[b])
    assert root[2] == 1 and root[4] == 3 and root[11] == 9 and root[6] == 6
    assert rows("components_shared_part", spark, sf_dir) == sorted(Counter(root.values()).items())


def test_different_parts_are_no_repeats(spark, write):
    day = datetime.date(1995, 1, 1)
    lines = [(1, 1, 5, day), (1, 21, 5, day), (1, 3, 5, day), (2, 3, 6, day), (2, 4, 5, day + datetime.timedelta(1)), (1, 4, 5, day)]
    write("orders", [(1, 7), (2, 7)], "o_orderkey long, o_custkey long")
    sf_dir = write("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate date")
    assert rows("duplicate_parts", spark, sf_dir) == [(7, day, 3, 2, 2)]
    assert rows("duplicate_parts_with_repeats", spark, sf_dir) == [(7, 3, 2, 1)]


def test_users_are_counted_one_by_one(spark, write):
    events = [(1, 1, "a"), (2, 17, "a"), (3, 17, "b"), (4, 33, "a"), (5, 33, "a")]
    n = defaultdict(int)
    for _, user, kind in events:
        n[user, kind] += 1
    sf_dir = write("events", events, "event_id long, user_id long, event_type string")
    assert rows("counts_closed_users", spark, sf_dir) == sorted((u, t, n[u, t]) for u in (1, 17, 33) for t in "ab")


def test_words_after_200_characters_tell_texts_apart(spark, write):
    texts = ["word " * 60 + "one", "word " * 60 + "two", "word " * 60 + "a guided one tour", None]
    sf_dir = write("documents", list(enumerate(texts)), "doc_id long, text string")
    a, b, c, none = (h for _, h in rows("text_audit_hash", spark, sf_dir))
    assert a == c != b and none == hashlib.sha256(b"").hexdigest()


def test_all_brands_one_edit_apart_are_paired(spark, write):
    names = ["Brand#1", "Brand#2", "Brand#11", "Brand#21", "Brand#12", "rand#1", "Brand#111", "xBrand#21", "", "x", "é"]
    sf_dir = write("part", [(i, n) for i, n in enumerate([*names, "x", None])], "p_partkey long, p_brand string")

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        shorter = any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
        return shorter if len(a) < len(b) else sum(x != y for x, y in zip(a, b)) == 1

    assert one_edit("Brand#1", "Brand#2") and one_edit("Brand#11", "Brand#21")
    assert rows("text_one_edit_brands", spark, sf_dir) == sorted((a, b) for a in names for b in names if one_edit(a, b))


LONG = "The long walk from the old castle gate to the harbour "


def test_align_compares_whole_clauses_and_sections(spark):
    spans = [(1, LONG + "before sunset", "Day 1"), (2, LONG + "after breakfast", "Day 1"), (3, "Museum", "Day 1"), (4, "Museum", "Day 2"), (5, "Wine tasting cellar dinner", "Day 2"), (6, "Wine tasting cellar dinner", "Other"), (7, "Twice", "Day 1"), (8, "twice!", "Day 3"), (9, "Boat", None)]
    candidates = [
        ("whole", LONG + "BEFORE sunset", None, None, None),  # two lines open alike
        ("opening only", LONG + "on Monday", None, None, None),
        ("title", "not there", "Museum", None, "Day 2"),
        ("title without section", None, "Museum", None, None),
        ("title in two", None, "Museum", None, "Day"),
        ("tokens", "none", "Tasting", "in a cellar with wine", "day 2"),
        ("tokens without section", None, "Tasting", "in a cellar with wine", None),
        ("too few", None, "Tasting", "alone", "Day 2"),
        ("twice", "Twice", "Museum", None, "Day 2"),  # ambiguous evidence decides, no later tier
        ("span without section", None, "Boat", None, "Day 2"),
    ]
    got = resolve.align(spark.createDataFrame(candidates, "id string, evidence string, title string, description string, section string"), spark.createDataFrame(spans, "span long, clause string, section string"))
    assert {r["id"]: (r["method"], r["span"], r["n_plausible"]) for r in got.collect()} == {
        "whole": ("exact_evidence", 1, 1),
        "opening only": (None, None, 0),
        "title": ("exact_title_in_section", 4, 1),
        "title without section": (None, None, 0),
        "title in two": (None, None, 2),
        "tokens": ("source_block_tokens", 5, 1),
        "tokens without section": (None, None, 0),
        "too few": (None, None, 0),
        "twice": (None, None, 2),
        "span without section": (None, None, 0),
    }
