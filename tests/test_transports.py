"""Anchors and records: the keyed joins against all pairs, and the split fold against one plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import transports as X

SCHEMA = "block string, pos long, " + ", ".join(f"{c} string" for c in (*X.ANCHOR, "evidence"))


def some(rng, block, n):
    place = lambda: rng.choice([None, "", "Prague", "Prague hbf", "Brno", "Vienna Airport", "VIE", "travel to Brno", "Old Town Station", "bus"])
    hour = lambda: rng.choice([None, None, "09:00", "10:30", "12:00"])
    for pos in range(n):
        kind = rng.choice(["flight", "train", "bus"])
        label = rng.choice(["Flight", f"{kind} to Brno", f"Return {kind} home", "Travel from Prague to Vienna Airport", "Scenic ride to Brno", "Bus", "", None, "LH 123 to VIE"])
        yield (block, pos, kind, rng.choice([None, "2026-05-03", "3.5.2026", "May 3", "4 May 2026", "2026-05-04", "soon"]), hour(), hour(), rng.choice([None, None, None, "LH 123", "123", "OK 7", "a", "--"]), rng.choice([None, "Luft", "RegioJet"]), rng.choice([None, None, None, "ABC123", "abc-123", "ZZ9"]), place(), place(), label, rng.choice(["e1", " e2 ", "", None]))


@pytest.fixture(scope="module")
def anchors(spark):
    rng = random.Random(11)
    rows = [r for b in range(200) for r in some(rng, f"b{b}", rng.randrange(1, 9))]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_pairs_equal_all_pairs(spark, anchors):
    a, r = anchors.where("pos % 2 = 0").withColumnRenamed("pos", "anchor"), anchors.where("pos % 2 = 1").withColumnRenamed("pos", "record")
    got = X.match_anchors(a, r)
    every = X.prepared(a, "anchor", "a_").join(X.prepared(r, "record", "r_"), "block").withColumn("rung", X.rung())
    want = {tuple(x) for x in every.where("rung is not null").select("block", "anchor", "record", "rung").collect()}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {x[3] for x in want} == set(range(1, X.RUNGS + 1))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_small_and_large_blocks(spark, anchors, monkeypatch):
    a, r = anchors.where("pos % 2 = 0").withColumnRenamed("pos", "anchor"), anchors.where("pos % 2 = 1").withColumnRenamed("pos", "record")
    want = X.match_anchors(a, r)
    # no block is small, some are: the same pairs, by keys too
    for most in (0, 2):
        monkeypatch.setattr(X, "PAIRS", most)
        assert sorted(X.match_anchors(a, r).collect(), key=str) == sorted(want.collect(), key=str)
    # blocks lie together: nothing of a small one is shuffled to be matched, or sent anywhere
    plan = want._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def segments(anchors):
    by = {}
    for row in sorted((r.asDict(recursive=True) for r in X.segments_ready(anchors).collect()), key=lambda r: (r["block"], r["pos"])):
        by.setdefault(row["block"], []).append(row)
    return by


def test_both_ladders_agree(anchors):
    pairs = X.prepared(anchors.withColumnRenamed("pos", "anchor"), "anchor", "a_").join(X.prepared(anchors.withColumnRenamed("pos", "record"), "record", "r_"), "block")
    by = {b: {r["pos"]: X.Segment(r) for r in rows} for b, rows in segments(anchors).items()}
    for r in pairs.select("block", "anchor", "record", (F.col("a_kind") == F.col("r_kind")).alias("same"), X.rung().isNotNull().alias("hit")).collect():
        a, b = by[r["block"]][r["anchor"]], by[r["block"]][r["record"]]
        assert (r["same"] and a.meets(b)) == r["hit"], (a.__dict__, b.__dict__)


def test_split_fold_equals_one_fold(spark, anchors):
    # a block of its own in which a made label, a number in it and a spanning number decide
    odd = [("odd", 0, "bus", None, None, None, None, None, "C1", None, None, "Coach", "x"), ("odd", 1, "bus", None, None, None, None, None, "c1", None, None, "Ride", "y"), ("odd", 2, "bus", None, None, None, "bus", None, None, None, None, "nothing", "z"), ("odd", 3, "bus", None, None, None, None, None, None, None, None, "Bus", "")]
    both = anchors.union(spark.createDataFrame(odd, SCHEMA))
    want = sorted((s.block, s.pos, *(getattr(s, c) for c in X._OUT)) for rows in segments(both).values() for s in X.fold_segments([X.Segment(r) for r in rows]))
    got = X.canonical_anchors(both)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(w[-1] > 2 for w in want) and len(want) < both.count()
    roots = X.may_meet(X.segments_ready(both)).groupBy("block").agg(F.count_distinct("root").alias("n")).agg(F.avg("n")).first()[0]
    assert roots > 1.2  # blocks are more than one fold each
    none = both.where("pos < 0")
    assert X.canonical_anchors(none).count() == 0


def test_small_folds_and_split_ones(spark, anchors, monkeypatch):
    some = anchors.where("block < 'b3'")
    want = X.canonical_anchors(some)
    plan = want._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # a small fold needs no sets that may meet
    monkeypatch.setattr(X, "FOLD", 2)
    assert sorted(X.canonical_anchors(some).collect(), key=str) == sorted(want.collect(), key=str)


def test_better_endpoints(spark):
    names = ["", "travel to Brno", "Brno", "Old Town", "VIE", "Praha hl nadrazi"]
    rows = spark.createDataFrame([(n,) for n in names], "x string").select(X.endpoint_quality(T.normalize(F.col("x")))).collect()
    assert [r[0] for r in rows] == [0, 1, 3, 4, 6, 6]


@pytest.mark.parametrize("text,iso,md", [("2026-5-3", "2026-05-03", None), ("on 16/1/26", "2026-01-16", None), ("1/16/2026", "2026-01-16", None), ("29/02/2019", None, None), ("Sat, May 3rd", None, "05-03"), ("3 Sept 2026", "2026-09-03", None), ("Feb 29", None, "02-29"), ("Feb 30", None, None), ("may", None, None), ("", None, None), (None, None, None), ("2026-13-01", None, None), ("December 24, 2025", "2025-12-24", None)])
def test_written_dates(spark, text, iso, md):
    r = spark.createDataFrame([(text,)], "x string").select(T.written_date(F.col("x")).alias("d")).first()["d"]
    assert (r["iso"], r["md"]) == (iso, md)


def test_one_look_at_a_pair_is_both_ladders(anchors):
    """Whether two are one segment, rung by rung once, is what either ladder says; also of what a fold has made."""
    either = lambda a, b: a.kind == b.kind and not (a.date and b.date and not X.same_day(a, b)) and (bool(a.confirmation and b.confirmation and a.n_confirmation == b.n_confirmation and (a.weak or b.weak)) or a.meets(b) or b.meets(a))
    found = set()
    for rows in segments(anchors).values():
        made = X.fold_segments([X.Segment(dict(r)) for r in rows])
        for some_ in ([X.Segment(dict(r)) for r in rows], made):
            for a in some_:
                for b in some_:
                    found.add(X.same_segment(a, b))
                    assert X.same_segment(a, b) == bool(either(a, b)), (a.__dict__, b.__dict__)
    assert found == {True, False}


def test_many_small_folds_are_handed_on_together(spark, anchors):
    """A batch for each fold costs more than the fold."""
    ready = X.segments_ready(anchors).withColumn("at", F.row_number().over(X.W.partitionBy("block", "kind").orderBy("pos"))).orderBy("block", "kind", "pos").toArrow()
    out = list(X.folded(iter(ready.to_batches(max_chunksize=100))))
    assert len(out) == 1 and out[0].num_rows == X.canonical_anchors(anchors).count()


def test_a_fold_is_whole_however_its_files_are_read(spark):
    """A bucket's file of several row groups may be read by several tasks; the fold's rows stay together."""
    n = 4000
    rows = [(f"b{b % 40}", b // 40, "train", None, None, None, None, None, f"C{b % 40}", None, None, f"Ride {b}", "x" * (b % 7)) for b in range(n)]
    hadoop, key = spark._jsc.hadoopConfiguration(), "parquet.block.size"
    hadoop.set(key, "2048")
    hadoop.set("parquet.page.size.row.check.min", "10")
    hadoop.set("parquet.block.size.row.check.min", "10")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = X.canonical_anchors(spark.createDataFrame(rows, SCHEMA), 2).collect()
    finally:
        for k in (key, "parquet.page.size.row.check.min", "parquet.block.size.row.check.min"):
            hadoop.unset(k)
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k)
    assert [(r["block"], r["pos"], r["members"]) for r in sorted(got, key=lambda r: r["block"])] == sorted((f"b{b}", 0, n // 40) for b in range(40))
