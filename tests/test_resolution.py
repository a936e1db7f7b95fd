"""Candidate windows against the rule written out; the ambiguity gate; odd rows."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import resolution as R

SCHEMA = "block string, candidate string, identity string, date string, city string, title string, role string, section_type string, has_time boolean, has_booking boolean, has_plan boolean, has_recommendation boolean, stage int, item int, blocks array<string>, labels array<string>"
NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]
norm = lambda x: re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()


def plain(rows, most, total):
    """Windows of one trip: [(family, key, members)], and whether it is ambiguous."""
    rows = sorted((dict(zip(NAMES, r)) for r in rows), key=lambda r: (r["stage"], r["item"], r["candidate"]))
    city = lambda r: norm(r["city"]) or "unknown-city"
    day = lambda r: "|".join([r["identity"] or "", r["date"] or "undated", city(r)])
    made = {}

    def add(family, key, members, top=None):
        some = sorted({m["candidate"]: m for m in members}.values(), key=lambda m: (m["candidate"] != top, m["stage"], m["item"], m["candidate"]))[:most]
        made[(family, key)] = [m["candidate"] for m in some]

    def in_scope(p, c):
        if (p["identity"] or "") != (c["identity"] or "") or p["date"] and c["date"] and p["date"] != c["date"] or p["city"] and c["city"] and norm(p["city"]) != norm(c["city"]):
            return False
        labels = lambda r: {norm(x) for x in r["labels"] or []} - {""}
        return bool(set(p["blocks"] or []) & set(c["blocks"] or []) or labels(p) & labels(c) or p["date"] and c["date"])

    for p in rows:
        if p["role"] == "grouping_proposal":
            add(1, p["candidate"], [p, *(c for c in rows if c is not p and in_scope(p, c))], p["candidate"])
    by_day = {}
    for r in rows:
        by_day.setdefault(day(r), []).append(r)
    firm = lambda r: bool(r["has_time"] or r["has_booking"] or r["has_plan"])
    for r in rows:
        same = by_day[day(r)]
        if r["section_type"] == "city_reference" or r["role"] == "city_note_candidate" or r["has_recommendation"] or not firm(r) and len(same) >= 8 and sum(map(firm, same)) >= 2:
            if (2, day(r)) not in made:
                add(2, day(r), same)
    shared = {}
    for r in rows:
        if r["role"] != "grouping_proposal" and r["section_type"] != "city_reference":
            for b in r["blocks"] or []:
                shared.setdefault(f"{day(r)}|{b}", []).append(r)
    for key, group in shared.items():
        if len(group) > 1:
            add(3, key, group)
    titled = {}
    for r in rows:
        titled.setdefault(f"{r['identity'] or ''}|{norm(r['title'])}", []).append(r)
    for key, group in titled.items():
        if len({r["date"] or "" for r in group}) > 1:
            add(4, key, group)
    seen, out = set(), []
    for (family, key), members in made.items():
        if tuple(sorted(members)) not in seen:
            seen.add(tuple(sorted(members)))
            out.append((family, key, members))
    groups = {}
    for r in rows:
        groups.setdefault((r["stage"], r["date"] or "", norm(r["city"])), []).append(r)
    is_open = any(r["role"] == "grouping_proposal" for r in rows) or any(len(g) > 1 for g in groups.values()) or any(norm(a["title"]) == norm(b["title"]) and (a["date"] or "") != (b["date"] or "") for a in rows for b in rows)
    return out[:total], is_open


@pytest.mark.parametrize("most,total", [(24, 30), (3, 4)])
def test_windows_equal_the_rule(spark, most, total):
    rng, rows = random.Random(most), []
    pick = rng.choice
    for b in range(25):
        for k in range(rng.choice([1, 2, 6, 14, 40])):
            rows.append((f"t{b}", f"c{k}", pick(["s1", "s2", None, ""]), pick([None, "", "d1", "d1", "d2"]), pick([None, "Brno", "brno ", "Vienna", "--"]), pick(["Lunch", "lunch!", "Castle", "", None]), pick([None, None, "", "grouping_proposal", "city_note_candidate"]), pick([None, None, None, "city_reference"]), *(pick([None, False, False, True]) for _ in range(3)), pick([None, False, False, False, True]), pick([1, 1, 2]), rng.randrange(5), pick([None, [], ["b1"], ["b1", "b2"], ["b3", "b3"]]), pick([None, [], ["Day 1"], ["day 1", "Food"], [None, ""]])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, gates = {}, {}
    for b in {r[0] for r in rows}:
        found, gates[b] = plain([r for r in rows if r[0] == b], most, total)
        want |= {(b, place): w for place, w in enumerate(found, 1)}
    got = {(r["block"], r["place"]): (r["family"], r["key"], r["members"]) for r in R.windows(df, most, total).collect()}
    assert got == want
    if most == 24:
        assert {w[0] for w in want.values()} == {1, 2, 3, 4}
        assert {r["block"]: r["ambiguous"] for r in R.ambiguous(df).collect()} == gates and len(set(gates.values())) == 2
        none = df.where("stage < 0")
        assert R.windows(none).count() == 0 and R.ambiguous(none).count() == 0


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "hashpartitioning(" in line]


def test_candidates_are_dealt_out_once(spark):
    """By block; after that only what proposals ask for is shuffled, and no window or group of candidates."""
    row = ("t", "c", "s", "d1", "Brno", "Lunch", "grouping_proposal", "", True, False, False, False, 1, 1, ["b"], ["l"])
    moved = shuffles(R.windows(spark.createDataFrame([row], SCHEMA)))
    assert len(moved) <= 7 and all("of#" in m or "REPARTITION_BY_NUM" in m for m in moved), moved


def test_ambiguity_reads_only_what_it_looks_at(spark):
    plan = R.ambiguous_trips(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "has_plan" not in plan


def test_nothing_shuffled_outlives_the_table_it_made(spark):
    """A staged table's shuffle files go when it stands; the session's setting stays as it was."""
    from tallyloom.plans import staging

    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return set(re.findall(r"shuffle_(\d+)_\d+_\d+\.data", files))

    before = shuffled()
    wide = spark.range(2000).select((F.col("id") % 7).alias("block"), "id")
    made = [staging.bucketed(wide, ["block"], 3), staging.staged(wide.repartition(3, "block"))]
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert [m.count() for m in made] == [2000, 2000]
    assert spark.conf.get(staging.CLEANUP, None) in (None, "false")


def test_narrow_lines_make_the_same_windows(spark):
    """Lines dealt out narrow and made candidates where they lie, or candidates dealt out: the same windows."""
    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(str, df.collect()))
    lines = R.trip_lines(spark, sf, 3)
    assert set(lines.columns) == {"block", *R._KEYS, "identity", "quarter", "flags", "city", "p_brand", "p_type"}
    assert rows(R.windows(lines, n=3, made=R.as_candidates)) == rows(R.windows(R.trip_candidates(spark, sf), n=3)) != []
