"""Window and fold queries against brute force on small tables with hot trips, ties and same-day stays."""

import datetime
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyloom import registry
from tallyloom.operators import coverage, resolve
from tallyloom.plans import staging
from tallyloom.streaming import windows

registry.load_all()
DAY = datetime.date(1995, 1, 1)


@pytest.fixture
def trips(spark, tmp_path):
    """Orders and their lines: trip 1 is large and crowded, with stays of no length."""
    rng = random.Random(3)
    orders, lines = [], []
    for key in range(1, 160):
        trip = 1 if key < 90 else rng.randint(2, 12)
        day = DAY + datetime.timedelta(rng.randint(0, 40))
        orders.append((key, trip, day))
        for n in range(rng.randint(1, 4)):
            lines.append((key, n, day + datetime.timedelta(rng.choice([0, 0, 1, 5, 30, -3])), float(rng.randint(1, 60))))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate date, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    last = {k: max(d for o, _, d, _ in lines if o == k) for k, _, _ in orders}
    return str(tmp_path), orders, lines, [(t, k, d, last[k]) for k, t, d in orders]


def rows(query, spark, sf_dir):
    return sorted((tuple(r) for r in registry.QUERIES[query](spark, sf_dir).collect()), key=str)


def test_days_and_overlaps(spark, trips):
    sf_dir, _, _, stays = trips
    days, pairs = defaultdict(set), defaultdict(list)
    for t, k, a, z in stays:
        days[t] |= {a + datetime.timedelta(i) for i in range(max(1, (z - a).days))}
        for u, l, b, y in stays:
            if t == u and k < l and a < y and b < z:
                pairs[t].append((min(z, y) - max(a, b)).days)
    assert rows("date_spine", spark, sf_dir) == sorted(((t, len(d), min(d), max(d)) for t, d in days.items()), key=str)
    assert rows("interval_overlap_pairs", spark, sf_dir) == sorted(((t, len(p), sum(p)) for t, p in pairs.items()), key=str)


def test_items_by_leg_and_stay(spark, trips):
    sf_dir, orders, lines, stays = trips
    trip = {k: t for k, t, _ in orders}
    legs = []
    for t in set(trip.values()):
        own = sorted((d, k) for k, u, d in orders if u == t)
        legs += [(t, k, d, n[0] if n else None) for (d, k), n in zip(own, [*own[1:], None])]
    by_leg, by_stay = Counter(), Counter()
    for k, _, day, _ in lines:
        t = trip[k]
        inside = [(0, a, leg) for u, leg, a, z in legs if u == t and z and a <= day < z] + [(1, a, leg) for u, leg, a, _ in legs if u == t and a == day]
        by_leg[min(inside)[2] if inside else None] += 1
        held = [s for u, s, a, z in stays if u == t and s != k and a <= day <= z]
        if held:
            by_stay[min(held)] += 1
    assert rows("interval_leg_lookup", spark, sf_dir) == sorted(by_leg.items(), key=str)
    assert rows("stay_collision", spark, sf_dir) == sorted(by_stay.items(), key=str)


def test_recovery_batches(spark, trips):
    sf_dir, _, lines, _ = trips
    want = {}
    for key in {k for k, *_ in lines}:
        left, admitted, dropped = 120.0, 0, 0
        for _, quantity in sorted((n, q) for k, n, _, q in lines if k == key):
            if admitted < 5 and quantity <= left:
                left, admitted = left - quantity, admitted + 1
            else:
                dropped += 1
        want[key] = (admitted, dropped)
    assert {r[0]: (r[1], r[2]) for r in registry.QUERIES["recovery_batches"](spark, sf_dir).collect()} == want


def test_greedy_assignment(spark):
    rng = random.Random(5)
    claims = [(g, rng.randint(0, 9), rng.randint(0, 9), float(rng.randint(0, 5))) for g in range(6) for _ in range(40)]
    want = []
    for g in range(6):
        lefts, rights = set(), set()
        for _, left, right in sorted((x, a, b) for h, a, b, x in claims if h == g):
            if left not in lefts and right not in rights:
                want.append((g, left, right))
                lefts.add(left)
                rights.add(right)
    got = resolve.claim_budget(spark.createDataFrame(claims, "group long, left long, right long, rank double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_recovery_plan_with_copies(spark, tmp_path):
    rng = random.Random(7)
    docs = [(i, "copy" if i % 3 == 0 else f"text {rng.randint(0, 40)}", rng.choice("ab"), rng.choice("xy")) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for lang, source in {(d[2], d[3]) for d in docs}:
        spans = sorted((hashlib.sha256(t.encode()).hexdigest(), len(t)) for _, t, a, b in docs if (a, b) == (lang, source))
        for k in range(0, len(spans), 8):
            part = spans[k : k + 8]
            want.append((lang, source, k // 8, len(part), sum(n for _, n in part), hashlib.sha256(",".join(h for h, _ in part).encode()).hexdigest()))
    assert rows("shadow_recovery_plan", spark, str(tmp_path)) == sorted(want, key=str)


def plain_pieces(text, size, overlap):
    """The rule on strings instead of places."""
    out, rest = [], text.strip()
    while len(rest) > size:
        window = rest[:size]
        blank, line = window.rfind("\n\n"), window.rfind("\n")
        cut = blank if blank > size * 0.55 else line if line > size * 0.55 else size
        if piece := rest[:cut].strip():
            out.append(piece)
        rest = rest[cut - min(overlap, cut // 5) :].strip()
    return out + [rest] * bool(rest)


def test_pieces_of_long_texts():
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "\n", "\n\n", "x" * 30, "  ", "é"]) for _ in range(rng.randint(0, 400)))
        assert [text[a:z] for a, z in coverage.chunks(text, 200, 50)] == plain_pieces(text, 200, 50)
    assert coverage.chunks("") == coverage.chunks(" \n ") == []
    with pytest.raises(ValueError, match="more than 80"):
        coverage.chunks("word " * 100_000)


def test_events_as_a_real_stream(spark, tmp_path):
    """The same windows and sessions from a stream that comes in two files as from the whole table."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    events = [(k, at(h), k % 3, "ab"[k % 2], float(k)) for k, h in enumerate([0, 1, 2, 3, 12, 13, 30, 31, 50, 80])]
    end = [(99, at(500), 9, "z", 0.0)]  # moves the watermark past all others
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    folder = tmp_path / "events"
    for k, part in enumerate((events[:6], events[6:] + end)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}/events.parquet")
    table = spark.createDataFrame(events, schema)
    for name, function in (("windows", windows.tumbling), ("sessions", windows.sessions)):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
        assert stream.isStreaming
        run = function(stream).writeStream.outputMode("append").format("memory").queryName(f"got_{name}").option("checkpointLocation", f"{tmp_path}/at_{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
        assert sorted(map(tuple, spark.table(f"got_{name}").collect())) == sorted(map(tuple, function(table).collect()))


def test_a_table_is_read_as_a_stream(spark):
    stream = windows.event_stream(spark, "/root/testdata/sf0.001")
    assert stream.isStreaming and stream.columns == spark.read.parquet("/root/testdata/sf0.001/events.parquet").columns


@pytest.mark.parametrize("raw,clock", [
    ("at 9", "09:00"), ("at9", "09:00"), ("9:30 pm", "21:30"), ("13 pm", "13:00"), ("12 am", "00:00"), ("0 am", "00:00"), ("12pm", "12:00"), ("14.30", "14:30"), ("3.5", None), ("9 p", None),
    ("24:00", None), ("9:75", None), ("2024-01-01 10:30", "10:30"), ("2024-01-01T9:05:10.5Z", "09:05"), ("2024-01-01T09:05+02:00", "09:05"), ("2024-01-01", None), (" 7 ", "07:00"), ("", None), (None, None),
])
def test_clock(spark, raw, clock):
    from pyspark.sql import functions as F

    from tallyloom.functions import text as T

    assert spark.createDataFrame([(raw,)], "c string").select(T.clock(F.col("c"))).first()[0] == clock


def test_expectations_take_the_first_open_candidate(spark):
    from tallyloom.operators import matching

    rng = random.Random(11)
    expectations = [(rng.randint(0, 3), rng.choice("xy"), i, rng.choice([True, False, None])) for i in range(60)]
    candidates = [(rng.randint(0, 3), rng.choice("xy"), i, rng.choice(["item", "other"])) for i in range(50)]
    used, want = set(), []
    for g, label, e, only in expectations:
        took = next((c for h, m, c, kind in candidates if (h, m) == (g, label) and c not in used and (not only or kind == "item")), None)
        used.add(took)
        want.append((g, e, took))
    got = matching.first_unused(
        spark.createDataFrame(expectations, "group long, label string, expectation long, items_only boolean"), spark.createDataFrame(candidates, "group long, label string, candidate long, kind string")
    )
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


PROSE = [
    ("Write to eli@example.com today", "email"), ("Customer Eli kamerow", "role_labelled_name"), ("customer: see desk", "role_labelled_name"), ("Customer Service desk", None),
    ("Customer Service desk, Customer Eli kamerow", "role_labelled_name"), ("Passenger Terminal 3", None), ("1225 Harvard street nw, 20009 Washington", "street_address"), ("221B Baker Street", None),
    ("Tel: 555 0199 22", "phone"), ("+43 660 1234567 any time", "phone"), ("call 555-123-4567 now", "phone"), ("from 2038-04-02 to 2038-04-05", None), ("ends 05.04.2038", None), ("on January 12-25 2019", None), ("", None), (None, None),
]


def test_identity_signals(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators import prose

    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PROSE)], "i int, t string").select("i", prose.identity_signal(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [s for _, s in PROSE]


def test_sentences_and_codes(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators import prose

    rows = [
        ("Visit St. Stephen's. Customer Eli kamerow. Then lunch!  Mail a@b.com? Bye.", "Visit St. Stephen's. Then lunch! Bye.", "Visit St. Stephen's. Customer Eli kamerow. Then lunch!  Mail a@b.com? Bye."),
        ("Ride, travel code 0468406277, seat 5 (AB12C)", "Ride, travel code 0468406277, seat 5 (AB12C)", "Ride,, seat 5"),
        ("FR8331 at 06:20 on 2019-01-18 06:20", "FR8331 at 06:20 on 2019-01-18 06:20", "FR8331 at 06:20 on 2019-01-18 06:20"),
        ("ticket code: #2159 1990 1842 0436 ok", "ticket code: #2159 1990 1842 0436 ok", "ok"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i int, t string")
    got = df.select("i", prose.without_identity(F.col("t")).alias("a"), prose.without_codes(F.col("t")).alias("b")).orderBy("i").collect()
    for r, (_, a, b) in zip(got, rows):
        assert (r["a"], r["b"]) == (a, b)


def test_pairs_near_the_poles_and_the_date_line(spark):
    import math

    from tallyloom.operators import geo

    rng = random.Random(13)
    points = [(i, i % 2, rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), rng.uniform(-90, -84), 90.0, -90.0, 0.0]), rng.choice([rng.uniform(-180, 180), 180.0, -180.0, 179.9])) for i in range(260)]

    def km(a, b):
        x, y, u, v = map(math.radians, (a[2], a[3], b[2], b[3]))
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1.0, math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2)))

    df = spark.createDataFrame(points, "vec_id long, label long, lat double, lon double")
    for radius in (300.0, 2500.0):
        got = sorted((r["a"], r["b"]) for r in geo.radius_pairs(df, radius, "label").collect())
        assert got == sorted((a[0], b[0]) for a in points for b in points if a[0] < b[0] and a[1] == b[1] and km(a, b) <= radius)


@pytest.mark.parametrize("name", ["greedy_assignment", "best_unique_match"])
def test_parts_grow_with_lines(spark, monkeypatch, name):
    """Every exchange has as many parts as lines call for, so that a task's share stays."""
    monkeypatch.setattr(staging, "ROWS", 500)
    sf_dir = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500 + 1
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan)
    assert n > 4 and dealt and set(dealt) == {str(n)}


def test_stays_read_lines_once(spark):
    """Items and stays come from lines that are dealt out and written once; the rest of the plan reads what was written."""
    plan = registry.QUERIES["stay_collision"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan
