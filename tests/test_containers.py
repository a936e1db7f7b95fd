"""Named candidates against every assignment of tokens; page covers against a walk; components within a radius against a plain union."""

import itertools
import random

import pyarrow as pa

from tallyloom.operators import containers as C
from tallyloom.operators import geo, overlap


def edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def any_assignment(title, text):
    """Tries every way to give each token of the title a token of the text."""
    words = lambda s: [w for w in (s or "").lower().split() if w not in C.STOP]
    own, said = words(title), words(text)
    if not own or len(own) > len(said):
        return False
    for chosen in itertools.permutations(said, len(own)):
        apart = [(x, y) for x, y in zip(own, chosen) if x != y]
        if not apart or len(apart) == 1 and len(own) > 1 and all(min(len(x), len(y)) >= 6 and x[:2] == y[:2] and x[-2:] == y[-2:] and edit(x, y) for x, y in apart):
            return True
    return False


def test_named_as_by_any_assignment(spark):
    rng = random.Random(4)
    words = ["castle", "castles", "castlle", "caastle", "museum", "musseum", "old", "town", "the", "visit", "square", "squaare", "old", "inn"]
    titles = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for i in range(60)] + [(100, None), (101, ""), (102, "the visit"), (103, "castle castle"), (104, "castle castlle")]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for i in range(60)] + [(100, None), (101, ""), (102, "castle caastle"), (103, "castle castle old")]
    got = C.named_in(spark.createDataFrame(titles, "candidate long, title string"), spark.createDataFrame(texts, "container long, text string"))
    want = {(i, j) for i, t in titles for j, d in texts if any_assignment(t, d)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert (103, 102) in want and (104, 103) in want


def walk(first, last, batches):
    out, page = [], first
    while page <= last:
        here = sorted((-stop, batch) for batch, start, stop, text in batches if start == page and start <= stop <= last and text and text.strip())
        if not here:
            return None
        out.append(here[0][1])
        page = 1 - here[0][0]
    return out or None


def test_covers_equal_a_walk(spark):
    rng = random.Random(8)
    requests, batches = [], []
    for doc in range(60):
        last = rng.randrange(1, 40)
        requests.append((doc, 1, last))
        for k in range(rng.choice([0, 5, 60, 120])):
            start = rng.randrange(1, last + 3)
            batches.append((doc, k, start, start + rng.choice([-1, 0, 1, 2, 9]), rng.choice(["x", "x", "x", " ", None])))
    batches += [(70, k, k, k, "x") for k in range(1, 101)] + [(71, 0, 3, 9, "x")]
    requests += [(70, 1, 100), (71, 3, 9), (72, 1, 5), (73, 5, 1)]
    got = C.page_cover(spark.createDataFrame(requests, "doc long, first int, last int"), spark.createDataFrame(batches, "doc long, batch long, start int, stop int, text string"))
    want = {d: walk(a, b, [x[1:] for x in batches if x[0] == d]) for d, a, b in requests}
    assert {r["doc"]: r["batches"] for r in got.collect()} == want
    assert len(want[70]) == 100 and sum(w is not None for w in want.values()) > 10


def components(rows, km):
    """[(index, source_order, lat, lon)] -> {index: component}, by plain union."""
    rows = sorted(rows)
    placed = [r for r in rows if r[2] is not None and r[3] is not None]
    if len(rows) < 2 or len(placed) < 2:
        return {r[0]: 0 for r in rows}
    import math

    def far(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    root = {r[0]: r[0] for r in placed}
    for _ in placed:
        for a in placed:
            for b in placed:
                if far(a, b) <= km:
                    root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
    home = {r[0]: root[min(placed, key=lambda p: (abs(p[0] - r[0]), p[0]))[0]] for r in rows}
    parts = {}
    for r in rows:
        parts.setdefault(home[r[0]], []).append(r)
    order = sorted(parts.values(), key=lambda p: (p[0][1], p[0][0]))
    if len(order) == 2 and min(map(len, order)) == 1 and max(map(len, order)) >= 3:
        return {r[0]: 0 for r in rows}
    return {r[0]: k for k, part in enumerate(order) for r in part}


def test_radius_components_equal_plain_union(spark):
    rng, rows = random.Random(2), []
    for b in range(40):
        n = rng.choice([1, 2, 3, 4, 9, 15])
        for i in rng.sample(range(30), n):
            near = rng.choice([(48.2, 16.37), (48.2, 16.4), (49.2, 16.6), (0.0, 179.999), (0.0, -179.999)])
            placed = rng.random() < 0.75
            rows.append((f"b{b}", i, 100 - i if b % 2 else i, near[0] + rng.uniform(-0.012, 0.012) if placed else None, near[1] if placed or rng.random() < 0.3 else None))
    rows += [("four", i, i, 10.0 if i < 3 else 20.0, 10.0) for i in range(4)] + [(None, 1, 1, 1.0, 1.0)]
    got = geo.radius_components(spark.createDataFrame(rows, "block string, index long, source_order long, lat double, lon double"))
    want = {(b, i): c for b in {r[0] for r in rows if r[0]} for i, c in components([r[1:] for r in rows if r[0] == b], 2.0).items()}
    assert {(r["block"], r["index"]): r["component"] for r in got.collect()} == want
    assert max(want.values()) >= 2 and {want["four", i] for i in range(4)} == {0}


def test_few_candidates_sort_no_tokens(spark):
    """Tokens of descriptions meet few candidates where they are; none is dealt out by token to be joined."""
    c, d = spark.range(3).selectExpr("id as candidate", "concat('inn ', id) as title"), spark.range(3).selectExpr("id as container", "concat('old inn ', id) as text")
    plan = C.named_in(c, d)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan


def words_by_chance(seed, n):
    rng = random.Random(seed)
    words = ["castle", "castles", "castlle", "caastle", "museum", "musseum", "old", "town", "the", "within", "wiithin", "square", "squaare", "inn", "a&b"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for i in range(n)]


def test_descriptions_are_not_dealt_out_for_few_candidates(spark, monkeypatch):
    """Few candidates are found within the tasks that read descriptions; many by joins: the same pairs."""
    c, d = spark.createDataFrame(words_by_chance(1, 80), "candidate long, title string"), spark.createDataFrame(words_by_chance(2, 300), "container long, text string")
    found = C.named_in(c, d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    within = {tuple(r) for r in found.collect()}
    monkeypatch.setattr(overlap, "FEW", 0)
    for few in (C.FEW, 0):
        monkeypatch.setattr(C, "FEW", few)
        rows = [tuple(r) for r in C.named_in(c, d).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == within
    assert len(within) > 100


def test_places_looked_up_in_parts(monkeypatch):
    own = pa.array([t.replace("&", " ").split() for _, t in words_by_chance(3, 60)])
    texts = pa.array([t.replace("&", " and ") for _, t in words_by_chance(4, 200)] + [""])
    pairs = lambda: [x for part in C._Titles(own).found(texts) for x in zip(*(a.tolist() for a in part))]
    whole = pairs()
    monkeypatch.setattr(C, "PLACES", 8)
    assert pairs() == whole and len(whole) == len({x[:2] for x in whole}) > 100


def test_one_edit():
    for a, b in itertools.product(["castle", "castles", "castel", "acastle", "caste", "cas", ""], repeat=2):
        assert C._one_edit(a, b) == edit(a, b)
