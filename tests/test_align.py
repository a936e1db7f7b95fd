"""Alignment in three tiers against a scan of all spans."""

import random
import re
import unicodedata

from tallyloom.functions.text import LINE_STOPWORDS
from tallyloom.operators.resolve import align


def fold(x):
    return "".join(c for c in unicodedata.normalize("NFD", (x or "").lower()) if not unicodedata.combining(c))


def norm(x):
    return re.sub("[^a-z0-9]+", " ", fold(x).replace("&", " and ")).strip()


def distinctive(x):
    return {t for t in re.sub("[^a-z0-9]+", " ", fold(x)).split() if len(t) >= 4 and not t.isdigit() and t not in LINE_STOPWORDS}


def plain(candidate, spans):
    _, evidence, title, description, section = candidate
    near = [s for s in spans if norm(section) and norm(s[2]) and (norm(section) in norm(s[2]) or norm(s[2]) in norm(section))]
    tiers = [
        ("exact_evidence", [s for s in spans if norm(evidence) and norm(s[1]) == norm(evidence)]),
        ("exact_title_in_section", [s for s in near if norm(title) and norm(s[1]) == norm(title)]),
    ]
    words, scored = distinctive(" ".join(x for x in (title, description) if x is not None)), []
    for s in near:
        tok = distinctive(s[1])
        if tok and 2 * len(words & tok) >= len(tok):
            scored.append((len(words & tok) / len(tok), len(words & tok), s))
    best = max((x[:2] for x in scored), default=None)
    tiers.append(("source_block_tokens", [x[2] for x in scored if x[:2] == best]))
    for name, found in tiers:
        if found:
            return (name, found[0][0], 1) if len(found) == 1 else (None, None, len(found))
    return None, None, 0


def test_tiers_equal_a_scan(spark):
    rng = random.Random(6)
    words = "castle museum square dinner lunch river bridge market église 2024 into walk old".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    sections = ["Day 1", "day 1: Prague", "Brno", "", None, "D"]
    spans = [(i, say(6), rng.choice(sections)) for i in range(60)] + [(100, None, "Brno"), (101, "a whole line of evidence", "Brno"), (102, "Castle & museum", "Brno"), (103, "castle and museum", "Day 1")]
    candidates = [(i, say(5), say(4), say(6), rng.choice(sections)) for i in range(120)] + [(200, "A whole LINE of evidence!", None, None, None), (201, None, "castle and museum", None, "brno"), (202, "", "", "", ""), (203, None, None, None, "Brno"), (204, None, None, "old castle, museum", "Day 1")]
    got = align(spark.createDataFrame(candidates, "id long, evidence string, title string, description string, section string"), spark.createDataFrame(spans, "span long, clause string, section string"))
    want = {c[0]: plain(c, spans) for c in candidates}
    assert {r["id"]: (r["method"], r["span"], r["n_plausible"]) for r in got.collect()} == want
    assert {w[0] for w in want.values()} == {None, "exact_evidence", "exact_title_in_section", "source_block_tokens"}
