"""Operators on words: decontamination, Jaccard join, BM25 search; against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from tallyloom.llm import bm25, decontaminate, ngram_jaccard

SF = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(90, None), (91, ""), (92, " \t\n"), (93, "one"), (94, "ONE"), (95, "é ß 漢字 🙂 x"), (96, "Ä Ö Ü ä"), (None, "null id"), (97, "a b c d e f g"), (98, "!!! ???")]


def words(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' as n", "1 as bits", "2 as cls", "3 as key", "'y' as items")


def near_copies(seed, groups=6, size=8, length=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, length))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i, " ".join(copy)))
            i += 1
    rng.shuffle(rows)
    return rows


# Jaccard join


def shingle_set(text):
    w = words(SPACED, text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else find(i))) for i, s in sets)


def joined(df, **options):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_jaccard.join(df, **options).collect())


@pytest.mark.parametrize("light", [64, 1], ids=["light tiles", "size-banded tiles"])
@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed, light):
    rows = near_copies(seed) + ODD
    assert joined(frame(spark, rows), light=light) == brute_components(rows)


def test_join_bounds(spark):
    shared = [f"s{i}" for i in range(100)]
    rows = [(1, " ".join(shared)), (2, " ".join(shared + [f"t{i}" for i in range(24)])), (3, " ".join(["u"] * 0 + shared + [f"v{i}" for i in range(25)]))]
    # 96 shingles of 120 is 0.8 and links; 96 of 121 doesn't
    assert joined(frame(spark, rows)) == brute_components(rows) == [("1", 96, "1"), ("2", 120, "1"), ("3", 121, "3")]


def test_join_repeated_rows_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (4, "A b C d e f"), (6, None), (6, None)]
    assert joined(frame(spark, rows)) == [("4", 2, "4"), ("5", 2, "4"), ("5", 2, "4"), ("6", 0, "6"), ("6", 0, "6")]
    assert joined(frame(spark, [])) == []
    assert ngram_jaccard.deduplicated(frame(spark, [])).collect() == []


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = near_copies(3) + ODD
    df = frame(spark, rows + rows[:5])
    kept = ngram_jaccard.deduplicated(df)
    assert kept.columns == df.columns
    want = {i for i, _, c in brute_components(rows) if i == c}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("seed", [4, 5])
def test_linked_sets_share_a_tile_with_room(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    edges = ngram_jaccard.band_edges()
    for n in [1, 2, 3, 5, 9, 40, *edges[1:8], 333, 2000]:
        for share in (1, 0.95, 0.9, 0.8):
            whole = np.unique(rng.integers(0, 1 << 63, n * 3, dtype=np.uint64))
            rng.shuffle(whole)
            both = whole[: max(1, int(n * share))]
            a = np.sort(np.r_[both, whole[n : 2 * n - len(both)]])
            b = np.sort(np.r_[both, whole[2 * n : 2 * n + int(rng.integers(0, n // 5 + 1))]])
            small, large = sorted((a, b), key=len)
            if 100 * len(both) < 80 * (len(a) + len(b) - len(both)):
                continue
            (ks, ss), (kl, sl) = ((ngram_jaccard.tile_keys(x, edges), ngram_jaccard.tile_spans(len(x), edges)[2]) for x in (small, large))
            common = set(ks[ss & 1 == 1].tolist()) & set(kl.tolist())
            assert common
            rest = lambda k, s: {int(x): len_ - (int(y) >> 1 & (1 << 31) - 1) for x, y, len_ in zip(k, s, s >> 32)}
            rs, rl = rest(ks[ss & 1 == 1], ss[ss & 1 == 1]), rest(kl, sl)
            assert any(180 * min(rs[k], rl[k]) >= 80 * (len(a) + len(b)) for k in common)


@pytest.mark.parametrize("parts", [1, 37])
def test_a_passage_that_many_share_makes_few_pairs(spark, monkeypatch, parts):
    """Sets that share most of their shingles, but not enough for a link, are not compared; near copies are all found."""
    passage = [f"p{i}" for i in range(150)]
    rows = [(i, " ".join(passage + [f"u{i}_{k}" for k in range(45)])) for i in range(120)]
    rows += [(200 + i, " ".join([f"q{k}" for k in range(100)] + [f"v{i}"] * (i % 7))) for i in range(40)]
    pairs = []
    linked = ngram_jaccard._linked
    monkeypatch.setattr(ngram_jaccard, "_linked", lambda p, *more: (pairs.append(p.count()), linked(p, *more))[1])
    assert joined(frame(spark, rows).repartition(parts)) == brute_components(rows)
    assert sum(pairs) < 200


@pytest.mark.parametrize("most", [0, 10**9], ids=["all late", "none late"])
def test_order_of_shingles_does_not_matter(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_jaccard, "COMMON", most)
    rows = near_copies(7)
    assert joined(frame(spark, rows)) == brute_components(rows)


@pytest.mark.parametrize("sf", SF)
def test_join_sql(same, sf):
    same(ngram_jaccard.op10_ngram_jaccard, ngram_jaccard.SQL, sf)


# decontamination


def brute_contamination(docs, items):
    wins = {}
    for item, text in items:
        w = words(PLAIN, text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for i, text in docs:
        w = words(PLAIN, text)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (these := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= these
        out.append((str(i), len(w), len(hit), sorted(map(str, found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def contaminated(df, benchmark):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(df, benchmark).collect())


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "??"), (23, items[0][1]), (24, items[1][1].upper()), (25, "é 漢 🙂")]
    docs = [(i, " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + [rng.choice(items)[1] or ""] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))])) for i in range(60)] + ODD
    docs += docs[:3]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert contaminated(frame(spark, docs), benchmark) == brute_contamination(docs, items)


def test_contamination_threshold_and_empty(spark):
    window = " ".join(f"k{i}" for i in range(13))
    docs = [(1, window + " x" * 247), (2, window + " x" * 248), (3, " ".join(window.split()[:12]))]
    benchmark = spark.createDataFrame([(1, window)], "item_id long, text string")
    got = contaminated(frame(spark, docs), benchmark)
    assert [(r[1], r[2], r[4]) for r in got] == [(260, 13, True), (261, 13, False), (12, 0, False)]
    assert [r["doc_id"] for r in decontaminate.clean(frame(spark, docs), benchmark).orderBy("doc_id").collect()] == [2, 3]
    assert contaminated(frame(spark, []), benchmark) == []
    assert all(r[2] == 0 and not r[4] for r in contaminated(frame(spark, docs), benchmark.limit(0)))


@pytest.mark.parametrize("sf", SF)
def test_contamination_sql(same, sf):
    same(decontaminate.op6_decontamination, decontaminate.SQL, sf)


def test_contamination_query_digest(spark):
    got = decontaminate.op6_decontamination(spark, SF[0])
    assert got.where("n_items = 0").select("items_sha256").distinct().collect()[0][0] == hashlib.sha256(b"").hexdigest()


# BM25


def brute_search(docs, queries, k):
    held = [(i, Counter(words(PLAIN, t))) for i, t in docs if i is not None]
    n, mean = len(held), sum(sum(c.values()) for _, c in held) / max(1, len(held))
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        terms = set(words(PLAIN, text)) & set(df)
        scores = []
        for i, c in held:
            length = sum(c.values())
            score = round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (bm25.K1 + 1) / (c[t] + bm25.K1 * (1 - bm25.B + bm25.B * length / mean)) for t in terms if c[t]), 6)
            if score > 0:
                scores.append((-score, i))
        out += [(q, rank, i, round(-s, 5)) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_docs", [8192, 70])
def test_search_equals_brute_force(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(bm25, "QUERY_TERMS", 20 if shard_docs == 70 else bm25.QUERY_TERMS)
    rng = random.Random(6)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(900)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 50)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(15)] + [r for r in ODD if r[0] is not None]
    queries = docs[::40] + [(91, ""), (92, None), (93, "absent"), (94, docs[7][1])]
    got = bm25.search(frame(spark, docs), frame(spark, queries)).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in got) == brute_search(docs, queries, 10)


def test_search_empty(spark):
    docs = frame(spark, [(1, "a b")])
    assert bm25.search(docs.limit(0), docs).collect() == []
    assert bm25.search(docs, docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf", SF)
def test_search_sql(same, sf):
    same(bm25.op9_bm25, bm25.SQL, sf)


def test_statistics_come_from_the_index(spark):
    """Documents, mean length and frequencies of asked terms are read off the shards' indexes; no text is read for them again."""
    texts = ["Red fox", "red red dog", None, "", "blue dog dog", "fox"]
    index = bm25._index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "bigint")
    terms = {w: int(bm25._terms(bm25.WordHashes(), w).view("int64")[0]) for w in ("red", "dog", "fox", "absent")}
    found, n, mean = bm25._frequencies(index, spark.createDataFrame([(t,) for t in terms.values()], "term bigint"))
    got = {r["term"]: r["df"] for r in found.collect()}
    assert {w: got.get(t) for w, t in terms.items()} == {"red": 2, "dog": 2, "fox": 2, "absent": None}
    assert (n, mean) == (6, 9 / 6)
