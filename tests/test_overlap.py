"""Shared tokens against a scan, sent to tasks, cut small and by joins; and how often their texts are read."""

import random

import pytest
from test_align import distinctive, norm, plain

from tallyloom.operators import overlap, resolve


def counted(spark, df):
    """``df``, and a count of the rows read of it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema), seen


@pytest.mark.parametrize("few, places", [(None, None), (None, 1), (0, None)])
@pytest.mark.parametrize("half_of", ["text", "set"])
def test_sharing_equals_a_scan(spark, monkeypatch, few, places, half_of):
    if few is not None:
        monkeypatch.setattr(overlap, "FEW", few)
    if places is not None:
        monkeypatch.setattr(overlap, "PLACES", places)
    rng = random.Random(4)
    words = "castle museum square dinner lunch river bridge market 2024 1st walk old again tower".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    texts = [(i, rng.choice("abc"), say(9)) for i in range(150)] + [(500, "a", ""), (501, "z", "castle museum"), (502, "a", "castle")]
    sets = [(f"s{i}", rng.choice("abd"), sorted(distinctive(say(6)))) for i in range(60)] + [("again", b, ["castle", "tower"]) for b in "ac"] + [("none", "a", [])]
    want = []
    for i, block, text in texts:
        for s, of, tokens in sets:
            n = len(distinctive(text) if half_of == "text" else tokens)
            matched = len(distinctive(text) & set(tokens))
            if block == of and matched and 2 * matched >= n:
                want.append((i, s, matched, n))
    t = spark.createDataFrame(texts, "id long, block string, text string")
    got = overlap.sharing(t, spark.createDataFrame(sets, "set string, block string, tokens array<string>"), half_of)
    assert sorted(tuple(r) for r in got.select("id", "set", "matched", "n").collect()) == sorted(want)


def test_asked_for_leaves_what_may_match(spark):
    texts = [(1, "castle museum"), (2, "old day"), (3, "castle tower bridge"), (4, "castle tower"), (5, ""), (6, "12 2024 again"), (7, "castle castle tower bridge")]
    one = lambda c, *x: spark.createDataFrame([(v,) for v in x], f"{c} string")
    got = overlap.asked_for(spark.createDataFrame(texts, "id long, text string"), one("value", "old day"), one("token", "castle", "again"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4]


@pytest.mark.parametrize("few", [None, 0])
def test_alignment_reads_spans_once(spark, monkeypatch, few):
    if few is not None:
        monkeypatch.setattr(overlap, "FEW", few)
    spans = [(1, "a whole line", "Brno"), (2, "Castle & museum", "Brno"), (3, "old castle, tower", "Day 1"), (4, None, "Brno"), (5, "castle river", None)]
    candidates = [(1, "A whole LINE", None, None, None), (2, None, "castle and museum", None, "brno"), (3, None, None, "tower of a castle", "day 1: Prague"), (4, None, None, None, None)]
    s, seen = counted(spark, spark.createDataFrame(spans, "span long, clause string, section string"))
    got = resolve.align(spark.createDataFrame(candidates, "id long, evidence string, title string, description string, section string"), s)
    assert {r["id"]: (r["method"], r["span"], r["n_plausible"]) for r in got.collect()} == {c[0]: plain(c, spans) for c in candidates}
    assert seen.value == len(spans)


def documents(rng):
    words = "castle museum square dinner river bridge market église 2024 walk old &".split()
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", ", ", ".\n"]) for _ in range(n))
    docs = [(i, f"src{i % 3}", None, say(rng.randrange(30))) for i in range(40)] + [(100, "src1", None, None), (101, None, None, "Castle by the river, old bridge"), (102, "src2", None, "the one & only tower; by a gate")]
    items = [(i, say(rng.randrange(1, 12))) for i in range(20)] + [(100, None), (101, "Old bridge; the one and only TOWER"), (102, "nothing of it")]
    return docs, items


def test_sections_read_documents_once(spark, monkeypatch):
    import re

    docs, items = documents(random.Random(9))
    docs.append((300, "src9", None, "golden harbour; marble lantern, copper kettle tower"))
    items += [(300, "Golden harbour; copper kettle"), (301, "silver spoon. Marble lantern, copper kettle")]
    d, seen = counted(spark, spark.createDataFrame(docs, "doc_id long, source string, lang string, text string"))
    tables = {"documents": d, "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    monkeypatch.setattr(resolve, "table", lambda spark, sf_dir, name: tables[name])
    got = {(r["item_id"], r["pos"]): (r["method"], r["doc_id"] if r["method"] is None else (r["doc_id"], r["doc_pos"]), r["n_plausible"]) for r in resolve.align_in_sections(spark, "").collect()}
    assert seen.value == len(docs)
    cut = lambda x: [(p, c) for p, c in enumerate(re.split("[,;.\n]", x or "")) if c.strip(" ")]
    spans = [((i, p), c, source) for i, source, _, text in docs for p, c in cut(text)]
    want = {}
    for i, text in items:
        keys = {norm(c) for _, c in cut(text)} - {""}
        held = {s for _, c, s in spans if norm(c) in keys and s is not None}
        section = held.pop() if len(held) == 1 else None
        for p, c in cut(text):
            want[i, p] = plain(((i, p), c, cut(text)[0][1], c, section), spans)
    assert got == want
    assert {w[0] for w in want.values()} == {None, "exact_evidence", "exact_title_in_section", "source_block_tokens"}


def test_three_tiers_read_documents_twice(spark, monkeypatch, tmp_path):
    import duckdb

    from tallyloom import registry

    docs, items = documents(random.Random(5))
    docs += [(200, "src0", None, "castle museum square dinner river bridge\nwhere one castle, a museum and the square are"), (201, "src0", None, "Nothing of it")]
    items += [(200, "a museum, one castle and some square where nobody is tonight"), (201, "castle museum square dinner river bridge market")]
    d, i = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for df, name in ((d, "documents"), (i, "benchmark")):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    read, seen = counted(spark, d)
    monkeypatch.setattr(resolve, "table", lambda spark, sf_dir, name: {"documents": read, "benchmark": i}[name])
    got = resolve.align_three_tier(spark, "").select("item_id", "outcome", "doc_id").collect()
    assert seen.value <= 2 * len(docs)
    want = con.execute(f"SELECT item_id, outcome, doc_id FROM ({registry.ORACLE_SQL['align_three_tier']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {w[1] for w in want} == {"exact", "unresolved", "tokens", "none"}
