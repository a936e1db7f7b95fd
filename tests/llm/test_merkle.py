"""The manifest against a plain tree, its proofs, odd rows, and its SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Levels of the tree, bottom first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    """[(sibling or None, is it on the left)] of node i."""
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def fold(at, steps):
    for h, left in steps:
        at = H(at) if h is None else H(h, at) if left else H(at, h)
    return at


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows):
    """Per row (doc_id, source, lang, n_chars, text) what the query returns, by the rule itself."""
    made = [(r, H(*map(cell, (r[0], r[1], r[2], r[3], r[4])))) for r in rows]
    langs = sorted({r[2] for r, _ in made}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((m for m in made if m[0][2] == x), key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1])) for x in langs}
    trees = {x: climb([h for _, h in g]) for x, g in groups.items()}
    over = climb([trees[x][-1][0] for x in langs])
    out = []
    for at, x in enumerate(langs):
        for i, (r, h) in enumerate(groups[x]):
            steps = path(trees[x], i) + path(over, at)
            n = r[3] + 1 if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[3]
            root = fold(H(*map(cell, (r[0], r[1], r[2], n, r[4]))), steps)
            out.append((r[0], h, trees[x][-1][0], over[-1][0], H(*(s or "" for s, _ in steps)), root, root == over[-1][0]))
    return sorted(map(str, out))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


@pytest.fixture
def ran(spark, tmp_path):
    def run(rows, **more):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})
        df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        return merkle.op12_merkle_manifest(spark, str(tmp_path))

    return run


def test_odd_rows(ran):
    rows = [(i, f"s{i % 3}", ("en", "de", None, "é", "z")[i * i % 5], i if i % 4 else None, "x" * (i * 7 % 40) if i % 6 else None) for i in range(60)]
    rows += [(7, "s", "en", 1, "twice"), (7, "s", "en", 1, "twice"), (7, "s", "en", 1, "other"), (None, None, None, None, None), (None, "s", "en", 4, ""), (8, "", "", 0, ""), (9, "s", "one", 5, "é" * 200_000)]
    got = ran(rows, key=1, pos=2, n=3, h=4, id=5, leaf=6, root=7, row=8, part=9)
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got.collect()) == plain(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(ran, n):
    rows = [(i, "s", "en", 3, "abc") for i in range(n)]
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in ran(rows).collect()) == plain(rows)


@pytest.mark.parametrize("bits", [1, 3])
def test_many_tiers_and_whole_proofs(spark, bits):
    rows = [(i, "s", f"l{i % 7 if i < 50 else 0}", i, "t") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = merkle.manifest(merkle.leaves(docs), bits=bits, with_proofs=True)
    got = found.select("*", (merkle.folded(F.col("leaf"), F.col("steps")) == F.col("root")).alias("ok"), (merkle.folded(F.lit("0" * 64), F.col("steps")) == F.col("root")).alias("bad")).collect()
    want = {eval(w)[0]: eval(w) for w in plain(rows)}
    assert len(got) == 90
    for r in got:
        doc, leaf, subroot, root, proof, _, _ = want[r["id"]]
        assert (leaf, subroot, root, proof) == (r["leaf"], r["subroot"], r["root"], r["proof_sha256"])
        assert r["ok"] and not r["bad"] and r["folded_root"] == root
        assert H(*(s["h"] or "" for s in r["steps"])) == proof


def test_copies_of_one_row_are_split(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    placed = merkle.numbered(merkle.leaves(docs.repartition(4)), F.col("id").asc_nulls_first(), F.col("h").asc())
    assert placed.agg(F.count_distinct("pos")).first()[0] == 3000
    got = merkle.manifest(merkle.leaves(docs), bits=5)
    assert got.where("folded_root = root").count() == 3000
    assert got.select("root").distinct().count() == 1


def test_sql(same):
    same(merkle.op12_merkle_manifest, merkle.SQL)
