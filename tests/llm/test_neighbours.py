"""Neighbour search: recall against brute force, exact scores and order, copies, odd rows, and parts of any size."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyloom.llm import neighbours

DATA = "/root/testdata"


def brute(rows, k, mod=20):
    """{query row: [(vec_id, score)]} of all usable rows [(id, vector)], nearest first."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q is not None and q % mod == 0:
            near = [(-float((np.array(x) * np.array(y)).sum()), v is None, v or 0, v) for j, (v, y) in enumerate(rows) if j != i]
            out.append((q, [(v, -s) for s, _, _, v in sorted(near)[:k]]))
    return sorted(out, key=str)


def answers(df):
    by = {}
    rows = df.collect()
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v, key=lambda x: x[0]) for q, v in by.items()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    t = pq.read_table(f"{DATA}/{sf}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), dtype="f8")
    got, hits, total = answers(neighbours.op13_nearest_neighbours(spark, f"{DATA}/{sf}")), 0, 0
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    at = {int(v): i for i, v in enumerate(ids)}
    for q, found in got.items():
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(score - s[at[v]]) < 1e-12 for _, v, score in found)
        assert [(-score, v) for _, v, score in found] == sorted((-score, v) for _, v, score in found)
        hits += len({v for _, v, _ in found} & set(ids[np.argsort(-s)[:20]].tolist()))
        total += 20
    assert hits >= 0.9 * total


def test_small_parts_and_many_tasks_find_the_same(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = np.round(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.3, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    asked = df.where("id % 20 = 0")
    one = neighbours.search(df, asked, leaf_rows=100)
    # leaves beyond a part are dealt to several, parts with many queries to several tasks, the forest is fitted on a sample
    many = neighbours.search(df, asked, leaf_rows=100, part_rows=40, task_queries=17)
    assert answers(one) == answers(many)
    few = answers(neighbours.search(df, asked, leaf_rows=60, sample=400, measured=30))
    want = {q: {v for v, _ in near} for q, near in brute([(i, v.tolist()) for i, v in enumerate(x)], 20)}
    assert sum(len({v for _, v, _ in few[q]} & want[q]) for q in want) >= 0.9 * 20 * len(want)


def test_clusters_need_few_rows():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(50, 16)) * 4
    x = centres[rng.integers(0, 50, 20_000)] + rng.normal(size=(20_000, 16)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = neighbours.Forest(x[:8000], len(x))
    leaves = forest.route(x)
    sizes = np.bincount(leaves.ravel(), minlength=forest.trees * forest.leaves)
    assert sizes.sum() == forest.trees * len(x) and sizes.max() < 4 * neighbours.LEAF_ROWS
    hits = 0
    for q, order in zip(x[:50], forest.visit(x[:50], sizes, len(x) // 5, 21)):  # a twentieth of what the four trees hold
        hits += np.isin(leaves[np.argsort(-(x @ q))[:20]], order).any(1).sum()
    assert hits >= 0.9 * 50 * 20


def test_copies_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.5, 0.5]), (120, [0.0, 2.0]), (None, [3.0, 0.0]), (None, [0.25, 1.0]), (7, [1.0]), (140, [1.0])]
    bad = [(160, None), (180, []), (200, [0.0, 0.0]), (220, [1.0, None]), (240, [nan, 1.0]), (260, [inf, 1.0]), (1, [0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<float>, gid int, v int")
    vectors = neighbours.usable(df)
    got = neighbours.search(vectors, vectors.where("id % 20 = 0"))
    padded = [(i, (v + [0.0])[:2]) for i, v in rows]
    want = [(q, rank, v, s) for q, near in brute(padded, 20) for rank, (v, s) in enumerate(near, 1)]
    assert sorted(map(str, ((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()))) == sorted(map(str, want))


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5])], "id long, v array<double>")
    got = answers(neighbours.search(df, df.where("id % 20 = 0")))
    assert got == {0: [(1, 1, 4.0), (2, 20, 1.5)], 20: [(1, 0, 1.5), (2, 1, 1.5)]}
    alone = df.where("id = 0")
    assert neighbours.search(alone, alone).count() == 0
    none = df.where("id < 0")
    assert neighbours.search(none, none).count() == 0
    assert neighbours.search(none, none).columns == ["query_id", "rank", "vec_id", "score"]
