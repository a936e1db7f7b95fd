"""Yinyang clustering against plain rounds of exact integers, its bounds, odd rows, and its SQL."""

import hashlib

import numpy as np
import pytest

from tallyloom.llm import centroids


def plain(points, k, rounds, seed="2:"):
    """[(id, q)] -> clusters, distances and centroids, by scanning every centroid in Python integers."""
    order = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"{seed}{p[0]}".encode()).hexdigest(), p[1]))
    c = [list(q) for _, q in order[:k]]
    assign = lambda: [min((sum((x - y) ** 2 for x, y in zip(q, m)), j) for j, m in enumerate(c)) for _, q in points]
    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(c)):
            rows = [q for (_, q), o in zip(points, own) if o == j]
            if rows:
                c[j] = [sum(x) // len(rows) for x in zip(*rows)]
    return assign(), c


@pytest.mark.parametrize("n,dim,k,spread", [(300, 5, 23, 6), (200, 64, 40, 300), (50, 3, 40, 2), (7, 4, 40, 9), (120, 6, 12, 1 << 26)])
def test_equals_plain_rounds(spark, n, dim, k, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.integers(-spread, spread + 1, dim).tolist()) for i in rng.permutation(n)]
    want, c = plain(rows, k, 5)
    got, means = centroids.cluster(spark.createDataFrame(rows, "id long, q array<int>").repartition(3), k=k)
    assert means.tolist() == c
    assert sorted((r["id"], r["cluster"], r["distance"]) for r in got.collect()) == sorted((i, j, d) for (i, _), (d, j) in zip(rows, want))


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(3)
    c = rng.integers(-200, 200, (40, 8))
    q = c[rng.integers(0, 40, 5000)] + rng.integers(-40, 40, (5000, 8))
    group = centroids.group_centroids(c)
    own, upper, lower = centroids.scan_all(q, c, group)
    for _ in range(4):
        old, c = c, c + rng.integers(-3, 4, c.shape)
        own, upper, lower, cost = centroids.scan_open(q, c, group, own, upper, lower, np.sqrt(((c - old) ** 2).sum(1)))
        d = ((q[:, None] - c) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(q)), own])).all()
        d = d.astype("f8")
        d[np.arange(len(q)), own] = np.inf
        for g in range(group.max() + 1):
            assert (lower[:, g] <= np.sqrt(d[:, group == g].min(1, initial=np.inf))).all()
        assert cost < 0.5 * d.size


def test_ties_take_the_smaller_number(spark):
    rows = [(1, [0, 0]), (2, [2, 0]), (3, [1, 0]), (3, [1, 0]), (4, [0, 0]), (None, [2, 0]), (None, [1, 0])]
    want, c = plain(rows, 3, 2)
    got, means = centroids.cluster(spark.createDataFrame(rows, "id long, q array<int>"), k=3, rounds=2)
    assert means.tolist() == c
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got.collect()) == sorted((str(i), j, d) for (i, _), (d, j) in zip(rows, want))


def test_what_takes_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001], 1), (2, None, 2), (3, [], 3), (4, [1.0], 4), (5, [1.0, None], 5), (6, [nan, 1.0], 6), (7, [inf, 1.0], 7), (8, [1.0, -inf], 8), (None, [1.0, 1.0], 9), (9, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q int")
    got = centroids.integers(df, dim=2).collect()
    assert sorted((str(r["id"]), r["q"]) for r in got) == [("1", [128, -1]), ("None", [256, 256])]
    with pytest.raises(Exception, match="too large"):
        centroids.integers(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dim=2).collect()
    df.where("vec_id < 0").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert centroids.op11_centroid_clustering(spark, str(tmp_path)).count() == 0
    found, c = centroids.cluster(centroids.integers(df.where("vec_id < 0")))
    assert found.count() == 0 and len(c) == 0


def test_sql(same):
    same(centroids.op11_centroid_clustering, centroids.SQL)
