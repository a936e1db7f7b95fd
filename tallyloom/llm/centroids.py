"""Centroid clustering of integer vectors by Yinyang bounds, exact.

Vectors are scaled to integers; the first centroids are the vectors of smallest digest.  Centroids are put into groups once.
A vector keeps an upper bound of its distance to its own centroid and, for each group, one lower bound of the distances to the group's
other centroids.  In a round the bounds move by as much as the centroids did; a vector whose upper bound lies under all its lower
bounds is passed over, then its upper bound is made exact, and of what is still open only groups whose
lower bound lies under it are scanned, exactly, in integers.  Bounds are widened by far more than a double's rounding,
and a vector is only passed over where its bound is strictly smaller, so that ties are always scanned: smaller numbers win them.

Each round writes vectors and bounds to the shared folder and drops the table before the last, so that a lost executor
costs one round and no more than two tables stand there.  Sums are partial before they are shuffled and come to one row a centroid; centroids
(k rows) are all that the driver holds.

Edge cases: null vectors, those of another length and those with null or non-finite components take no part; a component
beyond ``LIMIT`` after scaling raises, as its squared distances need not fit 64 bits.  A null id has no digest, so
it is the last to make a centroid.  Rows that repeat an id are vectors of their own; of equal digests the smaller vector comes
first.  Fewer vectors than k make fewer centroids, none at all an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, shared_path, table

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2:"
#: Centroids to a group, about.
GROUP_SIZE = 10
#: Largest component after scaling: 64 squares of differences of two such fit 64 bits.
LIMIT = 1 << 27
#: Squares and products of components up to this add up exactly in doubles, in vectors of up to 256 components.
EXACT_IN_DOUBLES = 1 << 20
#: Relative widening of the bounds.
SLACK = 1e-9


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id and ``q``, the vector in integers, of the vectors that take part."""
    v = F.col(vec_col)
    whole = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)))
    wide = F.exists(v, lambda x: F.abs(x.cast("double") * float(scale)) >= float(LIMIT))
    q = F.when(wide, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")).otherwise(scaled.cast("array<int>"))
    return vectors.where(whole).select(F.col(id_col).alias("id"), q.alias("q"))


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of q to all rows of c, as integers."""
    if q.size and c.size and max(np.abs(q).max(), np.abs(c).max()) <= EXACT_IN_DOUBLES and q.shape[1] <= 256:
        x, y = q.astype("f8"), c.astype("f8")
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype("i8")
    return np.stack([((q.astype("i8") - row) ** 2).sum(1) for row in c], axis=1) if len(c) else np.empty((len(q), 0), "i8")


def group_centroids(c: np.ndarray, size: int = GROUP_SIZE) -> np.ndarray:
    """The group of each centroid, by a few rounds of plain clustering of the centroids themselves."""
    n = max(1, -(-len(c) // size))
    means = c[:n].astype("f8")
    for _ in range(5):
        group = ((c[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([c[group == g].mean(0) if (group == g).any() else means[g] for g in range(n)])
    return group


def _group_minima(d: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.stack([d[:, group == g].min(1) if (group == g).any() else np.full(len(d), np.inf) for g in range(n)], axis=1)


def scan_all(q: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, upper bound and a lower bound for each group, with no bounds before."""
    d = squared(q, c)
    own = d.argmin(1)
    rows = np.arange(len(q))
    upper = np.sqrt(d[rows, own].astype("f8")) * (1 + SLACK)
    far = d.astype("f8")
    far[rows, own] = np.inf
    return own, upper, np.sqrt(_group_minima(far, group, group.max() + 1)) * (1 - SLACK)


def scan_open(q: np.ndarray, c: np.ndarray, group: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As :func:`scan_all` from the bounds of the round before; also the number of distances that were computed."""
    n, cost = group.max() + 1, 0
    moved = np.array([drift[group == g].max(initial=0.0) for g in range(n)])
    own, upper, lower = own.copy(), (upper + drift[own]) * (1 + SLACK), lower - moved - SLACK * (np.where(np.isinf(lower), 0, np.abs(lower)) + moved)
    at = np.flatnonzero(upper >= lower.min(1))  # the global filter
    exact = ((q[at].astype("i8") - c[own[at]]) ** 2).sum(1)
    cost += len(at)
    upper[at] = np.sqrt(exact.astype("f8")) * (1 + SLACK)
    still = upper[at] >= lower[at].min(1)
    at, exact = at[still], exact[still]
    d = np.full((len(at), len(c)), np.iinfo("i8").max)
    d[np.arange(len(at)), own[at]] = exact
    scanned = lower[at] <= upper[at][:, None]  # the filter by group
    for g in range(n):
        rows, members = np.flatnonzero(scanned[:, g]), np.flatnonzero(group == g)
        if len(rows) and len(members):
            d[np.ix_(rows, members)] = squared(q[at[rows]], c[members])
            cost += len(rows) * len(members)
    rows, best = np.arange(len(at)), d.argmin(1)
    # A scanned group's bound is what was found; the group that a vector leaves has its old centroid among the others now.
    far = np.where(d == np.iinfo("i8").max, np.inf, d.astype("f8"))
    far[rows, best] = np.inf
    found = np.sqrt(_group_minima(far, group, n)) * (1 - SLACK)
    lower[at] = np.where(scanned, found, np.minimum(lower[at], found))
    upper[at], own[at] = np.sqrt(d[rows, best].astype("f8")) * (1 + SLACK), best
    return own, upper, lower, cost


def _assign(c: np.ndarray, group: np.ndarray, drift: np.ndarray | None, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = np.asarray(b["q"].flatten()).reshape(b.num_rows, -1)
            if drift is None:
                own, upper, lower = scan_all(q, c, group)
            else:
                lower = np.asarray(b["lower"].flatten()).reshape(b.num_rows, -1)
                own, upper, lower, _ = scan_open(q, c, group, np.asarray(b["cluster"]), np.asarray(b["upper"]), lower, drift)
            if last:
                distance = np.concatenate([((q[i : i + 1000].astype("i8") - c[own[i : i + 1000]]) ** 2).sum(1) for i in range(0, len(q), 1000)])
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(own.astype("i4")), pa.array(distance)], ["id", "cluster", "distance"])
            else:
                at = pa.array(np.arange(0, lower.size + 1, lower.shape[1], dtype="i4"))
                bounds = pa.ListArray.from_arrays(at, pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([b["id"], b["q"], pa.array(own.astype("i4")), pa.array(upper), bounds], ["id", "q", "cluster", "upper", "lower"])

    return run


def cluster(points: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """id, cluster and squared distance of each point (id, q), and the final centroids."""
    spark, id_type = points.sparkSession, dict(points.dtypes)["id"]

    def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = shared_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = write(points, "vectors")
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = now.select(digest.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return now.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), np.empty((0, 0), "i8")
    c = np.array([r["q"] for r in first], dtype="i8")
    group, drift = group_centroids(c), None
    for r in range(rounds + 1):
        last = r == rounds
        schema = f"id {id_type}, cluster int, distance bigint" if last else f"id {id_type}, q array<int>, cluster int, upper double, lower array<double>"
        after, new = write(now.mapInArrow(_assign(c, group, drift, last), schema), f"clusters-{r}")
        discard(spark, path)
        now, path = after, new
        if not last:
            sums = now.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(c.shape[1])]).collect()
            old, c = c, c.copy()
            for row in sums:
                c[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(c.shape[1])]
            drift = np.sqrt(((c - old) ** 2).sum(1).astype("f8"))
    return now, c


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, c = cluster(integers(table(spark, sf_dir, "embeddings")))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    rows = [(i, sums[i], total, hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i in sorted(sums)]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row a centroid: k at most
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (
  SELECT rid, vec_id, q, cluster, d FROM (
    SELECT rid, vec_id, q, cluster, CAST(list_sum(list_transform(range(1, {DIM + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS BIGINT) AS d FROM kept, c{r}
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cluster) = 1
)"""


def _update(r: int) -> str:
    return f"""
c{r} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r - 1} o LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range({DIM})) AS i FROM a{r - 1}) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m USING (cluster)
)"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id) NULLS LAST, q) - 1 AS cluster, q AS c FROM kept QUALIFY cluster < {K}
), {"".join(_round(r) + "," + _update(r + 1) + "," for r in range(ROUNDS))} {_round(ROUNDS)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)
"""
