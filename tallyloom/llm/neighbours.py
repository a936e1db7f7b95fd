"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one priority queue over all of them, exact reranking.

Trees split at the median of random projections.  They are fitted on at most about ``SAMPLE`` vectors; every vector is then dealt to its
leaf in each tree.  A search keeps one queue of nodes of all trees, in the order of the query's inner product with the mean of a node's
sample, and opens leaves until they hold as many rows as the budget says.  All candidates of those leaves are compared with the
query in double precision.

The budget is measured, not guessed: a bounded sample of queries is answered by brute force (one pass over the vectors), and the budget is
the number of rows after which the queue has met ``TARGET`` of their true neighbours.  So it follows the data: where vectors lie in
clusters a few leaves suffice, where they have no structure the queue must open a large share of them, and the search costs accordingly.

Leaves are gathered into parts of some ``PART_ROWS`` rows; a leaf that alone holds more is dealt to several parts by hash.  Queries meet
the parts of their leaves, at most some ``TASK_QUERIES`` of them in a task, beyond which a part is sent to several tasks.  Exact copies of a vector are one
candidate with its smallest k + 1 ids, which are all that any result can name, so a group of copies of any size is one row of a leaf.
The driver holds the sample, the forest (of bounded depth) and the counts of its leaves.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part; a shorter vector counts as
padded by zeros.  A query's own row is left out, other rows of its id are not; a null id is no query and comes last among ties, and rows
that repeat a query give its answers again.  Fewer candidates than k are all returned; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table

K, TREES, LEAF_ROWS, SAMPLE = 20, 4, 256, 1 << 15
#: A leaf is fitted on so many vectors of the sample at least, which bounds the depth of the trees.
LEAF_SAMPLE = 16
#: Queries that are answered by brute force, and the share of their neighbours that the budget must meet.
MEASURED, TARGET = 128, 0.95
PART_ROWS, TASK_QUERIES = 1 << 14, 1 << 14
_CHUNK = 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and v (in doubles) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def matrix(lists: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


class Forest:
    """Complete binary trees: node i has the children 2 i + 1 and 2 i + 2; nodes without a plane are leaves."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 1):
        rng, (n, dim) = np.random.default_rng(seed), sample.shape
        self.dim, self.trees = dim, trees
        self.depth = max(0, min(int(np.ceil(np.log2(max(1, rows / leaf_rows)))), int(np.log2(max(1, n / LEAF_SAMPLE)))))
        inner, self.leaves = (1 << self.depth) - 1, 1 << self.depth
        self.planes = rng.normal(size=(trees, inner, dim)).astype("f4")
        self.offsets = np.zeros((trees, inner))
        self.means = np.zeros((trees, inner + self.leaves, dim), "f4")
        for t in range(trees):
            members = [np.arange(n)]
            for i in range(inner + self.leaves):
                at, members[i] = members[i], None
                self.means[t, i] = sample[at].mean(0) if len(at) else self.means[t, (i - 1) // 2]
                if i < inner:
                    p = (sample[at] * self.planes[t, i]).sum(1)
                    self.offsets[t, i] = np.median(p) if len(at) else 0.0
                    right = p > self.offsets[t, i]
                    members += [at[~right], at[right]]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered across trees."""
        out = np.empty((len(x), self.trees), "i4")
        for t in range(self.trees):
            node = np.zeros(len(x), "i8")
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * self.planes[t, node]).sum(1) > self.offsets[t, node])
            out[:, t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def visit(self, x: np.ndarray, sizes: np.ndarray, budget: float, least: int) -> list[list[int]]:
        """Leaves opened for each row, in order, until they hold ``budget`` rows and those of one tree ``least``; empty ones are passed over."""
        nodes, first = self.means.shape[1], self.leaves - 1
        gains, sizes, out = x @ self.means.reshape(-1, self.dim).T.astype("f8"), sizes.tolist(), []
        for gain in gains:
            gain = (-gain).tolist()
            queue = [(gain[t * nodes], t, 0) for t in range(self.trees)]
            heapq.heapify(queue)
            met, total, of_tree = [], 0, [0] * self.trees
            while queue and (total < budget or max(of_tree) < least):
                _, t, i = heapq.heappop(queue)
                if i >= first:
                    leaf = t * self.leaves + i - first
                    if sizes[leaf]:
                        met.append(leaf)
                        total += sizes[leaf]
                        of_tree[t] += sizes[leaf]
                else:
                    for child in (2 * i + 1, 2 * i + 2):
                        heapq.heappush(queue, (gain[t * nodes + child], t, child))
            out.append(met)
        return out


class Parts:
    """Leaves as parts: neighbours of a tree together, a large leaf alone in several."""

    def __init__(self, sizes: np.ndarray, leaves: int, rows: int = PART_ROWS):
        self.first, self.blocks = np.zeros(len(sizes), "i8"), np.maximum(1, -(-sizes // rows))
        part, filled = -1, 0
        for leaf, n in enumerate(sizes.tolist()):
            if leaf % leaves == 0 or filled + n > rows:
                part, filled = part + 1, 0
            self.first[leaf] = part
            filled += n
            part += int(self.blocks[leaf]) - 1


def _top(scores: np.ndarray, k: int, tie: np.ndarray) -> list[np.ndarray]:
    """For each row the places of its k largest scores that are finite, of equal ones those of smaller ``tie``."""
    n, out = scores.shape[1], []
    floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    for row, low in zip(scores, floor):
        at = np.flatnonzero((row >= low) & (row > -np.inf))
        out.append(at[np.lexsort((tie[at], -row[at]))[:k]])
    return out


_FOUND = "array<struct<score double, gid bigint, tie bigint, own boolean>>"
_ARROW_FOUND = pa.struct([("score", pa.float64()), ("gid", pa.int64()), ("tie", pa.int64()), ("own", pa.bool_())])


def _lists(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("i4")), values)


def _rerank(dim: int, k: int):
    """The k best of a part's rows for each query that opened leaves of it."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        q = matrix(queries["v"], dim)
        numbers, lengths, scores, gids, ties, own = [], [], [], [], [], []
        if len(rows) and len(queries):
            leaf, tie = np.asarray(rows["leaf"].combine_chunks()), np.asarray(rows["tie"].combine_chunks())
            order = np.argsort(leaf, kind="stable")
            x, gid, leaf, tie = matrix(rows["v"], dim)[order], np.asarray(rows["gid"].combine_chunks())[order], leaf[order], tie[order]
            opened = queries["leaves"].combine_chunks()
            sizes, flat = np.asarray(opened.value_lengths()), np.asarray(opened.flatten())
            asked, number = np.repeat(np.arange(len(q)), sizes), np.asarray(queries["number"].combine_chunks())
            for start in range(0, len(q), _CHUNK):
                end = min(len(q), start + _CHUNK)
                near = np.full((end - start, len(x)), -np.inf)
                here = (asked >= start) & (asked < end)
                for one in np.unique(flat[here]):
                    who = asked[here & (flat == one)] - start
                    a, b = np.searchsorted(leaf, [one, one + 1])
                    near[who, a:b] = q[start + who] @ x[a:b].T
                for i, at in enumerate(_top(near, k, tie), start):
                    if len(at):
                        numbers.append(number[i])
                        lengths.append(len(at))
                        scores.append((x[at] * q[i]).sum(1))  # the same for a pair in whichever part it meets
                        gids.append(gid[at])
                        ties.append(tie[at])
                        own.append((x[at] == q[i]).all(1))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        values = pa.StructArray.from_arrays([pa.array(join(scores, "f8")), pa.array(join(gids, "i8")), pa.array(join(ties, "i8")), pa.array(join(own, bool))], fields=list(_ARROW_FOUND))
        return pa.table({"number": pa.array(np.array(numbers, "i8")), "found": _lists(lengths, values)})

    return run


def _nearest(queries: np.ndarray, dim: int, k: int):
    """Brute force: of a task's rows the k nearest to each query that are not its own vector, with their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in queries]  # heaps of (score, a number against ties, vector)
        count = 0
        for b in batches:
            x = matrix(b["v"], dim)
            for start in range(0, len(x), 4096):
                y = x[start : start + 4096]
                for j, at in enumerate(_top(queries @ y.T, k + 1, np.arange(len(y)))):
                    for i, s in zip(at.tolist(), (y[at] * queries[j]).sum(1).tolist()):
                        if not (len(best[j]) == k and s <= best[j][0][0]) and (y[i] != queries[j]).any():
                            count += 1
                            (heapq.heappush if len(best[j]) < k else heapq.heapreplace)(best[j], (s, count, y[i]))
        rows = [(j, s, v) for j, heap in enumerate(best) for s, _, v in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), _lists([dim] * len(rows), pa.array(np.concatenate([r[2] for r in rows])))], ["q", "score", "v"])

    return run


def budget_for(distinct: DataFrame, sampled: np.ndarray, forest: Forest, sizes: np.ndarray, k: int, target: float = TARGET) -> int:
    """Rows that a search must meet for ``target`` of the sampled queries' true neighbours."""
    exact = distinct.select("v").mapInArrow(_nearest(sampled, forest.dim, k), "q int, score double, v array<double>")
    exact = exact.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("place") <= k).select("q", "v").collect()
    if not exact:
        return 0
    homes = forest.route(np.array([r["v"] for r in exact]))
    met = []
    for order in forest.visit(sampled, sizes, np.inf, 0):
        met.append(np.full(len(sizes), np.inf))
        met[-1][order] = np.cumsum(sizes[order])
    need = [met[r["q"]][home].min() for r, home in zip(exact, homes)]
    return int(np.quantile(need, target, method="higher"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, measured: int = MEASURED, target: float = TARGET, part_rows: int = PART_ROWS, task_queries: int = TASK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of ``vectors`` (id, v) to each of ``queries`` (id, v), which are rows of ``vectors``."""
    id_type = dict(vectors.dtypes)["id"]
    by_id = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    copies = vectors.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    copies = copies.groupBy("v").agg(F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("no"), "id"))).alias("ids"))
    distinct = stage(copies.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    asked = stage(queries.select("id", "v").withColumn("number", F.monotonically_increasing_id()), "queries")
    n, dim = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    m = asked.count()
    if not n or not m:
        return vectors.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))

    def some(df: DataFrame, of: int, most: int) -> np.ndarray:
        share = min(1.0, most / of)
        rows = df if share == 1.0 else df.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30)))
        return matrix(rows.select("v").toArrow()["v"], dim)

    forest = Forest(some(distinct, n, sample), n, trees, leaf_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(forest.trees * forest.leaves, "i8")
        for b in batches:
            sizes += np.bincount(forest.route(matrix(b["v"], dim)).ravel(), minlength=len(sizes))
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(sizes[at])], ["leaf", "n"])

    sizes = np.zeros(forest.trees * forest.leaves, "i8")
    for r in distinct.select("v").mapInArrow(count, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # a row a leaf
        sizes[r["leaf"]] = r["n"]
    sampled = some(asked, m, measured)[: 4 * measured]
    budget = budget_for(distinct, sampled, forest, sizes, k, target)
    parts, tasks = Parts(sizes, forest.leaves, part_rows), -(-m // task_queries)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, gid = forest.route(matrix(b["v"], dim)), np.asarray(b["gid"])
            for t in range(forest.trees):
                block = (gid ^ (gid >> 33)) % parts.blocks[leaf[:, t]]
                yield pa.RecordBatch.from_arrays([pa.array(parts.first[leaf[:, t]] + block), pa.array(leaf[:, t]), b["gid"], b["tie"], b["v"]], ["part", "leaf", "gid", "tie", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, _CHUNK):
                c = b.slice(start, _CHUNK)
                rows, opened = [], []
                for i, leaves in enumerate(forest.visit(matrix(c["v"], dim), sizes, budget, k + 1)):
                    of_part: dict[int, list[int]] = {}
                    for leaf in leaves:
                        for block in range(int(parts.blocks[leaf])):
                            of_part.setdefault(int(parts.first[leaf]) + block, []).append(leaf)
                    rows += [(i, p) for p in of_part]
                    opened += of_part.values()
                at = pa.array([r[0] for r in rows], pa.int64())
                lists = _lists([len(x) for x in opened], pa.array([y for x in opened for y in x], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), c["number"].take(at), c["v"].take(at), lists], ["part", "number", "v", "leaves"])

    ids = F.col("ids")[0]["id"]
    tie = ids.cast("bigint") if id_type in ("tinyint", "smallint", "int", "bigint") else F.col("gid")
    rows = distinct.select("gid", F.coalesce(tie, F.lit((1 << 63) - 1)).alias("tie"), "v").mapInArrow(deal, "part bigint, leaf int, gid bigint, tie bigint, v array<double>")
    rows = rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    wanted = asked.select("number", "v").mapInArrow(ask, "part bigint, number bigint, v array<double>, leaves array<int>")
    wanted = wanted.withColumn("task", F.pmod(F.xxhash64("number"), F.lit(tasks)).cast("int"))
    found = rows.groupBy("part", "task").cogroup(wanted.groupBy("part", "task")).applyInArrow(_rerank(dim, k + 1), f"number bigint, found {_FOUND}")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "tie", "gid")  # one candidate from several trees has one place
    found = found.select("number", F.inline("found")).withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k + 1)
    found = found.groupBy("number", "gid").agg(F.first("score").alias("score"), F.first("own").alias("own"))
    found = found.join(distinct.select("gid", "ids"), "gid").join(asked.select("number", F.col("id").alias("query_id")), "number")
    itself = F.when(F.col("own"), F.array_position("ids", F.struct(F.col("query_id").isNull().alias("no"), F.col("query_id").alias("id")))).otherwise(0)
    found = found.withColumn("at", itself - 1).select("number", "query_id", "score", F.explode(F.filter("ids", lambda x, i: i != F.col("at"))).alias("of"))
    final = Window.partitionBy("number").orderBy(F.desc("score"), F.col("of.id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", F.col("of.id").alias("vec_id"), "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("id") % 20 == 0))
