"""Merkle manifest of a table: a tree for each group of rows, one over the groups' roots, and a proof for every row.

Rows become leaves by built-in functions and are numbered within their group by a range sort and counts of its partitions.  Buckets of
``2 ** BUCKET_BITS`` neighbours, aligned so that each is a whole subtree, go to executors as Arrow tables, where DuckDB climbs
them level by level: an ordered ``string_agg`` of two neighbours and its sha256.  Spark combines the buckets' roots in the same
way, tier by tier, until one node is left, then the groups' roots.  Each bucket is joined to its outer proof
(one row a bucket), and DuckDB climbs it once more with every leaf's inner proof and the root that folds out of the leaf and the whole proof.
No proof goes through a shuffle unless it is asked for.

A bucket is bounded, so a group of any size is many of them; copies of a row without end are split by the sort as well.  Leaves and tiers are
kept in the shared folder, so texts are read once.  The driver holds one number a tier.

Edge cases: a null group is a group of its own and comes first; null ids come before others in their group; equal ids follow each other by
leaf; a null cell is ``-``; a row that stands there twice is two leaves.  A lone leaf is its group's root, a lone group's root the root.
An empty table has no rows and no root.  Very long texts are hashed in the JVM and no further column is read.
"""

from __future__ import annotations

from collections.abc import Sequence

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table

#: A bucket holds 4096 nodes, a few hundred kilobytes.
BUCKET_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: the sibling's digest (null: there is none, and the node is hashed alone), and whether it stands on the left.
STEPS = "array<struct<h string, left boolean>>"
_ARROW_STEPS = pa.list_(pa.struct([("h", pa.string()), ("left", pa.bool_())]))

_engine: list[duckdb.DuckDBPyConnection] = []


def cell(value: Column) -> Column:
    """``-``, or the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(cell, values)), 256)


def leaves(rows: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", altered: dict[str, Column] | None = None) -> DataFrame:
    """key (the group, null first in its order), id, h (the leaf) and checked (the leaf of the row with ``altered`` columns)."""
    values = {f: F.col(f) for f in fields}
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    return rows.select(key.alias("key"), F.col(id_col).alias("id"), leaf(list(values.values())).alias("h"), leaf(list((values | (altered or {})).values())).alias("checked"))


def numbered(nodes: DataFrame, *order: Column) -> DataFrame:
    """pos, the place of a node (key, ...) in its key's order, and n, the number of its key's nodes.

    The sort's last column is the row's own number, so rows that are equal in all else are dealt to several tasks; as they are equal,
    which comes first doesn't matter."""
    nodes = stage(nodes, "nodes").withColumn("__salt", F.monotonically_increasing_id())
    order = (F.col("key"), *order, F.col("__salt").asc())
    placed = stage(nodes.repartitionByRange(*order).sortWithinPartitions(*order).drop("__salt").withColumn("row", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("part", F.shiftright("row", 33))
    of_key = Window.partitionBy("key")
    before = of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("key", "part").agg(F.min("row").alias("first"), F.count("*").alias("m"))  # a row a partition and key
    starts = starts.select("key", "part", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(of_key).alias("n"))
    return placed.join(starts, ["key", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _duck() -> duckdb.DuckDBPyConnection:
    """A connection of its own to the worker's one engine, in memory and on one thread."""
    if not _engine:
        _engine.append(duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""}))
    return _engine[0].cursor()


def _levels(n: int, bits: int) -> int:
    """Levels to climb in a bucket of a key of n nodes: a key's last bucket ends where one node is left."""
    return min(bits, (n - 1).bit_length())


def _climb(con: duckdb.DuckDBPyConnection, levels: int, more: str | None = None) -> None:
    """From nodes(i, h), and paths(i, ...) of them, to the nodes ``levels`` up; ``more`` is what a path's columns become, with its sibling s."""
    for _ in range(levels):
        if more:
            con.execute(f"CREATE OR REPLACE TEMP TABLE paths AS SELECT p.* REPLACE (p.i // 2 AS i, {more}) FROM paths p LEFT JOIN nodes s ON s.i = xor(p.i, 1)")
        con.execute("CREATE OR REPLACE TEMP TABLE nodes AS SELECT i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM nodes GROUP BY i // 2")


_STEP = "list_append(p.steps, {'h': s.h, 'left': p.i % 2 = 1}) AS steps"
_FOLD = "sha256(CASE WHEN s.h IS NULL THEN p.folded WHEN p.i % 2 = 1 THEN s.h || p.folded ELSE p.folded || s.h END) AS folded, p.proof || coalesce(s.h, '') AS proof"


def _load(bucket: pa.Table, columns: str | None = None) -> duckdb.DuckDBPyConnection:
    con = _duck()
    con.register("bucket", bucket)
    con.execute("CREATE OR REPLACE TEMP TABLE nodes AS SELECT pos AS i, h FROM bucket")
    if columns:
        con.execute(f"CREATE OR REPLACE TEMP TABLE paths AS SELECT pos AS i, {columns} FROM bucket")
    con.unregister("bucket")
    return con


def _root(bits: int):
    def run(bucket: pa.Table) -> pa.Table:
        n = bucket["n"][0].as_py()
        con = _load(bucket.select(["pos", "h"]))
        _climb(con, _levels(n, bits))
        ((h,),) = con.execute("SELECT h FROM nodes").fetchall()
        pos = bucket["pos"][0].as_py() >> bits
        return pa.table({"key": [bucket["key"][0].as_py()], "pos": pa.array([pos], pa.int64()), "h": [h], "n": pa.array([-(-n >> bits)], pa.int64())})

    return run


def _prove(bits: int):
    def run(bucket: pa.Table) -> pa.Table:
        con = _load(bucket.select(["pos", "h"]), "pos, CAST([] AS STRUCT(h VARCHAR, \"left\" BOOLEAN)[]) AS steps")
        _climb(con, _levels(bucket["n"][0].as_py(), bits), _STEP)
        ((root,),) = con.execute("SELECT h FROM nodes").fetchall()
        out = con.sql("SELECT pos, steps FROM paths").to_arrow_table()
        return pa.table({"key": pa.repeat(bucket["key"][0].as_py(), len(out)), "pos": out["pos"].cast(pa.int64()), "n": pa.repeat(bucket["n"][0].as_py(), len(out)), "steps": out["steps"].cast(_ARROW_STEPS), "root": pa.repeat(root, len(out))})

    return run


def tree(nodes: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """key, pos, steps and root of every node (key, pos, h, n): its whole proof and its key's root."""
    tiers = []
    while True:
        done = stage(nodes.groupBy("key", F.shiftright("pos", bits)).applyInArrow(_prove(bits), f"key string, pos bigint, n bigint, steps {STEPS}, root string"), "tier")
        tiers.append(done)
        if (done.agg(F.max("n")).first()[0] or 0) <= 1 << bits:
            break
        nodes = done.where(F.col("pos") % (1 << bits) == 0).select("key", F.shiftright("pos", bits).alias("pos"), F.col("root").alias("h"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"))
    proved = tiers.pop().drop("n")
    for lower in reversed(tiers):
        above = proved.select("key", F.col("pos").alias("above"), F.col("steps").alias("outer"), F.col("root").alias("top"))
        proved = lower.withColumn("above", F.shiftright("pos", bits)).join(above, ["key", "above"]).select("key", "pos", F.concat("steps", "outer").alias("steps"), F.col("top").alias("root"))
    return proved


def _finish(bits: int, with_proofs: bool):
    def run(bucket: pa.Table, outer: pa.Table) -> pa.Table:
        (above,) = outer.to_pylist()
        start = "id, h, checked AS folded, '' AS proof" + (", CAST([] AS STRUCT(h VARCHAR, \"left\" BOOLEAN)[]) AS steps" if with_proofs else "")
        con = _load(bucket.select(["pos", "h", "id", "checked"]), start)
        _climb(con, _levels(bucket["n"][0].as_py(), bits), _FOLD + (f", {_STEP}" if with_proofs else ""))
        folded, rest = "folded", "".join(s["h"] or "" for s in above["steps"])
        for s in above["steps"]:
            folded = f"sha256({folded})" if s["h"] is None else f"sha256('{s['h']}' || {folded})" if s["left"] else f"sha256({folded} || '{s['h']}')"
        out = con.sql(f"SELECT id, h AS leaf, sha256(proof || '{rest}') AS proof_sha256, {folded} AS folded_root{', steps' if with_proofs else ''} FROM paths").to_arrow_table()
        columns = {"id": out["id"].cast(bucket["id"].type), **{c: out[c].cast(pa.string()) for c in ("leaf", "proof_sha256", "folded_root")}}
        columns |= {c: pa.repeat(above[c], len(out)) for c in ("subroot", "root")}
        if with_proofs:
            upper = pa.array([above["steps"]], _ARROW_STEPS)
            steps = [inner + upper[0].as_py() for inner in out["steps"].to_pylist()]
            columns["steps"] = pa.array(steps, _ARROW_STEPS)
        return pa.table(columns)

    return run


def manifest(rows: DataFrame, bits: int = BUCKET_BITS, with_proofs: bool = False) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 and folded_root of all leaves (key, id, h, checked); with ``with_proofs`` also steps."""
    placed = stage(numbered(rows, F.col("id").asc_nulls_first(), F.col("h").asc()), "leaves")
    buckets = placed.withColumn("bucket", F.shiftright("pos", bits))
    roots = stage(buckets.groupBy("key", "bucket").applyInArrow(_root(bits), "key string, pos bigint, h string, n bigint"), "bucket-roots")
    inside = stage(tree(roots, bits), "proofs")
    subroots = inside.where("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("h"))
    groups = numbered(subroots, F.col("name").asc())
    over = tree(groups.select("key", "pos", "h", "n"), bits).select("pos", F.col("steps").alias("upper"), F.col("root").alias("top"))
    over = groups.select("pos", F.col("name").alias("key")).join(over, "pos").drop("pos")
    outer = inside.join(over, "key").select("key", F.col("pos").alias("bucket"), F.concat("steps", "upper").alias("steps"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    schema = f"id {dict(rows.dtypes)['id']}, leaf string, proof_sha256 string, folded_root string, subroot string, root string" + (f", steps {STEPS}" if with_proofs else "")
    return buckets.groupBy("key", "bucket").cogroup(outer.groupBy("key", "bucket")).applyInArrow(_finish(bits, with_proofs), schema)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give, by built-in functions."""
    return F.aggregate(steps, start, lambda at, s: F.sha2(F.when(s["h"].isNull(), at).when(s["left"], F.concat(s["h"], at)).otherwise(F.concat(at, s["h"])), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = manifest(leaves(docs, altered={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CELL = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_CELL.format(f if f != "n_chars" else "({n})") for f in FIELDS) + ")"
_CRC = """xor(list_reduce(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, b)), 4294967295), 4294967295)"""
_PARENT = "sha256(CASE WHEN s.h IS NULL THEN f.node WHEN f.i % 2 = 1 THEN s.h || f.node ELSE f.node || s.h END), f.proof || coalesce(s.h, '')"

SQL = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS key, {_LEAF.format(n="n_chars")} AS h,
         {_LEAF.format(n=f"CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS checked FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaf
), t(key, lev, i, h) AS (
  SELECT key, 0, pos, h FROM placed
  UNION ALL
  SELECT key, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM t) WHERE n > 1 GROUP BY key, lev, i // 2
), sub AS MATERIALIZED (
  SELECT key, max(lev) AS depth, arg_max(h, lev) AS h, row_number() OVER (ORDER BY key) - 1 AS pos FROM t GROUP BY key
), u(lev, i, h) AS (
  SELECT 0, pos, h FROM sub
  UNION ALL
  SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lev, i // 2
), top AS MATERIALIZED (
  SELECT max(lev) AS depth, arg_max(h, lev) AS h FROM u
), f(rid, key, lev, i, node, proof) AS (
  SELECT rid, key, 0, pos, checked, '' FROM placed
  UNION ALL
  SELECT f.rid, f.key, f.lev + 1, f.i // 2, {_PARENT}
  FROM f JOIN sub ON sub.key = f.key AND f.lev < sub.depth LEFT JOIN t s ON s.key = f.key AND s.lev = f.lev AND s.i = xor(f.i, 1)
), g(rid, lev, i, node, proof) AS (
  SELECT f.rid, 0, sub.pos, f.node, f.proof FROM f JOIN sub ON sub.key = f.key AND f.lev = sub.depth
  UNION ALL
  SELECT f.rid, f.lev + 1, f.i // 2, {_PARENT}
  FROM g f JOIN top ON f.lev < top.depth LEFT JOIN u s ON s.lev = f.lev AND s.i = xor(f.i, 1)
)
SELECT p.doc_id, p.h AS leaf, sub.h AS subroot, top.h AS root, sha256(g.proof) AS proof_sha256, g.node AS folded_root, g.node = top.h AS verified
FROM placed p JOIN sub ON sub.key = p.key JOIN top ON true JOIN g ON g.rid = p.rid AND g.lev = top.depth
"""
