"""A lossless codec for tables of identifiers: sorted dictionaries, lists of codes, positions in fixed lists, and bit masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.staging import staged
from ..registry import query
from ..sources.tables import table


def place(c: Column, fixed: Sequence[str]) -> Column:
    """Where a value stands in a fixed list, from 0; one that doesn't raises, null stays."""
    at = F.array_position(F.array(*map(F.lit, fixed)), c) - 1
    return F.when(at < 0, F.raise_error(F.concat(F.lit("no such value: "), c)).cast("bigint")).otherwise(at).cast("int")


def value_at(c: Column, fixed: Sequence[str]) -> Column:
    return F.when(c.isNotNull(), F.element_at(F.array(*map(F.lit, fixed)), c + 1))


def mask(c: Column, fixed: Sequence[str]) -> Column:
    """The values of an array as bits, by their places in a fixed list of 62 at most; one that isn't there raises."""
    assert len(fixed) <= 62
    bits = F.transform(c, lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(x, fixed)))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def unmasked(c: Column, fixed: Sequence[str]) -> Column:
    """The values of a mask, in the order of the list."""
    values = F.array_compact(F.array(*[F.when(F.getbit(c, F.lit(i)) == 1, F.lit(v)) for i, v in enumerate(fixed)]))
    return F.when(c.isNotNull(), values)


class Codec:
    """``dictionaries`` maps a name to the columns, strings or arrays of strings, that share it.

    ``compact`` gives rows whose columns hold codes, ``expand`` the values again.  A dictionary holds each value once, and codes are dense in
    its order; where values are few a join sends it to every task, else both sides are sorted, as Spark finds from its size.  Null cells, null
    elements and empty lists are kept; ``id`` is unique."""

    def __init__(self, rows: DataFrame, dictionaries: Mapping[str, Sequence[str]], id_: str):
        self.columns = {c: name for name, columns in dictionaries.items() for c in columns}
        self.id, self.lists = id_, {c for c, t in rows.dtypes if t.startswith("array")}
        self.order = rows.columns

        def values(column: str) -> DataFrame:
            return rows.select((F.explode(column) if column in self.lists else F.col(column)).alias("value"))

        self.dictionaries = {}
        for name, columns in dictionaries.items():
            distinct = reduce(DataFrame.union, map(values, columns)).where("value is not null").distinct()
            self.dictionaries[name] = staged(numbered(distinct, "value"), f"dictionary-{name}")
        self.compact = staged(self._through(rows, "value", "code"), "compact")

    def _through(self, rows: DataFrame, key: str, to: str) -> DataFrame:
        for column, name in self.columns.items():
            words = self.dictionaries[name].select(F.col(key).alias("__key"), F.col(to).alias("__to"))
            if column in self.lists:
                one = rows.select(self.id, F.posexplode(column).alias("__at", "__key")).join(words, "__key", "left")
                whole = one.groupBy(self.id).agg(F.array_sort(F.collect_list(F.struct("__at", "__to")))["__to"].alias("__list"))
                empty = F.when(F.col(column).isNotNull(), F.array().cast(dict(whole.dtypes)["__list"]))
                rows = rows.join(whole, self.id, "left").withColumn(column, F.coalesce("__list", empty)).drop("__list")
            else:
                rows = rows.join(words, rows[column] == words["__key"], "left").withColumn(column, F.col("__to")).drop("__key", "__to")
        return rows.select(*self.order)

    def expand(self) -> DataFrame:
        return self._through(self.compact, "code", "value")


#: The fixed lists of the query's columns.
STATUS, FLAGS = ("F", "O", "P"), ("A", "N", "R")


def order_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a decision: the parts that it is about, its outcome, its status, and its lines' flags.  A status or a flag beyond the fixed lists is none."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("part_"), "l_partkey"))).alias("subjects"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag").isin(*FLAGS), F.col("l_returnflag")))).alias("flags"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision"), F.col("o_orderpriority").alias("outcome"), F.concat(F.lit("part_"), "o_custkey").alias("main"), F.when(F.col("o_orderstatus").isin(*STATUS), F.col("o_orderstatus")).alias("o_orderstatus"))
    return o.join(li, F.col("decision") == F.col("l_orderkey"), "left").select("decision", "outcome", "main", "subjects", "o_orderstatus", "flags")


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT 'part_' || l_partkey)) AS subjects, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1),
p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT 'part_' || l_partkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION SELECT 'part_' || o_custkey FROM orders)),
u AS (SELECT l_orderkey, string_agg(code, ',' ORDER BY x) AS subjects FROM (SELECT l_orderkey, unnest(subjects) AS x FROM s) JOIN p ON v = x GROUP BY 1),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
SELECT o_orderkey AS decision, o.code AS outcome, p.code AS main, u.subjects, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS status,
  CAST(list_sum(list_transform(flags, lambda x: CASE x WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END)) AS BIGINT) AS flags, true AS same
FROM orders JOIN o ON o.v = o_orderpriority JOIN p ON p.v = 'part_' || o_custkey LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN u ON u.l_orderkey = o_orderkey""")
def decision_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in codes, and whether the codes give back each order as it was."""
    rows = staged(order_decisions(spark, sf_dir), "decisions")
    coded = rows.withColumn("o_orderstatus", place(F.col("o_orderstatus"), STATUS)).withColumn("flags", mask(F.col("flags"), FLAGS))
    codec = Codec(coded, {"parts": ["main", "subjects"], "outcomes": ["outcome"]}, "decision")
    back = codec.expand().withColumn("o_orderstatus", value_at(F.col("o_orderstatus"), STATUS)).withColumn("flags", unmasked(F.col("flags"), FLAGS))
    both = back.select("decision", F.struct(*rows.columns).alias("new")).join(rows.select("decision", F.struct(*rows.columns).alias("old")), "decision")
    same = both.select("decision", F.col("new").eqNullSafe(F.col("old")).alias("same"))
    c = codec.compact
    return c.join(same, "decision").select("decision", "outcome", "main", F.array_join("subjects", ",").alias("subjects"), F.col("o_orderstatus").alias("status"), "flags", "same")
