"""Coverage of source clauses by output tokens, recovery batches, chunking and day context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import table


def required_clauses(n: Column, least_tokens: Column) -> Column:
    """All clauses of a line that has several and a short one, else half of them, rounded up."""
    return F.when((n >= 2) & (least_tokens <= 2), n).otherwise(F.ceil(n / 2))


_TOKENS = "list_filter(string_split(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+'))"


@query(f"""WITH b AS (SELECT DISTINCT unnest({_TOKENS.format("text")}) AS tok FROM benchmark),
c AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
k AS (SELECT doc_id, line, generate_subscripts(string_split_regex(t, '[,;]'), 1) AS nth, unnest(string_split_regex(t, '[,;]')) AS clause FROM c),
x AS (SELECT doc_id, line, nth, unnest({_TOKENS.format("clause")}) AS tok FROM k),
p AS (SELECT doc_id, line, nth, count(*) AS n, count(b.tok) AS hit FROM x LEFT JOIN b ON b.tok = x.tok GROUP BY ALL),
l AS (SELECT doc_id, line, count(*) AS n, min(n) AS least, count(*) FILTER (2 * hit >= n) AS covered FROM p GROUP BY ALL)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (covered >= CASE WHEN n >= 2 AND least <= 2 THEN n ELSE ceil(n / 2) END) AS n_covered, CAST(sum(n) AS BIGINT) AS n_clauses FROM l GROUP BY doc_id""")
def coverage_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document whose clauses are covered by the items' tokens, a clause by half of its own."""
    wanted = lambda c: F.filter(T.tokens(F.col(c)), lambda x: (F.length(x) >= 4) & ~x.rlike("^[0-9]+$"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(wanted("text")).alias("tok")).distinct().withColumn("known", F.lit(1))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    parts = lines.select("doc_id", "line", F.posexplode(F.split("t", "[,;]")).alias("at", "clause")).select("doc_id", "line", "at", F.explode(wanted("clause")).alias("tok"))
    clause = parts.join(known, "tok", "left").groupBy("doc_id", "line", "at").agg(F.count("*").alias("n"), F.count("known").alias("hit"))
    line = clause.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("n").alias("least"), F.count_if(F.expr("2 * hit >= n")).alias("covered"))
    return line.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("covered") >= required_clauses(F.col("n"), F.col("least"))).alias("n_covered"), F.sum("n").alias("n_clauses"))


#: Most pieces of a text.
MOST_PIECES = 80


def chunks(text: str, size: int = 4000, overlap: int = 800, most: int = MOST_PIECES) -> list[tuple[int, int]]:
    """(start, end) of overlapping pieces, white space at their ends left out.

    A piece ends before the last blank line, or else the last line break, of the next ``size`` characters, if that lies
    beyond 55 % of them; else after ``size``.  The next begins a fifth of the piece earlier, ``overlap`` at most.
    A text of more than ``most`` pieces is an error, as the rest may not be lost.  An empty text has none."""

    def bare(a: int, z: int) -> tuple[int, int]:
        held = text[a:z]
        return a + len(held) - len(held.lstrip()), a + len(held.rstrip())

    at, end = bare(0, len(text))
    out: list[tuple[int, int]] = []
    while end - at > size:
        marks = [k - at for mark in ("\n\n", "\n") if (k := text.rfind(mark, at, at + size)) - at > size * 0.55]
        length = marks[0] if marks else size
        piece = bare(at, at + length)
        if piece[0] < piece[1]:
            out.append(piece)
        at = bare(at + length - min(overlap, length // 5), end)[0]
        if at >= end:
            return out
        if len(out) > most:
            raise ValueError(f"more than {most} pieces")
    return [*out, (at, end)] if at < end else out


@query()
def chunk_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document: each depends on where the one before ended, so a text is a small fold."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, e) for i, t in zip(b["doc_id"], b["text"]) for k, (s, e) in enumerate(chunks(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "end"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(cut, "doc_id long, piece int, start int, end int")


@query("""WITH u AS (SELECT lang, source, sha256(text) AS digest, length(text) AS n FROM documents),
b AS (SELECT lang, source, floor((row_number() OVER (PARTITION BY lang, source ORDER BY digest, n) - 1) / 8) AS batch, digest, n FROM u)
SELECT lang, source, CAST(batch AS BIGINT) AS batch, count(*) AS n_spans, CAST(sum(n) AS BIGINT) AS n_chars, sha256(string_agg(digest, ',' ORDER BY digest)) AS batch_hash FROM b GROUP BY ALL""")
def shadow_recovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncovered spans in deterministic batches of eight by source and section, each with its hash.
    Copies are counted before they are numbered, and a section is numbered by heads of digests, so none is one task's."""
    texts = table(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
    u = texts.groupBy("lang", "source", "digest", "n").agg(F.count("*").alias("copies")).withColumn("head", F.coalesce(F.substring("digest", 1, 3), F.lit("~")))
    # a span's place in its section: spans of smaller heads, of which there are some thousand at most, and smaller ones of its own head
    heads = u.groupBy("lang", "source", "head").agg(F.sum("copies").alias("in_head"))
    heads = heads.withColumn("before", F.sum("in_head").over(W.partitionBy("lang", "source").orderBy("head")) - F.col("in_head"))
    of_head = F.sum("copies").over(W.partitionBy("lang", "source", "head").orderBy("digest", "n").rowsBetween(W.unboundedPreceding, 0)) - F.col("copies")
    u, h = u.withColumn("within", of_head).alias("u"), heads.alias("h")
    placed = u.join(h, F.expr("u.lang <=> h.lang and u.source <=> h.source and u.head = h.head")).select("u.lang", "u.source", "digest", "n", "copies", (F.col("before") + F.col("within")).alias("at"))
    b = placed.withColumn("batch", F.explode(F.sequence(F.floor(F.col("at") / 8), F.floor((F.col("at") + F.col("copies") - 1) / 8))))
    b = b.withColumn("k", (F.least(F.col("at") + F.col("copies"), (F.col("batch") + 1) * 8) - F.greatest("at", F.col("batch") * 8)).cast("int"))
    digests = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("digest", "k")))), lambda x: F.array_repeat(x["digest"], x["k"])))
    return b.groupBy("lang", "source", "batch").agg(F.sum("k").alias("n_spans"), F.sum(F.col("n") * F.col("k")).cast("bigint").alias("n_chars"), F.sha2(F.array_join(digests, ","), 256).alias("batch_hash"))


@query("""SELECT o_orderkey, count(*) OVER w AS n_day, count(*) FILTER (o_orderstatus = 'F') OVER w AS n_fixed FROM orders WINDOW w AS (PARTITION BY o_custkey, CAST(o_orderdate AS DATE))""")
def day_context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its day's total and fixed count, joined back from counts that are combined before the shuffle."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    days = o.groupBy("o_custkey", "day").agg(F.count("*").alias("n_day"), F.count_if(F.col("o_orderstatus") == "F").alias("n_fixed"))
    return o.join(days, ["o_custkey", "day"]).select("o_orderkey", "n_day", "n_fixed")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey) AS nth FROM lineitem)
SELECT l_orderkey, count(*) AS n, CAST(count(*) FILTER (before + l_quantity <= 100) AS BIGINT) AS n_preserved FROM (
  SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) GROUP BY l_orderkey""")
def evidence_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of an order's first items fit a running budget."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.sum("l_quantity").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    return li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("upto") <= 100).alias("n_preserved"))


@query()
def recovery_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order admitted in order to a budget: one that does not fit is passed over and counted, and a
    later, smaller one may still fit.  No window says that; it is a fold over sorted lines."""

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, left, admitted, dropped = None, 120.0, 0, 0
        for b in batches:
            done = []
            for key, quantity in zip(b["order"], b["quantity"]):
                if key != order:
                    if order is not None:
                        done.append((order, admitted, dropped))
                    order, left, admitted, dropped = key, 120.0, 0, 0
                if admitted < 5 and quantity <= left:
                    left, admitted = left - quantity, admitted + 1
                else:
                    dropped += 1
            yield pd.DataFrame(done, columns=["order", "n_admitted", "n_dropped"])
        if order is not None:
            yield pd.DataFrame([(order, admitted, dropped)], columns=["order", "n_admitted", "n_dropped"])

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    total = li.groupBy("order").agg(F.count("*").alias("n"), F.sum("quantity").alias("q"))
    fits = total.where("n <= 5 and q <= 120").select("order", F.col("n").cast("int").alias("n_admitted"), F.lit(0).alias("n_dropped"))
    # only orders that may overflow are folded; sorted, so that a task holds one order's state at a time
    over = li.join(total.where("n > 5 or q > 120").select("order"), "order").repartition("order").sortWithinPartitions("order", "line", "quantity")
    return fits.union(over.mapInPandas(admit, "order long, n_admitted int, n_dropped int"))
