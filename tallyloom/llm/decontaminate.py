"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (the whole item, if it has fewer).  Its shingles
are runs of five words (fewer in shorter windows).  All of a window must occur, so of its shingles put
in order of rarity over the whole corpus the join needs the first alone: the prefix has length one.

1. One pass over the corpus counts the benchmark's shingles; a shingle that never occurs ends its
   windows there.  A bit map of fixed size, which all benchmark shingles have marked, lets tasks drop
   the other shingles before they are shuffled; a full map would only drop fewer.
2. Every window keeps its rarest shingle with the place it has in the window.
3. A second pass lists where those shingles stand in the documents, with the words around them.
4. The two are joined on the shingle.  Length and place bound the match: a window that would begin
   before a document's first word or end after its last is dropped.  What is left is compared word
   by word over the whole window.

Edge cases: a null or empty text, or one without words, has no words and no hits; an item without
words has no window; repeated rows have the same result each; equal windows of several items are
compared once and count for each item; an empty benchmark leaves every document clean.  Extra columns
of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import BitMap, bit_map
from .shared import hidden, small_batches, stage, table
from .shingles import WordHashes, plain_words, shingles

WINDOW, SHINGLE = 13, 5


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row per distinct window and place: window (its words), n, items, shingle, place."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            rows = []
            for item, text in zip(b["item"], b["text"]):
                words = plain_words(text)
                n = min(WINDOW, len(words))
                if not n:
                    continue
                size = min(SHINGLE, n)
                cut_ = shingles(known.of(words), size).view(np.int64)
                for at in range(len(words) - n + 1):
                    rows.append((item, b" ".join(words[at : at + n]).decode("utf-8", "surrogatepass"), n, size, cut_[at : at + n - size + 1].tolist()))
            yield pd.DataFrame(rows, columns=["item", "window", "n", "size", "shingles"])

    kind = dict(benchmark.dtypes)[item_col]
    cut_windows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).mapInPandas(cut, f"item {kind}, window string, n int, size int, shingles array<bigint>")
    distinct = cut_windows.groupBy("window").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))
    return distinct.select("window", "n", "size", "items", F.posexplode("shingles").alias("place", "shingle"))


def _count(docs: DataFrame, sizes: list[int], marked: BitMap) -> DataFrame:
    """shingle, n: how often each marked shingle stands in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(marked)  # one MB

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for text in b["text"]:
                hashes = known.of(plain_words(text))
                for size in sizes:
                    s = shingles(hashes, size)
                    found.append(s[shared.value.hits(s)])
            s, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"shingle": s.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("frequency"))


def _scan(docs: DataFrame, sizes: list[int], marked: BitMap, id_type: str) -> DataFrame:
    """doc_id, text_hash, n_words of every row, with the marked shingles' places and surroundings."""
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            lengths, found = [], []
            for text in b["text"]:
                words = plain_words(text)
                hashes = known.of(words)
                hits = []
                for size in sizes:
                    s = shingles(hashes, size)
                    for at in shared.value.hits(s):
                        first = max(0, at - (WINDOW - size))
                        around = b" ".join(words[first : at + WINDOW]).decode("utf-8", "surrogatepass")
                        hits.append({"size": size, "shingle": int(s[at].view(np.int64)), "at": int(at), "first": int(first), "around": around})
                lengths.append(len(words))
                found.append(hits)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n_words": lengths, "hits": found})

    schema = f"doc_id {id_type}, text_hash bigint, n_words bigint, hits array<struct<size:int,shingle:bigint,at:int,first:int,around:string>>"
    return docs.mapInPandas(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    cut = stage(windows(benchmark, item_col, item_text_col), "windows")
    sizes = sorted(r["size"] for r in cut.select("size").distinct().collect())  # five numbers at most

    # rarity over the whole corpus; the first shingle in that order is the window's prefix
    rarity = _count(narrow, sizes, bit_map(cut.select("shingle").distinct()))
    prefix = (
        cut.join(rarity, "shingle", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), F.col("place"), F.col("shingle"))).alias("p"), F.first("n").alias("n"), F.first("size").alias("size"), F.first("items").alias("items"))
        .where("p.frequency > 0")
        .select("window", "n", "size", "items", "p.place", "p.shingle")
    )
    prefix = stage(prefix, "prefixes")

    scanned = stage(_scan(narrow, sizes, bit_map(prefix.select("shingle").distinct()), id_type), "hits")
    hit = scanned.where("size(hits) > 0").select("doc_id", "text_hash", "n_words", F.explode("hits").alias("h")).select("doc_id", "text_hash", "n_words", "h.*")
    words = F.split("around", " ")
    begin = F.col("at") - F.col("place")
    occurring = (
        hit.join(prefix, ["shingle", "size"])
        .withColumn("begin", begin)
        .where((F.col("begin") >= 0) & (F.col("begin") + F.col("n") <= F.col("n_words")))  # bounds of place and length
        .where(F.array_join(F.slice(words, F.col("begin") - F.col("first") + 1, F.col("n")), " ") == F.col("window"))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("begin", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    # words in the union of the spans, which stand in order of their begin
    covered = F.expr("""aggregate(spans, named_struct('end', 0L, 'total', 0L),
        (a, s) -> named_struct('end', greatest(a.end, bigint(s.begin + s.n)),
                               'total', a.total + greatest(0L, s.begin + s.n - greatest(a.end, bigint(s.begin)))), a -> a.total)""")
    occurring = occurring.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), covered.alias("hit"), F.array_sort(F.expr("transform(items, x -> string(x))")).alias("__items"))
    joined = scanned.select("doc_id", "text_hash", "n_words").join(occurring, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__h")), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("bigint")
    items = F.coalesce("__items", F.array().cast("array<string>"))
    return joined.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones."""
    id_, h = hidden(docs, "id", "h")
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(h)).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(id_)) & (text_hash == F.col(h)), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), o AS (
  SELECT doc_id, item_id, dw.n, k FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
