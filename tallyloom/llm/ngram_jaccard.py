"""Exact Jaccard join of documents on word shingles, for links and their components.

Documents with the same set are one class, which has a number; its smallest id is its label.  Classes are compared
within tiles, and a pair of a tile goes on only if its sizes and places fit, then if bit counts of the two
signatures allow enough overlap, and is linked if an intersection of the sorted shingles says so.

*Signature*: shingles hashed to about as many bits as the set is large; a bit is set if an odd number
falls on it.  Where two signatures differ, at least one element is in one set only, so the count of
differing bits bounds the overlap from above.  A longer signature folds to the length of a shorter.

*Order*: shingles go from rare to common, then by hash.  How common one is comes from a table of fixed size
(``CELLS`` bits of the hash) in which every task counts all its texts; the sums do not depend on how rows are dealt
out.  Any order gives the same links, so a cell that several shingles share costs time only.

*Tiles*: a tile is a size band and a shingle.  A pair's tile is that of the band of its smaller set.  With sizes
``a <= b`` and the overlap ``o`` that a link needs, linked sets share one of the first ``a - o + 1`` of the smaller
and one of the first ``b - o + 1`` of the larger.  So a class stands as the *smaller* in its own band with as few
shingles as partners of its own size or more allow, and as the *larger* in its own band and, if sets of that band are not too
small for it, in the one below.  In a tile the smaller are compared with the larger, if what follows the shingle in
both leaves room for ``o``.  A passage that many different texts share stands behind what each has for
itself and makes no tile, until it is so much of a text that those sharing it are nearly linked.
1. Every class of a tile is compared with the tile's leader, the class with the fewest shingles before the tile's, which is
   that with the least of its own beside what the tile shares (in a tile of more than ``LIGHT``
   also with two more).  The links give components: copies and chains of near copies cost a few comparisons each, not one
   for every pair of a group.
2. In tiles that still hold several components, the classes of different components are compared.
Every linked pair is so compared, or joined by other links already.

Shingles are compared as 64-bit hashes.

Edge cases: a null or empty text, or one without words, has an empty set, links with nothing and is its
own component; fewer words than a shingle are one shingle of their own; very long texts cost time in proportion, and
batches are bounded in bytes; rows that repeat an id are
matched each by its own text, different ones too; a null id is nobody's smallest; an empty table gives none.  Extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import bit_map
from .shared import hidden, small_batches, stage, table
from .shingles import WordHashes, shingle_set, shingles, spaced_words

SHINGLE = 5
#: A pair is linked from this share of the union on: NUM / DEN.
NUM, DEN = 80, 100
#: A tile of more classes has three leaders.
LIGHT = 64
#: A shingle counted more often than this, above what chance gives a cell, comes late in the order; bits of a cell's number; cells of a
#: row in which counts are sent.
COMMON, CELLS, ROW_CELLS = 16, 24, 1 << 16
#: Bits of the map of tile keys that more than one row has.
KEY_BITS = 26
#: A band's sets differ in size by the factor of a link at most so many times over.
BAND_STEPS = 4


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bits, as int64 words: a power of two not less than the set's size, 64 at least."""
    bits = 64
    while bits < len(shingles):
        bits *= 2
    odd = (np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def band_edges(num: int = NUM, den: int = DEN) -> np.ndarray:
    """Least size of each band."""
    out = [1]
    while out[-1] < 1 << 31:
        edge = out[-1]
        for _ in range(BAND_STEPS):
            edge = max(edge + 1, edge * den // num)
        out.append(edge)
    return np.array(out)


def wanted(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """The least overlap that links sets of these sizes."""
    return -(-num * (a + b) // (num + den))


def spans(n: int, edges: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[int, int, int, int]:
    """A set's band; how many of its first shingles stand as the smaller and as the larger there; and as the larger in the band below."""
    own = int(np.searchsorted(edges, n, "right")) - 1
    least = -(-num * n // den)
    smaller = n - wanted(n, n, num, den) + 1
    larger = n - wanted(n, max(least, int(edges[own])), num, den) + 1
    below = n - wanted(n, least, num, den) + 1 if least < edges[own] else 0
    return own, smaller, larger, below


def tile_spans(n: int, edges: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each tile of a set: the band, the shingle's place, and a span: the set's size, the place
    and whether the set stands as the smaller too, in 31, 31 and 1 bits."""
    own, smaller, larger, below = spans(n, edges, num, den)
    place = np.r_[np.arange(larger), np.arange(below)]
    small = np.r_[np.arange(larger) < smaller, np.zeros(below, bool)]
    return np.repeat([own, own - 1], [larger, below]), place, (np.int64(n) << 32) | (place << 1) | small


def tile_keys(ordered: np.ndarray, edges: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The keys of a set's tiles, its shingles given in order."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    band, place, _ = tile_spans(len(ordered), edges, num, den)
    return ((ordered[place] + band.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def order_table(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """For each cell how common its shingles are: 0 up to ``COMMON`` texts, then a step for each factor of 4."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        cells = np.zeros(1 << CELLS, np.uint16)
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for text in b["text"]:
                w = known.of(spaced_words(text))
                found.append(shingles(w, min(size, len(w))) if len(w) else w)
            at, n = np.unique(np.concatenate(found) >> np.uint64(64 - CELLS), return_counts=True)
            at = at.astype(np.int64)
            cells[at] = np.minimum(cells[at].astype(np.int64) + n, 65_535)
        rows = [(k, zlib.compress(c, 1)) for k, c in enumerate(cells.reshape(-1, ROW_CELLS)) if c.any()]
        yield pd.DataFrame(rows, columns=["row", "packed"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b["row"], b["packed"]):
                held[k] = held.get(k, 0) + np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.int64)
        yield pd.DataFrame([(k, int(c.sum()), zlib.compress(c, 1)) for k, c in held.items()], columns=["row", "total", "packed"])

    sums = stage(docs.select("text").mapInPandas(tally, "row int, packed binary").repartition("row").mapInPandas(add, "row int, total bigint, packed binary"), "counts")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << CELLS)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for packed in b["packed"]:
                over = np.frombuffer(zlib.decompress(packed), np.int64) - mean - 4 * mean**0.5
                out.append(zlib.compress(np.where(over > COMMON, 1 + np.log2(np.maximum(over, 1) / max(COMMON, 1)).clip(0, 400) / 2, 0).astype(np.uint8)))
            yield pd.DataFrame({"row": b["row"], "grades": out})

    table = np.zeros(1 << CELLS, np.uint8)  # one byte a cell, however large the corpus
    for r in sums.mapInPandas(grade, "row int, grades binary").collect():
        table[r["row"] * ROW_CELLS : (r["row"] + 1) * ROW_CELLS] = np.frombuffer(zlib.decompress(r["grades"]), np.uint8)
    return table


def in_order(shingles: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """A sorted set from rare to common, equally common ones by hash."""
    grade = grades[(shingles >> np.uint64(64 - CELLS)).astype(np.int64)]
    return shingles[np.argsort(grade, kind="stable")] if grade.any() else shingles


def sign(docs: DataFrame, id_type: str, grades: np.ndarray, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, text_hash, n, digest (of the set), keys (of its tiles), bits of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(grades, 1))  # 16 MB at most

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        grades = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        edges = band_edges(num, den)

        def one(text: str | None) -> tuple:
            s = shingle_set(known.of(spaced_words(text)), size)
            return len(s), xxhash.xxh3_128_digest(s.tobytes()), tile_keys(in_order(s, grades), edges, num, den), signature(s)

        for b in batches:
            done: dict[int, tuple[str | None, tuple]] = {}
            rows = []
            for text_hash, text in zip(b["text_hash"], b["text"]):
                held = done.get(text_hash)
                if held is None or held[0] != text:
                    held = done[text_hash] = (text, one(text))
                rows.append(held[1])
            n, digest, keys, bits = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n": n, "digest": digest, "keys": keys, "bits": bits})

    return docs.mapInPandas(per_batch, f"doc_id {id_type}, text_hash bigint, n int, digest binary, keys array<bigint>, bits array<bigint>")


def shared_keys(signed: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """``signed`` with the keys that two rows at least may have, and their spans.  Most keys stand on one row only; a bit
    map of fixed size drops them before anything is joined.  A full one lets more through and changes no result."""
    short = signed.select(F.explode("keys").alias("key")).select(F.shiftrightunsigned("key", 24).alias("key"))
    marked = signed.sparkSession.sparkContext.broadcast(bit_map(short.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.shiftleft("key", 24).alias("key")), KEY_BITS))

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = band_edges(num, den)
        for b in batches:
            keys, spans = [], []
            for n, own in zip(b["n"], b["keys"]):
                hits = marked.value.hits(np.asarray(own, np.int64))
                keys.append(np.asarray(own, np.int64)[hits])
                spans.append(tile_spans(n, edges, num, den)[2][hits] if len(hits) else hits)
            yield b.assign(keys=pd.Series(keys, index=b.index, dtype=object), spans=pd.Series(spans, index=b.index, dtype=object))

    return signed.mapInPandas(some, T.StructType([*signed.schema.fields, T.StructField("spans", T.ArrayType(T.LongType()))]))


def fits(num: int = NUM, den: int = DEN) -> Column:
    """May the classes of columns n_a, bits_a and n_b, bits_b be linked, by their sizes and bit counts?"""
    shorter = "least(size(bits_a), size(bits_b))"

    def folded(bits: str) -> str:
        return f"if(size({bits}) > {shorter}, transform(sequence(0, {shorter} - 1), i -> {bits}[i] ^ {bits}[i + {shorter}]), {bits})"

    apart = f"aggregate(zip_with({folded('bits_a')}, {folded('bits_b')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    both = "bigint(n_a + n_b)"
    # overlap is at most (both - apart) / 2, and a link needs den * overlap >= num * (both - overlap)
    return F.expr(f"case when bigint(least(n_a, n_b)) * {den} < bigint(greatest(n_a, n_b)) * {num} then false else ({both} - {apart}) * {num + den} >= {both} * {2 * num} end")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cls, items (the sorted shingles, packed) for the (cls, label, text_hash) wanted.  A bit map drops other documents before the shuffle."""
    marked = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select("text_hash")))

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            b = b.iloc[marked.value.hits(b["text_hash"].to_numpy(np.int64))]
            items = [shingle_set(known.of(spaced_words(t)), size).tobytes() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "items": items})

    found = docs.mapInPandas(some, T.StructType([docs.schema["doc_id"], docs.schema["text_hash"], T.StructField("items", T.BinaryType())]))
    return found.join(F.broadcast(wanted) if _few(wanted) else wanted, ["doc_id", "text_hash"]).dropDuplicates(["cls"]).select("cls", "items")


def _few(df: DataFrame, most: int = 10_000) -> bool:
    """Has a written table at most so many rows?  They are then safe to broadcast."""
    return df.count() <= most


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    likely = stage(pairs.join(side("a"), "a").join(side("b"), "b").where(fits(num, den)).select("a", "b"), "likely")
    ends = stage(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", F.col("label").alias("doc_id"), "text_hash"), "cls"), "ends")
    if ends.isEmpty():
        return likely
    sets = stage(_sets(docs, ends, size), "sets")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["items_a"], b["items_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    # first by b, which repeats little; the join by a, where a leader's rows are many, is one that can be split
    whole = likely.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b")), "b").join(sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a")), "a")
    return stage(whole.select("a", "b", "items_a", "items_b").mapInPandas(compare, "a bigint, b bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every end of the edges (a, b): large and small stars in turn."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct()
        e = stage(small, "edges")
        if (after := state(e)) == before:
            break
        before = after
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root, which is the class itself where it has no link."""
    return members.join(roots.withColumnsRenamed({"node": "cls", "root": "__root"}), "cls", "left").withColumn("root", F.coalesce("__root", "cls")).drop("__root")


def places_fit(num: int = NUM, den: int = DEN) -> str:
    """May these two of a tile be linked, by their sizes, if its shingle is the first, in order, that they share?  What
    follows must then hold the rest of the overlap."""
    n = lambda x: f"shiftright(span_{x}, 32)"
    rest = lambda x: f"({n(x)} - (shiftright(span_{x}, 1) & 2147483647))"
    return f"least({n('a')}, {n('b')}) * {den} >= greatest({n('a')}, {n('b')}) * {num} and least({rest('a')}, {rest('b')}) * {num + den} >= {num} * ({n('a')} + {n('b')})"


def _open_pairs(tiles: DataFrame, roots: DataFrame, fit: str) -> DataFrame:
    """Pairs of different components within ``tiles`` (key, cls, span), the smaller with the larger, that ``fit``."""
    rooted = stage(_rooted(tiles, roots), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    open_ = stage(rooted.join(mixed, "key"), "open")
    side = lambda x: open_.select("key", F.col("cls").alias(x), F.col("root").alias(f"root_{x}"), F.col("span").alias(f"span_{x}"))
    once = "(shiftright(span_a, 32) < shiftright(span_b, 32) or shiftright(span_a, 32) = shiftright(span_b, 32) and a < b)"
    return side("a").where("span_a & 1 = 1").join(side("b"), "key").where(f"{once} and root_a != root_b and {fit}").select("a", "b").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, num: int = NUM, den: int = DEN, light: int = LIGHT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row."""
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    signed = stage(sign(narrow, id_type, order_table(narrow, size), size, num, den), "signed")

    # classes of equal sets
    first = stage(signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select("digest", F.monotonically_increasing_id().alias("cls"), F.col("s.doc_id").alias("label"), F.col("s.text_hash").alias("text_hash")), "first")
    members = shared_keys(signed, num, den).join(first.withColumnsRenamed({"digest": "d", "text_hash": "h"}), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("label")) & (F.col("text_hash") == F.col("h")))
    classes = stage(members.select("cls", "label", "text_hash", "n", "bits", "keys", "spans").dropDuplicates(["cls"]), "classes")
    rows = classes.select("cls", F.explode(F.arrays_zip("keys", "spans")).alias("t")).select(F.col("t.keys").alias("key"), "cls", F.col("t.spans").alias("span"))

    # tiles of two classes at least, one of them as the smaller; with their leaders
    spread = lambda seed: F.min_by("cls", F.xxhash64("cls", F.lit(seed)))
    place = F.shiftright("span", 1).bitwiseAND(2**31 - 1)
    tiles = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("span").bitwiseAND(1)).alias("small"), F.min(place).alias("least")).where("size > 1 and small = 1")
    shared = stage(rows.join(tiles.select("key", "size", "least"), "key"), "tiles")
    heavy = shared.where(F.col("size") > light).groupBy("key").agg(F.array_distinct(F.array(spread(1), spread(2))).alias("more")).select("key", F.explode("more").alias("leader"))
    leaders = shared.where(place == F.col("least")).groupBy("key").agg(F.min("cls").alias("leader")).union(heavy).distinct()
    at = shared.select("key", F.col("cls").alias("leader"), F.col("span").alias("span_a"))
    led = stage(leaders.join(at, ["key", "leader"]), "leaders")
    stars = shared.withColumnRenamed("span", "span_b").join(led, "key").where(f"cls != leader and {places_fit(num, den)}")
    stars = stars.select(F.least("leader", "cls").alias("a"), F.greatest("leader", "cls").alias("b")).distinct()
    roots = components(_linked(stars, narrow, classes, size, num, den))

    links = _linked(_open_pairs(shared.select("key", "cls", "span"), roots, places_fit(num, den)), narrow, classes, size, num, den)
    roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(links))

    # a component's id is the smallest label of its classes
    whole = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    labelled = whole.join(first.select(F.col("cls").alias("node"), "label"), "node")
    ids = labelled.join(labelled.groupBy("root").agg(F.min("label").alias("least")), "root").select(F.col("node").alias("cls"), "least")
    named = first.select("digest", "cls", "label").join(ids, "cls", "left").select(F.col("digest").alias("__d"), F.coalesce("least", "label").alias("least"))
    out = signed.select("doc_id", "text_hash", "n", "digest").join(named, F.col("digest") == F.col("__d"), "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, once."""
    found = join(docs, id_col, text_col)
    id_, h, n = hidden(docs, "id", "h", "n")
    kept = found.where("doc_id is null or doc_id = component_id").groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(h)).agg(F.count("*").alias(n))
    kept = stage(kept, "kept")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = docs.join(kept, F.col(id_col).eqNullSafe(F.col(id_)) & (text_hash == F.col(h)))
    single = (F.col(n) == 1) | F.col(id_).isNull()
    return joined.where(single).select(*docs.columns).union(joined.where(~single).dropDuplicates([id_, h]).select(*docs.columns))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[k : k + {SHINGLE} - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) AS k FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
)
SELECT node AS doc_id, coalesce(max(n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node
"""
