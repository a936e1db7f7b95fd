"""Secret scan with corpus-wide ownership, in DataFrame functions alone.

Three kinds of span are found by pattern (``BASE``).  A fourth, ``owned``, comes from the corpus: long
mixed tokens are candidates, and the hash of every candidate and of every base value is counted by the
distinct repositories and distinct owners that hold it.  A value that more than ``max_owners`` owners
or ``max_repositories`` repositories hold is a copied example; one that fewer hold looks live.
Candidates that look live, and overlap no base span, are added as spans; base spans always stay.

Positions are code points, from the lengths of the pieces between matches.  A document's spans stay in
its row; only rows with spans are exploded, and counts are combined before they are shuffled, so a
value that a third of all documents hold is a count, not a group.

Edge cases: a null text is an empty one and has no spans; a null repository or owner is one more
repository or owner; rows repeated in every column have the same spans each; an empty table gives an
empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hidden, stage, table

#: Kinds in order, with pattern, group of the value, and least length of that group.  Fixed values.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a maximal run of fewer than 32 holds no run of 32: the short ones need not be listed
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Candidates: maximal runs that hold an upper-case letter, a lower-case letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
MAX_OWNERS, MAX_REPOSITORIES = 2, 3
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """An array, not empty, cut into some sqrt(n) arrays of some sqrt(n) items, in order."""
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    numbers = F.sequence(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1)
    return F.transform(numbers, lambda k: F.slice(items, k * size + 1, size))


def _placed(found: Column, rank: int, kind: str, least: int) -> Column:
    """Spans of pieces (gap before, length, value) that follow each other; those of a short value go.
    Places are summed up by block, and appended to within a block only, so n matches cost n to the power 1.5 at most."""
    length = lambda x: x["g"] + x["l"]
    span = lambda at, x: F.struct((at + x["g"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + length(x)).alias("end"), x["v"].alias("value"))
    within = lambda block, at: F.aggregate(
        block,
        F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span(acc["at"], x)))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    total = lambda block: F.aggregate(block, F.lit(0), lambda at, x: at + length(x))
    before = lambda sums, i: F.aggregate(F.slice(sums, 1, i), F.lit(0), lambda at, n: at + n)
    return _bind(_blocks(found), lambda blocks: _bind(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda block, i: within(block, before(sums, i))))))


def _spans(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """The pattern's leftmost matches as an array of structs; those of a short value are dropped after matching."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None)
    pieces = F.arrays_zip(match.alias("m"), F.split(text, pattern, -1).alias("gap"), *([value.alias("v")] if group else []))
    found = F.transform(pieces, lambda x: F.struct(F.length(x["gap"]).alias("g"), F.length(x["m"]).alias("l"), (x["v"] if group else x["m"]).alias("v")))
    found = F.filter(found, lambda x: x["l"].isNotNull())
    return F.when(text.rlike(pattern), _bind(found, lambda f: _placed(f, rank, kind, least))).otherwise(F.array().cast(SPAN))


def _clear_of(items: Column, base: Column) -> Column:
    """Those of ``items`` that overlap no span of ``base``; a block of them is compared with the spans in its stretch."""
    overlap = lambda b, x: (b["start"] < x["end"]) & (x["start"] < b["end"])
    stretch = lambda block: F.struct(block[0]["start"].alias("start"), F.element_at(block, -1)["end"].alias("end"))
    clear = lambda block: _bind(stretch(block), lambda s: _bind(F.filter(base, lambda b: overlap(b, s)), lambda near: F.filter(block, lambda x: ~F.exists(near, lambda b: overlap(b, x)))))
    return F.when((F.size(items) == 0) | (F.size(base) == 0), items).otherwise(F.flatten(F.transform(_blocks(items), clear)))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base`` (spans of the three kinds, by start and kind) and ``extra`` (candidates clear of them), in place of such as are there."""
    docs = docs.drop("base", "extra")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    *kinds, more = hidden(docs, "assign", "access", "hex", "more")
    out = docs
    for name, (rank, (kind, pattern, group, least)) in zip(kinds, enumerate(BASE)):
        out = out.withColumn(name, _spans(text, pattern, group, least, rank, kind))
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
    out = out.withColumn("base", F.array_sort(F.concat(*kinds))).withColumn(more, F.filter(_spans(text, CANDIDATE, 0, 20, len(BASE), "owned"), mixed))
    return out.withColumn("extra", _clear_of(F.col(more), F.col("base"))).drop(*kinds, more)


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """value_hash -> n_repositories, n_owners, live; one narrow shuffle for each distinct count."""
    held = (
        found.select(F.explode(F.concat("base", "extra")).alias("s"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("o"))
        .select(F.sha2("s.value", 256).alias("value_hash"), "r", "o")
        .groupBy("value_hash", "r", "o")
        .agg(F.lit(1).alias("x"))
    )
    repositories = held.groupBy("value_hash", "r").agg(F.lit(1).alias("x")).groupBy("value_hash").agg(F.count("*").alias("n_repositories"))
    owners = held.groupBy("value_hash", "o").agg(F.lit(1).alias("x")).groupBy("value_hash").agg(F.count("*").alias("n_owners"))
    live = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES)
    return repositories.join(owners, "value_hash").withColumn("live", live)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str = "source", owner: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, text_hash, base, spans (base and added), live (spans whose value looks live)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(repository).alias("__r"), F.col(owner).alias("__o"))
    found = stage(find(narrow).select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), "base", "extra", "__r", "__o"), "secret-spans")
    some = found.where("size(base) + size(extra) > 0")
    judged = (
        some.select("doc_id", "text_hash", "base", "extra").distinct()
        .withColumn("s", F.explode(F.concat("base", "extra")))
        .select("doc_id", "text_hash", "s", F.sha2("s.value", 256).alias("value_hash"))
        .join(ownership(some, "__r", "__o"), "value_hash")
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.when((F.col("s.kind") != "owned") | F.col("live"), F.col("s")))).alias("spans"), F.sort_array(F.collect_list(F.when(F.col("live"), F.col("s")))).alias("live"))
        .withColumnsRenamed({"doc_id": "__id", "text_hash": "__h"})
    )
    none = F.array().cast(SPAN)
    joined = found.join(judged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__h")), "left")
    return joined.select("doc_id", "text_hash", "base", F.coalesce("spans", none).alias("spans"), F.coalesce("live", none).alias("live"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, blocks: Column, live: Column) -> Column:
    """``text`` with the spans of ``blocks``, sorted by start, replaced.  A block's part of the text is cut out once, and its
    pieces appended to within the block only."""
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    ends = F.transform(blocks, lambda block: F.array_max(F.transform(block, lambda s: s["end"])))

    def pieces(part: Column, block: Column, lo: Column, near: Column) -> Column:
        mark = lambda s: F.when(F.exists(near, lambda x: overlap(x, s)), "<secret>").otherwise("<example-secret>")
        two = lambda at, s: F.array(F.substring(part, at - lo + 1, s["start"] - at), mark(s))
        return F.aggregate(
            block,
            F.struct(lo.alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], two(acc["at"], s))).alias("out")),
            lambda acc: acc["out"],
        )

    def of_block(block: Column, lo: Column, hi: Column) -> Column:
        stretch = F.struct(block[0]["start"].alias("start"), hi.alias("end"))
        return _bind(F.filter(live, lambda x: overlap(x, stretch)), lambda near: _bind(F.substring(text, lo + 1, hi - lo), lambda part: pieces(part, block, lo, near)))

    def of_all(ends: Column) -> Column:
        before = lambda i: F.coalesce(F.array_max(F.slice(ends, 1, i)), F.lit(0))
        done = F.flatten(F.transform(blocks, lambda block, i: _bind(before(i), lambda lo: of_block(block, lo, F.greatest(lo, ends[i])))))
        return F.concat(F.array_join(done, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return _bind(ends, of_all)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str = "source", owner: str = "source") -> DataFrame:
    """``docs`` with every span replaced: ``<secret>`` where its value looks live, else ``<example-secret>``.
    Rows without spans pass as they are; of others a column ``n_chars`` is counted anew; overlapping spans are one replacement, live if either is."""
    id_, h, spans, live = hidden(docs, "id", "h", "spans", "live")
    found = scan(docs, id_col, text_col, repository, owner).where("size(spans) > 0").groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(h)).agg(F.first("spans").alias(spans), F.first("live").alias(live))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(h)), "left")
    cut = _bind(F.col(text_col).cast("string"), lambda whole: _bind(_blocks(F.col(spans)), lambda blocks: _replaced(whole, blocks, F.col(live))))
    done = joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(cut))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return done.select(*docs.columns)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("live").cast("bigint").alias("n_live"))


def _sql_matches(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, v,
         sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(m) AS l, {least} AS least
  FROM (
    SELECT doc_id, unnest(range(len(ms))) AS nth, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1 : len(ms)]) AS g
    FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gs FROM d)
  ) WINDOW w AS (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING)"""


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), m AS ({" UNION ALL ".join(_sql_matches(*b, i) for i, b in enumerate([*BASE, ("owned", CANDIDATE, 0, 20)]))}
), s AS (
  SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, CAST(a + l AS BIGINT) AS z, v FROM m WHERE length(v) >= least
), base AS (
  SELECT * FROM s WHERE rank < {len(BASE)}
), extra AS (
  SELECT * FROM s WHERE rank = {len(BASE)} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.a < s.z AND s.a < b.z)
), both_ AS (
  SELECT * FROM base UNION ALL SELECT * FROM extra
), o AS (
  SELECT v, count(DISTINCT source) <= {min(MAX_OWNERS, MAX_REPOSITORIES)} AS live FROM both_ JOIN d USING (doc_id) GROUP BY v
), j AS (
  SELECT doc_id, rank, kind, a, z, live, kind || ':' || a || ':' || z AS w FROM both_ JOIN o USING (v)
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
         string_agg(w, ',' ORDER BY a, rank) FILTER (kind <> 'owned') AS base, string_agg(w, ',' ORDER BY a, rank) FILTER (kind <> 'owned' OR live) AS spans
  FROM j GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (doc_id)
"""
