"""Deduplication, budgets, sections and spans of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import table
from .text_queries import NORMAL_SQL, lines_of

_SQUEEZE_SQL = "trim(regexp_replace(line, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def suppressed_lines(docs: DataFrame, keep: int = 2, least: int = 4) -> DataFrame:
    """Lines with ``kept``: false from the third occurrence in a document on, whatever the case."""
    lines = lines_of(docs).withColumn("line", T.squeeze(F.col("line"))).where(F.length("line") >= least)
    nth = F.row_number().over(W.partitionBy("doc_id", F.lower("line")).orderBy("pos"))
    return lines.withColumn("kept", nth <= keep)


@query(f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT doc_id, source, pos, {_SQUEEZE_SQL} AS line FROM l),
n AS (SELECT source, line, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS nth FROM s WHERE length(line) >= 4)
SELECT source, count(*) FILTER (nth <= 2) AS kept_lines, coalesce(sum(length(line)) FILTER (nth <= 2), 0)::BIGINT AS kept_chars, count(*) FILTER (nth > 2) AS suppressed_lines FROM n GROUP BY source""")
def dedupe_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: what is kept of each source when repeated lines are suppressed."""
    return (
        suppressed_lines(table(spark, sf_dir, "documents"))
        .groupBy("source")
        .agg(
            F.count_if("kept").alias("kept_lines"),
            F.coalesce(F.sum(F.when(F.col("kept"), F.length("line"))), F.lit(0)).cast("bigint").alias("kept_chars"),
            F.count_if(~F.col("kept")).alias("suppressed_lines"),
        )
    )


def material_key(text: F.Column, id_: F.Column, least: int = 80) -> F.Column:
    """The hash of the normalised text where it has 80 characters; else the row's own key."""
    normal = T.normalize(text)
    return F.when(F.length(normal) >= least, F.sha2(normal, 256)).otherwise(F.concat(F.lit("id:"), id_.cast("string")))


@query(f"""WITH k AS (SELECT doc_id, source, CASE WHEN length(n) >= 80 THEN sha256(n) ELSE 'id:' || doc_id END AS k FROM (SELECT doc_id, source, {NORMAL_SQL.format('text')} AS n FROM documents))
SELECT min(doc_id) AS survivor, count(*) AS n_copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, sum(doc_id)::BIGINT AS id_sum FROM k GROUP BY k""")
def material_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each group of equal materials, with the sources of all."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", "source", material_key(F.col("text"), F.col("doc_id")).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("survivor"), F.count("*").alias("n_copies"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.sum("doc_id").alias("id_sum")).drop("key")


@query(f"""WITH k AS (SELECT source, sha256({NORMAL_SQL.format('text')}) || ':' || coalesce(lang, '') AS k FROM documents)
SELECT source, count(DISTINCT k) AS n_keys, bit_xor(('0x' || left(sha256(k), 15))::BIGINT) AS key_xor FROM (SELECT DISTINCT source, k FROM k) GROUP BY source""")
def material_idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free key of a source's distinct materials: hashes combined by exclusive or, so no group is gathered."""
    key = F.concat(F.sha2(T.normalize(F.col("text")), 256), F.lit(":"), F.coalesce("lang", F.lit("")))
    keyed = table(spark, sf_dir, "documents").select("source", key.alias("k")).distinct()
    return keyed.groupBy("source").agg(F.count("*").alias("n_keys"), F.bit_xor(F.conv(F.left(F.sha2("k", 256), F.lit(15)), 16, 10).cast("bigint")).alias("key_xor"))


@query("""WITH c AS (SELECT source, n_chars, least(n_chars, 18000) AS capped FROM documents), t AS (SELECT *, sum(capped) OVER (PARTITION BY source) AS total FROM c),
b AS (SELECT source, n_chars, capped, CASE WHEN total > 60000 THEN least(capped, greatest(500, CAST(floor(capped * 60000.0::DOUBLE / total) AS BIGINT))) ELSE capped END AS budget FROM t)
SELECT source, sum(n_chars)::BIGINT AS raw_chars, sum(capped)::BIGINT AS capped_chars, sum(budget)::BIGINT AS budget_chars, count(*) FILTER (budget < n_chars) AS n_truncated, sum((budget + 3) // 4)::BIGINT AS tokens FROM b GROUP BY source""")
def material_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document capped, then all of a source scaled to a total, with a floor.  The total is an
    aggregate that is joined back, so a hot source is no window in one task."""
    capped = table(spark, sf_dir, "documents").select("source", "n_chars", F.least("n_chars", F.lit(18000)).alias("capped"))
    total = capped.groupBy("source").agg(F.sum("capped").alias("total"))
    scaled = F.greatest(F.lit(500), F.floor(F.col("capped") * 60000.0 / F.col("total")))
    b = capped.join(total, "source").withColumn("budget", F.when(F.col("total") > 60000, F.least("capped", scaled)).otherwise(F.col("capped")))
    return b.groupBy("source").agg(F.sum("n_chars").alias("raw_chars"), F.sum("capped").alias("capped_chars"), F.sum("budget").alias("budget_chars"), F.count_if(F.col("budget") < F.col("n_chars")).alias("n_truncated"), F.sum(F.expr("(budget + 3) div 4")).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 1500 THEN length(text) ELSE length(substr(text, 1, 1230) || '[trimmed]' || right(text, 150)) END AS n,
sha256(CASE WHEN length(text) <= 1500 THEN text ELSE substr(text, 1, 1230) || '[trimmed]' || right(text, 150) END) AS digest FROM documents""")
def material_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a budget of 1,500 characters: 82 % from the head, a mark, and from the tail what is left less 120."""
    budget, head = 1500, 1230
    cut = F.when(F.length("text") <= budget, F.col("text")).otherwise(F.concat(F.substring("text", 1, head), F.lit("[trimmed]"), F.right("text", F.lit(budget - head - 120))))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("bigint").alias("n"), F.sha2(cut, 256).alias("digest"))


@query("""WITH s AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
SELECT conv_id, section::BIGINT AS section, count(*) AS n_turns, min(turn) AS first_turn FROM s GROUP BY ALL""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section begins at every turn of the user; what stands before the first is section 0."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("section"))
    return c.groupBy("conv_id", "section").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, trim(unnest(regexp_split_to_array(line, '[,;]| and | or | & '))) AS clause FROM l)
SELECT doc_id, count(*) AS n_clauses, count(DISTINCT clause) AS n_distinct, bit_xor(('0x' || left(sha256(clause), 15))::BIGINT) AS digest FROM c WHERE clause <> '' GROUP BY doc_id""")
def span_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines split into clauses, each with a digest."""
    c = lines_of(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.split("line", "[,;]| and | or | & ")).alias("clause")).withColumn("clause", F.trim("clause")).where("clause != ''")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.count_distinct("clause").alias("n_distinct"), F.bit_xor(F.conv(F.left(F.sha2("clause", 256), F.lit(15)), 16, 10).cast("bigint")).alias("digest"))


@query("""SELECT doc_id, array_to_string(list_filter(range(1, 11), lambda p: NOT list_contains(list_transform(regexp_extract_all(m, '=== page ([0-9]+) ===', 1), lambda x: CAST(x AS BIGINT)), p)), ',') AS missing
FROM (SELECT doc_id, array_to_string(list_transform(list_filter(range(1, 11), lambda p: (doc_id + p) % 3 <> 0), lambda p: '=== page ' || p || ' ==='), chr(10)) AS m FROM documents)""")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested pages whose mark a transcript lacks."""
    marks = F.expr("array_join(transform(filter(sequence(1, 10), p -> (doc_id + p) % 3 <> 0), p -> concat('=== page ', p, ' ===')), '\n')")
    found = F.expr("transform(regexp_extract_all(m, '=== page ([0-9]+) ===', 1), x -> int(x))")
    return table(spark, sf_dir, "documents").select("doc_id", marks.alias("m")).select("doc_id", F.array_join(F.array_except(F.sequence(F.lit(1), F.lit(10)), found), ",").alias("missing"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, value, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events),
f AS (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM e)
SELECT event_id, user_id, round(v, 6) AS last_purchase FROM f""")
def forward_fill_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last purchase so far, forgotten at an error."""
    by_time = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("seg", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(by_time))
    w = W.partitionBy("user_id", "seg").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("event_id", "user_id", F.round(F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w), 6).alias("last_purchase"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM e)
SELECT user_id, seg::BIGINT AS seg, event_type, count(*) AS n FROM s GROUP BY ALL""")
def segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal events of a user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    b = F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(w)), 0).otherwise(1)
    e = table(spark, sf_dir, "events").withColumn("b", b).withColumn("seg", F.sum("b").over(w))
    return e.groupBy("user_id", "seg", "event_type").agg(F.count("*").alias("n"))
