"""Text normalisation and tokens over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import column_label, table

NORMAL_SQL = "trim(regexp_replace(replace(strip_accents(lower(coalesce({0}, ''))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
TOKENS_SQL = "list_filter(string_split(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.LINE_STOPWORDS) + "]"
DISTINCTIVE_SQL = f"list_filter({TOKENS_SQL}, lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains({_STOP}, x))"
_AUDIT = "[" + ", ".join(f"'{w}'" for w in T.AUDIT_WORDS) + "]"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, pos (from 1), line.  A null or empty text is one empty line."""
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "line")).select("doc_id", "source", "lang", (F.col("p") + 1).alias("pos"), "line")


@query(f"SELECT doc_id, sha256({NORMAL_SQL.format('text')}) AS normal_sha FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("normal_sha"))


@query(f"""SELECT lang, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct FROM (SELECT lang, unnest({DISTINCTIVE_SQL.format('text')}) AS t FROM documents) GROUP BY lang""")
def text_distinctive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("lang", F.explode(T.distinctive_tokens(F.col("text"))).alias("t")).groupBy("lang", "t").agg(F.count("*").alias("n"))
    return counted.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split({NORMAL_SQL.format("substr(text, 1, 200)")}, ' '), lambda x: x <> '' AND NOT list_contains({_AUDIT}, x)), ' ') AS identity FROM documents""")
def text_audit_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text's first 200 characters, as its SQL.  For whole texts see ``text_audit_hash``."""
    return table(spark, sf_dir, "documents").select("doc_id", T.audit_identity(F.substring("text", 1, 200)).alias("identity"))


@query(f"""SELECT doc_id, sha256(array_to_string(list_filter(string_split({NORMAL_SQL.format("text")}, ' '), lambda x: x <> '' AND NOT list_contains({_AUDIT}, x)), ' ')) AS identity_sha FROM documents""")
def text_audit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each whole text's audit identity."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.audit_identity(F.col("text")), 256).alias("identity_sha"))


_BOILER_SQL = " OR ".join(f"regexp_matches(trim(line), '{p}')" for p in T.BOILERPLATE)
_COST_SQL = " OR ".join("regexp_matches(trim(line), '{}')".format(p.replace("'", "''")) for p in T.PLANNING_COST)


@query(f"""SELECT source, count(*) AS n_lines, count(*) FILTER ({_BOILER_SQL}) AS n_boilerplate, count(*) FILTER ({_COST_SQL}) AS n_cost,
  count(*) FILTER (regexp_matches(line, '{T.PRICE}')) AS n_price
FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""")
def text_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.trim("line")
    return (
        lines_of(table(spark, sf_dir, "documents"))
        .groupBy("source")
        .agg(
            F.count("*").alias("n_lines"),
            F.count_if(T.any_of(line, T.BOILERPLATE)).alias("n_boilerplate"),
            F.count_if(T.any_of(line, T.PLANNING_COST)).alias("n_cost"),
            F.count_if(F.col("line").rlike(T.PRICE)).alias("n_price"),
        )
    )


@query("""SELECT DISTINCT a.r_name AS a, b.n_name AS b, levenshtein(a.r_name, b.n_name) = 1 AS one_edit FROM region a, nation b WHERE b.n_regionkey = a.r_regionkey
UNION SELECT p1, p2, levenshtein(p1, p2) = 1 FROM (SELECT DISTINCT p_brand AS p1, 'x' AS k FROM part) x JOIN (SELECT DISTINCT p_brand AS p2, left(p_brand, 7) AS k FROM part) y ON left(p1, 7) = y.k""")
def text_one_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region, and brands with the same first 7 characters, as its SQL.  For all brands one
    edit apart see ``text_one_edit_brands``."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    names = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a"), F.left("p_brand", F.lit(7)).alias("k")).distinct()
    pairs = brands.join(brands.withColumnRenamed("a", "b"), "k").select("a", "b")
    return names.union(pairs).distinct().select("a", "b", F.coalesce(T.one_edit(F.col("a"), F.col("b")), F.lit(False)).alias("one_edit"))


def one_edit_pairs(names: DataFrame) -> DataFrame:
    """a, b: all ordered pairs of ``name`` one edit apart.  Such names share a variant, which is a name or a name
    without one of its characters, so only names of a variant are compared."""
    variants = F.expr("array_distinct(transform(sequence(0, length(name)), i -> if(i = 0, name, concat(left(name, i - 1), substring(name, i + 1)))))")
    v = names.select("name").where("name is not null").distinct().select("name", F.explode(variants).alias("variant"))
    pairs = v.withColumnRenamed("name", "a").join(v.withColumnRenamed("name", "b"), "variant").where("a != b").select("a", "b").distinct()
    return pairs.where(F.coalesce(T.one_edit(F.col("a"), F.col("b")), F.lit(False)))


@query("""SELECT a.p_brand AS a, b.p_brand AS b FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON levenshtein(a.p_brand, b.p_brand) = 1""")
def text_one_edit_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of brands one edit apart."""
    return one_edit_pairs(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")))


@query("""WITH t AS (SELECT event_id, CAST(event_id % 30 AS VARCHAR) AS h, lpad(CAST(event_id % 70 AS VARCHAR), 2, '0') AS m, event_id % 4 AS k FROM events),
u AS (SELECT event_id, CASE k WHEN 0 THEN h || ':' || m WHEN 1 THEN 'at ' || h || ' pm' WHEN 2 THEN h || '.' || m || ' AM' ELSE h END AS raw, CAST(h AS INT) AS h, CAST(m AS INT) AS m, k FROM t)
SELECT event_id, raw, CASE
  WHEN k = 0 AND h <= 23 AND m <= 59 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0')
  WHEN k = 1 AND h <= 23 THEN lpad(CAST(CASE WHEN h < 12 THEN h + 12 ELSE h END AS VARCHAR), 2, '0') || ':00'
  WHEN k = 2 AND h <= 23 AND m <= 59 THEN lpad(CAST(CASE WHEN h = 12 THEN 0 ELSE h END AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0')
  WHEN k = 3 AND h <= 23 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':00' END AS clock FROM u""")
def text_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, m, k = F.expr("string(event_id % 30)"), F.expr("lpad(string(event_id % 70), 2, '0')"), F.expr("event_id % 4")
    raw = F.when(k == 0, F.concat(h, F.lit(":"), m)).when(k == 1, F.concat(F.lit("at "), h, F.lit(" pm"))).when(k == 2, F.concat(h, F.lit("."), m, F.lit(" AM"))).otherwise(h)
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", "raw", T.clock(F.col("raw")).alias("clock"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 40 AS d, o_orderkey % 14 AS m, 1990 + o_orderkey % 30 AS y, o_orderkey % 2 AS k FROM orders),
u AS (SELECT o_orderkey, d, m, y, CASE k WHEN 0 THEN d || '/' || m || '/' || y ELSE y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') END AS raw, k FROM t)
SELECT o_orderkey, raw, CASE k WHEN 0 THEN coalesce(TRY_CAST(y || '-' || m || '-' || d AS DATE), TRY_CAST(y || '-' || d || '-' || m AS DATE)) ELSE TRY_CAST(raw AS DATE) END AS day FROM u""")
def text_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("""if(o_orderkey % 2 = 0, concat(o_orderkey % 40, '/', o_orderkey % 14, '/', 1990 + o_orderkey % 30),
                    concat(1990 + o_orderkey % 30, '-', lpad(string(o_orderkey % 14), 2, '0'), '-', lpad(string(o_orderkey % 40), 2, '0')))""")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", T.trip_date(F.col("raw")).alias("day"))


@query("""SELECT doc_id, CASE WHEN length(s) > 280 THEN substr(s, 1, 280) || '...' ELSE s END AS short
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS s FROM documents)""")
def text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 280).alias("short"))


@query("""SELECT p_partkey, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INT)) ELSE chr(CAST(64 + i // 26 AS INT)) || chr(CAST(65 + i % 26 AS INT)) END AS label
FROM (SELECT p_partkey, p_partkey % 702 AS i FROM part)""")
def source_column_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", column_label(F.col("p_partkey") % 702).alias("label"))


@query("""SELECT doc_id, (p - 1) // 8 + 1 AS batch, min(p) AS first_page, max(p) AS last_page
FROM (SELECT doc_id, unnest(range(1, CAST(n_chars // 500 + 2 AS BIGINT))) AS p FROM documents) GROUP BY ALL""")
def source_page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr("sequence(1L, n_chars div 500 + 1)")).alias("p"))
    return pages.groupBy("doc_id", F.expr("(p - 1) div 8 + 1").alias("batch")).agg(F.min("p").alias("first_page"), F.max("p").alias("last_page"))


@query("""SELECT event_type, count(*) AS n, sum(k) AS total, count(DISTINCT user_id) AS users FROM (
  SELECT event_type, user_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events) GROUP BY event_type""")
def source_json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_distinct("user_id").alias("users"))
