"""Privacy classification, redaction and leak search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

#: Patterns of what is private.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
SECRET = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\s*[:=]"


@query(f"""SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '{EMAIL}')) AS with_email, count(*) FILTER (regexp_matches(text, '{PHONE}')) AS with_phone,
  count(*) FILTER (regexp_matches(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\\s*[:=]')) AS with_secret FROM documents GROUP BY source""")
def privacy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda p: F.count_if(F.col("text").rlike(p))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), has(EMAIL).alias("with_email"), has(PHONE).alias("with_phone"), has(SECRET).alias("with_secret"))


@query(f"""WITH m AS (SELECT DISTINCT doc_id, source, lower(unnest(regexp_extract_all(text, '{EMAIL}'))) AS v FROM documents)
SELECT v AS value, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM m GROUP BY v HAVING count(DISTINCT source) > 1""")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that leave their source: the values found are joined on, not searched for in every text."""
    m = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("v")).select("doc_id", "source", F.lower("v").alias("value")).distinct()
    by_source = m.groupBy("value", "source").agg(F.count("*").alias("n"))
    return by_source.groupBy("value").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_sources")).where("n_sources > 1")


@query(f"""SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[email]', 'g')) AS redacted_sha FROM documents""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.regexp_replace("text", EMAIL, "[email]"), 256).alias("redacted_sha"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(c_acctbal, 2) END AS balance, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'private' ELSE coalesce(n_name, 'unknown') END AS place
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private fields are null, and a stronger reason overwrites a field."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    place = F.when(F.col("c_mktsegment") == "MACHINERY", "private").otherwise(F.coalesce("n_name", F.lit("unknown")))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.round("c_acctbal", 2)).alias("balance"), place.alias("place"))
