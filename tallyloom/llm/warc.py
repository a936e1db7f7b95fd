"""Content-addressed WARC archive.

``write_archive`` stores each payload once, compressed, under its SHA-256, in one Parquet table, and the exact
header text of every record in another.  A digest names its payload only if all rows that share it
have the same bytes; otherwise the job fails.  ``read_archive`` joins the two back to whole
records and checks each payload against its digest and its header.

Of records with equal payloads of ``min_revisit_bytes`` or more, that with the largest id is the
response and the others are revisits of it; smaller payloads are responses always, though stored once.

Edge cases: a null html is an empty payload, a null url an empty target; rows repeated in every
column give repeated records, all responses if their id is the largest; a null id is the smallest.
An empty table gives an empty archive; very long payloads go in batches bounded in bytes.  The payload shuffle combines equal
payloads before it, and payloads are compressed before they are shuffled; the join back is one that Spark can split where
a third of all records have one payload.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, small_batches, table

MIN_REVISIT_BYTES = 1000
DATE = "2026-01-01T00:00:00Z"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of each payload, and the payload compressed; equal ones alike."""
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        parts = {"digest": [], "sha1": [], "n": [], "packed": []}
        for payload in b["payload"]:
            for name, value in zip(parts, (hashlib.sha256(payload).hexdigest(), hashlib.sha1(payload).hexdigest(), len(payload), press.compress(payload))):
                parts[name].append(value)
        yield pd.DataFrame({"record": b["record"], "url": b["url"], **{k: pd.Series(v, index=b.index, dtype="int64" if k == "n" else object) for k, v in parts.items()}})


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records of headers and stored payloads."""
    expand = zstandard.ZstdDecompressor()
    for b in batches:
        payloads, raws = [], []
        for digest, header, kind, stated, packed in zip(b["digest"], b["header"], b["record_type"], b["stated_sha1"], b["packed"]):
            payload = expand.decompress(packed)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"damaged payload {digest}")
            if hashlib.sha1(payload).hexdigest() != stated:
                raise ValueError(f"header and payload {digest} disagree")
            payloads.append(payload)
            raws.append(header.encode() + (b"" if kind == "revisit" else payload) + b"\r\n\r\n")
        yield pd.DataFrame({"record": b["record"], "record_type": b["record_type"], "refers_to": b["refers_to"], "payload": pd.Series(payloads, index=b.index, dtype=object), "raw": pd.Series(raws, index=b.index, dtype=object)})


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``path``/payloads and ``path``/headers."""
    spark = pages.sparkSession
    small_batches(spark)
    id_type = dict(pages.dtypes)[id_col]
    rows = pages.select(
        F.col(id_col).alias("record"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).mapInPandas(_pack, f"record {id_type}, url string, digest string, sha1 string, n bigint, packed binary")
    stored = (
        rows.groupBy("digest")
        .agg(F.min("packed").alias("packed"), F.max("packed").alias("other"), F.max("record").alias("response"), F.min("n").alias("n"), F.min("sha1").alias("sha1"))
        .withColumn("packed", F.when(F.col("packed") == F.col("other"), F.col("packed")).otherwise(F.raise_error(F.lit("two payloads share a digest"))))
        .drop("other")
    )
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    known = spark.read.schema(stored.schema).parquet(f"{path}/payloads").select("digest", "response", "n", "sha1")
    revisit = (F.col("n") >= min_revisit_bytes) & ~F.col("record").eqNullSafe(F.col("response"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("record"))),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, _line("WARC-Refers-To", _urn(F.col("response")))).otherwise(""),
        F.when(revisit, _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(""),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    headers = rows.select("record", "url", "digest").join(known, "digest").select("record", "digest", header.alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def _headers(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    stored = spark.read.schema(f"record {id_type}, digest string, header string").parquet(f"{path}/headers")
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return stored.select("record", "digest", "header", F.regexp_extract("header", r"\r\nWARC-Type: (\w+)", 1).alias("record_type"), F.nullif(F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1), F.lit("")).cast(id_type).alias("refers_to"), F.regexp_extract(field("WARC-Payload-Digest"), r"^sha1:(.*)$", 1).alias("stated_sha1"))


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """record, record_type, refers_to, payload (whole, also of revisits), raw (the record's exact bytes)."""
    small_batches(spark)
    stored = spark.read.schema("digest string, packed binary").parquet(f"{path}/payloads")
    whole = _headers(spark, path, id_type).join(stored, "digest")
    return whole.mapInPandas(_rebuild, f"record {id_type}, record_type string, refers_to {id_type}, payload binary, raw binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    whole = read_archive(spark, path)
    return whole.select(F.col("record").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), w AS (
  SELECT page_id, strlen(h) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w
"""
