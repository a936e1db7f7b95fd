"""URL filter by a sorted array of 64-bit digests.

A list of entries (host, path prefix) becomes one file: the sorted xxh64 digests of the keys
``host + path``, the keys' kinds, and the keys themselves.  Workers map the file into memory.  For
each url the digests of its candidates - every suffix of the host at a dot, with every prefix of
the path that has a listed length - are sought by one vectorised binary search a batch, and each
digest found counts only if the stored key equals the candidate.

A list over ``MAX_INDEX_BYTES`` is dealt by digest into shards, which are packed, mapped and probed in the same way.

Edge cases: a null or empty url, or one without ``://``, has an empty host and path, fits no entry and is
allowed.  An empty entry list allows everything.  Repeated rows give repeated results; columns of
the input other than the id and the url are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii, table

ALLOW, BLOCK, LISTED = 0, 1, 2

#: Rules: (host, path prefix, kind).  Fixed values.
RULES = [
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
]

#: Hosts of the block list, each with its subdomains.  Fixed values.
BLOCKED_HOSTS = [
    "ads-track.example.com",
    "adult-x.example.com",
    "casino-win.example.net",
    "cheap-pills.example.net",
    "free-bets.example.net",
    "spam-farm.example.org",
]

#: A list over this size is not shipped whole to every executor, but dealt into shards of this size; candidates of a shard.
MAX_INDEX_BYTES, SHARD_CANDIDATES = 64 << 20, 1_000_000

Entry = tuple[str, str, int]


def pack(entries: Iterable[Entry]) -> bytes:
    """n, number of lengths, lengths; then n digests, n + 1 offsets, n places of the path, n kinds, keys."""
    rows = sorted({(xxhash.xxh64_intdigest(h + p), h + p, len(h.encode()), k, len(p)) for h, p, k in entries})
    keys = [key.encode() for _, key, _, _, _ in rows]
    lengths = sorted({r[4] for r in rows})
    parts = [
        np.array([len(rows), len(lengths), *lengths], np.int64),
        np.array([r[0] for r in rows], np.uint64),
        np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64),
        np.array([r[2] for r in rows], np.int64),
        np.array([r[3] for r in rows], np.int64),
    ]
    return b"".join(p.tobytes() for p in parts) + b"".join(keys)


class DigestIndex:
    """The packed file, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n, k = (int(x) for x in whole[:16].view(np.int64))
        words = whole[: 8 * (2 + k + 4 * n + 1)].view(np.int64)
        self.lengths = words[2 : 2 + k].tolist()
        at = 2 + k
        self.digests = words[at : at + n].view(np.uint64)
        self.offsets = words[at + n : at + 2 * n + 1]
        self.host_bytes = words[at + 2 * n + 1 : at + 3 * n + 1]
        self.kinds = words[at + 3 * n + 1 : at + 4 * n + 1]
        self.keys = whole[8 * (at + 4 * n + 1) :]

    def entries(self, candidates: list[tuple[str, str]]) -> Iterator[tuple[int, str, int]]:
        """(place in candidates, key, kind) of each listed (host, path)."""
        if not candidates or not len(self.digests):
            return
        sought = np.array([xxhash.xxh64_intdigest(h + p) for h, p in candidates], np.uint64)
        first = np.searchsorted(self.digests, sought, "left")
        last = np.searchsorted(self.digests, sought, "right")
        for i in np.flatnonzero(last > first):
            host, path = candidates[i]
            key = host + path
            for j in range(first[i], last[i]):
                stored = self.keys[self.offsets[j] : self.offsets[j + 1]].tobytes()
                if stored == key.encode("utf-8", "surrogatepass") and self.host_bytes[j] == len(host.encode("utf-8", "surrogatepass")):
                    yield int(i), key, int(self.kinds[j])


_open: dict[str, DigestIndex] = {}


def candidates(host: str, path: str, lengths: list[int], longest: int) -> list[tuple[str, str]]:
    """The host and its domains with what the path begins with, of the lengths that the list has; none of more than ``longest`` letters, its longest
    host, so that a host of very many labels costs no more than a short one."""
    if not host:
        return []
    starts = [0, *(i + 1 for i, c in enumerate(host) if c == ".")]
    hosts = [host[i:] for i in starts if len(host) - i <= longest]
    return [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]


def judge(hits: list[tuple[str, int]]) -> tuple[str | None, str, str | None]:
    """Rule, verdict and listed entry from the entries that fit; the longest rule wins."""
    rules = [h for h in hits if h[1] != LISTED]
    listed = max((h for h in hits if h[1] == LISTED), key=lambda h: (len(h[0]), h[0]), default=(None, 0))[0]
    if rules:
        rule, kind = max(rules, key=lambda h: (len(h[0]), h[1], h[0]))
        return rule, "block" if kind == BLOCK else "allow", listed
    return None, "block" if listed is not None else "allow", listed


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (lower-cased) and path: what stands after the first ``://``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return df.withColumn("host", lower_ascii(F.regexp_extract(text, pattern, 1))).withColumn("path", F.regexp_extract(text, pattern, 2))


def _ship(spark: SparkSession, packed: bytes) -> str:
    """Give the file to every executor, those that start later too; returns its name."""
    name = f"digests-{xxhash.xxh64_hexdigest(packed)}-{os.getpid()}.bin"
    if not any(str(f).endswith(name) for f in spark.sparkContext.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="tallyloom-index-"), name)
        with open(path, "wb") as out:
            out.write(packed)
        spark.sparkContext.addFile(path)
    return name


def _entry_bytes(host: str, path: str) -> int:
    return 40 + len(host.encode()) + len(path.encode())


def filter_urls(pages: DataFrame, entries: list[Entry], id_col: str = "page_id", url_col: str = "url", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """id, host, path, rule, verdict, listed for every row of ``pages``."""
    urls = split_url(pages.select(id_col, url_col), url_col).select(id_col, "host", "path")
    if sum(_entry_bytes(h, p) for h, p, _ in entries) > max_index_bytes:
        return _sharded(urls, entries, id_col, max_index_bytes)
    name, longest = _ship(pages.sparkSession, pack(entries)), max((len(h) for h, _, _ in entries), default=0)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = SparkFiles.get(name)
        index = _open.get(path) or _open.setdefault(path, DigestIndex(path))
        for b in batches:
            owner, all_candidates = [], []
            for i, (host, path_) in enumerate(zip(b["host"], b["path"])):
                found = candidates(host, path_, index.lengths, longest)
                owner += [i] * len(found)
                all_candidates += found
            hits: dict[int, list] = {}
            for i, key, kind in index.entries(all_candidates):
                hits.setdefault(owner[i], []).append((key, kind))
            judged = [judge(hits.get(i, [])) for i in range(len(b))]
            yield b.assign(**{c: pd.Series([x[k] for x in judged], dtype=object, index=b.index) for k, c in enumerate(("rule", "verdict", "listed"))})

    kind = dict(urls.dtypes)[id_col]
    return urls.mapInPandas(probe, f"{id_col} {kind}, host string, path string, rule string, verdict string, listed string")


def _sharded(urls: DataFrame, entries: list[Entry], id_col: str, max_index_bytes: int) -> DataFrame:
    """The same search for a list too large to ship whole: candidates and entries are dealt by digest to shards, each of which
    packs its part of the list into a file, maps it and probes it."""
    spark = urls.sparkSession
    lengths, longest = sorted({len(p) for _, p, _ in entries}), max(len(h) for h, _, _ in entries)
    size = sum(_entry_bytes(h, p) for h, p, _ in entries)
    asked = urls.select("host", "path").where("host != ''").distinct()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, p, ch, cp, xxhash.xxh64_intdigest(ch + cp) % shards) for h, p in zip(b["host"], b["path"]) for ch, cp in candidates(h, p, lengths, longest)]
            yield pd.DataFrame(rows, columns=["host", "path", "c_host", "c_path", "shard"])

    # some candidates and some bytes of the list to a shard
    dots = F.size(F.split("host", r"\.")) * len(lengths)
    shards = max(1, -(-size // max(1, max_index_bytes)), -(-(asked.agg(F.sum(dots)).first()[0] or 0) // SHARD_CANDIDATES))
    dealt = [(xxhash.xxh64_intdigest(h + p) % shards, h, p, k) for h, p, k in entries]
    listed = spark.createDataFrame(dealt, "shard bigint, e_host string, e_path string, e_kind int")

    def probe(asked: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(listed):
            with tempfile.NamedTemporaryFile() as file:
                file.write(pack(zip(listed["e_host"], listed["e_path"], listed["e_kind"].astype(int))))
                file.flush()
                for i, key, kind in DigestIndex(file.name).entries(list(zip(asked["c_host"], asked["c_path"]))):
                    found.append((asked["c_host"].iat[i], asked["c_path"].iat[i], key, kind))
        return pd.DataFrame(found, columns=["c_host", "c_path", "e_key", "e_kind"])

    dealt_out = asked.mapInPandas(deal, "host string, path string, c_host string, c_path string, shard bigint")
    once = dealt_out.select("c_host", "c_path", "shard").distinct()  # a domain of many urls is looked up once
    hits = once.groupBy("shard").cogroup(listed.groupBy("shard")).applyInPandas(probe, "c_host string, c_path string, e_key string, e_kind int")
    hits = dealt_out.select("host", "path", "c_host", "c_path").join(hits, ["c_host", "c_path"])
    best = lambda of: F.max(F.when(of, F.struct(F.length("e_key").alias("n"), F.col("e_kind"), F.col("e_key"))))
    found = hits.groupBy("host", "path").agg(best(F.col("e_kind") != LISTED).alias("r"), best(F.col("e_kind") == LISTED).alias("l"))
    verdict = F.when(F.col("r").isNotNull(), F.when(F.col("r.e_kind") == BLOCK, "block").otherwise("allow")).when(F.col("l").isNotNull(), "block").otherwise("allow")
    return urls.join(found, ["host", "path"], "left").select(id_col, "host", "path", F.col("r.e_key").alias("rule"), verdict.alias("verdict"), F.col("l.e_key").alias("listed"))


def default_entries() -> list[Entry]:
    return RULES + [(h, "", LISTED) for h in BLOCKED_HOSTS]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), default_entries())


_HOSTS = ", ".join(f"'{h}'" for h in BLOCKED_HOSTS)
SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), s AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
), r(h, pre, kind) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT page_id, max_by(h || pre, length(h || pre)) AS rule, max_by(kind, length(h || pre)) AS kind
  FROM (SELECT DISTINCT page_id, host, path FROM p) q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id
), l AS (
  SELECT page_id, max_by(h, length(h)) AS listed FROM (SELECT DISTINCT page_id, host FROM p) q
  JOIN (SELECT unnest([{_HOSTS}]) AS h) b ON host = h OR ends_with(host, '.' || h) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(kind, CASE WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM p LEFT JOIN m ON m.page_id = p.page_id LEFT JOIN l ON l.page_id = p.page_id
"""
