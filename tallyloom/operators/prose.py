"""Identity and codes in prose: what a line gives away, tokens shaped like booking codes, and texts without either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

#: Patterns of what identifies a person, and of digit runs that are dates.
EMAIL = r"(?i)\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b"
ROLE = r"\b(?:[Cc]ustomer|[Rr]enter|[Dd]river|[Pp]assenger|[Ll]ead\s+(?:[Tt]raveler|[Gg]uest))\s*(?::|\s+[A-Z][\w'’-]+)"
ROLE_FOLLOWER = r"\s+([A-Z][\w'’-]*)$"
STREET = (
    r"(?i)\b\d{1,5}[a-z]?\s+(?:[A-Za-z][\w'’.-]*\s+){1,4}(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|place|pl|square|sq|terrace|ter|way)\b"
    r"[^,;:]{0,20}[,;]?[^,;:]{0,30}\b\d{4,6}\b"
)
LABELLED_PHONE = r"(?i)\b(?:phone|tel(?:ephone)?|mobile|cell)\b\s*[:.]?\s*\+?\d[\d\s().-]{6,}"
INTERNATIONAL_PHONE = r"\+\d[\d\s().-]{7,}\d"
US_PHONE = r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"
TRAILING_PHONE = r"(?:\+?\d[\d\s().-]{8,}\d)\s*$"
DATE_RUN = r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}$|^\d{1,2}[-./]\d{1,2}[-./]\d{2,4}$|^\d{1,2}\s*[-–]\s*\d{1,2}[,.]?\s*\d{4}$|^\d{4}\s*[-–]\s*\d{4}$"
#: Words after a role that are no names.
NO_NAMES = (
    "assistance care centre center check copy desk details drop entrance experience gate hall help information instruction instructions lounge "
    "manifest name names number parking pickup pick policy reference relations seat seats service services support terminal ticket tickets waiting"
).split()
#: Fixed value: where a sentence ends, but not after these abbreviations.
SENTENCE_END = r"(?i)(?<=[.!?])(?<!\b(?:st|mt|dr|mr|mrs|ms|vs|no|approx)\.)\s+"
#: Tokens shaped like codes, and those that are flights, dates and times.
DIGIT_RUN = r"\+?\d[\d ()./-]{5,}\d"
MIXED_TOKEN = r"#?\b[A-Za-z0-9-]{5,}\b"
NO_CODE = (
    r"^[A-Z]{1,2}\d{3,4}$|^\d{4}[-./]\d{1,2}[-./]\d{1,2}(?:\s+\d{1,2})?$|^\d{1,2}[-./]\d{1,2}[-./]\d{2,4}(?:\s+\d{1,2})?$|^\d{1,2}[:.]\d{2}(?:\s*[-–]\s*\d{1,2}[:.]\d{2})?$"
)
CODE_LABEL = r"(?i)\b(?:travel|ticket|booking|confirmation)\s*[- ]?code\s*[:#]?\s*"

SIGNALS = ["email", "role_labelled_name", "street_address", "phone"]


def ascii_edges(pattern: str) -> str:
    r"""``\b`` as an edge between ASCII letters, digits and ``_`` and all else, whatever the Java release takes it for."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(ascii_edges(pattern))


def identity_signal(c: Column) -> Column:
    """The first of ``SIGNALS`` in a piece of prose, or null.  A role needs a colon, or a name behind it that is none of
    ``NO_NAMES``; a phone without label or country is none if its digits are a date."""
    roles = F.regexp_extract_all(c, F.lit(ascii_edges(ROLE)), F.lit(0))
    follower = lambda m: F.lower(F.regexp_extract(m, ROLE_FOLLOWER, 1))
    named = F.exists(roles, lambda m: m.contains(":") | ~follower(m).isin(NO_NAMES))
    run = lambda p: F.regexp_extract(c, ascii_edges(p), 0)
    dated = lambda m: F.regexp_replace(F.trim(m), "[.,;:]$", "").rlike(DATE_RUN)
    phone = _has(c, LABELLED_PHONE) | _has(c, INTERNATIONAL_PHONE)
    for p in (US_PHONE, TRAILING_PHONE):
        phone = phone | ((run(p) != "") & ~dated(run(p)))
    return F.when(_has(c, EMAIL), "email").when(named, "role_labelled_name").when(_has(c, STREET), "street_address").when(phone, "phone")


def without_identity(c: Column) -> Column:
    """The sentences of a text that give nobody away, joined by single spaces.  Null stays null."""
    kept = F.filter(F.split(c, ascii_edges(SENTENCE_END)), lambda s: identity_signal(F.trim(s)).isNull())
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s{2,}", " "))


def code_tokens(c: Column) -> Column:
    """Digit runs of seven digits at least, then tokens of letters and digits that are part of no token before them; no
    flights, dates or times."""
    digits = F.transform(F.regexp_extract_all(c, F.lit(DIGIT_RUN), F.lit(0)), lambda t: F.trim(t))
    digits = F.filter(digits, lambda t: (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 7) & ~t.rlike(NO_CODE))
    mixed = F.transform(F.regexp_extract_all(c, F.lit(ascii_edges(MIXED_TOKEN)), F.lit(0)), lambda t: F.regexp_replace(t, "^#", ""))
    mixed = F.array_distinct(F.filter(mixed, lambda t: t.rlike("[A-Za-z]") & t.rlike("[0-9]") & ~t.rlike(NO_CODE)))
    new = F.filter(mixed, lambda t, i: ~F.exists(digits, lambda d: d.contains(t)) & ~F.exists(F.slice(mixed, 1, i), lambda d: d.contains(t)))
    return F.concat(digits, new)


def without_codes(c: Column) -> Column:
    """The text without its ``code_tokens``, the longest first, each with a ``#`` before it, and without labels and brackets
    that are left with nothing.  A text without such tokens stays as it is."""
    tokens = code_tokens(c)
    longest = F.transform(F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), lambda x: x["t"])
    bare = F.aggregate(longest, c, lambda a, t: F.replace(F.replace(a, F.concat(F.lit("#"), t), F.lit("")), t, F.lit("")))
    for pattern, new in ((ascii_edges(CODE_LABEL), ""), (r"\s{2,}", " "), (r"\s+([,.;:])", "$1"), (r"\(\s*\)", ""), (r"^\s+|\s+$", "")):
        bare = F.regexp_replace(bare, pattern, new)
    return F.when(F.size(tokens) > 0, bare).otherwise(c)


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _run_sql(p: str) -> str:
    m = f"regexp_extract(s, {_q(p)}, 0)"
    return f"({m} <> '' AND NOT regexp_matches(regexp_replace(trim({m}), '[.,;:]$', ''), {_q(DATE_RUN)}))"


_FOLLOWER_SQL = f"lower(regexp_extract(m, {_q(ROLE_FOLLOWER)}, 1))"
_SIGNAL_SQL = f"""CASE WHEN regexp_matches(s, {_q(EMAIL)}) THEN 'email'
  WHEN len(list_filter(regexp_extract_all(s, {_q(ROLE)}, 0), lambda m: contains(m, ':') OR NOT list_contains([{", ".join(map(_q, NO_NAMES))}], {_FOLLOWER_SQL}))) > 0 THEN 'role_labelled_name'
  WHEN regexp_matches(s, {_q(STREET)}) THEN 'street_address'
  WHEN regexp_matches(s, {_q(LABELLED_PHONE)}) OR regexp_matches(s, {_q(INTERNATIONAL_PHONE)}) OR {_run_sql(US_PHONE)} OR {_run_sql(TRAILING_PHONE)} THEN 'phone' END"""
_TOKENS_SQL = f"""list_concat(dg, list_filter(mx, lambda t, i: NOT list_bool_or(list_transform(list_prepend('', list_concat(dg, mx[1 : i - 1])), lambda d: contains(d, t)))))"""
_CODES_SQL = f"""SELECT doc_id, text, {_TOKENS_SQL} AS tokens FROM (SELECT doc_id, text,
  list_filter(list_transform(regexp_extract_all(text, {_q(DIGIT_RUN)}, 0), lambda t: trim(t)), lambda t: length(regexp_replace(t, '[^0-9]', '', 'g')) >= 7 AND NOT regexp_matches(t, {_q(NO_CODE)})) AS dg,
  list_filter(list_transform(regexp_extract_all(text, {_q(MIXED_TOKEN)}, 0), lambda t: regexp_replace(t, '^#', '')), lambda t: regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, {_q(NO_CODE)})) AS mx
  FROM documents)"""


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s FROM documents), g AS (SELECT doc_id, {_SIGNAL_SQL} AS signal FROM l)
SELECT doc_id, {", ".join(f"count(*) FILTER (signal = '{x}') AS n_{x}" for x in SIGNALS)} FROM g GROUP BY doc_id HAVING count(signal) > 0""")
def identity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that give somebody away, by the first signal of each.  No shuffle: lines stay in their row."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), identity_signal), lambda s: s.isNotNull()).alias("found")).where("size(found) > 0")
    count = lambda x: F.size(F.filter("found", lambda s: s == x)).cast("bigint").alias(f"n_{x}")
    return found.select("doc_id", *[count(x) for x in SIGNALS])


@query(f"WITH c AS ({_CODES_SQL}) SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, sha256(array_to_string(tokens, ' ')) AS tokens_sha FROM c WHERE len(tokens) > 0")
def protected_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-shaped tokens of each document that has any, in order."""
    c = table(spark, sf_dir, "documents").select("doc_id", code_tokens(F.col("text")).alias("tokens")).where("size(tokens) > 0")
    return c.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha"))


@query(f"""WITH c AS ({_CODES_SQL}), o AS (SELECT doc_id, text, list_transform(list_sort(list_transform(tokens, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda x: x.t) AS tokens FROM c WHERE len(tokens) > 0),
b AS (SELECT doc_id, list_reduce(list_prepend(text, tokens), lambda a, t: replace(replace(a, '#' || t, ''), t, '')) AS x FROM o)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, {_q(CODE_LABEL)}, '', 'g'), '\\s{{2,}}', ' ', 'g'), '\\s+([,.;:])', '\\1', 'g'), '\\(\\s*\\)', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS scrubbed_sha FROM b""")
def scrubbed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with codes, without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.size(code_tokens(F.col("text"))) > 0)
    return docs.select("doc_id", F.sha2(without_codes(F.col("text")), 256).alias("scrubbed_sha"))


@query()
def identity_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the sentences that give somebody away, where that changes the words.  SQL's patterns cannot look behind."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", without_identity(F.col("text")).alias("kept"))
    return docs.where(squeezed("kept") != squeezed("text")).select("doc_id", (F.length("text") - F.length("kept")).alias("n_shorter"), F.sha2("kept", 256).alias("kept_sha"))
