"""Walks over JSON of any shape: the strings that it holds, and the same tree with what is private taken out."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

#: How deep strings are looked for; what an event's details show of a list, an object and a string; what is private.
DEPTH, LIST, OBJECT, STRING = 6, 30, 60, 500
PRIVATE_KEY = re.compile("address|booking|code|confirmation|content|door|email|key|lockbox|passcode|password|phone|pnr|private|raw|reference|secret|text|token|wifi|wi-fi", re.I | re.A)
_EMAIL = re.compile(r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I | re.A)
_PHONE = re.compile(r"\+?[0-9][0-9\s().-]{7,}[0-9]")
_CODE = re.compile(r"\b(password|passcode|access code|door code|lockbox|wifi|wi-fi|confirmation|booking reference|reservation code|pnr)\s*[:#-]?\s*[A-Z0-9][A-Z0-9 -]{2,}\b", re.I | re.A)


def _strings(value: object) -> list[tuple[str, str]]:
    """Paths and strings of a tree, in its order.  The walk keeps its own stack, so no tree is too deep for it."""
    out, stack = [], [("$", value, 0)]
    while stack:
        path, node, depth = stack.pop()
        if depth > DEPTH:
            continue
        if isinstance(node, str):
            if node.strip():
                out.append((path, node))
        elif isinstance(node, list):
            stack += [(f"{path}[{i}]", x, depth + 1) for i, x in reversed(list(enumerate(node)))]
        elif isinstance(node, dict):
            stack += [(f"{path}.{k}", x, depth + 1) for k, x in reversed(node.items())]
    return out


def _shown(text: str, private: bool) -> str:
    text = " ".join(text.split())
    if len(text) > STRING:
        text = text[:STRING].strip() + "..."
    if not private:
        text = _CODE.sub(r"\1 [redacted]", _PHONE.sub("[redacted phone]", _EMAIL.sub("[redacted email]", text)))
    return text


def _redacted(value: object, private: bool, key: str | None = None) -> object:
    hide = bool(not private and key and PRIVATE_KEY.search(key))
    if isinstance(value, str):
        return "[redacted value]" if hide else _shown(value, private)
    if isinstance(value, list):
        rest = [f"[truncated {len(value) - LIST} items]"] if len(value) > LIST else []
        return "[redacted list]" if hide else [_redacted(x, private) for x in value[:LIST]] + rest
    if isinstance(value, dict):
        rest = {"_truncatedKeys": len(value) - OBJECT} if len(value) > OBJECT else {}
        return "[redacted object]" if hide else {k: _redacted(x, private, k) for k, x in list(value.items())[:OBJECT]} | rest
    return value


def _parsed(text: str | None) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return False, None


def string_leaves(c: Column) -> Column:
    """Array of (path, value) of the strings of a JSON text that are not blank, down to six levels, in its order.  Null if it is no JSON, or
    nested deeper than Python's reader goes."""

    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"path": p, "value": v} for p, v in _strings(parsed[1])] if (parsed := _parsed(t))[0] else None)

    return F.pandas_udf(walk, "array<struct<path string, value string>>")(c)


def redacted(c: Column, private: bool = False) -> Column:
    """A JSON text with private keys' values, addresses, phones and codes replaced, and long strings, lists and objects cut as the rule says; with
    ``private`` only cut.  Numbers and booleans stay also under private keys, as the rule has it.  Null if it is no JSON."""

    def walk(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            read, value = _parsed(text)
            try:
                return json.dumps(_redacted(value, private), ensure_ascii=False) if read else None
            except RecursionError:
                return None

        return texts.map(one)

    return F.pandas_udf(walk, "string")(c)


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as event details, nested."""
    c = table(spark, sf_dir, "conversations")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return c.select("conv_id", "turn", F.to_json(F.struct("role", F.struct(lines.alias("lines"), F.col("text").alias("note")).alias("body"), F.array(F.struct("conv_id", "turn")).alias("at"))).alias("details"))


@query("""WITH l AS (SELECT conv_id, turn, role, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS lines FROM conversations)
SELECT conv_id, turn, CAST(len(lines) + CASE WHEN trim(coalesce(role, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END AS BIGINT) AS n_strings,
  CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) + CASE WHEN trim(coalesce(text, '')) <> '' THEN length(text) ELSE 0 END + CASE WHEN trim(coalesce(role, '')) <> '' THEN length(role) ELSE 0 END AS BIGINT) AS n_chars FROM l""")
def detail_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many strings, and characters of them, each turn's details hold at any depth."""
    found = _details(spark, sf_dir).select("conv_id", "turn", string_leaves(F.col("details")).alias("s"))
    return found.select("conv_id", "turn", F.size("s").cast("bigint").alias("n_strings"), F.aggregate("s", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["value"])).alias("n_chars"))


@query()
def details_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's details as an event shows them."""
    return _details(spark, sf_dir).select("conv_id", "turn", redacted(F.col("details")).alias("details"))
