"""Readers.  Tables are Parquet; documents may also come as CSV or JSON lines."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns up to ZZZ have a label.
MAX_COLUMNS = 26 + 26**2 + 26**3


def quote_open(line: str, open_: bool) -> bool:
    """Does a quoted cell go on after this line of a CSV file, if one does (``open_``) or does not before it?"""
    at = 0
    if not open_ and line[:1] == '"':
        open_, at = True, 1
    while True:
        if open_:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            open_, at = False, at + 1
        at = line.find(",", at) + 1
        if not at:
            return False
        if line[at : at + 1] == '"':
            open_, at = True, at + 1


def csv_lines(spark: SparkSession, path: str, max_records: int = 50_000) -> DataFrame:
    """A CSV file's records as text lines ``Row n | A1: v | B1: v``; blank cells are left out.

    Records may have any number of cells, and quoted cells may have line breaks.  More than ``max_records``
    records, a cell past column ZZZ or a quote that is not closed is an error, as a cut-off file would pass for a
    whole one.  Files are read in blocks: a first pass counts each block's records, from which the driver knows
    where the next one begins; only a record that stands in two blocks is put together by a shuffle."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "^\ufeff", "").alias("line"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # for both states that a block may begin in: records that begin in it, and the state after it
        at, n, state = None, [0, 0], [False, True]
        out = []
        for b in batches:
            for file, start, line in zip(b["file"], b["start"], b["line"]):
                if (file, start) != at:
                    if at:
                        out.append((*at, *n, *state))
                    at, n, state = (file, start), [0, 0], [False, True]
                n = [k + (not s) for k, s in zip(n, state)]
                state = [quote_open(line, s) for s in state]
        if at:
            out.append((*at, *n, *state))
        yield pd.DataFrame(out, columns=["file", "start", "n0", "n1", "s0", "s1"])

    blocks = lines.mapInPandas(count, "file string, start bigint, n0 bigint, n1 bigint, s0 boolean, s1 boolean").collect()  # a row for each block
    begin: dict[tuple[str, int], tuple[int, bool]] = {}
    total, last, row, open_ = 0, None, 0, False
    for b in sorted(blocks):
        if b["file"] != last:
            if open_:
                raise ValueError(f"a quote is not closed in {last}")
            last, row = b["file"], 0
        begin[b["file"], b["start"]] = (row, open_)
        n = b["n1"] if open_ else b["n0"]
        row, total, open_ = row + n, total + n, b["s1"] if open_ else b["s0"]
    if open_:
        raise ValueError(f"a quote is not closed in {last}")
    if total > max_records:
        raise ValueError(f"more than {max_records} records")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a block's lines by record; whole is false for what may go on in another block
        at, row, open_, held, first = None, 0, False, [], False
        for b in batches:
            out = []
            for file, start, line in zip(b["file"], b["start"], b["line"]):
                if (file, start) != at:
                    if held:
                        out.append((*at, row, "\n".join(held), False))
                    at, held = (file, start), []
                    row, open_ = begin[at]
                    first = open_
                if not open_:
                    row += 1
                held.append(line)
                open_ = quote_open(line, open_)
                if not open_:
                    out.append((*at, row, "\n".join(held), not first))
                    held, first = [], False
            yield pd.DataFrame(out, columns=["file", "start", "row", "text", "whole"])
        if held:
            yield pd.DataFrame([(*at, row, "\n".join(held), False)], columns=["file", "start", "row", "text", "whole"])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for b in batches:
            done = []
            for row, text in zip(b["row"], b["text"]):
                cells = next(csv.reader([text]), [])
                if len(cells) > MAX_COLUMNS:
                    raise ValueError(f"more than {MAX_COLUMNS} cells in row {row}")
                done.append(" | ".join([f"Row {row}", *[f"{_label(i)}{row}: {v.strip()}" for i, v in enumerate(cells) if v.strip()]]))
            yield pd.DataFrame({"file": b["file"], "row": b["row"], "line": done})

    parts = lines.mapInPandas(pieces, "file string, start bigint, row int, text string, whole boolean")
    torn = parts.where("not whole").groupBy("file", "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "text")))["text"], "\n").alias("text"))
    return parts.where("whole").select("file", "row", "text").union(torn).mapInPandas(label, "file string, row int, line string")


def _label(i: int) -> str:
    """As ``column_label``, of a number."""
    out, i = "", i + 1
    while i:
        i, at = divmod(i - 1, 26)
        out = chr(65 + at) + out
    return out


def column_label(i) -> F.Column:
    """0 -> A, 25 -> Z, 26 -> AA, 701 -> ZZ: bijective base 26, for columns up to ZZZ."""
    letter = lambda n: F.chr((F.lit(65) + n).cast("long"))
    i = i if isinstance(i, F.Column) else F.lit(i)
    one, two = i, i - 26
    three = i - 26 - 676
    return (
        F.when(i < 26, letter(one))
        .when(two < 676, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a given schema; what does not parse goes to ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)
