"""Which texts share how many distinctive tokens with which sets of tokens.

Sets that are not too many are sent to every task, which numbers the words of a batch of texts and adds up what each text shares; no text is
shuffled.  More of them are joined by their rarest tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.staging import staged

#: Tokens, or values, up to so many and of so many characters in all are sent to every task.
FEW, FEW_CHARACTERS = 100_000, 16_000_000
#: Places of sets that are looked up at a time, unless one text alone has more.
PLACES = 1 << 20


def few(*of: tuple[DataFrame, str]) -> bool:
    """Is each column of strings, or of arrays of them, that small?"""
    for df, c in of:
        values = df.select(F.explode(c).alias("x") if dict(df.dtypes)[c].startswith("array") else F.col(c).alias("x"))
        n, characters = values.agg(F.count("*"), F.sum(F.length("x"))).first()
        if n > FEW or (characters or 0) > FEW_CHARACTERS:
            return False
    return True


def _words(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct distinctive tokens each normalised text has; and row and place in ``vocabulary`` of those found there, by row."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
    row, coded = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts).dictionary_encode()
    word, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    tells = pc.and_(pc.greater_equal(pc.binary_length(word), 4), pc.match_substring_regex(word, "[^0-9]"))
    tells = pc.and_not(tells, pc.is_in(word, pa.array(T.LINE_STOPWORDS, word.type))).to_numpy(zero_copy_only=False)
    at = pc.index_in(word, vocabulary.cast(word.type)).fill_null(-1).to_numpy(zero_copy_only=False)
    told = tells[code]
    pair = np.sort(row[told].astype(np.int64) * len(word) + code[told])  # numpy's unique is far slower here
    row, code = np.divmod(pair[np.diff(pair, prepend=-1) != 0], max(len(word), 1))
    known = at[code] >= 0
    return np.bincount(row, minlength=len(texts)), row[known], at[code[known]]


def asked_for(texts: DataFrame, values: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of ``texts`` (text, normalised, and other columns) whose text is one of ``values`` (value) or of whose distinctive tokens half, one at least, are
    among ``tokens`` (token).  Values or tokens too many to be sent to every task leave nothing out."""
    if not few((values, "value"), (tokens, "token")):
        return texts
    whole, vocabulary = (pc.unique(df.toArrow().column(0).combine_chunks()) for df in (values, tokens))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            n, row, _ = _words(text, vocabulary)
            half = (n > 0) & (2 * np.bincount(row, minlength=len(text)) >= n)
            yield b.filter(pc.or_(pc.is_in(text, whole.cast(text.type)), pa.array(half)))

    return texts.mapInArrow(keep, texts.schema)


def sharing(texts: DataFrame, sets: DataFrame, half_of: str) -> DataFrame:
    """id, set, matched, n of texts (id, block, text: normalised) and sets (set, block, tokens: distinct ones) of the same block that share half of the
    distinctive tokens of the one that ``half_of`` names (text or set), one at least: how many they share and how many that one has."""
    sets = staged(sets.select("set", "block", "tokens").where("size(tokens) > 0"), "sets")
    if not few((sets, "tokens"), (sets, "block")):
        return _by_rarest(texts, sets, half_of)
    schema = f"id {dict(texts.dtypes)['id']}, set {dict(sets.dtypes)['set']}, matched int, n int"
    sent = sets.toArrow().combine_chunks()
    if not len(sent):
        return sets.sparkSession.createDataFrame([], schema)
    of_set, blocks = (sent.column(c).combine_chunks() for c in ("set", "block"))
    tokens = sent.column("tokens").combine_chunks()
    size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    flat, owner = pc.list_flatten(tokens).dictionary_encode(), pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary, blocks = flat.dictionary, blocks.dictionary_encode()
    place = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(blocks.dictionary) + blocks.indices.to_numpy(zero_copy_only=False)[owner]
    order = np.argsort(place, kind="stable")
    places, first, count = np.unique(place[order], return_index=True, return_counts=True)
    owner, blocks = owner[order], blocks.dictionary

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, row, word = _words(b.column("text"), vocabulary)
            block = pc.index_in(b.column("block"), blocks.cast(b.column("block").type)).fill_null(-1).to_numpy(zero_copy_only=False)[row]
            at = word.astype(np.int64) * len(blocks) + block
            k = np.minimum(np.searchsorted(places, at), len(places) - 1)
            same = (block >= 0) & (places[k] == at)
            row, k = row[same], k[same]
            # cut where a text begins, so that each is whole
            upto, edges, lo = np.cumsum(count[k]), np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row)), 0
            while lo < len(row):
                fits = np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PLACES, "right")
                hi = edges[np.searchsorted(edges, fits, "right") - 1]
                hi = hi if hi > lo else edges[np.searchsorted(edges, lo, "right")]
                c = count[k[lo:hi]]
                of = owner[np.repeat(first[k[lo:hi]] - np.cumsum(c) + c, c) + np.arange(c.sum())]
                pair, matched = np.unique(np.repeat(row[lo:hi], c) * len(size) + of, return_counts=True)
                text, of = np.divmod(pair, len(size))
                total = n[text] if half_of == "text" else size[of]
                ok = 2 * matched >= total
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(text[ok])), of_set.take(pa.array(of[ok])), pa.array(matched[ok], pa.int32()), pa.array(total[ok], pa.int32())], ["id", "set", "matched", "n"])
                lo = hi

    return texts.select("id", "block", "text").mapInArrow(pairs, schema)


def _by_rarest(texts: DataFrame, sets: DataFrame, half_of: str) -> DataFrame:
    """``sharing`` by joins.  Half of the tokens can't be shared without one of the rarest, as many as are left when the half but one is taken away."""
    t = staged(texts.select("id", "block", F.array_distinct(T.distinctive_tokens(F.col("text"))).alias("tokens")), "texts")
    own, its, other, key = (t, "id", sets, "set") if half_of == "text" else (sets, "set", t, "id")
    of_own = own.select(its, "block", F.explode("tokens").alias("token"))
    of_other = other.select(key, "block", F.explode("tokens").alias("token"))
    seen = of_other.join(of_own.select("block", "token").distinct(), ["block", "token"], "left_semi").groupBy("block", "token").agg(F.count("*").alias("seen"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")))
    rare = of_own.join(seen, ["block", "token"], "left").groupBy(its, "block").agg(order.alias("o"))
    rare = rare.select(its, "block", F.explode(F.expr("slice(o, 1, size(o) - int(ceil(size(o) / 2)) + 1)")).alias("k")).where("k.seen > 0").select(its, "block", F.col("k.token").alias("token"))
    near = rare.join(of_other, ["block", "token"]).select("id", "set", "block").distinct()
    both = near.join(sets.withColumnRenamed("tokens", "of_set"), ["set", "block"]).join(t.withColumnRenamed("tokens", "of_text"), ["id", "block"])
    shared = both.select("id", "set", F.size(F.array_intersect("of_set", "of_text")).alias("matched"), F.size(f"of_{half_of}").alias("n"))
    return shared.where("2 * matched >= n")
