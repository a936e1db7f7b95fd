"""Exact SentencePiece BPE by a table of last tokens.

For each prefix of a text there is one last token that its encoding can end with.  An automaton over
the vocabulary lists the tokens that end at a place; a token is the last one there if it may stand
next to the last token of the prefix before it, that is, if the two pieces' text alone is encoded as
just these two.  The ids are then read backwards through the table.

The model file (a vocabulary with scores, byte pieces, a dummy prefix, no other normalisation) is read
here; the library itself is used in tests only.  A piece holds the space mark only at its front, and
letters and signs share no piece, so a run of marks with the letters or signs after it is encoded alone,
and equal runs are encoded once per task up to a bound in bytes on what is remembered.  Characters in no piece
become byte pieces.

Edge cases: a null text is empty and gives the end id alone; very long words cost time in proportion;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

MARK = "▁"
#: What a worker remembers: within a task, bytes of words in each of two generations, about; and token pairs.
MAX_BYTES, MAX_PAIRS = 96 << 20, 1_000_000
#: Bytes that a remembered word takes besides its texts.
WORD_BYTES = 350
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.surface: list[bytes] = []
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                piece, kind = entry[1].decode(), entry.get(3, _NORMAL)
                i = len(self.pieces)
                self.pieces.append(piece)
                surface = b""
                if kind == _NORMAL:
                    self.id[piece] = i
                    self.score[piece] = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
                    surface = piece.replace(MARK, " ").encode()
                elif kind == _BYTE:
                    b = int(piece[3:5], 16)
                    self.byte_id[b] = i
                    surface = bytes([b])
                elif kind == _UNKNOWN:
                    surface = " ⁇ ".encode()
                elif kind == _CONTROL and piece == "</s>":
                    self.end_id = i
                self.surface.append(surface)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has the space mark inside")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.start = len(self.pieces)
        self.size = [len(p) for p in self.pieces]
        self.written = [f"{i} " for i in range(len(self.pieces))]
        self.held = 0
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}
        self.splitter = self._splitter()

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost of equals: for the short texts of pair tests."""
        parts: list[str | None] = list(text)
        nxt = list(range(1, len(parts) + 1))
        prv = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and (b := nxt[a]) < len(parts) and (both := parts[a] + parts[b]) in self.score:
                heapq.heappush(heap, (-self.score[both], a, b, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or nxt[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            nxt[a] = nxt[b]
            if nxt[a] < len(parts):
                prv[nxt[a]] = a
            offer(prv[a])
            offer(a)
        return [p for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``?  With ``left`` the start: may it stand alone?"""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        alone = [self.pieces[i] for i in (left, right) if i != self.start]
        known = self.pairs[left << 32 | right] = self.merged("".join(alone)) == alone
        return known

    def encode_run(self, text: str) -> list[int] | None:
        """Ids of a text whose characters are all pieces; None if one is not."""
        last = [-1] * (len(text) + 1)  # the last token of each prefix
        last[0] = self.start
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] < 0 and (left := last[end + 1 - size]) >= 0:
                ok = pairs.get(left << 32 | token)
                if self.compatible(left, token) if ok is None else ok:
                    last[end + 1] = token
        ids = []
        i = len(text)
        while i > 0:
            token = last[i]
            if token < 0:
                return None
            ids.append(token)
            i -= self.size[token]
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> list[int]:
        ids = self.encode_run(word)
        if ids is not None:
            return ids
        ids = []
        for known, run in itertools.groupby(word, self.id.__contains__):
            if known:
                ids += self.encode_run("".join(run))
            else:
                ids += [self.byte_id[b] for b in "".join(run).encode("utf-8", "surrogatepass")]
        return ids

    def known_word(self, word: str) -> tuple[str, int, bytes]:
        """The ids written with a space after each, their number, and the bytes they stand for.
        Remembered in two generations: when the younger is full it becomes the older."""
        out = self.older.get(word)
        if out is None:
            ids = self.encode_word(word)
            out = ("".join([self.written[i] for i in ids]), len(ids), b"".join([self.surface[i] for i in ids]))
        if len(word) <= 64:
            self.held += WORD_BYTES + len(word) + len(out[0]) + len(out[2])
            if self.held > MAX_BYTES:
                self.words, self.older, self.held = {}, self.words, 0
            self.words[word] = out
        return out

    def forget(self) -> None:
        """At the end of a task, so that an idle worker holds the model and its pairs alone."""
        self.words, self.older, self.held = {}, {}, 0

    def _splitter(self) -> re.Pattern:
        """Runs that no piece spans the ends of: marks with letters, marks with signs, newlines.
        Signs are the ASCII ones that stand in pieces beside signs and marks only."""
        signs = {chr(c) for c in range(128) if not chr(c).isalnum()} - {"\n"}
        beside = {(a, b) for p in self.id for a, b in itertools.pairwise(p)} - {(MARK, MARK)}
        while mixed := {c for a, b in beside for c in (a, b) if c in signs and not {a, b} <= signs | {MARK}}:
            signs -= mixed
        newline = "" if any("\n" in p for p in self.id) else "\n"
        sign = re.escape("".join(sorted(signs)))
        return re.compile(f"{MARK}*(?:[^{MARK}{newline}{sign}]+|[{sign}]+)|{MARK}+" + "|\n+" * bool(newline))

    def split(self, text: str) -> list[str]:
        """The runs of a text, the dummy prefix in front."""
        return self.splitter.findall(MARK + text.replace(" ", MARK)) if text else []

    def encoded(self, text: str | None) -> tuple[str, int, str]:
        """(ids written with single spaces, the end id included; their number; the decoded text)."""
        known = self.known_word
        parts = [self.words.get(w) or known(w) for w in self.split(text or "")]
        surface = b"".join([p[2] for p in parts])
        return "".join([p[0] for p in parts]) + str(self.end_id), sum([p[1] for p in parts]) + 1, self._text(surface)

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.split(text or "") for i in self.encode_word(w)] + [self.end_id]

    def decode(self, ids: list[int]) -> str:
        return self._text(b"".join([self.surface[i] for i in ids]))

    @staticmethod
    def _text(surface: bytes) -> str:
        """The dummy prefix goes; bytes that are no UTF-8 become replacement characters."""
        return surface.removeprefix(b" ").decode("utf-8", "replace")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    return _models.get(path) or _models.setdefault(path, PieceModel(path))


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenize(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, ids and decoded text of every row."""
    small_batches(docs.sparkSession)
    path = model_path or default_model_path()
    kind = dict(docs.dtypes)[id_col]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        try:
            for b in batches:
                rows = []
                for text in b["text"]:
                    ids, n, decoded = m.encoded(text)
                    row = [n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()]
                    rows.append([*row, [int(i) for i in ids.split()], decoded] if with_ids else row)
                columns = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3]
                out = pd.DataFrame(rows, columns=columns, index=b.index)
                out.insert(0, id_col, b[id_col])
                yield out
        finally:
            m.forget()

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInPandas(encode, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), with_ids=False)
