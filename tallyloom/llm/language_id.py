"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes of a fixed-length window are embedded, filters of several widths slide over them, each keeps its
largest response (rectified), and a softmax over these features gives the window's language.  A text is
cut into windows from its first byte to its last; their scores are averaged by the bytes they hold.

Training takes a bounded sample (``SAMPLE_PER_LANGUAGE`` documents of each language, a piece of
each length in ``PIECES``); prediction covers every byte of every row.  For prediction the products of embeddings and filters
are tabled by byte pair, which gives the network's responses by look-up.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text if no row is
labelled, and an empty table gives none.  A letter is one of any script; digits, fractions and numerals are none.  Short texts are padded
to a window; very long ones are read to their end, in batches bounded in bytes.  Repeated rows give repeated results; other columns are
not read, and the label, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hidden, small_batches, table

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 8, 8
#: Documents of each language in the sample; characters of the pieces taken of each, short ones for short texts.
SAMPLE_PER_LANGUAGE, PIECES = 800, (WINDOW, 96, 32)
EPOCHS, BATCH, RATE = 5, 64, 0.01
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    """Of any script (general category L, as ``\\p{L}`` has it when the sample is taken); digits and signs of number are none."""
    return bool(text) and any(map(str.isalpha, text))


class ByteNet:
    """Parameters: ``embed`` [256, E], per width ``w`` [width * E, F] and ``b`` [F], ``out`` [features, classes], ``bias``."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.w = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def _params(self) -> list[np.ndarray]:
        return [self.embed, *self.w, *self.b, self.out, self.bias]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> ByteNet:
        """``x`` [n, WINDOW] bytes, ``y`` [n] class numbers; Adam on the mean cross-entropy."""
        rng = np.random.default_rng(seed)
        params = self._params()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                t += 1
                for i, g in enumerate(self._gradients(x[rows], y[rows])):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    params[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, rows = len(x), np.arange(len(x))[:, None]
        e = self.embed[x]
        windows, best, features = [], [], []
        for w, weight, bias in zip(WIDTHS, self.w, self.b):
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBEDDING)
            response = cols @ weight + bias
            at = response.argmax(1)
            windows.append(cols[rows, at])
            best.append(at)
            features.append(np.maximum(np.take_along_axis(response, at[:, None, :], 1)[:, 0], 0))
        f = np.concatenate(features, 1)
        logits = f @ self.out + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        df = (p @ self.out.T) * (f > 0)
        d_embed, dw, db = np.zeros_like(self.embed), [], []
        for k, (w, weight) in enumerate(zip(WIDTHS, self.w)):
            d = df[:, k * FILTERS : (k + 1) * FILTERS]
            dw.append(np.einsum("nf,nfk->kf", d, windows[k]))
            db.append(d.sum(0))
            back = (d[:, :, None] * weight.T[None]).reshape(n, FILTERS, w, EMBEDDING)
            for i in range(w):
                np.add.at(d_embed, x[rows, best[k] + i], back[:, :, i])
        return [d_embed, *dw, *db, f.T @ p, p.sum(0)]

    def tables(self) -> None:
        """Responses by byte pair (and, for the third of three, by byte)."""
        part = lambda k, i: self.embed @ self.w[k][i * EMBEDDING : (i + 1) * EMBEDDING]
        pair = lambda k, i: (part(k, i)[:, None] + part(k, i + 1)[None]).reshape(65536, FILTERS)
        self.pairs = [[(i, pair(k, i)) for i in range(0, w - 1, 2)] for k, w in enumerate(WIDTHS)]
        self.singles = [[(w - 1, part(k, w - 1))] if w % 2 else [] for k, w in enumerate(WIDTHS)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """[n, classes] of windows [n, WINDOW]."""
        code = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        features = []
        for k, w in enumerate(WIDTHS):
            n = WINDOW - w + 1
            response = sum([t.take(code[:, i : i + n], 0) for i, t in self.pairs[k]][1:], self.pairs[k][0][1].take(code[:, :n], 0))
            for i, t in self.singles[k]:
                response += t.take(x[:, i : i + n], 0)
            features.append(np.maximum(response.max(1) + self.b[k], 0))
        return np.concatenate(features, 1) @ self.out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        data = [t.encode("utf-8", "surrogatepass") if has_letter(t) else b"" for t in texts]
        counts = [-(-len(d) // WINDOW) for d in data]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(data):  # some 256 windows at a time, but a text is not parted
            end, total = at, 0
            while end < len(data) and (total == 0 or total + counts[end] <= 256):
                total += counts[end]
                end += 1
            if total:
                padded = b"".join([d.ljust(c * WINDOW, b"\0") for d, c in zip(data[at:end], counts[at:end])])
                x = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
                logits = np.concatenate([self.logits(x[i : i + 256]) for i in range(0, len(x), 256)])
                held = (x != 0).sum(1, dtype=np.int64)[:, None] + 1
                owners = np.repeat(np.arange(at, end), counts[at:end])
                starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
                mean = np.add.reduceat(logits * held, starts) / np.add.reduceat(held, starts)
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for owner, row in zip(owners[starts], p):
                    langs[owner], scores[owner] = self.classes[int(row.argmax())], float(row.max())
            at = end
        return langs, scores


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteNet | None:
    """A network from the labelled rows that are not held out; None if there are none.
    What the driver collects is bounded: so many pieces of so many documents of each language."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, SAMPLE_PER_LANGUAGE / n) * 1_000_000))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < shares[F.col(label_col)])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    start = lambda n: F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(n)), F.greatest(F.length(text) - n, F.lit(1)))
    pieces = chosen.select(F.col(label_col).alias("label"), F.explode(F.array(*[F.substring(text, (start(n) + 1).cast("int"), F.lit(n)) for n in PIECES])).alias("piece"))
    rows = pieces.where(F.col("piece").rlike(r"\p{L}")).orderBy(F.xxhash64("piece"), "piece", "label").limit(2 * len(PIECES) * SAMPLE_PER_LANGUAGE * len(counts)).collect()
    if not rows:
        return None
    classes = sorted({r["label"] for r in rows})
    x = np.frombuffer(b"".join(r["piece"].encode("utf-8", "replace")[:WINDOW].ljust(WINDOW, b"\0") for r in rows), np.uint8).reshape(-1, WINDOW)
    return ByteNet(classes).train(x, np.array([classes.index(r["label"]) for r in rows]))


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score``, in place of such as are there."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand numbers

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        network = shared.value
        if network is not None and not hasattr(network, "pairs"):
            network.tables()
        for texts in batches:
            texts = texts.tolist()
            langs, scores = network.predict(texts) if network else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    udf = F.pandas_udf(predict, "lang_pred string, score double")
    (name,) = hidden(docs, "p")
    predicted = docs.withColumn(name, udf(F.col(text_col).cast("string")))
    return predicted.select(*[F.col(c) for c in docs.columns if c not in (lang, score)], F.col(f"{name}.lang_pred").alias(lang), F.col(f"{name}.score").alias(score))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
