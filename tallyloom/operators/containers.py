"""Does a container's description name a candidate?  And which saved batches cover a run of pages?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.staging import staged
from ..registry import query
from ..sources.tables import table
from .overlap import few
from .text_queries import TOKENS_SQL

#: Words that say nothing of what is contained, and the least length of words that may differ by an edit.
STOP = "a an and at explore for in inside of the visit with within".split()
FUZZY_LENGTH = 6
#: Up to so many candidates are sent to every task; beyond that their tokens and those of descriptions are sorted.
FEW = 100_000


def naming_tokens(c: Column) -> Column:
    return F.filter(T.tokens(c), lambda x: ~x.isin(*STOP))


def names(own: Column, said: Column) -> Column:
    """Can each of a candidate's tokens (``own``) have a description's token (``said``) of its own: equal, but for one at most, which may be
    one edit apart if both have six letters or more and begin and end alike, and if another is equal?

    With one inexact pair at most, the best assignment is a count: no token lacks an equal one, or one does, once, and some
    token that the others leave over is close to it."""
    count = lambda x, of: F.size(F.filter(of, lambda y: y == x))
    lacking = F.filter(F.array_distinct(own), lambda x: count(x, own) > count(x, said))
    alike = lambda x, y: (F.least(F.length(x), F.length(y)) >= FUZZY_LENGTH) & (F.left(x, F.lit(2)) == F.left(y, F.lit(2))) & (F.right(x, F.lit(2)) == F.right(y, F.lit(2))) & T.one_edit(x, y)
    spare = lambda x: F.exists(F.filter(F.array_distinct(said), lambda y: alike(x, y)), lambda y: count(y, said) > count(y, own))
    fuzzy = (F.size(lacking) == 1) & (F.size(own) >= 2) & F.exists(lacking, lambda x: (count(x, own) == count(x, said) + 1) & spare(x))
    return (F.size(own) > 0) & (F.size(F.array_except(own, said)) <= 1) & ((F.size(lacking) == 0) | fuzzy)


def named_in(candidates: DataFrame, descriptions: DataFrame) -> DataFrame:
    """candidate and container of every candidate (candidate, title) that a description (container, text) names; each pair once.

    All of a candidate's tokens but one at most stand in the description, so of any two one does.  Candidates whose tokens are few are
    sent to every task, which reads descriptions once and deals none out; more are joined by their two rarest tokens.  Ids are unique;
    null and empty titles are named nowhere."""
    c = staged(candidates.select("candidate", naming_tokens(F.col("title")).alias("own")).where(F.size("own") > 0), "titles")
    return _named_within(c, descriptions) if few((c, "own")) else _named_by_rarest(c, descriptions)


#: Tokens of candidates that are looked up at a time, unless one description alone asks for more.
PLACES = 1 << 20


def _one_edit(a: str, b: str) -> bool:
    """Exactly one insertion, deletion or substitution apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class _Alike(dict):
    """word -> numbers of the candidates' words that it may stand for though they differ by an edit.  Cleared when over ``limit`` words."""

    def __init__(self, words: list[str], limit: int = 300_000) -> None:
        super().__init__()
        self.limit, self.by_ends = limit, {}
        for i, w in enumerate(words):
            if len(w) >= FUZZY_LENGTH:
                self.by_ends.setdefault((w[:2], w[-2:]), []).append((i, w))

    def __missing__(self, word: str) -> list[int]:
        if len(self) > self.limit:
            self.clear()
        of = self.by_ends.get((word[:2], word[-2:]), ()) if len(word) >= FUZZY_LENGTH and word not in STOP else ()
        self[word] = found = [i for i, w in of if _one_edit(w, word)]
        return found


class _Titles:
    """Candidates' tokens by number, for the descriptions of a batch at a time."""

    def __init__(self, own: pa.Array) -> None:
        flat, of = pc.list_flatten(own).cast(pa.large_string()).dictionary_encode(), pc.list_parent_indices(own).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = flat.dictionary
        place = np.unique(of * len(self.words) + flat.indices.to_numpy(zero_copy_only=False))
        self.of, self.word = np.divmod(place, max(len(self.words), 1))
        self.size = np.bincount(self.of, minlength=len(own))
        self.first = np.cumsum(self.size) - self.size
        self.repeats = self.size < pc.list_value_length(own).to_numpy(zero_copy_only=False)
        self.alike = _Alike(self.words.to_pylist())

    def found(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of ``texts`` (normalised) and candidates that may be named there: all tokens but one stand there, and for that one a word
        an edit apart; and whether they are named for sure."""
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        row, coded = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(parts).dictionary_encode()
        code, known = coded.indices.to_numpy(zero_copy_only=False), pc.index_in(coded.dictionary, self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        n = max(len(self.words), 1)
        place = known[code]
        said = np.unique((row * n + place)[place >= 0])
        alike = list(map(self.alike.__getitem__, coded.dictionary.to_pylist()))
        many = np.array([len(x) for x in alike], dtype=np.int64)
        of_word = np.array([i for x in alike for i in x], dtype=np.int64)
        c = many[code]
        nearly = np.unique(np.repeat(row, c) * n + of_word[np.repeat((np.cumsum(many) - many)[code] - np.cumsum(c) + c, c) + np.arange(c.sum())])
        # the two tokens of each candidate that the fewest of these texts have
        rank = np.bincount(said % n, minlength=n)[self.word]
        order = np.lexsort((rank, self.of))
        key = order[np.arange(len(order)) - self.first[self.of] < 2]
        key = key[np.argsort(self.word[key], kind="stable")]
        bounds = np.searchsorted(self.word[key], np.arange(n + 1))
        at, of_word = np.divmod(said, n)
        asks = bounds[of_word + 1] - bounds[of_word]
        upto, lo = np.cumsum(asks), 0
        edges = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
        while lo < len(at):
            fits = np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PLACES // 8, "right")
            hi = edges[np.searchsorted(edges, fits, "right") - 1]
            hi = hi if hi > lo else edges[np.searchsorted(edges, lo, "right")]
            c = asks[lo:hi]
            hit = key[np.repeat(bounds[of_word[lo:hi]] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            pair = np.unique(np.repeat(at[lo:hi], c) * len(self.size) + self.of[hit])
            text, of = np.divmod(pair, len(self.size))
            lo = hi
            # its tokens, each there or not
            c = self.size[of]
            token = self.word[np.repeat(self.first[of] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            which = np.repeat(np.arange(len(of)), c)
            there = _among(text[which] * n + token, said)
            lacks = np.bincount(which[~there], minlength=len(of))
            near = ~there & (lacks[which] == 1) & (c[which] >= 2)
            near[near] = _among(text[which[near]] * n + token[near], nearly)
            ok = lacks == 0
            sure = ok & ~self.repeats[of]
            ok[which[near]] = True
            yield text[ok], of[ok], sure[ok]


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _named_within(c: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``named_in`` of few candidates (candidate, own): only what numbers of tokens leave open is compared word by word."""
    sent = c.toArrow().combine_chunks()
    kinds = f"candidate {dict(c.dtypes)['candidate']}, container {dict(descriptions.dtypes)['container']}"
    if not len(sent):
        return c.sparkSession.createDataFrame([], kinds)
    ids, own = (sent.column(x).combine_chunks() for x in ("candidate", "own"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        titles = _Titles(own)
        for b in batches:
            for text, of, sure in titles.found(b.column("text")):
                open_ = pa.array(sure)
                said, its = b.column("text").take(pa.array(text)), own.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), b.column("container").take(pa.array(text)), pc.if_else(open_, pa.scalar(None, its.type), its), pc.if_else(open_, pa.scalar(None, said.type), said)], ["candidate", "container", "own", "said"])

    # an & is normalised to a word that says nothing, so these are the description's tokens and such words
    texts = descriptions.select("container", T.normalize(F.col("text")).alias("text")).where("text != ''")
    found = texts.mapInArrow(pairs, f"{kinds}, own array<string>, said string")
    return found.where(F.col("said").isNull() | names(F.col("own"), naming_tokens(F.col("said")))).select("candidate", "container")


def _named_by_rarest(c: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``named_in`` by joins.  Up to ``FEW`` candidates are still sent to every task, and one of one token is named where that stands; only
    descriptions that have a key of another are dealt out."""
    d = descriptions.select("container", naming_tokens(F.col("text")).alias("said"))
    so_few = c.count() <= FEW
    small = lambda df: F.broadcast(df) if so_few else df
    own, said = c.select("candidate", F.explode(F.array_distinct("own")).alias("token")), d.select("container", F.explode(F.array_distinct("said")).alias("token"))
    seen = said.join(small(own.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    rare = own.join(seen, "token", "left").groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token"))).alias("t"))
    keys = rare.select("candidate", F.explode(F.slice("t", 1, 2)["token"]).alias("token")).join(c.select("candidate", (F.size("own") == 1).alias("alone")), "candidate")
    keys = staged(keys, "rare-tokens")
    near = said.join(F.broadcast(keys), "token") if so_few else keys.join(said.hint("merge"), "token")
    alone = near.where("alone").select("candidate", "container")
    near = near.where("not alone").select("candidate", "container").distinct()
    both = near.join(d, "container").join(small(c), "candidate")
    return alone.union(both.where(names(F.col("own"), F.col("said"))).select("candidate", "container"))


_NAMING = "list_filter(" + TOKENS_SQL + ", lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP) + "], x))"


@query(f"""WITH b AS (SELECT item_id, unnest(regexp_split_to_array(text, '[,;.\\n]')) AS clause, generate_subscripts(regexp_split_to_array(text, '[,;.\\n]'), 1) - 1 AS pos FROM benchmark),
c AS MATERIALIZED (SELECT item_id, pos, {_NAMING.format("clause")} AS own FROM b), dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
d AS MATERIALIZED (SELECT doc_id, n, {_NAMING.format("line")} AS said FROM dl),
p AS (SELECT *, list_filter(list_distinct(own), lambda x: len(list_filter(own, lambda y: y = x)) > len(list_filter(said, lambda z: z = x))) AS lacking FROM c JOIN d ON len(own) > 0 AND len(list_filter(list_distinct(own), lambda x: NOT list_contains(said, x))) <= 1),
k AS (SELECT item_id, pos, doc_id, n FROM p WHERE len(lacking) = 0 OR (len(lacking) = 1 AND len(own) >= 2 AND len(list_filter(own, lambda y: y = lacking[1])) = len(list_filter(said, lambda z: z = lacking[1])) + 1
  AND len(list_filter(list_distinct(said), lambda s: len(list_filter(said, lambda y: y = s)) > len(list_filter(own, lambda z: z = s)) AND least(length(s), length(lacking[1])) >= {FUZZY_LENGTH} AND s[:2] = lacking[1][:2] AND s[-2:] = lacking[1][-2:] AND levenshtein(s, lacking[1]) = 1)) > 0))
SELECT item_id, CAST(pos AS INTEGER) AS pos, count(*) AS n_lines, min(doc_id) AS first_doc FROM k GROUP BY item_id, pos""")
def clauses_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clauses of benchmark items lines of documents name, and in how many."""
    c = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[,;.\n]")).alias("pos", "title")).select(F.struct("item_id", "pos").alias("candidate"), "title")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select(F.struct("doc_id", "n").alias("container"), "text")
    return named_in(c, d).groupBy("candidate").agg(F.count("*").alias("n_lines"), F.min("container.doc_id").alias("first_doc")).select("candidate.item_id", "candidate.pos", "n_lines", "first_doc")


def page_cover(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """doc, batches of each request (doc, first, last): of batches (doc, batch, start, stop, text) those that cover its pages, each beginning
    where the one before ends and reaching as far as any that stays within; null if a page is left over or there are none.

    From each page a jump leads to the page after the batch that begins there.  In each round the pages reached jump as far as the
    last round's jumps lead, and the jumps double, so a run of n batches takes log2 n rounds; no row waits for another.  Batches
    with blank text don't count; of batches that end alike the smallest id is taken.  A doc is requested once."""
    doc = requests.select("doc", "first", "last").where("first <= last")
    usable = batches.where("trim(text) != '' and start <= stop").join(doc, "doc").where("start >= first and stop <= last")
    jumps = usable.groupBy("doc", F.col("start").cast("long").alias("page")).agg(F.min(F.struct((-F.col("stop")).alias("far"), "batch")).alias("b"))
    jumps = staged(jumps.select("doc", "page", (1 - F.col("b.far")).cast("long").alias("to"), "b.batch"), "jumps")
    reached, far = staged(doc.select("doc", F.col("first").cast("long").alias("page")), "reached"), jumps.select("doc", "page", "to")
    steps = jumps.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(steps).bit_length()):
        reached = staged(reached.union(reached.join(far, ["doc", "page"]).select("doc", F.col("to").alias("page"))).distinct(), "reached")
        far = staged(far.join(far.select("doc", F.col("page").alias("to"), F.col("to").alias("beyond")), ["doc", "to"]).select("doc", "page", F.col("beyond").alias("to")), "far")
    path = reached.join(jumps, ["doc", "page"]).groupBy("doc").agg(F.max("to").alias("end"), F.array_sort(F.collect_list(F.struct("page", "batch")))["batch"].alias("batches"))
    return requests.select("doc", "last").join(path, "doc", "left").select("doc", F.when(F.col("end") == F.col("last") + 1, F.col("batches")).alias("batches"))


@query("""WITH RECURSIVE b AS (SELECT l_partkey AS doc, CAST(l_quantity AS BIGINT) AS start, least(50, CAST(l_quantity AS BIGINT) + CAST(floor(l_extendedprice) AS BIGINT) % 9) AS stop, l_orderkey AS batch FROM lineitem WHERE l_returnflag <> 'A'),
q AS (SELECT doc, min(start) AS first, max(start) AS last FROM b GROUP BY doc), u AS (SELECT b.* FROM b JOIN q USING (doc) WHERE stop <= last),
j AS (SELECT doc, start, max(stop) + 1 AS nxt, arg_min(batch, (-stop, batch)) AS batch FROM u GROUP BY doc, start),
p(doc, page, n, ids) AS (SELECT doc, first, 0, CAST([] AS BIGINT[]) FROM q UNION ALL SELECT p.doc, j.nxt, p.n + 1, list_append(p.ids, j.batch) FROM p JOIN j ON j.doc = p.doc AND j.start = p.page),
e AS (SELECT p.doc, n, ids FROM p JOIN q ON q.doc = p.doc AND page = last + 1)
SELECT q.doc AS part, CAST(n AS INTEGER) AS n_batches, array_to_string(ids, ',') AS batches FROM q LEFT JOIN e USING (doc)""")
def pages_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether shipments of a part, as batches of pages from their quantity on, cover all from the least quantity to the largest."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag != 'A'")
    start = F.col("l_quantity").cast("long")
    b = li.select(F.col("l_partkey").alias("doc"), F.col("l_orderkey").alias("batch"), start.alias("start"), F.least(F.lit(50).cast("long"), start + F.floor("l_extendedprice") % 9).alias("stop"), F.col("l_returnflag").alias("text"))
    q = b.groupBy("doc").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    return page_cover(q, b).select(F.col("doc").alias("part"), F.size("batches").alias("n_batches"), F.array_join("batches", ",").alias("batches")).withColumn("n_batches", F.when(F.col("batches").isNotNull(), F.col("n_batches")))
