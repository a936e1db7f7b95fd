"""Transport anchors (what a source says of a flight, train or bus) matched with records, and folded into one anchor for each segment.

A match is a ladder of eight rungs, any of which suffices.  Each rung implies that the two sides share some key: a clock time, a confirmation, a number
that the other's text holds, or tokens.  A small block's pairs are all judged; of a large one they come from one join by key for each of these, and are then
judged by the whole ladder, once each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.staging import bucketed, partitions, staged
from ..registry import query
from ..sources.tables import table
from .containment import SHORT_TIERS, contains_join
from .resolve import connected

#: Words of a route that tell nothing apart.
STOP = "and connection connecting final flight from home inbound leg outbound return the to train travel".split()
#: Fixed value: the pattern of a label that names no place, or any.
GENERIC = r"^(?:flight|train|bus|ferry|transfer|drive|transport)(?:\s+(?:to|from)\s+[a-z0-9 ]+)?$"
ANCHOR = "kind date departure_time arrival_time number provider confirmation departure arrival label".split()
#: What an anchor says of its route, and all that it says but for its number.
ROUTE = ("label", "departure", "arrival")
SAID = (*ROUTE, "provider", "confirmation")
RUNGS = 8
#: Pairs of a block and kind that are judged without a look at keys; larger blocks go by keys.
PAIRS = 10_000
#: Anchors of a block and kind that one fold takes as they are; more are split into sets that may meet.
FOLD = 256


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: (F.length(x) > 2) & ~x.isin(*STOP))


def normalised(df: DataFrame, id_: str) -> DataFrame:
    """block, ``id_``, the columns of ``ANCHOR`` without nulls and, as n_, their normalised forms where any is looked at."""
    d = df.select("block", id_, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ANCHOR])
    return d.select("*", *[T.normalize(F.col(c)).alias(f"n_{c}") for c in ("kind", "date", "number", "provider", "confirmation", "departure", "arrival", "label")])


def together(*cols: str) -> Column:
    """The normalised values of these as one text."""
    return F.concat_ws(" ", *[F.nullif(F.col(f"n_{c}"), F.lit("")) for c in cols])


def names_no_place() -> Column:
    """Does a label (n_label) tell no more than its kind (n_kind)?"""
    kind, label = F.col("n_kind"), F.col("n_label")
    vague = [kind, F.concat(kind, F.lit(" home")), F.concat(F.lit("return "), kind), F.concat(F.lit("return "), kind, F.lit(" home")), F.concat(kind, F.lit(" return")), F.concat(F.lit("home "), kind), F.concat(F.lit("final "), kind), F.concat(kind, F.lit(" to"))]
    openings = [F.concat(F.lit(w), kind, F.lit(e)) for w, e in (("return ", " "), ("home ", " "), ("final ", " "), ("", " to "), ("", " from "))]
    return reduce(Column.__or__, [label == v for v in vague] + [label.startswith(o) for o in openings] + [label.rlike(GENERIC)]) & (label != "") & (kind != "")


def prepared(df: DataFrame, id_: str, p: str) -> DataFrame:
    """Columns that the ladder needs, their names beginning with ``p``: of a table with block, ``id_`` and the columns of ``ANCHOR``."""
    d = normalised(df, id_).select("*", together(*ROUTE).alias("route"), together(*SAID).alias("text"))
    d = d.select("*", tokens(F.col("route")).alias("route_all"), tokens(F.col("text")).alias("text_all"))
    made = {c: F.col(c) for c in (*ANCHOR, "n_date", "n_number", "n_confirmation", "n_departure", "n_arrival", "text")} | {"day": T.written_date(F.col("date")), "generic": names_no_place()}
    made |= {"route_tok": F.array_distinct("route_all"), "specific": F.size("route_all") >= 2, "text_tok": F.array_distinct("text_all"), "full_tok": F.array_distinct(F.concat("text_all", tokens(F.col("n_number"))))}
    return d.select("block", id_, *[c.alias(f"{p}{n}") for n, c in made.items()])


def _place(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def rung() -> Column:
    """The lowest rung that an anchor (columns a_) and a record (columns r_) of one kind stand on; null if none."""
    c = F.col
    both = lambda x: (c(f"a_{x}") != "") & (c(f"r_{x}") != "")
    dep, arr = both("departure_time") & (c("a_departure_time") == c("r_departure_time")), both("arrival_time") & (c("a_arrival_time") == c("r_arrival_time"))
    day = T.dates_match(c("a_day"), c("r_day"), c("a_n_date"), c("r_n_date"))
    veto = ((c("a_departure_time") != "") | (c("a_arrival_time") != "") | (c("a_number") != "")) & both("date") & ~day
    overlap = F.size(F.array_intersect("a_route_tok", "r_route_tok"))
    specific = c("a_specific") & c("r_specific")
    from_, to = _place(c("a_n_departure"), c("r_n_departure")), _place(c("a_n_arrival"), c("r_n_arrival"))
    confirmed = F.when(F.when(both("departure") & both("arrival"), from_ & to).otherwise(~specific | (overlap >= 2)), 4)
    ladder = (
        F.when(dep & arr, 1)
        .when((dep | arr) & both("date") & day & (overlap >= 1), 2)
        .when((c("a_n_number") != "") & c("r_text").contains(c("a_n_number")), 3)
        .when(both("confirmation") & (c("a_n_confirmation") == c("r_n_confirmation")), confirmed)
        .when(overlap >= 2, 5)
        .when((dep | arr) & (from_ | to), 6)
        .when((overlap >= 1) & ~specific & c("r_generic"), 7)
        .when(~specific & (F.size(F.array_intersect("a_full_tok", "r_text_tok")) >= 2), 8)
    )
    return F.when((c("a_kind") == c("r_kind")) & ~veto, ladder)


def match_anchors(anchors: DataFrame, records: DataFrame, n: int | None = None) -> DataFrame:
    """block, anchor, record and rung of every anchor (block, anchor, columns of ``ANCHOR``) and record (block, record, the same) of one block that match.

    A date that disagrees vetoes anchors with a time or a number; equal confirmations decide alone whether the rungs after them count.  A number
    of signs alone is none.  Ids are unique; nulls are empty; a null block matches nothing.  A record's number is not looked at.

    Both are dealt out by block and kind once, in n buckets.  Where a block's anchors and records of a kind make no more than ``PAIRS`` pairs these are judged
    as they are; of larger ones only pairs that share a key are."""
    n, of_kind = n or partitions(anchors, records), ["block", "kind"]
    dealt = lambda df, id_, p, name: bucketed(df.withColumn("kind", F.coalesce(F.col("kind").cast("string"), F.lit(""))), of_kind, n, name, lambda d: prepared(d, id_, p).withColumnRenamed(f"{p}kind", "kind"))
    a, r = dealt(anchors, "anchor", "a_", "anchors"), dealt(records, "record", "r_", "records")
    large = a.groupBy(*of_kind).agg(F.count("*").alias("a_n")).join(r.groupBy(*of_kind).agg(F.count("*").alias("r_n")).hint("merge"), of_kind).where(F.col("a_n") * F.col("r_n") > PAIRS).select(*of_kind)
    whole = lambda a, r: a.withColumn("a_kind", F.col("kind")).join(r.withColumn("r_kind", F.col("kind")).hint("merge"), of_kind)
    if large.isEmpty():
        return judged(whole(a, r))
    large = staged(large, "large-blocks")
    of_large = [x.join(large, of_kind, "left_semi").withColumnRenamed("kind", f"{p}kind") for x, p in ((a, "a_"), (r, "r_"))]
    return judged(whole(a.join(large, of_kind, "left_anti"), r)).union(by_keys(*of_large))


def judged(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("rung", rung()).where("rung is not null").select("block", "anchor", "record", "rung")


def by_keys(a: DataFrame, r: DataFrame) -> DataFrame:
    """What ``match_anchors`` returns, of prepared anchors and records.  These are small as files and large in memory, so neither is sent to every task."""
    on = ["block", "kind", "key"]
    key = lambda df, id_, p, of: df.select("block", F.col(f"{p}kind").alias("kind"), of.alias("key"), id_)
    equal = lambda x, y: key(a.where(F.col(f"a_{x}") != ""), "anchor", "a_", F.col(f"a_{y}")).join(key(r.where(F.col(f"r_{x}") != ""), "record", "r_", F.col(f"r_{y}")).hint("merge"), on)
    pairs = [equal("departure_time", "departure_time"), equal("arrival_time", "arrival_time"), equal("confirmation", "n_confirmation")]
    # two tokens in common: one of them is not the anchor's most frequent
    of_record = key(r, "record", "r_", F.explode("r_text_tok"))
    seen = of_record.groupBy(*on).agg(F.count("*").alias("seen"))
    of_anchor = key(a, "anchor", "a_", F.explode("a_full_tok")).join(seen, on)
    rare = of_anchor.groupBy("block", "kind", "anchor").agg(F.sort_array(F.collect_list(F.struct("seen", "key"))).alias("k"))
    rare = rare.where(F.size("k") > 1).select("block", "kind", "anchor", F.explode(F.expr("slice(k, 1, size(k) - 1)")["key"]).alias("key"))
    pairs += [rare.join(of_record.hint("merge"), on), key(a, "anchor", "a_", F.explode("a_route_tok")).join(key(r.where("r_generic"), "record", "r_", F.explode("r_route_tok")).hint("merge"), on)]
    within = F.struct("block", "kind").alias("within")
    numbers = key(a.where("a_n_number != ''"), "anchor", "a_", F.col("a_n_number"))
    texts = key(r, "record", "r_", F.col("r_text"))
    held = contains_join(numbers.select(within, F.col("key").alias("value")), texts.select(within, F.col("record").alias("id"), F.col("key").alias("text")), SHORT_TIERS, by="within")
    pairs.append(numbers.join(held.select("within.block", "within.kind", F.col("value").alias("key"), F.col("id").alias("record")), on))
    once = reduce(DataFrame.union, [p.select("block", "anchor", "record") for p in pairs]).distinct()
    return judged(once.join(a.hint("merge"), ["block", "anchor"]).join(r.hint("merge"), ["block", "record"]))


# --- one anchor for each segment ---------------------------------------------------------------------------

#: What an endpoint is worth, and one that says next to nothing.
VAGUE_ENDPOINT = r"\b(?:flight|train|bus|ferry|transfer|travel)\s+(?:to|from)\b"
TERMINAL = r"\b(?:airport|bahnhof|hbf|station|terminal|nadrazi)\b"
WEAK_ENDPOINT = r"^(?:bus|ferry|flight|train|transfer|travel)(?:\s+(?:to|from)(?:\s+.+)?)?$"
EVIDENCE = 2400
_FILLED = "arrival arrival_time confirmation date departure departure_time number provider".split()
_LABEL_WORDS = "flight travel from to train bus ferry transfer".split()


def endpoint_quality(normal: Column) -> Column:
    """0 for none, 1 for a phrase, 3 for a word, 4 for several, 6 for a code or a station."""
    return F.when(normal == "", 0).when(normal.rlike(VAGUE_ENDPOINT), 1).when(normal.rlike("^[a-z]{3}$") | normal.rlike(TERMINAL), 6).when(normal.contains(" "), 4).otherwise(3)


_STOP = frozenset(STOP)


def _words(*normal: str) -> list[str]:
    return [t for n in normal for t in n.split() if len(t) > 2 and t not in _STOP]


@lru_cache(1 << 14)
def _route(*normal: str) -> tuple[frozenset[str], bool]:
    """Tokens of a route, and whether they are two or more; many anchors say the same."""
    route = _words(*normal)
    return frozenset(route), len(route) >= 2


class Segment:
    """An anchor as the fold holds it: its values, each with its normalised form."""

    def __init__(self, row: dict):
        self.__dict__ |= row
        self.members = 1
        self.look()

    def look(self) -> None:
        self.route, self.specific = _route(self.n_label, self.n_departure, self.n_arrival)
        self._text = self._words = None

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = " ".join(filter(None, (self.n_label, self.n_departure, self.n_arrival, self.n_provider, self.n_confirmation)))
        return self._text

    @property
    def words(self) -> frozenset[str]:
        if self._words is None:
            self._words = self.route.union(_words(self.n_provider, self.n_confirmation))
        return self._words

    @property
    def numbered(self) -> frozenset[str]:
        """Its words and those of its number."""
        return self.words.union(_words(self.n_number)) if self.n_number else self.words

    def meets(self, other: Segment) -> bool:
        """Does this one, as an anchor, match the other as a record?"""
        if self.has_identity and self.date and other.date and not same_day(self, other):
            return False
        dep, arr = bool(self.departure_time) and self.departure_time == other.departure_time, bool(self.arrival_time) and self.arrival_time == other.arrival_time
        overlap, specific = len(self.route & other.route), self.specific and other.specific
        if dep and arr or (dep or arr) and self.date and other.date and same_day(self, other) and overlap:
            return True
        if self.n_number and self.n_number in other.text:
            return True
        ends = [part_of(getattr(self, f"n_{c}"), getattr(other, f"n_{c}")) for c in ("departure", "arrival")]
        if self.confirmation and other.confirmation and self.n_confirmation == other.n_confirmation:
            return all(ends) if self.departure and self.arrival and other.departure and other.arrival else not specific or overlap >= 2
        if overlap >= 2 or (dep or arr) and any(ends):
            return True
        return not specific and (bool(overlap) and other.generic or len(self.numbered & other.words) >= 2)

    @property
    def has_identity(self) -> bool:
        return bool(self.departure_time or self.arrival_time or self.number)

    @property
    def filled(self) -> int:
        return sum(bool(getattr(self, c)) for c in _FILLED)

    @property
    def weak(self) -> bool:
        return self.weak_departure or self.weak_arrival

    def absorb(self, new: Segment) -> None:
        """Take in another anchor of the segment: the fuller one's values, else the other's; of each endpoint the better."""
        best, rest = (new, self) if new.filled > self.filled else (self, new)
        row = dict(best.__dict__)
        for c in ("date", "departure_time", "arrival_time", "number", "provider", "confirmation"):
            if not row[c]:
                row |= {k: rest.__dict__[k] for k in (c, f"n_{c}", "iso", "md") if k in row and (k not in ("iso", "md") or c == "date")}
        for c in ("departure", "arrival"):
            if rest.__dict__[f"q_{c}"] > best.__dict__[f"q_{c}"]:
                row |= {k: rest.__dict__[k] for k in (c, f"n_{c}", f"q_{c}", f"weak_{c}")}
        verb = "Flight" if row["kind"] == "flight" else "Travel"
        ends = (["from", row["departure"]] if row["departure"] and row["arrival"] else []) + (["to", row["arrival"]] if row["arrival"] else [])
        row["label"] = " ".join([verb, *ends]) if ends else {"flight": "Flight", "train": "Train", "bus": "Bus", "ferry": "Ferry"}.get(row["kind"], "Transfer")
        norms = (["from", row["n_departure"]] if row["departure"] and row["arrival"] else []) + (["to", row["n_arrival"]] if row["arrival"] else [])
        row["n_label"] = " ".join(filter(None, [verb.lower(), *norms])) if ends else row["label"].lower()
        row["generic"] = is_generic(row["n_label"], row["kind"])
        pieces = [x for x in (best.evidence.strip(), rest.evidence.strip()) if x]
        row["evidence"] = "\n".join(dict.fromkeys(pieces))[:EVIDENCE]
        row["members"], row["pos"] = self.members + 1, self.pos
        self.__dict__ |= row
        self.look()


def is_generic(label: str, kind: str) -> bool:
    """Of the labels that the fold itself makes: does it name no place, or one end alone?"""
    import re

    return label == kind or label.startswith((f"{kind} to ", f"{kind} from ")) or label == f"{kind} to" or bool(re.search(GENERIC, label))


def part_of(a: str, b: str) -> bool:
    return bool(a and b) and (a in b or b in a)


def same_day(a: Segment, b: Segment) -> bool:
    if a.iso and b.iso:
        return a.iso == b.iso
    if a.iso and b.md and a.iso[5:] == b.md or b.iso and a.md and b.iso[5:] == a.md:
        return True
    return bool(a.n_date) and a.n_date == b.n_date


def same_segment(left: Segment, right: Segment) -> bool:
    """Does either, as an anchor, match the other as a record, or do equal confirmations of which one has a weak end?  But for numbers, generic labels
    and a number's words the ladder is the same both ways, so each rung is looked at once; dates that disagree have ended it before."""
    if left.kind != right.kind:
        return False
    dated = bool(left.date and right.date)
    if dated and not same_day(left, right):
        return False
    confirmed = bool(left.confirmation and right.confirmation) and left.n_confirmation == right.n_confirmation
    if confirmed and (left.weak or right.weak):
        return True
    dep, arr = bool(left.departure_time) and left.departure_time == right.departure_time, bool(left.arrival_time) and left.arrival_time == right.arrival_time
    overlap = 0 if left.route.isdisjoint(right.route) else len(left.route & right.route)
    if dep and arr or dated and overlap and (dep or arr):
        return True
    if left.n_number and left.n_number in right.text or right.n_number and right.n_number in left.text:
        return True
    specific = left.specific and right.specific
    if confirmed:
        if left.departure and left.arrival and right.departure and right.arrival:
            return part_of(left.n_departure, right.n_departure) and part_of(left.n_arrival, right.n_arrival)
        return not specific or overlap >= 2
    if overlap >= 2 or (dep or arr) and (part_of(left.n_departure, right.n_departure) or part_of(left.n_arrival, right.n_arrival)):
        return True
    if specific:
        return False
    return bool(overlap) and (left.generic or right.generic) or len(left.numbered & right.words) >= 2 or len(right.numbered & left.words) >= 2


def fold_segments(rows: list[Segment], into: list[Segment] | None = None) -> list[Segment]:
    """Each anchor, in order, goes into the first segment that is the same, or begins one."""
    out = [] if into is None else into
    for row in rows:
        for segment in out:
            if same_segment(segment, row):
                segment.absorb(row)
                break
        else:
            out.append(row)
    return out


_OUT = [*ANCHOR, "evidence", "members"]


def segments_ready(anchors: DataFrame) -> DataFrame:
    """Anchors with what the fold looks at: normalised values, days, and the worth of endpoints.  Those without a block or place are left out."""
    a = anchors.where(F.col("block").isNotNull() & F.col("pos").isNotNull())
    a = normalised(a.withColumn("__id", F.struct("pos", F.coalesce(F.col("evidence").cast("string"), F.lit("")).alias("evidence"))), "__id")
    a = a.select("*", T.written_date(F.col("date")).alias("day"))
    made = {**{c: F.col(c) for c in ANCHOR}, "evidence": F.col("__id.evidence"), **{f"n_{c}": F.col(f"n_{c}") for c in ("date", "number", *SAID)}}
    made |= {"iso": F.coalesce("day.iso", F.lit("")), "md": F.coalesce("day.md", F.lit("")), "generic": names_no_place()}
    for x in ("departure", "arrival"):
        n = F.col(f"n_{x}")
        made |= {f"q_{x}": endpoint_quality(n), f"weak_{x}": (n == "") | n.rlike(WEAK_ENDPOINT)}
    return a.select("block", F.col("__id.pos").alias("pos"), *[c.alias(x) for x, c in made.items()])


def may_meet(ready: DataFrame) -> DataFrame:
    """block, pos and root: anchors in different roots are never of one segment, nor is anything that a fold makes of them.

    A segment's values are its members' own, but for the label, so two segments that match share a key that an anchor of each has: a time,
    a confirmation, a token, or a number's longest token in the other's text.  A label that the fold makes adds the kind's name, which only anchors
    without an arrival can get, and words in which a number might stand."""
    hub = F.array_compact(F.array(F.when(F.col("arrival") == "", F.col("kind"))))
    mark = lambda prefix, c: F.when(c != "", F.concat(F.lit(prefix), c))
    keys = F.array_compact(F.array(mark("d ", F.col("departure_time")), mark("a ", F.col("arrival_time")), F.when(F.col("confirmation") != "", F.concat(F.lit("c "), "n_confirmation"))))
    words = F.transform(F.array_union(F.concat(tokens(F.col("text_")), tokens(F.col("n_number"))), hub), lambda x: F.concat(F.lit("w "), x))
    longest = F.array_max(F.transform(F.split("n_number", " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    at = ready.withColumn("text_", together(*SAID)).select("block", "pos", "kind", F.concat(keys, words).alias("keys"), longest.alias("number"), "text_")
    at = staged(at, "may-meet")
    node = F.struct("block", "pos")
    within = F.struct("block", "kind").alias("within")
    held = contains_join(at.where("number != ''").select(within, F.col("number").alias("value")), at.select(within, F.col("pos").alias("id"), F.col("text_").alias("text")), SHORT_TIERS, by="within")
    by_number = held.select("within.block", "within.kind", F.concat(F.lit("n "), "value").alias("key"), F.col("id").alias("pos"))
    own_number = at.where("number != ''").select("block", "kind", F.concat(F.lit("n "), "number").alias("key"), "pos")
    common = F.lit(" ".join(_LABEL_WORDS)).contains(F.col("number"))
    # a number that stands in a made label may meet all of its block and kind
    anywhere = at.join(at.where((F.col("number") != "") & common).select("block", "kind").distinct(), ["block", "kind"]).select("block", "kind", F.lit("all").alias("key"), "pos")
    rows = at.select("block", "kind", F.explode("keys").alias("key"), "pos").union(by_number).union(own_number).union(anywhere)
    least = rows.groupBy("block", "kind", "key").agg(F.min("pos").alias("first"))
    edges = rows.join(least, ["block", "kind", "key"]).select(node.alias("b"), F.struct("block", F.col("first").alias("pos")).alias("a")).where("a != b").distinct()
    roots = connected(edges)
    return at.select(node.alias("node")).join(roots, "node", "left").select("node.block", "node.pos", F.coalesce("root.pos", "node.pos").alias("root"))


def canonical_anchors(anchors: DataFrame, n: int | None = None) -> DataFrame:
    """block, pos (of the first member), the columns of ``ANCHOR``, evidence and members of each segment of anchors (block, pos, those, evidence).

    Which anchor an earlier one has become decides what the next meets, so this is a fold in order of pos.  Anchors are dealt out by block and kind once,
    in n buckets, and anchors of different kinds never meet: those of a block and kind are one fold.  Where these are more than ``FOLD`` it runs
    apart for each set of them that may meet.  A task holds the segments of one fold, and what it hands on, at a time.  pos is unique within a block; nulls are empty."""
    n, of_kind = n or partitions(anchors), ["block", "kind"]
    ready = bucketed(anchors.withColumn("kind", F.coalesce(F.col("kind").cast("string"), F.lit(""))), of_kind, n, "segments", segments_ready)
    types = dict(ready.dtypes)
    large = ready.groupBy(*of_kind).agg(F.count("*").alias("n")).where(F.col("n") > FOLD).select(*of_kind)
    # a place within the fold holds its rows together, in order, however files are read
    placed = lambda df, *by: df.withColumn("at", F.row_number().over(W.partitionBy(*by).orderBy("pos")))
    if large.isEmpty():
        parts = [placed(ready, *of_kind)]
    else:
        large = staged(large, "large-blocks")
        split = ready.join(large, of_kind, "left_semi")
        rows = split.join(may_meet(split).hint("merge"), ["block", "pos"]).select(*ready.columns, F.to_json(F.struct("root")).alias("root"))
        parts = [placed(ready.join(large, of_kind, "left_anti"), *of_kind), placed(rows.repartition(n, *of_kind, "root"), *of_kind, "root").drop("root")]
    schema = f"block {types['block']}, pos {types['pos']}, " + ", ".join(f"{c} {'int' if c == 'members' else 'string'}" for c in _OUT)
    return reduce(DataFrame.union, [p.mapInArrow(folded, schema) for p in parts])


#: Segments that a fold hands on at a time, at least.
HANDED = 10_000


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of folds whose rows follow each other, ``at`` from 1 on; of many small folds together."""
    held, done = [], []
    for b in batches:
        types = {"block": b.schema.field("block").type, "pos": b.schema.field("pos").type, "members": pa.int32()}

        def handed() -> pa.RecordBatch:
            columns = ["block", "pos", *_OUT]
            return pa.RecordBatch.from_arrays([pa.array([getattr(s, c) for s in done], types.get(c, pa.string())) for c in columns], columns)  # noqa: B023

        names = b.schema.names
        for values in zip(*[c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) else c.to_pylist() for c in b.columns]):
            row = dict(zip(names, values))
            if row["at"] == 1:
                done += held
                held = []
                if len(done) >= HANDED:
                    yield handed()
                    done = []
            fold_segments([Segment(row)], held)
    done += held
    if done:
        yield handed()


# --- on the driver's tables: a line item is an anchor, an order a record -----------------------------------

_KIND = {"A": "flight", "N": "train", "R": "bus", "F": "flight", "O": "train", "P": "bus"}


def _clock(c: Column, empty: int) -> Column:
    """A full hour out of an amount; none of one hour in ``empty``."""
    hour = F.floor(c) % 24
    return F.when(F.floor(c) % empty != 0, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00")))


def _kind(c: Column) -> Column:
    return reduce(lambda out, k: out.when(c == k, _KIND[k]), _KIND, F.when(F.lit(False), ""))


def trip_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # repeated line items go while they lie by order
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey").dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey").distinct()
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).dropDuplicates(["s_suppkey"])
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s.select("s_suppkey", "n_name", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = _kind(F.col("l_returnflag"))
    return j.select(
        F.col("o_custkey").alias("block"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("anchor"), kind.alias("kind"), F.when(F.col("l_discount") < 0.08, F.to_date("l_shipdate").cast("string")).alias("date"),
        _clock(F.col("l_extendedprice"), 3).alias("departure_time"), _clock(F.col("l_extendedprice") / 24, 3).alias("arrival_time"), F.when(F.col("l_tax") < 0.02, F.col("l_suppkey").cast("string")).alias("number"),
        F.lit("").alias("provider"), F.when(F.col("l_discount") < 0.05, F.col("l_orderkey").cast("string")).alias("confirmation"), F.col("n_name").alias("departure"), F.when(F.col("l_quantity") > 25, F.col("r_name")).alias("arrival"), F.concat(kind, F.lit(" from "), "n_name").alias("label"), F.col("l_linestatus").alias("evidence"),
    )


def trip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = o.join(c.select("c_custkey", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    kind = _kind(F.col("o_orderstatus"))
    return j.select(
        F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("record"), kind.alias("kind"), F.to_date("o_orderdate").cast("string").alias("date"), _clock(F.col("o_totalprice"), 3).alias("departure_time"), _clock(F.col("o_totalprice") / 24, 3).alias("arrival_time"), F.lit("").alias("number"),
        F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").cast("string").alias("confirmation"), F.when(F.col("o_totalprice") > 100000, F.col("n_name")).alias("departure"), F.when(F.col("o_totalprice") < 150000, F.col("r_name")).alias("arrival"), F.concat(kind, F.lit(" to "), "r_name").alias("label"),
    )


_TOK = "list_filter(string_split({0}, ' '), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP) + "], x))"
_HOUR = "CASE WHEN CAST(floor({0}) AS BIGINT) % 3 <> 0 THEN lpad(CAST(CAST(floor({0}) AS BIGINT) % 24 AS VARCHAR), 2, '0') || ':00' END"
_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items()) + " END"
_N = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_PLACE = "({0} <> '' AND {1} <> '' AND (contains({0}, {1}) OR contains({1}, {0})))"
MATCH_SQL = f"""WITH ga AS (SELECT DISTINCT ON (o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey) o_custkey AS block, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS anchor, {_CASE.format("l_returnflag")} AS kind, CASE WHEN l_discount < 0.08 THEN CAST(l_shipdate AS DATE) END AS day,
  {_HOUR.format("l_extendedprice")} AS dep_t, {_HOUR.format("l_extendedprice / 24")} AS arr_t, CASE WHEN l_tax < 0.02 THEN CAST(l_suppkey AS VARCHAR) END AS number, CASE WHEN l_discount < 0.05 THEN CAST(l_orderkey AS VARCHAR) END AS conf,
  lower(n_name) AS dep, CASE WHEN l_quantity > 25 THEN lower(r_name) END AS arr, {_CASE.format("l_returnflag")} || ' from ' || lower(n_name) AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
gr AS (SELECT o_custkey AS block, o_orderkey AS record, {_CASE.format("o_orderstatus")} AS kind, CAST(o_orderdate AS DATE) AS day, {_HOUR.format("o_totalprice")} AS dep_t, {_HOUR.format("o_totalprice / 24")} AS arr_t,
  o_orderpriority AS provider, CAST(o_orderkey AS VARCHAR) AS conf, CASE WHEN o_totalprice > 100000 THEN lower(n_name) END AS dep, CASE WHEN o_totalprice < 150000 THEN lower(r_name) END AS arr, {_CASE.format("o_orderstatus")} || ' to ' || lower(r_name) AS label
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT *, {_TOK.format(_N.format("concat_ws(' ', label, dep, arr)"))} AS route, {_TOK.format(_N.format("concat_ws(' ', label, dep, arr, conf, number)"))} AS words FROM ga),
r AS (SELECT *, {_TOK.format(_N.format("concat_ws(' ', label, dep, arr)"))} AS route, {_N.format("concat_ws(' ', label, dep, arr, provider, conf)")} AS text, {_TOK.format(_N.format("concat_ws(' ', label, dep, arr, provider, conf)"))} AS words FROM gr),
p AS (SELECT a.block, a.anchor, r.record, coalesce(a.dep_t = r.dep_t, false) AS dep_ok, coalesce(a.arr_t = r.arr_t, false) AS arr_ok, coalesce(a.day = r.day, false) AS day_ok, coalesce(a.day <> r.day, false) AS day_off, len(list_intersect(list_distinct(a.route), list_distinct(r.route))) AS overlap,
  len(a.route) >= 2 AND len(r.route) >= 2 AS specific, a.dep_t IS NOT NULL OR a.arr_t IS NOT NULL OR a.number IS NOT NULL AS own, a.number IS NOT NULL AND contains(r.text, a.number) AS number_ok, coalesce(a.conf = r.conf, false) AS conf_ok,
  a.dep IS NOT NULL AND a.arr IS NOT NULL AND r.dep IS NOT NULL AND r.arr IS NOT NULL AS ends, coalesce({_PLACE.format("a.dep", "r.dep")}, false) AS from_ok, coalesce({_PLACE.format("a.arr", "r.arr")}, false) AS to_ok, len(list_intersect(list_distinct(a.words), list_distinct(r.words))) AS shared
  FROM a JOIN r ON a.block = r.block AND a.kind = r.kind),
m AS (SELECT block, anchor, record, CASE WHEN dep_ok AND arr_ok THEN 1 WHEN (dep_ok OR arr_ok) AND day_ok AND overlap >= 1 THEN 2 WHEN number_ok THEN 3
  WHEN conf_ok THEN CASE WHEN ends THEN CASE WHEN from_ok AND to_ok THEN 4 END WHEN NOT specific OR overlap >= 2 THEN 4 END
  WHEN overlap >= 2 THEN 5 WHEN (dep_ok OR arr_ok) AND (from_ok OR to_ok) THEN 6 WHEN overlap >= 1 AND NOT specific THEN 7 WHEN NOT specific AND shared >= 2 THEN 8 END AS rung FROM p WHERE NOT (own AND day_off))"""


@query(f"{MATCH_SQL} SELECT block AS trip, record, rung, count(*) AS n_anchors, CAST(min(anchor[2]) AS INTEGER) AS least_line FROM m WHERE rung IS NOT NULL GROUP BY ALL")
def anchor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order, as a record, how many line items match it, by the rung they stand on."""
    found = match_anchors(trip_anchors(spark, sf_dir), trip_records(spark, sf_dir), partitions(table(spark, sf_dir, "lineitem")))
    return found.groupBy(F.col("block").alias("trip"), "record", "rung").agg(F.count("*").alias("n_anchors"), F.min("anchor.l_linenumber").alias("least_line"))


@query()
def canonical_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each customer's line items, folded in order of key and line."""
    return canonical_anchors(trip_anchors(spark, sf_dir).withColumnRenamed("anchor", "pos"), partitions(table(spark, sf_dir, "lineitem"))).select(F.col("block").alias("trip"), "pos.l_orderkey", "pos.l_linenumber", "kind", "date", "departure_time", "departure", "arrival", "label", "members")
