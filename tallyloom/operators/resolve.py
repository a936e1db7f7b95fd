"""Entity resolution: reconciliation, winners, claims, alignment and components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.staging import partitions, staged
from ..plans.trips import items
from ..registry import query
from ..sources.tables import table
from .containment import compatible
from .overlap import asked_for, few, sharing
from .text_queries import DISTINCTIVE_SQL, NORMAL_SQL, lines_of


@query("""WITH p AS (SELECT o_custkey, o_orderpriority, o_orderstatus, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS top FROM orders)
SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status, count(*) AS n FROM p WHERE o_orderpriority = top GROUP BY o_custkey""")
def role_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among a customer's orders of top priority the status, if it is one."""
    by = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderstatus").alias("lo"), F.max("o_orderstatus").alias("hi"), F.count("*").alias("n"))
    top = by.groupBy("o_custkey").agg(F.min_by(F.struct("lo", "hi", "n"), "o_orderpriority").alias("t"))
    return top.select("o_custkey", F.when(F.col("t.lo") == F.col("t.hi"), F.col("t.lo")).alias("status"), F.col("t.n").alias("n"))


@query("""WITH k AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS rank, max(n) OVER (PARTITION BY l_orderkey) AS top FROM k)
SELECT l_orderkey, l_returnflag, n, CASE WHEN rank = 1 THEN 'applied' WHEN n = top THEN 'conflict' ELSE 'supporting' END AS outcome FROM r""")
def proposal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's flags the most frequent is applied, one as frequent conflicts, the others support."""
    k = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    w = W.partitionBy("l_orderkey")
    k = k.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "l_returnflag"))).withColumn("top", F.max("n").over(w))
    return k.select("l_orderkey", "l_returnflag", "n", F.when(F.col("rank") == 1, "applied").when(F.col("n") == F.col("top"), "conflict").otherwise("supporting").alias("outcome"))


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of edges (a, b).  Stars in turn: every node takes its
    neighbours' smallest, until nothing changes; each round is a checkpoint, so a lost executor costs one round."""
    sc = edges.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        sc.setCheckpointDir(edges.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp())
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct().checkpoint()
    before = None
    while (now := tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())) != before:
        before = now
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        e = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct().checkpoint()
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


_COMPONENTS_SQL = """WITH RECURSIVE s AS (SELECT s_suppkey, s_nationkey FROM supplier), m AS (SELECT DISTINCT l_partkey % 50 AS part, s_suppkey, s_nationkey FROM lineitem JOIN s ON s_suppkey = l_suppkey WHERE l_quantity >= 48 AND l_partkey % 5 = 0),
e AS (SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM m a JOIN m b ON a.part = b.part AND a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey),
r(node, root) AS (SELECT s_suppkey, s_suppkey FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT root, count(*) AS n FROM c GROUP BY root"""


def shared_components(suppliers: DataFrame, shipments: DataFrame) -> DataFrame:
    """root, n of suppliers (s_suppkey, s_nationkey) of a nation that share a part of shipments (part, l_suppkey),
    by component.  A part's suppliers are linked to its smallest one: the same components as from all pairs, in
    as many links as suppliers."""
    m = shipments.join(suppliers, shipments["l_suppkey"] == suppliers["s_suppkey"]).select("part", "s_nationkey", "s_suppkey").distinct()
    low = m.groupBy("part", "s_nationkey").agg(F.min("s_suppkey").alias("a"))
    roots = connected(m.join(low, ["part", "s_nationkey"]).select("a", F.col("s_suppkey").alias("b")))
    named = suppliers.join(roots, suppliers["s_suppkey"] == roots["node"], "left").select(F.coalesce("root", "s_suppkey").alias("root"))
    return named.groupBy("root").agg(F.count("*").alias("n"))


@query(_COMPONENTS_SQL)
def components_shared_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL: only large shipments of every fifth part, and parts in 50 buckets.  For all of them see
    ``components_shared_part``."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 48 and l_partkey % 5 = 0").select((F.col("l_partkey") % 50).alias("part"), "l_suppkey")
    return shared_components(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), li)


@query("""WITH RECURSIVE s AS (SELECT s_suppkey, s_nationkey FROM supplier), m AS (SELECT DISTINCT l_partkey AS part, s_suppkey, s_nationkey FROM lineitem JOIN s ON s_suppkey = l_suppkey),
e AS (SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM m a JOIN m b ON a.part = b.part AND a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey),
r(node, root) AS (SELECT s_suppkey, s_suppkey FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT root, count(*) AS n FROM c GROUP BY root""")
def components_shared_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation that share a part, over all lines, by component."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey")
    return shared_components(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), li)


@query("""SELECT l_orderkey, l_returnflag, w[1] AS quantity, round(w[2], 2) AS price, w[3] AS part, CASE WHEN n_q = 1 THEN 'quantity' ELSE 'price' END AS rung FROM (
  SELECT l_orderkey, l_returnflag, max((l_quantity, l_extendedprice, l_partkey)) AS w, count(*) FILTER (l_quantity = mq) AS n_q
  FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey, l_returnflag) AS mq FROM lineitem) GROUP BY ALL)""")
def merge_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's items with a flag the winner by quantity, price, part; and the rung that decided."""
    li = table(spark, sf_dir, "lineitem")
    by_quantity = li.groupBy("l_orderkey", "l_returnflag", "l_quantity").agg(F.count("*").alias("n"), F.max(F.struct("l_extendedprice", "l_partkey")).alias("x"))
    won = by_quantity.groupBy("l_orderkey", "l_returnflag").agg(F.max(F.struct("l_quantity", "x", "n")).alias("w"))
    return won.select("l_orderkey", "l_returnflag", F.col("w.l_quantity").alias("quantity"), F.round("w.x.l_extendedprice", 2).alias("price"), F.col("w.x.l_partkey").alias("part"), F.when(F.col("w.n") == 1, "quantity").otherwise("price").alias("rung"))


@query("""SELECT o_custkey AS trip, l_partkey AS part, min((CAST(o_orderdate AS DATE), o_orderkey))[2] AS claimed_by, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def claim_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of a customer that claims a part keeps it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("trip"), F.col("l_partkey").alias("part")).agg(F.min(F.struct(F.to_date("o_orderdate"), F.col("o_orderkey")))["o_orderkey"].alias("claimed_by"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, max((l_quantity, l_extendedprice, l_suppkey))[1] AS quantity, round(max((l_quantity, l_extendedprice, l_suppkey))[2], 2) AS price, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers, count(*) AS n
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dedupe_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated (order, line) the richest item, with all their suppliers."""
    best = F.max(F.struct("l_quantity", "l_extendedprice", "l_suppkey"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"), F.count("*").alias("n"))
    return g.where("n > 1").select("l_orderkey", "l_linenumber", F.col("b.l_quantity").alias("quantity"), F.round("b.l_extendedprice", 2).alias("price"), "suppliers", "n")


_CLAUSE_SQL = "SELECT {0} AS id, trim(unnest(regexp_split_to_array(text, '[,;.\\n]'))) AS clause FROM {1}"


def clauses(df: DataFrame, id_: str) -> DataFrame:
    return df.select(F.col(id_).alias("id"), F.explode(F.split("text", r"[,;.\n]")).alias("clause")).select("id", F.trim("clause").alias("clause")).where("clause != ''")


@query(f"""WITH b AS ({_CLAUSE_SQL.format("item_id", "benchmark")}), d AS ({_CLAUSE_SQL.format("doc_id", "documents")}), k AS (SELECT DISTINCT {NORMAL_SQL.format("clause")} AS k FROM d)
SELECT b.id AS item_id, count(*) AS n_clauses, count(*) FILTER (k.k IS NULL) AS n_missing FROM b LEFT JOIN k ON k.k = {NORMAL_SQL.format("clause")} WHERE clause <> '' GROUP BY b.id""")
def anchor_missing_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each item that are no document's."""
    b = clauses(table(spark, sf_dir, "benchmark"), "item_id").withColumn("k", T.normalize(F.col("clause")))
    known = clauses(table(spark, sf_dir, "documents"), "doc_id").select(T.normalize(F.col("clause")).alias("k")).distinct().withColumn("known", F.lit(True))
    return b.join(known, "k", "left").groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("n_clauses"), F.count_if(F.col("known").isNull()).alias("n_missing"))


@query(f"""WITH b AS (SELECT item_id, {NORMAL_SQL.format("substr(text, 1, 40)")} AS head, list_distinct({DISTINCTIVE_SQL.format("text")}) AS t FROM benchmark),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
ln AS (SELECT doc_id, pos, {NORMAL_SQL.format("substr(line, 1, 40)")} AS head, list_distinct({DISTINCTIVE_SQL.format("line")}) AS t FROM l),
exact AS (SELECT item_id, count(*) AS n, min((doc_id, pos)) AS at FROM b JOIN ln ON b.head = ln.head AND b.head <> '' GROUP BY item_id),
bt AS (SELECT item_id, unnest(t) AS tok FROM b), lt AS (SELECT doc_id, pos, unnest(t) AS tok FROM ln),
sc AS (SELECT item_id, doc_id, pos, count(*) AS matched FROM bt JOIN lt ON bt.tok = lt.tok GROUP BY ALL),
ra AS (SELECT sc.*, matched >= 0.5 * len(b.t) AS enough, rank() OVER (PARTITION BY item_id ORDER BY matched DESC) AS rk FROM sc JOIN b USING (item_id)),
tok AS (SELECT item_id, count(*) AS n, min((doc_id, pos)) AS at FROM ra WHERE enough AND rk = 1 GROUP BY item_id)
SELECT b.item_id, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 THEN 'unresolved' WHEN tok.n = 1 THEN 'tokens' WHEN tok.n > 1 THEN 'unresolved' ELSE 'none' END AS outcome,
  CASE WHEN e.n = 1 THEN e.at[1] WHEN e.n IS NULL AND tok.n = 1 THEN tok.at[1] END AS doc_id
FROM b LEFT JOIN exact e USING (item_id) LEFT JOIN tok USING (item_id)""")
def align_three_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL: the one line with an item's opening, else the one line with most of its distinctive tokens, half
    at least; several are left unresolved.  For whole clauses and sections see ``align_in_sections``."""
    head = lambda c: T.normalize(F.substring(c, 1, 40))
    b = staged(table(spark, sf_dir, "benchmark").select("item_id", head("text").alias("head"), F.array_distinct(T.distinctive_tokens(F.col("text"))).alias("t")), "aligned-items")
    ln = lines_of(table(spark, sf_dir, "documents"))
    at = F.min(F.struct("doc_id", "pos"))["doc_id"]
    heads = b.where("head != ''").select("item_id", "head")
    by_head = ln.select("doc_id", "pos", head("line").alias("head")).join(F.broadcast(heads) if few((heads, "head")) else heads, "head")
    exact = by_head.groupBy("item_id").agg(F.count("*").alias("e_n"), at.alias("e_at"))
    texts = ln.select(F.struct("doc_id", "pos").alias("id"), F.lit("").alias("block"), T.normalize(F.col("line")).alias("text"))
    scored = sharing(texts, b.select(F.col("item_id").alias("set"), F.lit("").alias("block"), F.col("t").alias("tokens")), "set").select(F.col("set").alias("item_id"), "id.doc_id", "id.pos", "matched")
    tied = scored.groupBy("item_id", "matched").agg(F.count("*").alias("n"), at.alias("at")).groupBy("item_id").agg(F.max(F.struct("matched", "n", "at")).alias("m"))
    found = b.select("item_id").join(exact, "item_id", "left").join(tied.select("item_id", F.col("m.n").alias("t_n"), F.col("m.at").alias("t_at")), "item_id", "left")
    outcome = F.expr("case when e_n = 1 then 'exact' when e_n > 1 then 'unresolved' when t_n = 1 then 'tokens' when t_n > 1 then 'unresolved' else 'none' end")
    return found.select("item_id", outcome.alias("outcome"), F.expr("case when e_n = 1 then e_at when e_n is null and t_n = 1 then t_at end").alias("doc_id"))


def align(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """id, method, span, n_plausible of candidates (id, evidence, title, description, section) among spans (span,
    clause, section): the span whose clause is the evidence; else that in a compatible section whose clause is the
    title; else that in a compatible section with the largest share of its distinctive tokens, half at least, in
    title and description, then with most of them.  The first tier with any span decides, and several spans are
    left unresolved.  Sections are compatible if one's label is part of the other's; without a label nothing is.  Ids are unique."""
    c = _candidates(candidates, "section")
    s = spans.select("span", T.normalize(F.col("clause")).alias("text"), T.normalize(F.col("section")).alias("s_section"))
    return _tiers(c.withColumnRenamed("section", "c_section"), _asked(c, s))


def _candidates(candidates: DataFrame, *kept: str) -> DataFrame:
    """Candidates' normalised evidence and title (and ``kept``), and c_tok, the distinctive tokens of title and description."""
    normal = [T.normalize(F.col(x)).alias(x) for x in ("evidence", "title", *kept)]
    return staged(candidates.select("id", *normal, F.array_distinct(T.distinctive_tokens(F.concat_ws(" ", "title", "description"))).alias("c_tok")), "candidates")


def _asked(c: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans (text and other columns) that ``asked_for`` leaves to these candidates, written once; all that any tier can find is among them."""
    values = c.select(F.explode(F.array("evidence", "title")).alias("value")).where("value != ''").distinct()
    return staged(asked_for(spans, values, c.select(F.explode("c_tok").alias("token")).distinct()), "spans")


def _tiers(c: DataFrame, s: DataFrame) -> DataFrame:
    """``align`` of candidates (id, evidence, title, c_section, c_tok) and spans (span, text, s_section), all normalised."""
    labels = compatible(c.select(F.col("c_section").alias("a")), s.select(F.col("s_section").alias("b"))).select(F.col("a").alias("c_section"), F.col("b").alias("s_section"))
    one = lambda tier: [F.count("*").alias(f"{tier}_n"), F.min("span").alias(f"{tier}_at")]

    exact = staged(c.where("evidence != ''").join(s, F.col("evidence") == F.col("text")).groupBy("id").agg(*one("e")), "by-evidence")
    inside = staged(c.join(exact.select("id"), "id", "left_anti").join(labels, "c_section").select("id", "title", "s_section", "c_tok"), "inside")
    named = staged(inside.where("title != ''").withColumn("text", F.col("title")).join(s, ["s_section", "text"]).groupBy("id").agg(*one("s")), "by-title")
    left = inside.join(named.select("id"), "id", "left_anti")
    scored = sharing(s.select(F.col("span").alias("id"), F.col("s_section").alias("block"), "text"), left.select(F.col("id").alias("set"), F.col("s_section").alias("block"), F.col("c_tok").alias("tokens")), "text")
    scored = scored.select(F.col("set").alias("id"), F.col("id").alias("span"), "matched", "n")
    top = scored.groupBy("id", (F.col("matched") / F.col("n")).alias("ratio"), "matched").agg(*one("t")).groupBy("id").agg(F.max(F.struct("ratio", "matched", "t_n", "t_at")).alias("m"))
    found = c.select("id").join(exact, "id", "left").join(named, "id", "left").join(top.select("id", "m.t_n", "m.t_at"), "id", "left")
    n, at = F.coalesce("e_n", "s_n", "t_n", F.lit(0)), F.coalesce("e_at", "s_at", "t_at")
    method = F.expr("case when e_n = 1 then 'exact_evidence' when e_n is null and s_n = 1 then 'exact_title_in_section' when e_n is null and s_n is null and t_n = 1 then 'source_block_tokens' end")
    return found.select("id", method.alias("method"), F.when(n == 1, at).alias("span"), n.alias("n_plausible"))


@query()
def align_in_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each clause of an item stands among the documents' clauses, in three tiers.  A document's section is
    its source; an item's is the one source that holds whole clauses of it, and an item with none or several of
    those has no section.  The title is the item's first clause."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[,;.\n]")).alias("pos", "clause")).where("trim(clause) != ''")
    title = b.groupBy("item_id").agg(F.min_by("clause", "pos").alias("title"))
    c = _candidates(b.join(title, "item_id").select(F.struct("item_id", "pos").alias("id"), F.col("clause").alias("evidence"), "title", F.col("clause").alias("description")))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", T.normalize(F.col("source")).alias("s_section"), F.posexplode(F.split("text", r"[,;.\n]")).alias("pos", "clause"))
    s = _asked(c, d.select(F.struct("doc_id", "pos").alias("span"), "source", "s_section", T.normalize(F.col("clause")).alias("text")))
    held = s.select(F.col("text").alias("evidence"), "source").join(c.select("id.item_id", "evidence").distinct(), "evidence")
    section = held.groupBy("item_id").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).select("item_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("section"))
    section = section.select("item_id", T.normalize(F.col("section")).alias("c_section"))
    found = _tiers(staged(c.withColumn("item_id", F.col("id.item_id")).join(section, "item_id", "left").drop("item_id").fillna("", "c_section"), "in-sections"), s)
    return found.select("id.item_id", F.col("id.pos").alias("pos"), "method", F.col("span.doc_id").alias("doc_id"), F.col("span.pos").alias("doc_pos"), "n_plausible")


def claim_budget(claims: DataFrame, n: int | None = None) -> DataFrame:
    """Greedy one-to-one assignment within each group, in order of ``rank``: a row is taken if neither its
    ``left`` nor its ``right`` is.  Order decides, so this is a fold over sorted rows; a task holds the taken
    ends of one group at a time, and sorts one of n parts."""
    import pandas as pd

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, lefts, rights = None, set(), set()
        for b in batches:
            keep = []
            for g, left, right in zip(b["group"], b["left"], b["right"]):
                if g != group:
                    group, lefts, rights = g, set(), set()
                keep.append(left not in lefts and right not in rights)
                if keep[-1]:
                    lefts.add(left)
                    rights.add(right)
            yield b.loc[pd.Series(keep, index=b.index, dtype=bool), ["group", "left", "right"]]

    types = dict(claims.dtypes)
    ordered = claims.select("group", "left", "right", "rank").repartition(*[n] if n else [], "group").sortWithinPartitions("group", "rank", "left", "right")
    return ordered.mapInPandas(fold, f"group {types['group']}, left {types['left']}, right {types['right']}")


@query()
def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to suppliers within an order, cheapest first, each once.  There are as many parts as lines call for, so a task's share stays."""
    n = partitions(table(spark, sf_dir, "lineitem"))
    li = items(spark, sf_dir, n).groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min("l_extendedprice").alias("rank"))
    return claim_budget(li.select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("left"), F.col("l_suppkey").alias("right"), "rank"), n)
