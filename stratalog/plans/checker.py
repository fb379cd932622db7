"""The history checker: list appends and reads, and what contradicts a serial order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs
from ..operators import revisions as V
from ..sources import views
from .registry import query

# Every order is a transaction on its customer's list: pending orders read a prefix of it, all others append to it.
APPEND_SQL = "A AS (SELECT o_custkey AS list, o_orderkey AS txid, epoch_us(o_orderdate) AS ts, o_custkey % 4 AS thread, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders WHERE o_orderstatus <> 'P')"
READ_SQL = "RD AS (SELECT o_custkey AS list, o_orderkey AS reader, 1 + o_orderkey % 7 AS upto FROM orders WHERE o_orderstatus = 'P')"


def appends(spark, sf):
    o = views.table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    rows = o.select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("txid"), views.micros("o_orderdate").alias("ts"), (F.col("o_custkey") % 4).alias("thread"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("list").orderBy("ts", "txid")).cast("long"))


def reads(spark, sf):
    rows = views.table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return rows.select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("reader"), (1 + F.col("o_orderkey") % 7).alias("upto"))


@query(f"WITH {APPEND_SQL} SELECT * FROM (SELECT list, lag(txid) OVER (PARTITION BY list ORDER BY pos) AS src, txid AS dst FROM A) WHERE src IS NOT NULL")
def ww_edges(spark, sf):
    """Each append after the one before it."""
    before = F.lag("txid").over(Window.partitionBy("list").orderBy("pos"))
    return appends(spark, sf).select("list", before.alias("src"), F.col("txid").alias("dst")).where("src is not null")


@query(f"WITH {APPEND_SQL}, {READ_SQL} SELECT RD.list AS list, A.txid AS src, RD.reader AS dst FROM RD JOIN A ON A.list = RD.list AND A.pos = RD.upto")
def wr_edges(spark, sf):
    """A read after the last append that it saw."""
    return reads(spark, sf).join(appends(spark, sf), "list").where("pos = upto").select("list", F.col("txid").alias("src"), F.col("reader").alias("dst"))


@query(f"WITH {APPEND_SQL}, {READ_SQL} SELECT RD.list AS list, RD.reader AS src, A.txid AS dst FROM RD JOIN A ON A.list = RD.list AND A.pos = RD.upto + 1")
def rw_edges(spark, sf):
    """A read before the first append that it didn't see."""
    return reads(spark, sf).withColumn("pos", F.col("upto") + 1).join(appends(spark, sf), ["list", "pos"]).select("list", F.col("reader").alias("src"), F.col("txid").alias("dst"))


@query(f"WITH {APPEND_SQL}, O2 AS (SELECT list, txid, ts, max(struct_pack(ts := ts, txid := txid)) OVER (PARTITION BY list ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM A) SELECT list, m.txid AS src, txid AS dst FROM O2 WHERE m.ts < ts")
def ts_edges(spark, sf):
    """An append after the one with the largest earlier commit time."""
    top = F.max(F.struct("ts", "txid")).over(Window.partitionBy("list").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return appends(spark, sf).withColumn("m", top).where(F.col("m.ts") < F.col("ts")).select("list", F.col("m.txid").alias("src"), F.col("txid").alias("dst"))


RT_SQL = """T(thread) AS (VALUES (0), (1), (2), (3)), U AS (SELECT T.thread, A.ts, 0 AS side, A.txid AS dst, NULL AS txid FROM A JOIN T ON T.thread <> A.thread UNION ALL SELECT thread, ts, 1, NULL, txid FROM A),
V AS (SELECT *, max(CASE WHEN side = 1 THEN struct_pack(ts := ts, txid := txid) END) OVER (PARTITION BY thread ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS m FROM U)"""


@query(f"WITH {APPEND_SQL}, {RT_SQL} SELECT CAST(thread AS BIGINT) AS thread, m.txid AS src, dst FROM V WHERE side = 0 AND m IS NOT NULL")
def rt_edges(spark, sf):
    """The last transaction that each other thread had finished before one began: real time."""
    a = appends(spark, sf).select("thread", "ts", "txid")
    threads = F.explode(F.array(*[F.lit(t).cast("long") for t in range(4)]))
    asks = a.withColumn("other", threads).where("other <> thread").select(F.col("other").alias("key"), F.col("ts").alias("at"), F.col("txid").alias("dst"))
    facts = a.select(F.col("thread").alias("key"), "ts", F.col("txid").alias("tie"), F.col("txid").alias("src"))
    # only what ended earlier counts
    return V.asof_join(asks, facts, "dst", strict=True, hot=True).where("src is not null").select(F.col("key").alias("thread"), "src", "dst")


@query(f"WITH {APPEND_SQL}, {READ_SQL} SELECT RD.list AS list, max(RD.upto) AS longest, arg_max(RD.reader, RD.upto * 1000000000 + RD.reader) AS reader FROM RD GROUP BY RD.list")
def longest_prefix_per_list(spark, sf):
    return reads(spark, sf).groupBy("list").agg(F.max("upto").alias("longest"), F.max_by("reader", F.struct("upto", "reader")).alias("reader"))


@query(f"WITH {APPEND_SQL}, {READ_SQL}, X AS (SELECT reader, list, reader * 10 + 7 AS item FROM RD WHERE upto > 5 UNION ALL SELECT RD.reader, RD.list, A.txid FROM RD JOIN A ON A.list = RD.list AND A.pos <= RD.upto) SELECT X.reader, X.list, X.item FROM X WHERE NOT EXISTS (SELECT 1 FROM A WHERE A.list = X.list AND A.txid = X.item)")
def garbage_reads(spark, sf):
    """Items that were read but never appended to the list; long reads hold one more item, which nobody wrote."""
    r, a = reads(spark, sf), appends(spark, sf)
    bad = r.where("upto > 5").select("reader", "list", (F.col("reader") * 10 + 7).alias("item"))
    good = r.join(a, "list").where("pos <= upto").select("reader", "list", F.col("txid").alias("item"))
    return bad.unionByName(good).join(a.select("list", F.col("txid").alias("item")), ["list", "item"], "left_anti").select("reader", "list", "item")


@query(f"WITH {APPEND_SQL}, {READ_SQL}, X AS (SELECT RD.reader, RD.list, A.pos + CASE WHEN RD.reader % 3 = 0 AND A.pos > 2 THEN 1 ELSE 0 END AS pos, A.txid AS item FROM RD JOIN A ON A.list = RD.list AND A.pos <= RD.upto) SELECT X.reader, X.list, min(X.pos) AS first_divergence FROM X JOIN A ON A.list = X.list AND A.pos = X.pos WHERE A.txid <> X.item GROUP BY ALL")
def divergent_reads(spark, sf):
    """Reads that differ from the longest list at some place, with the first."""
    r, a = reads(spark, sf), appends(spark, sf).select("list", "pos", F.col("txid").alias("item"))
    seen = r.join(a, "list").where("pos <= upto").select("reader", "list", (F.col("pos") + F.when((F.col("reader") % 3 == 0) & (F.col("pos") > 2), 1).otherwise(0)).alias("pos"), F.col("item").alias("got"))
    return seen.join(a, ["list", "pos"]).where("got <> item").groupBy("reader", "list").agg(F.min("pos").alias("first_divergence"))


# The dependency graph of all transactions; reads are turned back by three items each, so that histories conflict.
BACK_SQL = "RB AS (SELECT list, reader, upto, 1 + (reader + 3) % 7 AS other FROM RD)"
EDGE_SQL = """E AS (SELECT DISTINCT src, dst FROM (
  SELECT lag(txid) OVER (PARTITION BY list ORDER BY pos) AS src, txid AS dst FROM A
  UNION ALL SELECT A.txid, RB.reader FROM RB JOIN A ON A.list = RB.list AND A.pos = RB.upto
  UNION ALL SELECT RB.reader, A.txid FROM RB JOIN A ON A.list = RB.list AND A.pos = RB.other + 1) WHERE src IS NOT NULL AND src <> dst)"""
REACH = "P AS (SELECT src, dst FROM E UNION SELECT P.src, E.dst FROM P JOIN E ON P.dst = E.src)"
SCC_SQL = f"{APPEND_SQL}, {READ_SQL}, {BACK_SQL}, {EDGE_SQL}, {REACH}, S AS (SELECT a.src AS v, a.dst AS w FROM P a JOIN P b ON a.src = b.dst AND a.dst = b.src), C AS (SELECT v, min(w) AS component FROM S GROUP BY v HAVING count(DISTINCT w) > 1)"


def links(spark, sf):
    """(list, src, dst, kind): write after write, read after write and write after read on each list; an edge may stand there by several kinds."""
    a = appends(spark, sf).select("list", "pos", "txid")
    asks = F.array(F.struct(F.col("upto").alias("pos"), F.lit("wr").alias("kind")), F.struct((2 + (F.col("reader") + 3) % 7).alias("pos"), F.lit("rw").alias("kind")))
    met = reads(spark, sf).select("list", "reader", F.inline(asks)).join(a, ["list", "pos"])
    wr = F.col("kind") == "wr"
    read = met.select("list", F.when(wr, F.col("txid")).otherwise(F.col("reader")).alias("src"), F.when(wr, F.col("reader")).otherwise(F.col("txid")).alias("dst"), "kind")
    return ww_edges(spark, sf).withColumn("kind", F.lit("ww")).unionByName(read).where("src <> dst")


def least_kinds(edges):
    """Each edge once; the least of its kinds counts."""
    return edges.groupBy("src", "dst").agg(F.min("kind").alias("kind"))


def dependencies(spark, sf):
    """(src, dst, kind) over all lists."""
    return least_kinds(links(spark, sf))


@query(f"WITH RECURSIVE {SCC_SQL} SELECT v, component FROM C")
def scc(spark, sf):
    """Transactions that no serial order can hold: components of two and more."""
    return graphs.grouped_components(graphs.checkpointed(links(spark, sf).select("list", "src", "dst")), "list")


START_SQL = "B0 AS (SELECT component AS start FROM C GROUP BY component ORDER BY count(*), component LIMIT 1), B(start, v, d) AS (SELECT src, dst, 1 FROM E WHERE src = (SELECT start FROM B0) UNION SELECT B.start, E.dst, B.d + 1 FROM B JOIN E ON E.src = B.v WHERE B.d < 200 AND B.v <> B.start)"


@query(f"WITH RECURSIVE {SCC_SQL}, {START_SQL} SELECT start, CAST(min(d) AS INTEGER) AS length FROM B WHERE v = start GROUP BY start")
def shortest_cycle_len(spark, sf):
    """The shortest cycle through the smallest vertex of the smallest component."""
    path = violation(spark, sf)
    return spark.createDataFrame([(path[0][0], len(path))] if path else [], "start long, length int")


def violation(spark, sf):
    edges = graphs.checkpointed(links(spark, sf))
    parts = graphs.checkpointed(graphs.grouped_components(edges, "list"))
    least = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy("n", "component").take(1)
    if not least:
        return []
    # a cycle never leaves its component
    start = least[0]["component"]
    part = graphs.checkpointed(parts.where(F.col("component") == start).select("v"))
    inside = edges.join(part.toDF("src"), "src", "left_semi").join(part.toDF("dst"), "dst", "left_semi")
    return graphs.cycle_path(least_kinds(inside), start)


@query()
def explain_cycle(spark, sf):
    """The edges of a shortest cycle in the smallest component, in order, each with the dependency behind it."""
    rows = [(i, *edge) for i, edge in enumerate(violation(spark, sf))]
    return spark.createDataFrame(rows, "place int, src long, dst long, kind string")
