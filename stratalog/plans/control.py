"""Control plane: clocks, choices, creation checks, recovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import views
from ..sources.views import with_views
from .journal import JOURNAL_SQL, journal
from .reads import T
from .registry import query
from .storage import RUN_SQL, runs
from .transactions import INTENT_SQL, OUT_SQL, intents, outcomes

#: A read may be so far ahead of the clock (micros).
AHEAD = 100_000


@query(with_views(f" SELECT event_id, ts > {T} + {AHEAD} AS rejected FROM R", "R"))
def read_time_sanity(spark, sf):
    """Reads at a time too far ahead of the clock (T) are rejected."""
    return views.events(spark, sf).select("event_id", (F.col("ts") > T + AHEAD).alias("rejected"))


@query("WITH S AS (SELECT s_nationkey AS nation, list_sort(list_distinct(list(s_suppkey % 7))) AS shards FROM supplier GROUP BY ALL) SELECT nation, CAST(len(shards) AS BIGINT) AS shards, shards[nation % len(shards) + 1] AS chosen FROM S")
def choose_shard(spark, sf):
    """One of the distinct shards of a group, by its number."""
    rows = views.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sort_array(F.collect_set(F.col("s_suppkey") % 7)).alias("s"))
    return rows.select("nation", F.size("s").cast("long").alias("shards"), F.get("s", (F.col("nation") % F.size("s")).cast("int")).alias("chosen"))


@query(with_views(f", {RUN_SQL} SELECT level, bool_or(run_id % 5 = 0) AS busy, bool_and(run_id % 5 <> 0) AS drained FROM RUN GROUP BY level", "L"))
def compaction_drained(spark, sf):
    """Whether any run of a level is being compacted, and whether none is."""
    busy = F.col("run_id") % 5 == 0
    return runs(spark, sf).groupBy("level").agg(F.bool_or(busy).alias("busy"), F.bool_and(~busy).alias("drained"))


@query("WITH A AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey < 18), B AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey >= 6) SELECT node, 'left' AS change FROM (SELECT node FROM A EXCEPT SELECT node FROM B) UNION ALL SELECT node, 'joined' FROM (SELECT node FROM B EXCEPT SELECT node FROM A)")
def node_changes(spark, sf):
    """Nodes of one listing that aren't in the next, and the other way round."""
    s = views.table(spark, sf, "supplier")
    a, b = (s.where(c).select(F.col("s_suppkey").alias("node")) for c in ("s_nationkey < 18", "s_nationkey >= 6"))
    return a.exceptAll(b).select("node", F.lit("left").alias("change")).unionByName(b.exceptAll(a).select("node", F.lit("joined").alias("change")))


# First and largest wait (micros) of the backoff.
FIRST, MOST = 10_000, 5_000_000


@query(f"SELECT o_orderkey AS id, CAST(floor(least({MOST}, {FIRST} * (1 << (o_orderkey % 12))) * (500 + o_custkey % 1000) / 1000) AS BIGINT) AS wait FROM orders")
def backoff(spark, sf):
    """Waits that double with each attempt up to the largest, times 0.5 to 1.5 by a number that differs between callers."""
    doubled = F.least(F.lit(MOST), F.expr(f"{FIRST} * shiftleft(1L, cast(o_orderkey % 12 as int))"))
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), doubled.alias("d"), "o_custkey").select("id", F.floor(F.col("d") * (500 + F.col("o_custkey") % 1000) / 1000).cast("long").alias("wait"))


@query(with_views(f", {INTENT_SQL} SELECT txid, prepare_ts, prepare_ts - 1 AS retry_ts, rank() OVER (PARTITION BY key ORDER BY prepare_ts - txid % 2, txid) = 1 AS wins FROM I", "O"))
def retry_priority(spark, sf):
    """A transaction that is tried again gets a time one micro before its old one, so it is older than all that came after; the oldest of a key wins."""
    tried = F.col("prepare_ts") - F.col("txid") % 2
    wins = F.rank().over(Window.partitionBy("key").orderBy(tried, "txid")) == 1
    return intents(spark, sf).select("txid", "prepare_ts", (F.col("prepare_ts") - 1).alias("retry_ts"), wins.alias("wins"))


@query(with_views(f", {INTENT_SQL}, {OUT_SQL} SELECT I.txid, coalesce(F.outcome, 'cleaned') AS state FROM I LEFT JOIN F USING (txid)", "O"))
def outcome_of_waiters(spark, sf):
    """What a waiter learns of a transaction: its outcome, or that it was cleaned up already if there is none."""
    return intents(spark, sf).join(outcomes(spark, sf), "txid", "left").select("txid", F.coalesce("outcome", F.lit("cleaned")).alias("state"))


@query(with_views(f""", {INTENT_SQL}, {OUT_SQL}, P AS (SELECT I.*, o_custkey % 4 AS shard FROM I JOIN O ON O.o_orderkey = I.txid)
SELECT shard, count(*) AS pending, count(F.outcome) AS decided, CAST(count(*) FILTER (F.outcome = 'commit') AS BIGINT) AS committed, min(CASE WHEN F.outcome IS NULL THEN P.prepare_ts END) AS oldest_open FROM P LEFT JOIN F USING (txid) GROUP BY shard""", "O"))
def recovery_scan(spark, sf):
    """What a shard finds when it starts: pending intents of its data keys, those decided, and the oldest that is open."""
    own = views.orders(spark, sf).select(F.col("o_orderkey").alias("txid"), (F.col("o_custkey") % 4).alias("shard"))
    rows = intents(spark, sf).join(own, "txid").join(outcomes(spark, sf), "txid", "left")
    return rows.groupBy("shard").agg(
        F.count("*").alias("pending"), F.count("outcome").alias("decided"), F.count_if(F.col("outcome") == "commit").alias("committed"), F.min(F.when(F.col("outcome").isNull(), F.col("prepare_ts"))).alias("oldest_open")
    )


@query(with_views(f", {INTENT_SQL}, {OUT_SQL} SELECT I.key, F.txid, F.outcome, CAST((row_number() OVER (PARTITION BY I.key ORDER BY I.prepare_ts, F.txid) - 1) // 64 AS BIGINT) AS round FROM I JOIN F USING (txid)", "O"))
def resolve_rounds(spark, sf):
    """Prepared keys whose transaction is decided, resolved in order of time, 64 of a key at once."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("prepare_ts", "txid")) - 1
    return intents(spark, sf).join(outcomes(spark, sf), "txid").select("key", "txid", "outcome", F.floor(place / 64).cast("long").alias("round"))


# Groups to create: a customer's orders' keys as splits, as they come.
SPLITS_SQL = "G AS (SELECT o_custkey AS grp, list(o_totalprice ORDER BY o_orderkey) AS splits FROM orders GROUP BY o_custkey)"


@query(f"WITH {SPLITS_SQL} SELECT grp, CASE WHEN len(list_distinct(splits)) < len(splits) THEN 'repeated' WHEN splits <> list_sort(splits) THEN 'unsorted' WHEN list_min(splits) < 1000 THEN 'at an end' ELSE 'ok' END AS verdict, CAST(len(splits) + 1 AS BIGINT) AS tablets FROM G")
def create_group(spark, sf):
    """Checks of a new group's splits: distinct, ascending, none at the end of the axis; it gets one tablet more than splits."""
    rows = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("s"))
    verdict = F.when(F.size(F.array_distinct("s")) < F.size("s"), "repeated").when(F.col("s") != F.sort_array("s"), "unsorted").when(F.array_min("s") < 1000, "at an end").otherwise("ok")
    return rows.select("grp", verdict.alias("verdict"), (F.size("s") + 1).cast("long").alias("tablets"))


@query("WITH K AS (SELECT p_partkey AS id, p_size AS grp FROM part), E AS (SELECT s_suppkey AS id FROM supplier), G AS (SELECT n_nationkey AS grp FROM nation) SELECT K.id, CASE WHEN K.id >= 16777216 THEN 'not 24 bits' WHEN G.grp IS NULL THEN 'no such group' WHEN E.id IS NOT NULL THEN 'exists' ELSE 'ok' END AS verdict FROM K LEFT JOIN E ON E.id = K.id LEFT JOIN G ON G.grp = K.grp")
def create_keyspace(spark, sf):
    """Checks of new keyspaces: the id fits 24 bits and is free, the group exists."""
    k = views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("grp"))
    e = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("taken"))
    g = views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("grp"), F.lit(True).alias("known"))
    verdict = F.when(F.col("id") >= 1 << 24, "not 24 bits").when(F.col("known").isNull(), "no such group").when(F.col("taken").isNotNull(), "exists").otherwise("ok")
    return k.join(e, "id", "left").join(F.broadcast(g), "grp", "left").select("id", verdict.alias("verdict"))


@query("SELECT s_nationkey AS region, s_suppkey AS node, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS shard FROM supplier")
def add_shards(spark, sf):
    """New shards, one a node: numbers go on behind the largest there is, by region."""
    last = views.table(spark, sf, "nation").agg(F.max("n_nationkey").cast("long").alias("last"))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return views.table(spark, sf, "supplier").join(F.broadcast(last)).select(F.col("s_nationkey").alias("region"), F.col("s_suppkey").alias("node"), (F.col("last") + place).cast("long").alias("shard"))


@query("SELECT s_nationkey AS cluster, s_suppkey AS node FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY lpad(CAST(s_suppkey AS VARCHAR), 12, '0')) <= 3")
def metadata_hosts(spark, sf):
    """The first three nodes of a cluster, by the text of their ids, hold its metadata."""
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.lpad(F.col("s_suppkey").cast("string"), 12, "0")))
    return views.table(spark, sf, "supplier").withColumn("p", place).where("p <= 3").select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("node"))


@query("SELECT o_orderkey AS txid, o_custkey % 32 AS worker, o_custkey AS list, CASE WHEN o_orderstatus = 'P' THEN 'read' ELSE 'append' END AS op, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS item, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS step FROM orders")
def list_workload(spark, sf):
    """The workload that the checker judges: appends of unique items and reads, each on one list, in order."""
    read = F.col("o_orderstatus") == "P"
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("txid"), (F.col("o_custkey") % 32).alias("worker"), F.col("o_custkey").alias("list"), F.when(read, "read").otherwise("append").alias("op"), F.when(~read, F.col("o_orderkey")).alias("item"), step.alias("step")
    )


@query(with_views(f", {JOURNAL_SQL} SELECT shard, count(*) AS entries, min(seq) AS oldest, max(seq) AS latest, CAST(count(*) FILTER (seq <= 300) AS BIGINT) AS trimmed FROM J GROUP BY shard", "R"))
def journal_ends(spark, sf):
    """A shard's first and last sequence number, and how many entries trimming up to 300 takes away."""
    return journal(spark, sf).groupBy("shard").agg(F.count("*").alias("entries"), F.min("seq").alias("oldest"), F.max("seq").alias("latest"), F.count_if(F.col("seq") <= 300).alias("trimmed"))


# Blocks of a run: 64 order keys each.
BLOCK_SQL = "B AS (SELECT key, ts, l_orderkey // 64 AS block, l_linenumber, min(key) OVER (PARTITION BY l_orderkey // 64) AS lo, max(key) OVER (PARTITION BY l_orderkey // 64) AS hi, min(ts) OVER (PARTITION BY l_orderkey // 64) AS first, max(ts) OVER (PARTITION BY l_orderkey // 64) AS last FROM L), P AS (SELECT *, coalesce(list_max(list_filter(range(0, 9), n -> left(lo, 2 * n) = left(hi, 2 * n))), 0) AS shared FROM B)".replace("n -> ", "lambda n: ")
WIDTH_SQL = "CAST(greatest(1, ceil(length(ltrim(hex({0}), '0')) / 2.0)) AS INTEGER)"


@query(with_views(f", {BLOCK_SQL} SELECT block, key, ts, l_linenumber AS line, left(lo, 2 * shared) AS prefix, substr(key, 2 * shared + 1) AS suffix, lpad(hex(ts - first), 2 * {WIDTH_SQL.format('last - first')}, '0') AS delta FROM P", "L"))
def block_entries(spark, sf):
    """Rows of a block as they are stored: keys behind the prefix that all share, times as differences to the first, in as many bytes as the largest takes."""
    from ..functions import encodings as E

    rows = views.lineitem(spark, sf).select("key", "ts", F.floor(F.col("l_orderkey") / 64).alias("block"), F.col("tie.l_linenumber").alias("line"))
    ends = rows.groupBy("block").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    ends = ends.select("block", "lo", "first", E.shared_prefix_bytes(F.col("lo"), F.col("hi")).alias("shared"), E.byte_width(F.col("last") - F.col("first")).alias("width"))
    both = rows.join(ends, "block")
    delta = F.lpad(F.hex(F.col("ts") - F.col("first")), 2 * F.col("width"), F.lit("0"))
    return both.select("block", "key", "ts", "line", F.substr("lo", F.lit(1), 2 * F.col("shared")).alias("prefix"), F.substr("key", 2 * F.col("shared") + 1).alias("suffix"), delta.alias("delta"))


@query(with_views(f", {BLOCK_SQL} SELECT block, min(lo) AS lower, max(hi) AS upper, count(*) AS revisions, count(DISTINCT key) AS keys, CAST(max(shared) AS INTEGER) AS prefix_bytes, max({WIDTH_SQL.format('last - first')}) AS ts_bytes FROM P GROUP BY block", "L"))
def block_stats(spark, sf):
    """A listing of blocks: key range, counts, bytes of the shared prefix and of a time."""
    from ..functions import encodings as E

    rows = views.lineitem(spark, sf).groupBy(F.floor(F.col("l_orderkey") / 64).alias("block"), "key").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    rows = rows.groupBy("block").agg(F.min("key").alias("lower"), F.max("key").alias("upper"), F.sum("n").alias("revisions"), F.count("*").alias("keys"), F.min("first").alias("first"), F.max("last").alias("last"))
    return rows.select("block", "lower", "upper", "revisions", "keys", E.shared_prefix_bytes(F.col("lower"), F.col("upper")).alias("prefix_bytes"), E.byte_width(F.col("last") - F.col("first")).alias("ts_bytes"))
