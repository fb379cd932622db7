"""Metadata, transfers and rebalancing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import views
from .registry import query

# Tablets out of the customers: 1500 ranges of the key axis with a size each, on 4 shards.
TAB_SQL = "TAB AS (SELECT c_custkey AS id, c_nationkey % 3 AS colo, (c_custkey * 7) % 4 AS shard, c_custkey AS lo, c_custkey + 1 AS hi, CAST(round((c_acctbal + 1000) * 1200000) AS BIGINT) AS size FROM customer)"


def tablets(spark, sf):
    size = F.round((F.col("c_acctbal") + 1000) * 1_200_000).cast("long")
    return views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).cast("long").alias("colo"), (F.col("c_custkey") * 7 % 4).alias("shard"), F.col("c_custkey").alias("lo"), (F.col("c_custkey") + 1).alias("hi"), size.alias("size")
    )


# Sizes in bytes of the planner.
SPLIT, MERGE, CAPACITY, GAP, SHARE = 10_000_000_000, 2_500_000_000, 1_000_000_000_000, 10_000_000_000, 0.7


@query(f"WITH {TAB_SQL} SELECT id, size, row_number() OVER (ORDER BY size DESC, id) AS place FROM TAB WHERE size > {SPLIT}")
def split_candidates(spark, sf):
    """Tablets beyond the split size, largest first."""
    big = tablets(spark, sf).where(F.col("size") > SPLIT)
    return big.select("id", "size", F.row_number().over(Window.orderBy(F.desc("size"), "id")).cast("long").alias("place"))


@query(f"WITH {TAB_SQL} SELECT a.id AS left_id, b.id AS right_id, CAST(a.colo AS BIGINT) AS colo, a.size + b.size AS size FROM TAB a JOIN TAB b ON a.hi = b.lo AND a.colo = b.colo")
def adjacent_tablets(spark, sf):
    a = tablets(spark, sf).select(F.col("id").alias("left_id"), F.col("hi").alias("at"), "colo", F.col("size").alias("s"))
    b = tablets(spark, sf).select(F.col("id").alias("right_id"), F.col("lo").alias("at"), "colo", F.col("size").alias("t"))
    return a.join(b, ["at", "colo"]).select("left_id", "right_id", "colo", (F.col("s") + F.col("t")).alias("size"))


@query(f"WITH {TAB_SQL}, G AS (SELECT colo FROM TAB GROUP BY colo HAVING count(*) > 8 * 4) SELECT a.id AS left_id, min(b.id) AS right_id, a.size + min(b.size) AS size FROM TAB a JOIN TAB b ON a.hi = b.lo AND a.colo = b.colo WHERE a.size + b.size < {MERGE} AND a.colo IN (SELECT colo FROM G) AND (SELECT count(*) FROM TAB) > 1024 GROUP BY a.id, a.size")
def merge_candidates(spark, sf):
    """Neighbours that are small together, in groups with more than eight tablets a shard, if there are more than 1024 tablets."""
    t = tablets(spark, sf)
    groups = t.groupBy("colo").agg(F.count("*").alias("n")).where(F.col("n") > 8 * 4).select("colo")
    enough = t.agg((F.count("*") > 1024).alias("enough"))
    pairs = adjacent_tablets(spark, sf).join(groups, "colo", "left_semi").where(F.col("size") < MERGE)
    return pairs.join(F.broadcast(enough)).where("enough").select("left_id", "right_id", "size")


@query(f"WITH {TAB_SQL}, S AS (SELECT shard, CAST(sum(size) AS BIGINT) AS size FROM TAB GROUP BY shard), M AS (SELECT arg_max(shard, size) AS src, arg_min(shard, size) AS dst, max(size) AS most, max(size) - min(size) AS gap FROM S) SELECT T.id AS id, CAST(M.src AS BIGINT) AS src, CAST(M.dst AS BIGINT) AS dst, T.size AS size FROM TAB T JOIN M ON T.shard = M.src WHERE M.most >= {SHARE} * {CAPACITY} AND M.gap >= {GAP} AND T.size <= M.gap / 2")
def move_candidates(spark, sf):
    """Tablets of the fullest shard that may go to the emptiest without turning the difference over."""
    t = tablets(spark, sf)
    sizes = t.groupBy("shard").agg(F.sum("size").alias("size"))
    ends = sizes.agg(F.max_by("shard", "size").alias("src"), F.min_by("shard", "size").alias("dst"), F.max("size").alias("most"), (F.max("size") - F.min("size")).alias("gap"))
    ends = ends.where((F.col("most") >= SHARE * CAPACITY) & (F.col("gap") >= GAP))
    return t.join(F.broadcast(ends), F.col("shard") == F.col("src")).where(F.col("size") <= F.col("gap") / 2).select("id", "src", "dst", "size")


@query(f"WITH {TAB_SQL} SELECT CAST(colo AS BIGINT) AS colo, count(*) AS n FROM TAB GROUP BY colo")
def count_tablets_per_group(spark, sf):
    return tablets(spark, sf).groupBy("colo").agg(F.count("*").alias("n"))


@query(f"WITH {TAB_SQL} SELECT CAST(shard AS BIGINT) AS shard, max(id) + 1 AS next_id FROM TAB GROUP BY shard")
def next_tablet_id(spark, sf):
    return tablets(spark, sf).groupBy("shard").agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


# Transfers with sources and destinations.
TRANSFERS = [(1, [10, 11], [20]), (2, [12], [21, 22]), (3, [13], [23]), (4, [14, 15], [24])]
RANGES = [(10, 0, 5), (11, 5, 9), (20, 0, 9), (12, 9, 20), (21, 9, 12), (22, 12, 20), (13, 20, 30), (23, 20, 31), (14, 31, 40), (15, 41, 50), (24, 31, 50)]
TRANSFER_SQL = "TR(id, src, dst) AS (VALUES " + ", ".join(f"({i}, {s}, {d})" for i, s, d in TRANSFERS) + "), RG(tablet, lo, hi) AS (VALUES " + ", ".join(str(r) for r in RANGES) + ")"


def transfers(spark):
    return spark.createDataFrame(TRANSFERS, "id int, src array<int>, dst array<int>"), spark.createDataFrame(RANGES, "tablet int, lo int, hi int")


@query(f"WITH {TRANSFER_SQL} SELECT id AS transfer, 'src' AS role, unnest(src) AS tablet FROM TR UNION ALL SELECT id, 'dst', unnest(dst) FROM TR")
def transfer_membership(spark, sf):
    t, _ = transfers(spark)
    side = lambda c: t.select(F.col("id").alias("transfer"), F.lit(c).alias("role"), F.explode(c).alias("tablet"))
    return side("src").unionByName(side("dst"))


@query(f"""WITH {TRANSFER_SQL}, M AS (SELECT id, 'src' AS role, unnest(src) AS tablet FROM TR UNION ALL SELECT id, 'dst', unnest(dst) FROM TR),
C AS (SELECT id, role, min(lo) AS lo, max(hi) AS hi, sum(hi - lo) = max(hi) - min(lo) AS whole FROM M JOIN RG USING (tablet) GROUP BY ALL)
SELECT a.id AS transfer, a.whole AND b.whole AND a.lo = b.lo AND a.hi = b.hi AS valid FROM C a JOIN C b ON a.id = b.id AND a.role = 'src' AND b.role = 'dst'""")
def transfer_validate(spark, sf):
    """Sources and destinations must each be contiguous and cover the same range."""
    _, ranges = transfers(spark)
    cover = transfer_membership(spark, sf).join(ranges, "tablet").groupBy("transfer", "role").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum(F.col("hi") - F.col("lo")) == F.max("hi") - F.min("lo")).alias("whole"))
    a, b = (cover.where(F.col("role") == r).select("transfer", *[F.col(c).alias(f"{r}_{c}") for c in ("lo", "hi", "whole")]) for r in ("src", "dst"))
    return a.join(b, "transfer").select("transfer", (F.col("src_whole") & F.col("dst_whole") & (F.col("src_lo") == F.col("dst_lo")) & (F.col("src_hi") == F.col("dst_hi"))).alias("valid"))


# The transfer states and their allowed successors.
ALLOWED = [("Initialised", "Syncing"), ("Syncing", "Synced"), ("Synced", "Handoff"), ("Handoff", "Complete"), ("Initialised", "Aborted"), ("Syncing", "Aborted"), ("Synced", "Aborted")]
TRACE = [(1, 1, "Initialised"), (1, 2, "Syncing"), (1, 3, "Synced"), (1, 4, "Handoff"), (1, 5, "Complete"), (2, 1, "Initialised"), (2, 2, "Synced"), (2, 3, "Aborted"), (3, 1, "Initialised"), (3, 2, "Syncing"), (3, 3, "Synced"), (3, 4, "Handoff"), (3, 5, "Aborted")]


@query("WITH A(src, dst) AS (VALUES " + ", ".join(str(a) for a in ALLOWED) + "), T(transfer, step, state) AS (VALUES " + ", ".join(str(t) for t in TRACE) + "), L AS (SELECT *, lag(state) OVER (PARTITION BY transfer ORDER BY step) AS before FROM T) SELECT transfer, step, before, state FROM L WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM A WHERE A.src = L.before AND A.dst = L.state)")
def state_transition_violations(spark, sf):
    allowed = spark.createDataFrame(ALLOWED, "before string, state string")
    trace = spark.createDataFrame(TRACE, "transfer int, step int, state string").withColumn("before", F.lag("state").over(Window.partitionBy("transfer").orderBy("step")))
    return trace.where("before is not null").join(F.broadcast(allowed), ["before", "state"], "left_anti").select("transfer", "step", "before", "state")


@query("WITH S AS (SELECT s_suppkey AS shard, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier WHERE s_suppkey % 4 <> 0), N AS (SELECT n_nationkey AS node, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)) SELECT shard, CAST(node AS BIGINT) AS node FROM S JOIN N USING (n)")
def assign_shards(spark, sf):
    """Shards without a node to nodes without a shard, in order."""
    s, n = views.table(spark, sf, "supplier"), views.table(spark, sf, "nation")
    free_shards = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("shard"), F.row_number().over(Window.orderBy("s_suppkey")).alias("n"))
    taken = s.where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    free_nodes = n.join(taken, "n_nationkey", "left_anti").select(F.col("n_nationkey").cast("long").alias("node"), F.row_number().over(Window.orderBy("n_nationkey")).alias("n"))
    return free_shards.join(free_nodes, "n").select("shard", "node")


@query(f"WITH {TRANSFER_SQL}, M AS (SELECT id, unnest(src) AS tablet FROM TR) SELECT id AS transfer, count(*) AS runs, CAST(count(*) FILTER (tablet % 2 = 0) AS BIGINT) AS loaded, bool_and(tablet % 2 = 0) AS complete FROM M GROUP BY id")
def hydration_complete(spark, sf):
    """Whether all runs of a transfer's sources (one each here) are loaded."""
    t, _ = transfers(spark)
    runs = t.select(F.col("id").alias("transfer"), F.explode("src").alias("tablet"))
    even = F.col("tablet") % 2 == 0
    return runs.groupBy("transfer").agg(F.count("*").alias("runs"), F.sum(even.cast("long")).alias("loaded"), F.bool_and(even).alias("complete"))
