"""Bounds, ranges, range sets, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bounds, intervals
from ..sources import views
from ..sources.views import with_views
from .registry import query

SPLITS = [50, 100]
ROUTES = [(None, f"{50:016X}", 1), (f"{50:016X}", f"{100:016X}", 2), (f"{100:016X}", None, 3)]
ROUTE_SQL = "T(lo, hi, tablet) AS (VALUES (NULL, '{0}', 1), ('{0}', '{1}', 2), ('{1}', NULL, 3))".format(f"{50:016X}", f"{100:016X}")
HOLDS = "(T.lo IS NULL OR R.key >= T.lo) AND (T.hi IS NULL OR R.key < T.hi)"


def tablets(spark):
    return spark.createDataFrame(ROUTES, "lo string, hi string, tablet int")


@query(with_views(f", {ROUTE_SQL} SELECT CAST(T.tablet AS INTEGER) AS tablet, count(*) AS revisions, count(DISTINCT R.key) AS keys FROM R JOIN T ON {HOLDS} GROUP BY ALL", "R"))
def route_keys(spark, sf):
    routed = intervals.route(views.events(spark, sf), F.broadcast(tablets(spark)))
    return routed.groupBy("tablet").agg(F.count("*").alias("revisions"), F.countDistinct("key").alias("keys"))


BOUNDS = [("BeforeAll", ""), ("Before", f"{50:016X}"), ("After", f"{50:016X}"), ("Before", f"{75:016X}"), ("AfterPrefix", "00"), ("Before", f"{100:016X}"), ("AfterAll", "")]


def _routed(kind, key, direction):
    """Plain version for the SQL: the tablet in which a scan from a bound starts."""
    order = {"BeforeAll": (0, ""), "AfterAll": (2, ""), "AfterPrefix": (2, "") if key == "" or set(key) == {"F"} else (1, bounds.successor_hex(key) or "")}
    place = order.get(kind) or (1, key if kind == "Before" else key + "00")
    cuts = [(1, f"{s:016X}") for s in SPLITS]
    # a bound on a split belongs to the right tablet going up, to the left one going down
    return 1 + sum(c <= place if direction == "asc" else c < place for c in cuts)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{x}', {_routed(k, x, 'asc')}, {_routed(k, x, 'desc')})" for i, (k, x) in enumerate(BOUNDS)) + ") V(pos, kind, key, tablet_asc, tablet_desc)")
def route_bounds(spark, sf):
    rows = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(BOUNDS)], "pos int, kind string, key string")
    cut = bounds.bound(F.col("kind"), F.col("key"))
    splits = F.array(*[bounds.bound(F.lit("Before"), F.lit(f"{s:016X}")) for s in SPLITS])
    up = F.size(F.filter(splits, lambda s: (s["is_inf"] < cut["is_inf"]) | ((s["is_inf"] == cut["is_inf"]) & (s["cut"] <= cut["cut"]) & ~(F.col("kind") == "BeforeAll")))) + 1
    down = F.size(F.filter(splits, lambda s: (s["is_inf"] < cut["is_inf"]) | ((s["is_inf"] == cut["is_inf"]) & (s["cut"] < cut["cut"])))) + 1
    return rows.select("pos", "kind", "key", up.alias("tablet_asc"), down.alias("tablet_desc"))


@query(with_views(f", {ROUTE_SQL} SELECT R.key, count(*) AS revisions FROM R JOIN T ON {HOLDS} WHERE T.tablet <> 1 + R.user_id // 60 GROUP BY R.key", "R"))
def misrouted_keys(spark, sf):
    """Keys whose claimed owner isn't the one that the routing table names."""
    routed = intervals.route(views.events(spark, sf), F.broadcast(tablets(spark)))
    return routed.where(F.col("tablet") != 1 + F.floor(F.col("user_id") / 60)).groupBy("key").agg(F.count("*").alias("revisions"))


@query(with_views(f", {ROUTE_SQL}, K AS (SELECT DISTINCT key FROM R) SELECT CAST(T.tablet AS INTEGER) AS tablet, string_agg(R.key, ',' ORDER BY R.key) AS keys, count(*) AS n FROM K R JOIN T ON {HOLDS} GROUP BY ALL", "R"))
def split_keys_by_tablet(spark, sf):
    keys = views.events(spark, sf).select("key").distinct()
    return intervals.route(keys, F.broadcast(tablets(spark))).groupBy("tablet").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"), F.count("*").alias("n"))


@query(with_views(f", {ROUTE_SQL}, W AS (SELECT DISTINCT key, user_id % 3 = 0 AS is_precond FROM R) SELECT CAST(T.tablet AS INTEGER) AS tablet, CAST(count(*) FILTER (R.is_precond) AS BIGINT) AS preconditions, CAST(count(*) FILTER (NOT R.is_precond) AS BIGINT) AS mutations, string_agg(R.key, ',' ORDER BY R.key) AS keys FROM W R JOIN T ON {HOLDS} GROUP BY ALL", "R"))
def split_write_by_tablet(spark, sf):
    write = views.events(spark, sf).select("key", (F.col("user_id") % 3 == 0).alias("is_precond")).distinct()
    routed = intervals.route(write, F.broadcast(tablets(spark)))
    return routed.groupBy("tablet").agg(
        F.sum(F.col("is_precond").cast("long")).alias("preconditions"), F.sum((~F.col("is_precond")).cast("long")).alias("mutations"), F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys")
    )


STATES = [(1, 1, "Active", None, "40"), (2, 1, "Active", "40", "80"), (3, 1, "Hydrating", "40", "60"), (4, 1, "Stable", "80", None), (5, 2, "Active", None, None), (6, 1, "Frozen", "60", "80")]
STATE_SQL = "S(id, shard, state, lo, hi) AS (VALUES " + ", ".join(f"({i}, {s}, '{x}', {repr(lo) if lo else 'NULL'}, {repr(hi) if hi else 'NULL'})" for i, s, x, lo, hi in STATES) + ")"


@query(f"WITH {STATE_SQL} SELECT CAST(id AS INTEGER) AS id, CAST(shard AS INTEGER) AS shard, lo, hi, CAST(row_number() OVER (PARTITION BY shard ORDER BY lo NULLS FIRST) AS INTEGER) AS pos FROM S WHERE state IN ('Active', 'Stable')")
def routing_table(spark, sf):
    rows = spark.createDataFrame(STATES, "id int, shard int, state string, lo string, hi string").where(F.col("state").isin("Active", "Stable"))
    return rows.select("id", "shard", "lo", "hi", F.row_number().over(Window.partitionBy("shard").orderBy(F.col("lo").asc_nulls_first())).alias("pos"))


# Ranges out of the data: each user's span of event values, and each part's of its orders.
A_SQL = "A AS (SELECT user_id * 10 AS lo, user_id * 10 + 4 + user_id % 9 AS hi FROM (SELECT DISTINCT user_id FROM R))"
B_SQL = "B AS (SELECT user_id * 15 AS lo, user_id * 15 + 6 AS hi FROM (SELECT DISTINCT user_id FROM R))"
ISLANDS = """{0}1 AS (SELECT *, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {0}),
{0}2 AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi) AS i FROM {0}1),
{0}U AS (SELECT min(lo) AS lo, max(hi) AS hi FROM {0}2 GROUP BY i)"""


def set_a(spark, sf):
    u = views.events(spark, sf).select("user_id").distinct()
    return u.select((F.col("user_id") * 10).alias("lo"), (F.col("user_id") * 10 + 4 + F.col("user_id") % 9).alias("hi"))


def set_b(spark, sf):
    u = views.events(spark, sf).select("user_id").distinct()
    return u.select((F.col("user_id") * 15).alias("lo"), (F.col("user_id") * 15 + 6).alias("hi"))


@query(with_views(f", {A_SQL}, {ISLANDS.format('A')} SELECT lo, hi FROM AU", "R"))
def rangeset_union(spark, sf):
    return intervals.union(set_a(spark, sf))


@query(with_views(f", {A_SQL}, {B_SQL}, {ISLANDS.format('A')}, {ISLANDS.format('B')} SELECT greatest(AU.lo, BU.lo) AS lo, least(AU.hi, BU.hi) AS hi FROM AU JOIN BU ON AU.lo < BU.hi AND BU.lo < AU.hi", "R"))
def rangeset_intersection(spark, sf):
    return intervals.intersection(intervals.union(set_a(spark, sf)), intervals.union(set_b(spark, sf)))


@query(with_views(f""", {A_SQL}, {B_SQL}, {ISLANDS.format('A')}, {ISLANDS.format('B')},
C AS (SELECT hi AS lo, lead(lo, 1, 1000000000) OVER (ORDER BY lo) AS hi FROM BU UNION ALL SELECT -1000000000, min(lo) FROM BU)
SELECT greatest(AU.lo, C.lo) AS lo, least(AU.hi, C.hi) AS hi FROM AU JOIN C ON AU.lo < C.hi AND C.lo < AU.hi""", "R"))
def rangeset_difference(spark, sf):
    return intervals.difference(set_a(spark, sf), set_b(spark, sf))


@query(with_views(f", {A_SQL}, {ISLANDS.format('A')} SELECT 'below' AS side, lo, least(hi, 700) AS hi FROM AU WHERE lo < 700 UNION ALL SELECT 'above', greatest(lo, 700), hi FROM AU WHERE hi > 700", "R"))
def rangeset_split(spark, sf):
    merged = intervals.union(set_a(spark, sf))
    below = merged.where("lo < 700").select(F.lit("below").alias("side"), "lo", F.least("hi", F.lit(700)).alias("hi"))
    return below.unionByName(merged.where("hi > 700").select(F.lit("above").alias("side"), F.greatest("lo", F.lit(700)).alias("lo"), "hi"))


@query(with_views(f", {A_SQL}, {ISLANDS.format('A')} SELECT count(*) = 1 AS contiguous, CASE WHEN count(*) = 1 THEN min(lo) END AS lo, CASE WHEN count(*) = 1 THEN max(hi) END AS hi FROM AU", "R"))
def rangeset_contiguous(spark, sf):
    one = F.count("*") == 1
    return intervals.union(set_a(spark, sf)).agg(one.alias("contiguous"), F.when(one, F.min("lo")).alias("lo"), F.when(one, F.max("hi")).alias("hi"))


@query(with_views(f""", I AS (SELECT DISTINCT user_id AS seq, (user_id * 37) % 500 AS lo, (user_id * 37) % 500 + 20 + user_id % 30 AS hi FROM R),
C AS (SELECT DISTINCT c FROM (SELECT lo AS c FROM I UNION ALL SELECT hi FROM I)), P AS (SELECT c AS lo, lead(c) OVER (ORDER BY c) AS hi FROM C),
M AS (SELECT P.lo, P.hi, max(I.seq) AS seq FROM P JOIN I ON I.lo <= P.lo AND I.hi >= P.hi WHERE P.hi IS NOT NULL GROUP BY ALL),
G AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY seq ORDER BY lo) = lo THEN 0 ELSE 1 END AS s FROM M), H AS (SELECT *, sum(s) OVER (PARTITION BY seq ORDER BY lo) AS i FROM G)
SELECT seq, min(lo) AS lo, max(hi) AS hi FROM H GROUP BY seq, i""", "R"))
def rangemap_overlay(spark, sf):
    u = views.events(spark, sf).select(F.col("user_id").alias("seq")).distinct()
    inserts = u.select("seq", ((F.col("seq") * 37) % 500).alias("lo"), ((F.col("seq") * 37) % 500 + 20 + F.col("seq") % 30).alias("hi"), F.col("seq").alias("value"))
    return intervals.overlay(inserts).select("seq", "lo", "hi")


@query(with_views(f", {A_SQL} SELECT min(lo) AS lo, max(hi) AS hi FROM A WHERE lo < hi", "R"))
def bounding_range(spark, sf):
    return set_a(spark, sf).where("lo < hi").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query(with_views(f", {A_SQL} SELECT R.user_id AS user_id, count(*) AS held FROM (SELECT DISTINCT user_id FROM R) R JOIN A ON R.user_id * 11 >= A.lo AND R.user_id * 11 < A.hi GROUP BY ALL", "R"))
def range_contains(spark, sf):
    users = views.events(spark, sf).select("user_id").distinct()
    return intervals.containing(users.withColumn("p", F.col("user_id") * 11), set_a(spark, sf), "p").groupBy("user_id").agg(F.count("*").alias("held"))


@query(with_views(f", {A_SQL}, {B_SQL} SELECT A.lo AS a_lo, A.hi AS a_hi, B.lo AS b_lo, B.hi AS b_hi FROM A JOIN B ON A.lo < B.hi AND B.lo < A.hi", "R"))
def range_overlap_join(spark, sf):
    pairs = intervals.overlaps(set_a(spark, sf), set_b(spark, sf))
    return pairs.select(F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("lo2").alias("b_lo"), F.col("hi2").alias("b_hi"))


@query(with_views(f", {A_SQL} SELECT x.lo AS lo, x.hi AS mid, y.hi AS hi FROM A x JOIN A y ON x.hi = y.lo", "R"))
def range_adjacent(spark, sf):
    a = set_a(spark, sf)
    return a.toDF("lo", "mid").join(a.toDF("mid", "hi"), "mid").select("lo", "mid", "hi")


# Bounds in their order.
ORDERED = [("BeforeAll", ""), ("Before", ""), ("After", ""), ("Before", "00"), ("After", "00"), ("Before", "0001"), ("After", "0001"), ("AfterPrefix", "0001"), ("AfterPrefix", "00"), ("Before", "01"), ("AfterPrefix", "FF"), ("AfterPrefix", ""), ("AfterAll", "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{x}')" for i, (k, x) in enumerate(ORDERED, 1)) + ") V(pos, kind, key)")
def bound_sort(spark, sf):
    rows = spark.createDataFrame(list(reversed(ORDERED)), "kind string, key string")
    order = Window.orderBy(bounds.bound(F.col("kind"), F.col("key")))
    return rows.select(F.row_number().over(order).alias("pos"), "kind", "key")


@query(with_views(", S AS (SELECT DISTINCT user_id AS split FROM R) SELECT lag(split) OVER (ORDER BY split) AS lo, split AS hi FROM S UNION ALL SELECT max(split), NULL FROM S", "R"))
def splits_to_ranges(spark, sf):
    return intervals.splits_to_ranges(views.events(spark, sf).select(F.col("user_id").alias("split")).distinct())


@query(with_views(", S AS (SELECT DISTINCT user_id AS split FROM R) SELECT split, TRUE AS contiguous FROM S", "R"))
def ranges_to_splits(spark, sf):
    return intervals.ranges_to_splits(splits_to_ranges(spark, sf))


@query(with_views(", S AS (SELECT DISTINCT user_id FROM R) SELECT user_id, CAST((row_number() OVER (ORDER BY user_id) - 1) % 3 AS BIGINT) AS shard FROM S", "R"))
def round_robin_placement(spark, sf):
    users = views.events(spark, sf).select("user_id").distinct()
    return intervals.numbered(users, "user_id").select("user_id", (F.col("_place") % 3).cast("long").alias("shard"))
