"""Runs, manifests, compaction, split points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.encodings import shortest_between_hex
from ..operators import intervals
from ..operators import revisions as V
from ..sources import views
from ..sources.views import with_views
from .encodings import BETWEEN_SQL, SHARED_SQL
from .reads import T
from .registry import query

TS_OLD = 850_000_000_000_000
RUN_SQL = "RUN AS (SELECT run_id, run_id % 3 AS level, min(key) AS lower, max(key) AS upper, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS revisions, CAST(sum(size) AS BIGINT) AS size FROM L GROUP BY run_id)"


def runs(spark, sf):
    return views.lineitem(spark, sf).groupBy("run_id").agg(
        F.min("key").alias("lower"), F.max("key").alias("upper"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("revisions"), F.sum("size").alias("size")
    ).withColumn("level", F.col("run_id") % 3)


RUN = ("run_id", "level", "lower", "upper", "min_ts", "max_ts", "revisions", "size")


@query(with_views(f", {RUN_SQL} SELECT * FROM RUN", "L"))
def run_stats(spark, sf):
    return runs(spark, sf).select(*RUN)


@query(with_views(f", {RUN_SQL} SELECT run_id, level FROM RUN WHERE lower <= '{4321:016X}' AND upper >= '{4321:016X}'", "L"))
def run_for_key(spark, sf):
    return runs(spark, sf).where((F.col("lower") <= f"{4321:016X}") & (F.col("upper") >= f"{4321:016X}")).select("run_id", "level")


@query(with_views(f", {RUN_SQL}, E AS (SELECT run_id, revisions FROM (SELECT run_id, count(*) FILTER (ts BETWEEN {TS_OLD} AND {TS_OLD + 3600000000 * 24}) AS revisions FROM L GROUP BY run_id)) SELECT RUN.run_id, E.revisions > 0 AS useful FROM RUN JOIN E USING (run_id) WHERE min_ts <= {TS_OLD + 3600000000 * 24} AND max_ts >= {TS_OLD}", "L"))
def prune_runs_by_ts(spark, sf):
    """Runs that a read of one day can't skip by their times, and whether they hold anything of it."""
    end = TS_OLD + 86_400_000_000
    kept = runs(spark, sf).where((F.col("min_ts") <= end) & (F.col("max_ts") >= TS_OLD)).select("run_id")
    hits = views.lineitem(spark, sf).where(F.col("ts").between(TS_OLD, end)).select("run_id").distinct().withColumn("useful", F.lit(True))
    return kept.join(hits, "run_id", "left").select("run_id", F.coalesce("useful", F.lit(False)).alias("useful"))


@query(with_views(f", {RUN_SQL} SELECT level, CAST(sum(size) AS BIGINT) AS size, CAST(sum(CASE WHEN run_id % 5 = 0 THEN 0 ELSE size END) AS BIGINT) AS idle_size, CAST(CASE WHEN level = 0 THEN 0 ELSE 100000 * power(10, level - 1) END AS BIGINT) AS most FROM RUN GROUP BY level", "L"))
def level_sizes(spark, sf):
    """Sizes by level, without runs that are being compacted, and the most a level should hold (ten times more each)."""
    most = F.when(F.col("level") == 0, 0).otherwise(100_000 * F.pow(F.lit(10), F.col("level") - 1)).cast("long")
    return runs(spark, sf).groupBy("level").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("run_id") % 5 == 0, 0).otherwise(F.col("size"))).cast("long").alias("idle_size")).withColumn("most", most)


@query(with_views("SELECT run_id, CAST(count(DISTINCT key) * 8 + sum(CASE WHEN is_tombstone THEN 0 ELSE size END + 8) AS BIGINT) AS bytes FROM L GROUP BY run_id", "L"))
def memtable_size(spark, sf):
    """Key bytes once a key, value bytes and eight more a revision; a tombstone has no value."""
    by_key = views.lineitem(spark, sf).groupBy("run_id", "key").agg(F.sum(F.when(F.col("is_tombstone"), 0).otherwise(F.col("size")) + 8).alias("n"))
    return by_key.groupBy("run_id").agg((F.sum("n") + 8 * F.count("*")).cast("long").alias("bytes"))


TARGET = 20_000


@query(with_views(f", K AS (SELECT key, sum(size) AS s FROM L GROUP BY key), C AS (SELECT key, s, sum(s) OVER (ORDER BY key) - s AS below FROM K) SELECT CAST(floor(below / {TARGET}) AS BIGINT) AS new_run, min(key) AS lower, max(key) AS upper, count(*) AS keys, CAST(sum(s) AS BIGINT) AS size FROM C GROUP BY ALL", "L"))
def compact_run_assignment(spark, sf):
    """Sorted keys to runs of a target size; a key is never split. The running sum is over one row a key of the runs being compacted, by run first so that only run totals meet in one task."""
    by_key = views.lineitem(spark, sf).groupBy("run_id", "key").agg(F.sum("size").alias("s"))
    totals = by_key.groupBy("run_id").agg(F.sum("s").alias("t"))
    offset = totals.select("run_id", (F.sum("t").over(Window.orderBy("run_id")) - F.col("t")).alias("offset"))
    inside = F.sum("s").over(Window.partitionBy("run_id").orderBy("key")) - F.col("s")
    placed = by_key.withColumn("inside", inside).join(offset, "run_id").withColumn("new_run", F.floor((F.col("offset") + F.col("inside")) / TARGET))
    return placed.groupBy("new_run").agg(F.min("key").alias("lower"), F.max("key").alias("upper"), F.count("*").alias("keys"), F.sum("s").alias("size"))


@query(with_views(f", S AS (SELECT * FROM R WHERE ts <= {T} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, tie DESC) = 1) SELECT key, ts, event_id FROM S WHERE NOT is_tombstone", "R"))
def compact_equivalence(spark, sf):
    """A snapshot after compaction with a horizon before it equals the snapshot of the log."""
    log = views.events(spark, sf)
    merged = V.compact([log.where(F.col("event_id") % 4 == i) for i in range(4)], 8, horizon=T - 86_400_000_000)
    return V.snapshot(merged, T).select("key", "ts", "event_id")


SPLIT_KEYS = [f"{k:016X}" for k in (777, 1500, 2600, 9000)]


@query(with_views(f", {RUN_SQL}, P(split) AS (VALUES {', '.join(f'({k!r})' for k in SPLIT_KEYS)}) SELECT run_id FROM RUN WHERE EXISTS (SELECT 1 FROM P WHERE split > lower AND split <= upper)", "L"))
def splits_inside_run(spark, sf):
    """Runs that a split would cut in two."""
    splits = spark.createDataFrame([(k,) for k in SPLIT_KEYS], "split string")
    return runs(spark, sf).join(F.broadcast(splits), (F.col("split") > F.col("lower")) & (F.col("split") <= F.col("upper")), "left_semi").select("run_id")


SPLIT_SQL = f"""C AS (SELECT lower, run_id, size, CAST(sum(size) OVER (ORDER BY lower, run_id) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total, min(lower) OVER () AS lo FROM RUN),
F AS (SELECT *, lower AS hi, row_number() OVER (ORDER BY lower, run_id) AS n FROM C WHERE upto > total // 5 AND upto - size <= total * 4 // 5),
S AS (SELECT *, {SHARED_SQL} AS shared FROM F), K AS (SELECT n, abs(upto - total // 2) AS distance, CASE WHEN n = 1 THEN lower ELSE {BETWEEN_SQL} END AS split FROM S)"""


@query(with_views(f", {RUN_SQL}, {SPLIT_SQL} SELECT split, CAST(distance AS BIGINT) AS distance FROM K WHERE split IS NOT NULL ORDER BY length(split), distance, n LIMIT 1", "L"))
def find_split(spark, sf):
    """Where to split: among the runs from the first beyond one fifth of the data to the first beyond four fifths, the shortest key.

    The first of them offers its own lower key, the others a short key between
    the first key of all and theirs; of equally short ones the nearest to the
    middle, then the first. The windows run over one row a run.
    """
    order, whole = Window.orderBy("lower", "run_id"), Window.partitionBy()
    rows = runs(spark, sf).select("lower", "run_id", "size", F.sum("size").over(order).alias("upto"), F.sum("size").over(whole).alias("total"), F.min("lower").over(whole).alias("lo"))
    fits = rows.where("upto > total div 5 and upto - size <= total * 4 div 5").withColumn("n", F.row_number().over(order))
    split = F.when(F.col("n") == 1, F.col("lower")).otherwise(shortest_between_hex(F.col("lo"), F.col("lower")))
    found = fits.select("n", split.alias("split"), F.abs(F.col("upto") - F.expr("total div 2")).alias("distance")).where("split is not null")
    return found.orderBy(F.length("split"), "distance", "n").limit(1).select("split", "distance")


# Manifests: nested rows (keyspace, levels of runs).


def manifest(spark, sf):
    levels = runs(spark, sf).groupBy("level").agg(F.sort_array(F.collect_list(F.struct("lower", "upper", "run_id"))).alias("runs"))
    return levels.withColumn("keyspace", F.lit(1))


@query(with_views(f", {RUN_SQL} SELECT 1 AS keyspace, level, CAST(row_number() OVER (PARTITION BY level ORDER BY lower) - 1 AS INTEGER) AS pos, run_id, lower, upper FROM RUN", "L"))
def manifest_runs(spark, sf):
    return manifest(spark, sf).select("keyspace", "level", F.posexplode("runs").alias("pos", "r")).select("keyspace", "level", "pos", "r.run_id", "r.lower", "r.upper")


@query(with_views(f", {RUN_SQL} SELECT level, count(*) AS runs, min(lower) AS lower, max(upper) AS upper, CAST(count(*) FILTER (run_id % 2 = 0) AS BIGINT) AS from_a FROM RUN GROUP BY level", "L"))
def manifest_merge(spark, sf):
    """Two manifests level by level; a level that only one has stays."""
    a = runs(spark, sf).where(F.col("run_id") % 2 == 0).groupBy("level").agg(F.collect_list(F.struct("lower", "upper", "run_id")).alias("a"))
    b = runs(spark, sf).where(F.col("run_id") % 2 == 1).groupBy("level").agg(F.collect_list(F.struct("lower", "upper", "run_id")).alias("b"))
    none = F.array().cast("array<struct<lower:string,upper:string,run_id:bigint>>")
    both = a.join(b, "level", "full_outer").select("level", F.sort_array(F.concat(F.coalesce("a", none), F.coalesce("b", none))).alias("runs"), F.size(F.coalesce("a", none)).cast("long").alias("from_a"))
    return both.select("level", F.size("runs").cast("long").alias("runs"), F.array_min(F.transform("runs", lambda r: r["lower"])).alias("lower"), F.array_max(F.transform("runs", lambda r: r["upper"])).alias("upper"), "from_a")


@query(with_views(f", {RUN_SQL} SELECT level, run_id FROM RUN WHERE lower >= '{2000:016X}' AND upper < '{9000:016X}'", "L"))
def manifest_clip(spark, sf):
    return runs(spark, sf).where((F.col("lower") >= f"{2000:016X}") & (F.col("upper") < f"{9000:016X}")).select("level", "run_id")


@query(with_views(f", {RUN_SQL} SELECT coalesce(a.run_id, b.run_id) AS run_id, CASE WHEN a.run_id IS NULL THEN 'right' WHEN b.run_id IS NULL THEN 'left' ELSE 'moved' END AS difference FROM (SELECT * FROM RUN WHERE run_id <> 3) a FULL JOIN (SELECT run_id, CASE WHEN run_id = 5 THEN 9 ELSE level END AS level FROM RUN WHERE run_id <> 4) b ON a.run_id = b.run_id WHERE a.level IS DISTINCT FROM b.level", "L"))
def manifest_equal(spark, sf):
    """What tells two manifests apart; no row means equal."""
    a = runs(spark, sf).where("run_id <> 3").select("run_id", F.col("level").alias("x"))
    b = runs(spark, sf).where("run_id <> 4").select("run_id", F.when(F.col("run_id") == 5, 9).otherwise(F.col("level")).alias("y"))
    kind = F.when(F.col("x").isNull(), "right").when(F.col("y").isNull(), "left").otherwise("moved")
    return a.join(b, "run_id", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("run_id", kind.alias("difference"))


@query(with_views(f", {RUN_SQL}, W AS (SELECT run_id, level, lower, CASE WHEN run_id % 6 = 0 THEN lpad(hex((run_id + 4) * 500), 16, '0') ELSE upper END AS upper FROM RUN) SELECT level, run_id FROM W QUALIFY lag(upper) OVER (PARTITION BY level ORDER BY lower) >= lower", "L"))
def level_overlap_check(spark, sf):
    """Runs of a level that begin before the run before them ends."""
    wide = runs(spark, sf).withColumn("upper", F.when(F.col("run_id") % 6 == 0, F.lpad(F.hex((F.col("run_id") + 4) * 500), 16, "0")).otherwise(F.col("upper")))
    return wide.withColumn("_b", F.lag("upper").over(Window.partitionBy("level").orderBy("lower"))).where(F.col("_b") >= F.col("lower")).select("level", "run_id")


@query(with_views(f", {RUN_SQL} SELECT a.run_id AS run_id, count(*) AS below FROM RUN a JOIN (SELECT run_id, lpad(hex(run_id * 700), 16, '0') AS lower, lpad(hex(run_id * 700 + 900), 16, '0') AS upper FROM RUN) b ON a.lower < b.upper AND b.lower <= a.upper GROUP BY ALL", "L"))
def runs_below(spark, sf):
    """How many runs of the next level a run meets."""
    number = lambda c: F.conv(c, 16, 10).cast("long")
    a = runs(spark, sf).select("run_id", number("lower").alias("lo"), (number("upper") + 1).alias("hi"))
    b = runs(spark, sf).select((F.col("run_id") * 700).alias("lo"), (F.col("run_id") * 700 + 900).alias("hi"))
    return intervals.overlaps(a, b).groupBy("run_id").agg(F.count("*").alias("below"))
