"""Point reads, scans, pages, history and as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import revisions as V
from ..sources import views
from ..sources.views import Wanted, with_views
from .registry import query

#: 2024-01-15T00:00:00Z, in the middle of the events.
T = 1_705_276_800_000_000
K10, K40 = f"{10:016X}", f"{40:016X}"
KEY = f"{42:016X}"
KEYS = [f"{k:016X}" for k in (7, 3, 149, 200, 42, 77)]
LIVE = ("key", "ts", "event_id", "event_type")
COLS = "key, ts, event_id, event_type"
SNAP = f"SELECT * FROM R WHERE ts <= {T} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, tie DESC) = 1"
VALUES = ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYS))


@query(with_views(f", S AS ({SNAP}) SELECT {COLS} FROM S WHERE NOT is_tombstone AND key >= '{K10}' AND key < '{K40}'", "R"))
def scan_full_snapshot(spark, sf):
    keys = V.KeyRange(K10, K40)
    return V.snapshot(views.events(spark, sf, Wanted(keys, until=T)), T, keys).select(*LIVE)


@query(with_views(f", S AS ({SNAP}) SELECT {COLS} FROM S WHERE NOT is_tombstone AND key = '{KEY}'", "R"))
def get_at(spark, sf):
    log = views.events(spark, sf, Wanted(some=(KEY,), until=T))
    return log.orderBy(F.desc("ts"), F.desc("tie")).limit(1).where(~F.col("is_tombstone")).select(*LIVE)


@query(with_views(f", S AS ({SNAP}) SELECT {COLS} FROM S WHERE NOT is_tombstone AND key IN ({', '.join(repr(k) for k in KEYS)})", "R"))
def get_multi_at(spark, sf):
    return V.snapshot(views.events(spark, sf, Wanted(some=tuple(KEYS), until=T)), T).select(*LIVE)


@query(with_views(f", S AS ({SNAP}), Q(pos, key) AS (VALUES {VALUES}) SELECT CAST(Q.pos AS INTEGER) AS pos, Q.key, S.ts, S.event_id, S.event_type, S.ts IS NOT NULL AS found FROM Q LEFT JOIN (SELECT * FROM S WHERE NOT is_tombstone) S USING (key)", "R"))
def get_multi_positional(spark, sf):
    return V.positional(KEYS, views.events(spark, sf, Wanted(some=tuple(KEYS), until=T)), T).select("pos", "key", "ts", "event_id", "event_type", F.col("ts").isNotNull().alias("found"))


SAFE = 1_800_000_000_000_000
LATEST = "SELECT * FROM R QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, tie DESC) = 1"


@query(with_views(f", S AS ({LATEST}), Q(pos, key) AS (VALUES {VALUES}), J AS (SELECT Q.key, S.ts, S.event_id, S.is_tombstone FROM Q LEFT JOIN S USING (key)) SELECT key, CASE WHEN NOT is_tombstone THEN ts END AS ts, CASE WHEN NOT is_tombstone THEN event_id END AS event_id, (SELECT greatest(max(ts), CASE WHEN bool_or(ts IS NULL) THEN {SAFE} ELSE 0 END) FROM J) AS snapshot_ts FROM J", "R"))
def get_latest(spark, sf):
    """Newest revisions of a key set and the snapshot time: the largest time seen, and the safe time if a key has none."""
    asked = spark.createDataFrame([(k,) for k in KEYS], "key string")
    log = views.events(spark, sf, Wanted(some=tuple(KEYS)))
    found = asked.join(V.newest(log), "key", "left")
    missing = F.max(F.col("ts").isNull()).over(Window.partitionBy())
    snap = F.greatest(F.max("ts").over(Window.partitionBy()), F.when(missing, F.lit(SAFE)).otherwise(F.lit(0)))
    live = ~F.col("is_tombstone")
    return found.select("key", F.when(live, F.col("ts")).alias("ts"), F.when(live, F.col("event_id")).alias("event_id"), snap.alias("snapshot_ts"))


@query(with_views("SELECT user_id % 4 AS tablet, max(ts) AS snapshot_ts FROM R GROUP BY ALL", "R"))
def latest_snapshot(spark, sf):
    return views.events(spark, sf).groupBy((F.col("user_id") % 4).alias("tablet")).agg(F.max("ts").alias("snapshot_ts"))


@query(with_views(f", S AS ({SNAP}), P AS (SELECT * FROM S ORDER BY key LIMIT 7) SELECT {COLS} FROM P WHERE NOT is_tombstone", "R"))
def scan_page_asc(spark, sf):
    return V.scan_page(views.events(spark, sf, Wanted(until=T)), T, limit=7).rows.select(*LIVE)


@query(with_views(f", S AS ({SNAP}), P AS (SELECT * FROM S WHERE key >= '{K10}' AND key < '{K40}' ORDER BY key DESC LIMIT 9) SELECT {COLS} FROM P WHERE NOT is_tombstone", "R"))
def scan_page_desc(spark, sf):
    keys = V.KeyRange(K10, K40)
    return V.scan_page(views.events(spark, sf, Wanted(keys, until=T)), T, keys, "desc", 9).rows.select(*LIVE)


@query(with_views(f", S AS ({SNAP}), P AS (SELECT * FROM S ORDER BY key LIMIT 7) SELECT max(key) AS last_key, count(*) AS seen, CAST(count(*) FILTER (NOT is_tombstone) AS BIGINT) AS live, max(key) || '00' AS next_lower FROM P HAVING count(*) > 0", "R"))
def scan_cursor(spark, sf):
    page = V.scan_page(views.events(spark, sf, Wanted(until=T)), T, limit=7)
    return page.cursor().withColumn("next_lower", F.concat("last_key", F.lit("00")))




@query(with_views(f", S AS (SELECT * FROM O WHERE ts <= 2000000000000000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, tie DESC) = 1) SELECT key, ts, o_orderkey FROM S WHERE NOT is_tombstone AND starts_with(key, '00000000000001')", "O"))
def scan_prefix(spark, sf):
    """A byte prefix as a range of keys, which the scan can skip by; ``startswith`` can't."""
    keys = V.prefix_range("00000000000001")
    return V.snapshot(views.orders(spark, sf, Wanted(keys)), 2_000_000_000_000_000, keys).select("key", "ts", "o_orderkey")


@query(with_views(f", S AS ({SNAP}) SELECT key, ts, event_id FROM S WHERE NOT is_tombstone AND key >= greatest('{K10}', '0000000000000014') AND key < least('{K40}', '0000000000000032')", "R"))
def scan_clipped_to_tablet(spark, sf):
    """The asked range and the tablet's own, intersected before the scan."""
    asked, owned = V.KeyRange(K10, K40), V.KeyRange(f"{20:016X}", f"{50:016X}")
    keys = V.KeyRange(max(asked.lower, owned.lower), min(asked.upper, owned.upper))
    return V.snapshot(views.events(spark, sf, Wanted(keys, until=T)), T, keys).select("key", "ts", "event_id")


HISTORY = f"SELECT key, ts, event_id, event_type, is_tombstone FROM R WHERE key = '{KEY}'"
HCOLS = ("key", "ts", "event_id", "event_type", "is_tombstone")


@query(with_views(f"{HISTORY} ORDER BY ts, tie LIMIT 10", "R"))
def history_asc(spark, sf):
    return V.history(views.events(spark, sf, Wanted(some=(KEY,))), KEY, limit=10).select(*HCOLS)


@query(with_views(f"{HISTORY} ORDER BY ts DESC, tie DESC LIMIT 10", "R"))
def history_desc(spark, sf):
    return V.history(views.events(spark, sf, Wanted(some=(KEY,))), KEY, direction="desc", limit=10).select(*HCOLS)


@query(with_views(f"{HISTORY} AND ts BETWEEN {T} AND (SELECT max(ts) FROM R)", "R"))
def history_since(spark, sf):
    """An open end is pinned to the newest time first."""
    log = views.events(spark, sf, Wanted(some=(KEY,), since=T))
    latest = log.agg(F.max("ts").alias("t")).first()["t"]
    return V.history(log, KEY, since=T, until=latest or 0).select(*HCOLS)


@query(with_views(f"{HISTORY} AND ts BETWEEN {T - 5 * 86400000000} AND {T + 5 * 86400000000}", "R"))
def history_between(spark, sf):
    since, until = T - 5 * 86_400_000_000, T + 5 * 86_400_000_000
    return V.history(views.events(spark, sf, Wanted(some=(KEY,), since=since, until=until)), KEY, since, until).select(*HCOLS)


@query(with_views(f", P AS ({HISTORY} ORDER BY ts, tie LIMIT 10) SELECT max(ts) + 1 AS next_since, greatest(min(ts) - 1, 0) AS next_until, count(*) AS seen FROM P HAVING count(*) > 0", "R"))
def history_cursor(spark, sf):
    """Where the next page begins (ascending) or ends (descending); time 0 ends a descending scan."""
    page = V.history(views.events(spark, sf, Wanted(some=(KEY,))), KEY, limit=10)
    return page.agg((F.max("ts") + 1).alias("next_since"), F.greatest(F.min("ts") - 1, F.lit(0)).alias("next_until"), F.count("*").alias("seen")).where("seen > 0")


@query(with_views(", Q AS (SELECT key, ts AS \"at\", event_id AS request_id FROM R WHERE event_type = 'click'), V AS (SELECT * FROM R WHERE event_type <> 'click'), A AS (SELECT Q.key, Q.request_id, Q.\"at\", max(struct_pack(ts := V.ts, tie := V.tie, tomb := V.is_tombstone)) AS m FROM Q LEFT JOIN V ON V.key = Q.key AND V.ts <= Q.\"at\" GROUP BY ALL) SELECT key, request_id, \"at\", m.ts AS ts, m.tie AS event_id, m.tomb AS is_tombstone FROM A", "R"))
def asof_join(spark, sf):
    log = views.events(spark, sf)
    requests = log.where("event_type = 'click'").select("key", F.col("ts").alias("at"), F.col("event_id").alias("request_id"))
    others = log.where("event_type <> 'click'").select("key", "ts", "tie", "event_id", "is_tombstone")
    return V.asof_join(requests, others, "request_id", hot=True).select("key", "request_id", "at", "ts", "event_id", "is_tombstone")


def levels(log):
    return [log.where(F.col("event_id") % 4 == i) for i in range(4)]


@query(with_views(f", S AS ({SNAP}) SELECT key, ts, event_id FROM S WHERE NOT is_tombstone", "R"))
def scan_merge_levels(spark, sf):
    # the levels are one stored table: one scan, the newest of all of them
    merged = V.newest_of_sources([views.events(spark, sf, Wanted(until=T))], T)
    return merged.where(~F.col("is_tombstone")).select("key", "ts", "event_id")


@query(with_views(f", S AS ({SNAP}) SELECT key, ts, event_id, is_tombstone FROM S WHERE key IN ({', '.join(repr(k) for k in KEYS)})", "R"))
def merge_levels_get(spark, sf):
    return V.newest_of_sources(levels(views.events(spark, sf, Wanted(some=tuple(KEYS), until=T))), T).select("key", "ts", "event_id", "is_tombstone")


@query(with_views("SELECT key, ts, event_id, row_number() OVER (PARTITION BY key ORDER BY ts DESC, tie DESC) AS version FROM R", "R"))
def all_revisions_sorted(spark, sf):
    place = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("tie"))
    rows = V.compact(levels(views.events(spark, sf)), 8)
    return rows.select("key", "ts", "event_id", F.row_number().over(place).cast("long").alias("version"))


@query(with_views("SELECT key, count(*) AS versions, string_agg(ts || ':' || event_id, ',' ORDER BY ts DESC, tie DESC) AS revisions FROM R GROUP BY key", "R"))
def group_revisions(spark, sf):
    """All revisions of a key as one ordered list; a key's history is what the result holds."""
    grouped = views.events(spark, sf).groupBy("key").agg(F.count("*").alias("versions"), F.sort_array(F.collect_list(F.struct("ts", "tie")), asc=False).alias("r"))
    shown = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["ts"].cast("string"), x["tie"].cast("string"))), ",")
    return grouped.select("key", "versions", shown.alias("revisions"))


@query(with_views("SELECT key, ts, count(*) AS revisions FROM O GROUP BY ALL HAVING count(*) > 1", "O"))
def revision_order_violations(spark, sf):
    """Keys with two revisions at one time, which a log must not have."""
    before = F.lag("ts").over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("tie")))
    bad = views.orders(spark, sf).withColumn("_before", before).where(F.col("_before") <= F.col("ts"))
    return bad.groupBy("key", "ts").agg((F.count("*") + 1).alias("revisions"))


META = [("01", "shard", "0001", 10), ("01", "shard", "0002", 11), ("02", "tablet", "0001", 12), ("02", "tablet", "0007", 13), ("03", "node", "0004", 14), ("02", "tablet", "0009", 15)]
META_SQL = "META(prefix, kind, id, ts) AS (VALUES " + ", ".join(f"('{p}', '{k}', '{i}', {t})" for p, k, i, t in META) + ")"


@query(f"WITH {META_SQL} SELECT prefix || id AS key, kind, id, CAST(ts AS BIGINT) AS ts FROM META WHERE starts_with(prefix || id, '02')")
def meta_prefix_scan(spark, sf):
    """Typed metadata: one kind is one prefix of the encoded key."""
    meta = spark.createDataFrame(META, "prefix string, kind string, id string, ts long").withColumn("key", F.concat("prefix", "id"))
    return meta.where(V.prefix_range("02").holds(F.col("key"))).select("key", "kind", "id", "ts")


# The change feed: every event names the keys that changed with it.
FEED = "F AS (SELECT event_id AS change_id, ts AS at, unnest([key, lpad(hex((user_id * 7) % 150), 16, '0')]) AS key FROM R)"


FEED_SQL = """U AS (SELECT DISTINCT F.change_id, F.at AS t, F.key, 1 AS side, NULL AS tie, NULL AS rev FROM F UNION ALL SELECT NULL, ts, key, 0, tie, struct_pack(ts := ts, tie := tie, tomb := is_tombstone) FROM R),
V AS (SELECT *, max(rev) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM U)"""


@query(with_views(f", {FEED}, {FEED_SQL} SELECT change_id, t AS at, key, m.ts AS ts, coalesce(m.tomb, TRUE) AS is_tombstone FROM V WHERE side = 1", "R"))
def change_feed(spark, sf):
    """Changed keys with their value as of the change; absent ones are tombstones."""
    log = views.events(spark, sf)
    other = F.lpad(F.hex((F.col("user_id") * 7) % 150), 16, "0")
    changed = log.select(F.col("event_id").alias("change_id"), F.col("ts").alias("at"), F.explode(F.array_distinct(F.array("key", other))).alias("key"))
    joined = V.asof_join(changed, log.select("key", "ts", "tie", "is_tombstone"), "change_id", hot=True)
    return joined.select("change_id", "at", "key", "ts", F.coalesce("is_tombstone", F.lit(True)).alias("is_tombstone"))


@query(with_views(f", S AS ({LATEST}) SELECT key, ts, event_id FROM S WHERE NOT is_tombstone", "R"))
def change_feed_apply(spark, sf):
    """A snapshot at T brought up to date by the newer revisions of each key."""
    log = views.events(spark, sf)
    base, delta = V.snapshot(log, T, tombstones=True), log.where(F.col("ts") > T)
    return V.newest_of_sources([base, delta]).where(~F.col("is_tombstone")).select("key", "ts", "event_id")
