"""Journal queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import views
from ..sources.views import with_views
from ..streaming import journal as J
from .registry import query

# The events as a journal: shard = user % 5, entries in order of time; purchases acquire, errors relinquish.
JOURNAL_SQL = """J AS (SELECT user_id % 5 AS shard, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS seq, 'n' || (user_id % 3) AS participant, ts,
 CASE event_type WHEN 'purchase' THEN 'acquire' WHEN 'error' THEN 'relinquish' WHEN 'signup' THEN 'heartbeat' ELSE 'append' END AS kind, ts + 3600000000 AS lease_end, key, event_id FROM R)"""


def journal(spark, sf):
    log = views.events(spark, sf)
    shard = F.col("user_id") % 5
    kind = F.when(F.col("event_type") == "purchase", "acquire").when(F.col("event_type") == "error", "relinquish").when(F.col("event_type") == "signup", "heartbeat").otherwise("append")
    seq = F.row_number().over(Window.partitionBy(shard).orderBy("ts", "event_id")).cast("long")
    return log.select(shard.alias("shard"), seq.alias("seq"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("participant"), "ts", kind.alias("kind"), (F.col("ts") + 3_600_000_000).alias("lease_end"), "key", F.lit("put").alias("op"), "event_id")


@query(with_views(f", {JOURNAL_SQL} SELECT shard, seq, kind, key FROM J WHERE seq >= 1500", "R"))
def journal_tail(spark, sf):
    return J.tail(journal(spark, sf), 1500).select("shard", "seq", "kind", "key")


@query("WITH RECURSIVE " + with_views(f""", {JOURNAL_SQL},
F AS (SELECT shard, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS leader, CAST(-1 AS BIGINT) AS lease, FALSE AS accepted FROM (SELECT DISTINCT shard FROM J)
UNION ALL SELECT J.shard, J.seq,
 CASE WHEN J.kind = 'acquire' AND (F.leader IS NULL OR J.participant = F.leader OR J.ts > F.lease) THEN J.participant WHEN J.kind = 'relinquish' AND J.participant = F.leader THEN NULL ELSE F.leader END,
 CASE WHEN J.kind = 'acquire' AND (F.leader IS NULL OR J.participant = F.leader OR J.ts > F.lease) THEN J.lease_end WHEN J.kind = 'relinquish' AND J.participant = F.leader THEN -1 ELSE F.lease END,
 CASE J.kind WHEN 'acquire' THEN F.leader IS NULL OR J.participant = F.leader OR J.ts > F.lease WHEN 'heartbeat' THEN TRUE ELSE coalesce(J.participant = F.leader, FALSE) END
 FROM F JOIN J ON J.shard = F.shard AND J.seq = F.seq + 1)
SELECT shard, seq, accepted FROM F WHERE seq > 0""", "R").removeprefix("WITH "))
def accepted_proposals(spark, sf):
    return J.accepted_proposals(journal(spark, sf).drop("event_id")).select("shard", "seq", "accepted")


@query(with_views(f", {JOURNAL_SQL}, M AS (SELECT shard, max(seq) - 300 AS bound FROM J WHERE kind = 'acquire' GROUP BY shard) SELECT J.shard, J.key, J.ts, min(J.event_id) AS value, count(DISTINCT J.event_id) > 1 AS conflict FROM J JOIN M USING (shard) WHERE J.seq >= M.bound OR J.seq % 2 = 0 GROUP BY ALL", "R"))
def replay_journal(spark, sf):
    """The newest manifest drops older writes; its runs hold every second one. Writes that both have count once."""
    rows = journal(spark, sf).withColumn("value", F.col("event_id"))
    manifests = rows.where("kind = 'acquire'").select("shard", "seq", (F.col("seq") - 300).alias("lower_bound_seq"))
    return J.replay(rows, manifests, rows.where("seq % 2 = 0")).select("shard", "key", "ts", "value", "conflict")


@query(with_views(f", {JOURNAL_SQL} SELECT shard, arg_max(participant, seq) AS node, max(seq) AS seq FROM J WHERE kind = 'acquire' GROUP BY shard", "R"))
def current_leader(spark, sf):
    return journal(spark, sf).where("kind = 'acquire'").groupBy("shard").agg(F.max_by("participant", "seq").alias("node"), F.max("seq").alias("seq"))
