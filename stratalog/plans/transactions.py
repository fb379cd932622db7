"""Writes: preconditions, conflicts, two-phase commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from ..operators import revisions as V
from ..operators import transactions as X
from ..sources import views
from ..sources.views import with_views
from .ranges import HOLDS, ROUTE_SQL, tablets
from .reads import T
from .registry import query

DAYS15 = 15 * 86_400_000_000
PRE_SQL = f"P AS (SELECT key, min(ts) + (any_value(user_id) % 3) * {DAYS15} AS since FROM R GROUP BY key)"


def preconditions(log):
    return log.groupBy("key").agg((F.min("ts") + (F.first("user_id") % 3) * DAYS15).alias("since"))


@query(with_views(f", {PRE_SQL} SELECT P.key, P.since, max(R.ts) AS latest FROM P JOIN R USING (key) GROUP BY ALL HAVING max(R.ts) > P.since", "R"))
def precondition_check(spark, sf):
    log = views.events(spark, sf)
    return X.failed_preconditions(preconditions(log), log).select("key", "since", "latest")


# Intents: open orders prepare their customer's key; a third deletes.
INTENT_SQL = "I AS (SELECT key, o_orderkey AS txid, ts AS prepare_ts, CASE WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'put' END AS op FROM O WHERE o_orderstatus = 'O')"


def intents(spark, sf):
    op = F.when(F.col("o_orderkey") % 3 == 0, "delete").otherwise("put")
    return views.orders(spark, sf).where("o_orderstatus = 'O'").select("key", F.col("o_orderkey").alias("txid"), F.col("ts").alias("prepare_ts"), op.alias("op"))


@query(with_views(f", {INTENT_SQL}, Q AS (SELECT DISTINCT key, 900000000000000 AS r FROM O) SELECT Q.key, Q.r AS read_ts, min(I.txid) AS txid FROM Q JOIN I ON I.key = Q.key AND I.prepare_ts <= Q.r GROUP BY ALL", "O"))
def read_conflicts(spark, sf):
    reads = views.orders(spark, sf).select("key", F.lit(900_000_000_000_000).alias("at")).distinct()
    return X.read_conflicts(reads, intents(spark, sf)).withColumnRenamed("at", "read_ts")


@query(with_views(f", {INTENT_SQL}, W AS (SELECT key, o_orderkey AS txid FROM O WHERE o_orderstatus = 'P'), C AS (SELECT key, o_orderkey AS txid FROM O WHERE o_orderstatus = 'F') SELECT W.key, W.txid, min(H.txid) AS holder FROM W JOIN (SELECT key, txid FROM I UNION ALL SELECT key, txid FROM C) H ON H.key = W.key AND H.txid <> W.txid GROUP BY ALL", "O"))
def write_conflicts(spark, sf):
    """Mutations against other transactions' intents and precondition locks."""
    log = views.orders(spark, sf)
    writes = log.where("o_orderstatus = 'P'").select("key", F.col("o_orderkey").alias("txid"))
    locks = log.where("o_orderstatus = 'F'").select("key", F.col("o_orderkey").alias("txid"))
    return X.write_conflicts(writes, intents(spark, sf), locks)


@query(with_views(f", {INTENT_SQL} SELECT I.* FROM I WHERE NOT EXISTS (SELECT 1 FROM O WHERE O.key = I.key AND O.ts > I.prepare_ts + {400 * 86400000000})", "O"))
def prepare_intents(spark, sf):
    """Intents whose precondition (no revision more than 400 days newer) holds."""
    own = intents(spark, sf).withColumn("since", F.col("prepare_ts") + 400 * 86_400_000_000)
    return X.holding_preconditions(own, views.orders(spark, sf)).select("key", "txid", "prepare_ts", "op")


@query(with_views(f", {INTENT_SQL} SELECT txid % 20 AS txn, max(prepare_ts) + 1 AS commit_ts FROM I GROUP BY ALL", "O"))
def commit_ts(spark, sf):
    return intents(spark, sf).groupBy((F.col("txid") % 20).alias("txn")).agg((F.max("prepare_ts") + 1).alias("commit_ts"))


# Outcomes: two writers may decide; the first wins. Some transactions are undecided.
OUT_SQL = """D AS (SELECT txid, 1 + txid % 2 AS seq, 'commit' AS outcome, prepare_ts + 10 AS commit_ts FROM I WHERE txid % 7 <> 0
 UNION ALL SELECT txid, 2 - txid % 2, 'abort', NULL FROM I WHERE txid % 5 < 3),
F AS (SELECT txid, outcome, commit_ts FROM D QUALIFY row_number() OVER (PARTITION BY txid ORDER BY seq) = 1)"""


def outcomes(spark, sf):
    own = intents(spark, sf)
    commits = own.where("txid % 7 <> 0").select("txid", (1 + F.col("txid") % 2).alias("seq"), F.lit("commit").alias("outcome"), (F.col("prepare_ts") + 10).alias("commit_ts"))
    aborts = own.where("txid % 5 < 3").select("txid", (2 - F.col("txid") % 2).alias("seq"), F.lit("abort").alias("outcome"), F.lit(None).cast("long").alias("commit_ts"))
    return X.first_outcomes(commits.unionByName(aborts))


@query(with_views(f", {INTENT_SQL}, {OUT_SQL} SELECT * FROM F", "O"))
def first_outcome_wins(spark, sf):
    return outcomes(spark, sf)


@query(with_views(f""", {INTENT_SQL}, {OUT_SQL}, J AS (SELECT I.*, F.outcome, F.commit_ts FROM I JOIN F USING (txid))
SELECT key, commit_ts AS ts, 'data' AS space, op = 'delete' AS is_tombstone, txid FROM J WHERE outcome = 'commit'
UNION ALL SELECT key, CASE WHEN outcome = 'commit' THEN commit_ts ELSE prepare_ts + 1 END, 'pending', TRUE, txid FROM J""", "O"))
def resolve_intents(spark, sf):
    return X.resolve(intents(spark, sf), outcomes(spark, sf))


@query(with_views(f", {INTENT_SQL} SELECT key, min(txid) AS winner, count(*) AS contenders FROM I GROUP BY key HAVING count(*) > 1", "O"))
def preempt_winner(spark, sf):
    """Of several transactions at one key the oldest may preempt the others."""
    return intents(spark, sf).groupBy("key").agg(F.min("txid").alias("winner"), F.count("*").alias("contenders")).where("contenders > 1")


@query(with_views(f", {INTENT_SQL}, K AS (SELECT txid % 20 AS txn, key FROM I UNION SELECT txid % 20, lpad(hex(txid % 100), 16, '0') FROM I) SELECT txn, count(*) AS keys, min(key) AS first_key FROM K GROUP BY txn", "O"))
def tx_key_sets(spark, sf):
    """All keys of a transaction: mutations and preconditions, each once."""
    own = intents(spark, sf)
    pre = own.select((F.col("txid") % 20).alias("txn"), F.lpad(F.hex(F.col("txid") % 100), 16, "0").alias("key"))
    keys = own.select((F.col("txid") % 20).alias("txn"), "key").union(pre).distinct()
    return keys.groupBy("txn").agg(F.count("*").alias("keys"), F.min("key").alias("first_key"))


@query(with_views(f", {INTENT_SQL}, {OUT_SQL}, {ROUTE_SQL} SELECT R.txid, CAST(T.tablet AS INTEGER) AS tablet, count(*) AS keys FROM (SELECT I.txid, I.key FROM I JOIN F USING (txid) WHERE F.outcome = 'commit') R JOIN T ON {HOLDS} GROUP BY ALL", "O"))
def tx_cleanup_by_tablet(spark, sf):
    done = intents(spark, sf).join(outcomes(spark, sf).where("outcome = 'commit'"), "txid").select("txid", "key")
    return intervals.route(done, F.broadcast(tablets(spark))).groupBy("txid", "tablet").agg(F.count("*").alias("keys"))


@query(with_views(f", {INTENT_SQL}, {OUT_SQL}, L AS (SELECT key, max(ts) AS last FROM O GROUP BY key), P AS (SELECT key, min(prepare_ts) AS p FROM I WHERE txid NOT IN (SELECT txid FROM F) GROUP BY key) SELECT key, coalesce(p - 1, last) AS safe_read_ts FROM L LEFT JOIN P USING (key)", "O"))
def safe_read_ts(spark, sf):
    """Reads are safe up to just before the first undecided intent, else up to the last write."""
    undecided = intents(spark, sf).join(outcomes(spark, sf), "txid", "left_anti").groupBy("key").agg(F.min("prepare_ts").alias("p"))
    last = views.orders(spark, sf).groupBy("key").agg(F.max("ts").alias("last"))
    return last.join(undecided, "key", "left").select("key", F.coalesce(F.col("p") - 1, "last").alias("safe_read_ts"))


@query(with_views(f", {INTENT_SQL} SELECT key, string_agg(txid, ',' ORDER BY txid) AS locks, count(*) AS n, coalesce(string_agg(txid, ',' ORDER BY txid) FILTER (txid % 3 <> 0), '') AS after_release, count(*) <= 9 AS fits FROM I GROUP BY key", "O"))
def precond_locks(spark, sf):
    """Lock lists of a key, and what is left once deleting transactions release theirs; a list holds nine at most."""
    lists = intents(spark, sf).groupBy("key").agg(F.sort_array(F.collect_set("txid")).alias("l"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return lists.select("key", shown(F.col("l")).alias("locks"), F.size("l").cast("long").alias("n"), shown(F.filter("l", lambda x: x % 3 != 0)).alias("after_release"), (F.size("l") <= 9).alias("fits"))


@query(with_views(f", {INTENT_SQL} SELECT key, txid, op, CASE WHEN op = 'put' THEN lower(hex(txid)) END AS payload FROM I", "O"))
def decode_pending(spark, sf):
    """A pending value is the transaction (16 hex digits), a tag and the payload: written and read back."""
    tag = F.when(F.col("op") == "put", "01").otherwise("00")
    value = F.concat(F.lpad(F.hex("txid"), 16, "0"), tag, F.when(F.col("op") == "put", F.hex(F.lower(F.hex("txid")))).otherwise(F.lit("")))
    own = intents(spark, sf).select("key", F.unhex(value).alias("v"))
    raw = F.hex("v")
    put = F.substr(raw, F.lit(17), F.lit(2)) == "01"
    return own.select(
        "key",
        F.conv(F.substr(raw, F.lit(1), F.lit(16)), 16, 10).cast("long").alias("txid"),
        F.when(put, "put").otherwise("delete").alias("op"),
        F.when(put, F.unhex(F.substr(raw, F.lit(19))).cast("string")).alias("payload"),
    )


@query(with_views(f", B AS (SELECT key, {T} + 1 AS ts, 100000000 + any_value(user_id) AS tie, any_value(user_id) % 4 = 0 AS is_tombstone FROM R GROUP BY key HAVING max(ts) FILTER (ts <= {T}) <= {T} - 43200000000), U AS (SELECT key, ts, tie, is_tombstone FROM R WHERE ts <= {T} UNION ALL SELECT * FROM B) SELECT key, ts, tie FROM (SELECT * FROM U QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, tie DESC) = 1) WHERE NOT is_tombstone", "R"))
def write_apply(spark, sf):
    """A batch of writes whose precondition (unchanged for half a day) holds, applied to the log at T and read back."""
    log = views.events(spark, sf).where(F.col("ts") <= T).select("key", "ts", "tie", "is_tombstone", "user_id")
    batch = log.groupBy("key").agg(F.first("user_id").alias("user_id")).withColumn("since", F.lit(T - 43_200_000_000))
    accepted = X.holding_preconditions(batch, log)
    rows = accepted.select("key", F.lit(T + 1).alias("ts"), (100_000_000 + F.col("user_id")).alias("tie"), (F.col("user_id") % 4 == 0).alias("is_tombstone"))
    return V.snapshot(log.drop("user_id").unionByName(rows)).select("key", "ts", "tie")
