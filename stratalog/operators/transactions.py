"""Preconditions, conflicts, two-phase intents and their resolution, as joins.

A batch engine reports conflicts instead of waiting: what blocks is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_preconditions(preconditions: DataFrame, log: DataFrame) -> DataFrame:
    """(key, since) of preconditions that don't hold: a newer revision, tombstones too, exists. Absent keys pass."""
    newest = log.groupBy("key").agg(F.max("ts").alias("latest"))
    return preconditions.join(newest, "key").where(F.col("latest") > F.col("since"))


def holding_preconditions(preconditions: DataFrame, log: DataFrame) -> DataFrame:
    newest = log.groupBy(F.col("key").alias("k")).agg(F.max("ts").alias("latest"))
    return preconditions.join(newest, (F.col("key") == F.col("k")) & (F.col("latest") > F.col("since")), "left_anti")


def read_conflicts(reads: DataFrame, intents: DataFrame) -> DataFrame:
    """Reads (key, at) that meet a pending intent prepared at or before their time, with the oldest transaction that blocks them."""
    pending = intents.select("key", "txid", "prepare_ts")
    met = reads.join(pending, "key").where(F.col("prepare_ts") <= F.col("at"))
    return met.groupBy("key", "at").agg(F.min("txid").alias("txid"))


def write_conflicts(writes: DataFrame, intents: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Keys of a write (key, txid) that another transaction has prepared, or locked by a precondition."""
    other = intents.select("key", F.col("txid").alias("holder"))
    if locks is not None:
        other = other.unionByName(locks.select("key", F.col("txid").alias("holder")))
    return writes.join(other, "key").where(F.col("holder") != F.col("txid")).groupBy("key", "txid").agg(F.min("holder").alias("holder"))


def first_outcomes(outcomes: DataFrame) -> DataFrame:
    """Of several outcomes written for a transaction the first counts."""
    return outcomes.groupBy("txid").agg(F.min_by(F.struct("outcome", "commit_ts"), "seq").alias("o")).select("txid", "o.*")


def resolve(intents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Revisions that resolve intents: committed ones become puts or deletes at the commit time and their intent ends then; aborted ones end just after their prepare time; undecided ones stay pending."""
    joined = intents.join(outcomes, "txid", "left")
    committed = F.coalesce(F.col("outcome") == "commit", F.lit(False))
    data = joined.where(committed).select("key", F.col("commit_ts").alias("ts"), F.lit("data").alias("space"), (F.col("op") == "delete").alias("is_tombstone"), "txid")
    ended = joined.where(F.col("outcome").isNotNull()).select("key", F.when(committed, F.col("commit_ts")).otherwise(F.col("prepare_ts") + 1).alias("ts"), F.lit("pending").alias("space"), F.lit(True).alias("is_tombstone"), "txid")
    return data.unionByName(ended)


def txid(ts: Column, random_hex: Column, owner: Column) -> Column:
    """28 bytes in hex: owner (4), time (8), random (16); older transactions of an owner sort first."""
    return F.concat(F.lpad(F.hex(owner), 8, "0"), F.lpad(F.hex(ts), 16, "0"), F.lpad(random_hex, 32, "0"))
