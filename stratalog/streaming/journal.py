"""Journals: lease-filtered logs and replay, as batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "shard long, seq long, participant string, ts long, kind string, lease_end long, key string, op string"
ACCEPTED = ENTRY + ", accepted boolean"


def fold(rows: pd.DataFrame, leader: str | None, lease_end: int) -> tuple[list[bool], str | None, int]:
    """Which proposals are accepted, in order of seq: an acquire by the leader or after the lease's end, a heartbeat always, others from the leader."""
    out = []
    for who, ts, kind, end in zip(rows["participant"], rows["ts"], rows["kind"], rows["lease_end"]):
        if kind == "acquire":
            good = leader is None or who == leader or ts > lease_end
            if good:
                leader, lease_end = who, int(end)
        elif kind == "heartbeat":
            good = True
        else:
            good = who == leader
            if good and kind == "relinquish":
                leader, lease_end = None, -1
        out.append(bool(good))
    return out, leader, lease_end


def accepted_proposals(journal: DataFrame) -> DataFrame:
    """The batch form: each shard's journal folded in order. A shard's journal is one sequence by nature; rows come sorted and in one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
        return rows.assign(accepted=fold(rows, None, -1)[0])

    return journal.groupBy("shard").applyInPandas(run, ACCEPTED)


def accepted_stream(journal: DataFrame) -> DataFrame:
    """The streaming form: leader and lease are each shard's state; rows of a micro-batch are sorted, a gap in seq is an error."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        leader, lease_end, last = state.get if state.exists else (None, -1, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable").reset_index(drop=True)
        if rows["seq"].tolist() != list(range(last + 1, last + 1 + len(rows))):
            raise ValueError(f"shard {key[0]}: the journal has a gap after {last}")
        good, leader, lease_end = fold(rows, leader, lease_end)
        state.update((leader, lease_end, int(rows["seq"].iloc[-1])))
        yield rows.assign(accepted=good)

    return journal.groupBy("shard").applyInPandasWithState(run, ACCEPTED, "leader string, lease_end long, last long", "append", "NoTimeout")


def replay(writes: DataFrame, manifests: DataFrame, runs: DataFrame) -> DataFrame:
    """Revisions of a shard: those of the newest manifest's runs and of writes from its lower bound on.

    Equal revisions that both hold count once; ``conflict`` tells that one key
    and time has two values.
    """
    newest = manifests.groupBy("shard").agg(F.max_by("lower_bound_seq", "seq").alias("lower_bound_seq"))
    tail = writes.join(newest, "shard", "left").where(F.col("seq") >= F.coalesce("lower_bound_seq", F.lit(0)))
    both = tail.select("shard", "key", "ts", "value").unionByName(runs.select("shard", "key", "ts", "value")).distinct()
    return both.groupBy("shard", "key", "ts").agg(F.min("value").alias("value"), (F.count("*") > 1).alias("conflict"))


def tail(journal: DataFrame, start: int) -> DataFrame:
    """Entries from a sequence number on, in order."""
    return journal.where(F.col("seq") >= start).orderBy("shard", "seq")


def apply_changes(stream: DataFrame, target: str, checkpoint: str):
    """Keep the newest revision of each key of a change stream as Parquet, one folder a version.

    A batch that runs again after a failure writes the same version again.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("key", "ts", "value", "is_tombstone")
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{target}/v{number - 1}"))
        newest = rows.groupBy("key").agg(F.max_by(F.struct("ts", "value", "is_tombstone"), "ts").alias("r")).select("key", "r.*")
        newest.write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
