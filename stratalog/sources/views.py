"""The test tables read as revision logs.

A revision log has ``key`` (upper-case hex, which sorts like the bytes), ``ts``
(microseconds since the epoch), ``tie`` columns that order revisions of one key
and time, ``is_tombstone`` and a payload.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.revisions import KeyRange


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; times are UTC, so they don't depend on the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def hex_key(column: str) -> Column:
    return F.lpad(F.hex(F.col(column)), 16, "0")


@dataclass(frozen=True)
class Wanted:
    """What a read needs of a log, so that the scan can skip the rest: a range of keys, some keys, times from and upto (micros, included)."""

    keys: KeyRange = KeyRange()
    some: tuple[str, ...] | None = None
    since: int | None = None
    until: int | None = None


def number_from(bound: str) -> int:
    """The smallest number whose key (16 hex digits) isn't below a bound in hex."""
    return int(bound[:16].ljust(16, "0"), 16) + (len(bound) > 16)


def narrowed(rows: DataFrame, number: str, time: str, wanted: Wanted) -> DataFrame:
    """``rows`` filtered on the stored columns that keys and times are made of: these comparisons reach the scan."""
    n, t = F.col(number), F.col(time)
    if wanted.keys.lower is not None:
        rows = rows.where(n >= number_from(wanted.keys.lower))
    if wanted.keys.upper is not None:
        rows = rows.where(n < number_from(wanted.keys.upper))
    if wanted.some is not None:
        rows = rows.where(n.isin([int(k, 16) for k in wanted.some]))
    kind = rows.schema[time].dataType.simpleString()
    at = lambda micros: F.lit(datetime(1970, 1, 1) + timedelta(microseconds=micros)).cast(kind)
    if wanted.since is not None:
        rows = rows.where(t >= at(wanted.since))
    if wanted.until is not None:
        rows = rows.where(t <= at(wanted.until))
    return rows


def events(spark: SparkSession, sf_dir: str, wanted: Wanted = Wanted()) -> DataFrame:
    """R: one key a user; errors are deletes."""
    return narrowed(table(spark, sf_dir, "events"), "user_id", "ts", wanted).select(
        hex_key("user_id").alias("key"), micros("ts").alias("ts"), F.col("event_id").alias("tie"), (F.col("event_type") == "error").alias("is_tombstone"), "event_id", "event_type", "user_id"
    )


def orders(spark: SparkSession, sf_dir: str, wanted: Wanted = Wanted()) -> DataFrame:
    """O: one key a customer; pending orders are deletes."""
    return narrowed(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", wanted).select(
        hex_key("o_custkey").alias("key"), micros("o_orderdate").alias("ts"), F.col("o_orderkey").alias("tie"), (F.col("o_orderstatus") == "P").alias("is_tombstone"), "o_orderkey", "o_custkey", "o_orderstatus"
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: sized revisions; returned items are deletes. A run is 500 order keys."""
    return table(spark, sf_dir, "lineitem").select(
        hex_key("l_orderkey").alias("key"),
        micros("l_shipdate").alias("ts"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("tie"),
        (F.col("l_returnflag") == "R").alias("is_tombstone"),
        F.col("l_quantity").cast("bigint").alias("size"),
        F.floor(F.col("l_orderkey") / 500).cast("bigint").alias("run_id"),
        "l_orderkey",
    )


# The same views for DuckDB, as common table expressions.
SQL = {
    "R": """R AS (SELECT lpad(hex(user_id),16,'0') AS key, epoch_us(ts) AS ts, event_id AS tie, event_type='error' AS is_tombstone,
  event_id, event_type, user_id FROM events)""",
    "O": """O AS (SELECT lpad(hex(o_custkey),16,'0') AS key, epoch_us(o_orderdate) AS ts, o_orderkey AS tie, o_orderstatus='P' AS is_tombstone,
  o_orderkey, o_custkey, o_orderstatus FROM orders)""",
    "L": """L AS (SELECT lpad(hex(l_orderkey),16,'0') AS key, epoch_us(l_shipdate) AS ts, l_linenumber, l_partkey, l_suppkey,
  l_returnflag='R' AS is_tombstone, CAST(l_quantity AS BIGINT) AS size, CAST(floor(l_orderkey/500) AS BIGINT) AS run_id, l_orderkey FROM lineitem)""",
}


def with_views(body: str, *names: str) -> str:
    """A statement over the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("" if body.lstrip().startswith(",") else "\n") + body
