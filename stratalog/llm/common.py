"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows ...
BROADCAST_ROWS = 20_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by the cluster, from ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs on one machine, as in
    tests, a folder of our own is set; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not configured and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="stratalog-"))
        current = context._jsc.sc().getCheckpointDir()
    return configured or current.get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are written to the shared checkpoint folder once.

    A later loss of executors re-reads the files instead of recomputing, and
    several consumers read the same rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared checkpoint folder.

    Unlike after a checkpoint, its size is known from its files, so the planner
    broadcasts it where it is small. For loops: a checkpoint hands on the
    estimate of its plan, which grows with every join of a round.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    # no codec: compressors keep buffers outside of the heap; small row groups for little memory a task
    df.write.option("compression", "none").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_upto(df: DataFrame, rows: int) -> int:
    """How many rows there are, counted to ``rows + 1``."""
    return len(df.select(F.lit(1).alias("x")).limit(rows + 1).take(rows + 1))


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` (materialized, with narrow rows) is proven small.

    The proof is a count that stops after ``rows + 1`` rows; a larger side
    keeps the shuffled join.
    """
    return F.broadcast(df) if rows_upto(df, rows) <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain column would be copied by the optimizer into every place of use,
    inside lambdas once per element.
    """
    return F.transform(F.array(value), lambda x: body(x))[0]


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(columns: list[str]) -> Column:
    """All columns as one struct ``row``, so that no name of theirs meets one of ours."""
    return F.struct(*[column(c).alias(c) for c in columns]).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
