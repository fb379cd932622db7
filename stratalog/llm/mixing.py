"""Mixing sources to target weights with hash-threshold histograms.

Each row has a hash of its id. Per source, sizes are summed by hash bucket;
the bucket in which the running sum crosses the budget is the boundary, and only
the boundary bucket is split into finer buckets, until a bucket is one hash
value. What results is one hash threshold a source, so the decision is a filter:
no row is sorted, budgets are nested (a smaller budget takes a subset), and
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize, maybe_broadcast, packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: The hash has 60 bits: LEVELS histograms of 2 ** BITS buckets a source. A source's running sum is over so few rows, however hot it is.
BITS, LEVELS = 12, 5


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """60 bits of the key's MD5; a null key hashes like an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(mix_source, source_size, target) from rows of (mix_source, mix_size).

    Sources by code point, null last, take the weights in turn and share
    ``share`` times the sum of all sizes; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight. That is
    ``least(most * size, level * weight)`` where the level is the largest of
    (rest of the total) / (rest of the weights) over the sources in order of
    the level at which they fill up.

    The windows run over one row a source.
    """
    by_source = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("mix_source").isNull(), F.col("mix_source"))) - 1
    ranked = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("most", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("mix_source").isNull(), F.col("mix_source"))
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = F.max((share * F.col("all_sizes") - F.col("before")) / F.col("rest")).over(whole)
    return (
        capped.withColumn("all_sizes", F.sum("source_size").over(whole))
        .withColumn("before", before)
        .withColumn("rest", rest)
        .withColumn("level", level)
        .select("mix_source", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))
    )


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mix_source, source_size, target, passes, threshold): how rows are taken.

    ``sizes`` has (mix_source, mix_size, mix_hash). Every row is taken
    ``passes`` times, and once more if its hash is below ``threshold``; the
    sizes below the threshold come as near to the rest of the target as whole
    hash values allow (a value belongs below if at least half of it fits).
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = materialize(
        wanted.withColumn("passes", passes).select(
            "*",
            (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"),
            F.lit(0).cast("long").alias("prefix"),
        )
    )
    running = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for depth in range(1, LEVELS + 1):
        shift, last = BITS * (LEVELS - depth), depth == LEVELS
        known = maybe_broadcast(state).select(F.col("mix_source").alias("s"), F.col("prefix").alias("p"))
        bucket = F.shiftright("mix_hash", shift)
        # only what is inside the boundary bucket is read again
        inside = sizes.join(known, F.col("mix_source").eqNullSafe(F.col("s")) & (F.shiftright("mix_hash", shift + BITS) == F.col("p")))
        if depth > 1:
            inside = sizes = materialize(inside.select("mix_source", "mix_size", "mix_hash"))
        sums = inside.groupBy("mix_source", bucket.alias("bucket")).agg(F.sum("mix_size").alias("n"))
        crossed = sums.withColumn("upto", F.sum("n").over(running)).select(F.col("mix_source").alias("s"), "bucket", "n", (F.col("upto") - F.col("n")).alias("below"))
        # the first bucket that doesn't fit; a last level takes a value that fits by half
        need = F.col("below") + (F.col("n") / 2 if last else F.col("n"))
        found = (
            crossed.join(maybe_broadcast(state).select(F.col("mix_source").alias("s2"), "budget"), F.col("s").eqNullSafe(F.col("s2")))
            .where(need > F.col("budget"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "below")).alias("at"))
        )
        end = F.shiftleft(F.col("prefix") + 1, BITS)
        state = materialize(
            state.join(found, F.col("mix_source").eqNullSafe(F.col("s")), "left").select(
                "mix_source",
                "source_size",
                "target",
                "passes",
                # without a crossing all of the bucket is below: no row has the prefix that follows
                F.when(F.col("at").isNotNull(), F.col("budget") - F.col("at.below")).otherwise(F.lit(0.0)).alias("budget"),
                F.coalesce(F.col("at.bucket"), end).alias("prefix"),
            )
        )
    return state.select("mix_source", "source_size", "target", "passes", F.col("prefix").alias("threshold"))


def mix(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` (its columns ``keep``; all by default) and the struct ``mix``.

    ``mix`` holds size, source_size (long), target (double) and taken (long):
    a row is taken 0, 1 or 2 times, whole, so ``taken`` is 0, 1 or 2 times its
    size.

    A null text has size 0 and is never taken; a null source is a source of
    its own, last in order; rows with equal ids share a hash and are decided
    alike. An empty table gives an empty result. A column named ``mix`` is
    replaced.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c != "mix"]
    parts = F.struct(column(source).alias("source"), size_of(column(text)).alias("size"), hash_of(column(key)).alias("hash")).alias("mix")
    rows = documents.select(packed(keep), parts)
    narrow = text not in keep
    if narrow:  # else the narrow rows are materialized by themselves
        rows = materialize(rows)
    sizes = rows.select(F.col("mix.source").alias("mix_source"), F.col("mix.size").alias("mix_size"), F.col("mix.hash").alias("mix_hash"))
    if not narrow:
        sizes = materialize(sizes)
    plan = maybe_broadcast(thresholds(sizes, materialize(targets(sizes))))
    joined = rows.join(plan, F.col("mix.source").eqNullSafe(F.col("mix_source")))
    times = F.col("passes") + (F.col("mix.hash") < F.col("threshold")).cast("long")
    result = F.struct(F.col("mix.size").alias("size"), "source_size", "target", (F.col("mix.size") * times).alias("taken"))
    return joined.select(*unpacked(keep), result.alias("mix"))


def mixed(documents: DataFrame, **names) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as it is taken."""
    times = F.when(F.col("mix.size") > 0, F.col("mix.taken") / F.col("mix.size")).otherwise(F.lit(0.0)).cast("int")
    rows = mix(documents, **names).where(F.col("mix.taken") > 0)
    return rows.withColumn("mix", F.explode(F.array_repeat(F.lit(1), times))).drop("mix")
