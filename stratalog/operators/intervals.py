"""Interval algebra over DataFrames of (lo, hi), half open, on any ordered type.

An open end is null: a null ``lo`` is below all keys, a null ``hi`` above all.
A range is empty when ``lo >= hi``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(lo: Column, hi: Column, key: Column) -> Column:
    return (lo.isNull() | (key >= lo)) & (hi.isNull() | (key < hi))


def not_empty(lo: Column, hi: Column) -> Column:
    return lo.isNull() | hi.isNull() | (lo < hi)


def max_lo(a: Column, b: Column) -> Column:
    """The higher of two lower ends (greatest skips nulls, which are lowest)."""
    return F.greatest(a, b)


def min_hi(a: Column, b: Column) -> Column:
    """The lower of two upper ends (least skips nulls, which are highest)."""
    return F.least(a, b)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return not_empty(max_lo(lo1, lo2), min_hi(hi1, hi2)) & not_empty(lo1, hi1) & not_empty(lo2, hi2)


#: A sorted whole is cut into so many slices, by a bounded sample of its values.
SLICES, SAMPLE = 64, 4096


def cut_points(rows: DataFrame, name: str) -> list:
    """Values that cut a column into slices of about equal size: every n-th of a sample that a hash of the value chooses."""
    values = rows.select(F.col(name).alias("v")).where("v is not null").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    ordered = sorted(r["v"] for r in values)
    return sorted({ordered[i * len(ordered) // SLICES] for i in range(1, SLICES)}) if ordered else []


def slice_of(value: Column, cuts: list) -> Column:
    """In which slice a value is; null is in the first.

    Nested comparisons that halve the cuts, without a lambda: the optimizer infers
    filters from a slice that is a join key, and where a lambda stands in it, it may
    put one above rows without the value.
    """

    def within(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(value >= F.lit(cuts[middle]), within(middle + 1, last)).otherwise(within(first, middle))

    return within(0, len(cuts))


def union(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping and adjacent ranges merged: gaps and islands.

    Per group of ``by``. The order is cut into slices, each one task: running
    ends inside a slice, then what the slices before reach (a row a slice).
    """
    keys = list(by)
    rows = ranges.where(not_empty(F.col("lo"), F.col("hi"))).select(*keys, "lo", "hi")
    rows = rows.withColumn("_slice", slice_of(F.col("lo"), cut_points(rows, "lo")))
    order = Window.partitionBy(*keys, "_slice").orderBy(F.col("lo").asc_nulls_first(), F.col("hi").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    open_hi = lambda x: F.max(x.isNull().cast("int"))
    ends = rows.groupBy(*keys, "_slice").agg(F.max("hi").alias("_h"), open_hi(F.col("hi")).alias("_o"))
    ends = ends.select(*keys, "_slice", F.max("_h").over(slices).alias("_top"), F.coalesce(F.max("_o").over(slices), F.lit(0)).alias("_open"))
    inside = rows.select("*", F.max("hi").over(before).alias("_t"), F.coalesce(open_hi(F.col("hi")).over(before), F.lit(0)).alias("_u")).join(ends, [*keys, "_slice"])
    top, open_ = F.greatest("_t", "_top"), F.greatest("_u", "_open")
    starts = ((open_ == 0) & (top.isNull() | (F.col("lo") > top))).cast("int")
    marked = inside.withColumn("_s", starts)
    counts = marked.groupBy(*keys, "_slice").agg(F.sum("_s").alias("_n"))
    counts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(slices), F.lit(0)).alias("_base"))
    islands = marked.withColumn("_i", F.sum("_s").over(order)).join(counts, [*keys, "_slice"]).withColumn("_i", F.col("_i") + F.col("_base"))
    hi = F.when(F.max(F.col("hi").isNull()), F.lit(None)).otherwise(F.max("hi")).alias("hi")
    lo = F.when(F.max(F.col("lo").isNull()), F.lit(None)).otherwise(F.min("lo")).alias("lo")
    return islands.groupBy(*keys, "_i").agg(lo, hi).select(*keys, "lo", "hi")


def following(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the next larger value of a column (distinct, null first) as ``_next``, by slices."""
    rows = rows.withColumn("_slice", slice_of(F.col(name), cut_points(rows, name)))
    inside = F.lead(name).over(Window.partitionBy("_slice").orderBy(F.col(name).asc_nulls_first()))
    firsts = rows.groupBy("_slice").agg(F.min(name).alias("_f"))
    firsts = firsts.select("_slice", F.lead("_f").over(Window.orderBy("_slice")).alias("_first"))  # a row a slice
    return rows.withColumn("_next", inside).join(firsts, "_slice").withColumn("_next", F.coalesce("_next", "_first")).drop("_slice", "_first")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order of a column with distinct values as ``_place``, by slices."""
    rows = rows.withColumn("_slice", slice_of(F.col(name), cut_points(rows, name)))
    counts = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    counts = counts.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_base"))  # a row a slice
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(name)) - 1
    return rows.withColumn("_place", inside).join(counts, "_slice").withColumn("_place", F.col("_place") + F.col("_base")).drop("_slice", "_base")


def cell_width(*ranges: DataFrame) -> int:
    """Cells as wide as nine tenths of all ranges are at most, so that few ranges stand in more than two."""
    widths = [r.where("lo is not null and hi is not null").select(F.percentile_approx(F.col("hi") - F.col("lo"), 0.9).alias("w")).first()["w"] for r in ranges]
    return max(1, *[int(w or 1) for w in widths])


def in_cells(ranges: DataFrame, width: int) -> DataFrame:
    """Each range (``lo`` and ``hi`` not null) once for each cell that it touches."""
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)
    return ranges.where("lo < hi").withColumn("_cell", F.explode(F.sequence(first, last)))


def containing(points: DataFrame, ranges: DataFrame, point: str) -> DataFrame:
    """Points joined with all ranges (lo, hi) of whole numbers that hold them: an equi-join by cells of the axis."""
    width = cell_width(ranges)
    return points.withColumn("_cell", F.floor(F.col(point) / width)).join(in_cells(ranges, width), "_cell").where((F.col(point) >= F.col("lo")) & (F.col(point) < F.col("hi"))).drop("_cell")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of overlapping ranges, (lo, hi) and (lo2, hi2), of whole numbers: an equi-join by cells; a pair counts in its first common cell."""
    width = cell_width(a, b)
    x, y = in_cells(a, width), in_cells(b, width).withColumnRenamed("lo", "lo2").withColumnRenamed("hi", "hi2")
    both = x.join(y, "_cell").where((F.col("lo") < F.col("hi2")) & (F.col("lo2") < F.col("hi")))
    return both.where(F.col("_cell") == F.floor(F.greatest("lo", "lo2") / width)).drop("_cell")


def closed(ranges: DataFrame, by: DataFrame) -> DataFrame:
    """Open ends moved to the outer ends of ``by``, beyond which nothing can meet it."""
    ends = by.agg(F.min("lo").alias("_a"), F.max("hi").alias("_b"))
    return ranges.join(F.broadcast(ends)).select(F.coalesce("lo", "_a").alias("lo"), F.coalesce("hi", "_b").alias("hi"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pieces that both sets hold, of whole numbers; ``a`` has no open ends."""
    return overlaps(a, closed(b, a)).select(F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"))


def complement(ranges: DataFrame) -> DataFrame:
    """What no range holds."""
    merged = union(ranges)
    gaps = following(merged, "lo").select(F.col("hi").alias("lo"), F.col("_next").alias("hi")).where(F.col("lo").isNotNull())
    kind = merged.schema["lo"].dataType.simpleString()
    first = merged.agg(F.count("*").alias("n"), F.max(F.col("lo").isNull()).alias("open"), F.min("lo").alias("hi"))
    head = first.where((F.col("n") == 0) | ~F.col("open")).select(F.lit(None).cast(kind).alias("lo"), "hi")
    return head.unionByName(gaps)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pieces of ``a`` (without open ends) that ``b`` doesn't hold, of whole numbers."""
    return intersection(union(a), complement(b))


def overlay(inserts: DataFrame) -> DataFrame:
    """A range map: inserts (lo, hi, seq, value) in order, the last one wins; adjacent pieces with one insert are merged.

    Elementary intervals between all ends, each with the value of its highest
    sequence number.
    """
    cuts = inserts.select(F.col("lo").alias("c")).union(inserts.select("hi")).distinct()
    pieces = following(cuts, "c").select(F.col("c").alias("plo"), F.col("_next").alias("phi")).where(F.col("phi").isNotNull())
    top = containing(pieces, inserts, "plo").groupBy("plo", "phi").agg(F.max(F.struct("seq", "value")).alias("m"))
    return union(top.select(F.col("m.seq").alias("seq"), F.col("m.value").alias("value"), F.col("plo").alias("lo"), F.col("phi").alias("hi")), ("seq", "value"))


def splits_to_ranges(splits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Split points (split) to the ranges between them, open at both ends."""
    order = Window.partitionBy(*by).orderBy("split")
    rows = splits.select(*by, F.lag("split").over(order).alias("lo"), F.col("split").alias("hi"))
    last = splits.groupBy(*by).agg(F.max("split").alias("lo")).withColumn("hi", F.lit(None).cast(splits.schema["split"].dataType)).select(*by, "lo", "hi")
    return rows.unionByName(last)


def ranges_to_splits(ranges: DataFrame) -> DataFrame:
    """Contiguous ranges to their inner split points, with whether the neighbours touch."""
    order = Window.orderBy(F.col("lo").asc_nulls_first())
    return ranges.select(F.col("lo").alias("split"), F.lag("hi").over(order).alias("_before"), F.row_number().over(order).alias("_n")).where("_n > 1").select("split", (F.col("split") == F.col("_before")).alias("contiguous"))


def route(keys: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """Keys with the range that holds them. Routing tables are metadata of known, small size, so they are broadcast only below the session's own threshold (no hint)."""
    return keys.join(ranges, contains(F.col("lo"), F.col("hi"), F.col(key)))
