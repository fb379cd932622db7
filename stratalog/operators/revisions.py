"""Reads over a revision log: snapshots, pages, history, as-of joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 1000
ORDER = ("ts", "tie")


@dataclass(frozen=True)
class KeyRange:
    """Keys from ``lower`` (included) to ``upper`` (excluded); None is open."""

    lower: object = None
    upper: object = None

    def holds(self, key: Column) -> Column:
        """Two comparisons that reach the scan."""
        found = F.lit(True)
        if self.lower is not None:
            found = found & (key >= F.lit(self.lower))
        if self.upper is not None:
            found = found & (key < F.lit(self.upper))
        return found


def successor(prefix: str | bytes):
    """The smallest key above all keys with the prefix; None if there is none. Hex strings stay hex strings."""
    raw = bytes.fromhex(prefix) if isinstance(prefix, str) else bytes(prefix)
    raw = raw.rstrip(b"\xff")
    if not raw:
        return None
    up = raw[:-1] + bytes([raw[-1] + 1])
    return up.hex().upper() if isinstance(prefix, str) else up


def prefix_range(prefix) -> KeyRange:
    return KeyRange(prefix, successor(prefix))


def newest(log: DataFrame, order=ORDER, keys=("key",)) -> DataFrame:
    """The newest revision of each key, tombstones included; the window's limit is applied before the exchange too."""
    place = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_place", F.row_number().over(place)).where(F.col("_place") == 1).drop("_place")


def snapshot(log: DataFrame, at: int | None = None, keys: KeyRange = KeyRange(), tombstones: bool = False, order=ORDER) -> DataFrame:
    """Live rows of a key range at a time. The filters reach the scan of a log that stores ``key`` and ``ts``; views that compute them take the bounds themselves."""
    rows = log.where(keys.holds(F.col("key")))
    if at is not None:
        rows = rows.where(F.col("ts") <= at)
    rows = newest(rows, order)
    return rows if tombstones else rows.where(~F.col("is_tombstone"))


@dataclass
class Page:
    rows: DataFrame
    seen: DataFrame
    direction: str

    def cursor(self) -> DataFrame:
        """One row if anything was seen: the last key, where the next page begins or ends, and how much was seen and live."""
        last = F.max("key") if self.direction == "asc" else F.min("key")
        counts = self.seen.agg(last.alias("last_key"), F.count("*").alias("seen"), F.sum((~F.col("is_tombstone")).cast("long")).alias("live"))
        return counts.where(F.col("seen") > 0)

    def next_range(self, keys: KeyRange) -> KeyRange | None:
        """The range that is left, or None at the end."""
        found = self.cursor().take(1)
        if not found:
            return None
        last = found[0]["last_key"]
        after = last + "00" if isinstance(last, str) else bytes(last) + b"\0"
        return KeyRange(after, keys.upper) if self.direction == "asc" else KeyRange(keys.lower, last)


def scan_page(log: DataFrame, at: int, keys: KeyRange = KeyRange(), direction: str = "asc", limit: int = MAX_PAGE, order=ORDER) -> Page:
    """A page of a snapshot scan. The limit counts keys, tombstones too, and is 1000 at most; tombstones are dropped afterwards, so a page may be short or empty while more follows."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    ordered = F.col("key").asc() if direction == "asc" else F.col("key").desc()
    seen = snapshot(log, at, keys, tombstones=True, order=order).orderBy(ordered).limit(min(limit, MAX_PAGE))
    return Page(seen.where(~F.col("is_tombstone")), seen, direction)


def scan_pages(log: DataFrame, at: int, keys: KeyRange = KeyRange(), direction: str = "asc", limit: int = MAX_PAGE):
    """All pages in turn."""
    while keys is not None:
        page = scan_page(log, at, keys, direction, limit)
        keys = page.next_range(keys)
        if keys is not None:
            yield page


def history(log: DataFrame, key, since: int | None = None, until: int | None = None, direction: str = "asc", limit: int | None = None, order=ORDER) -> DataFrame:
    """Revisions of one key, tombstones included, in order of time; both ends are included."""
    rows = log.where(F.col("key") == F.lit(key))
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if until is not None:
        rows = rows.where(F.col("ts") <= until)
    rows = rows.orderBy(*[F.col(c).asc() if direction == "asc" else F.col(c).desc() for c in order])
    return rows if limit is None else rows.limit(min(limit, MAX_PAGE))


SLICES = 64


def asof_join(requests: DataFrame, log: DataFrame, request_id: str, order=ORDER, strict: bool = False, hot: bool = False) -> DataFrame:
    """Each request (key, at, ``request_id``) with the newest revision of its key at its time, or before it if ``strict``.

    Both sides meet in one ordered stream per key and the last revision before
    each request is carried on. With ``hot`` a key's stream is cut into slices
    of time (so a hot key is many tasks) and the last revision of each slice
    (a few rows a key) is carried into the next.
    """
    payload = [c for c in log.columns if c != "key"]
    rev = log.select(F.struct(*payload)).schema[0].dataType
    left = requests.select("key", F.col("at").alias("_t"), F.lit(1).alias("_side"), F.col(request_id), F.lit(None).cast(rev).alias("_rev"))
    right = log.select("key", F.col("ts").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(requests.schema[request_id].dataType).alias(request_id), F.struct(*payload).alias("_rev"), F.struct(*order).alias("_tie"))
    both = left.withColumn("_tie", F.lit(None).cast(right.schema["_tie"].dataType)).unionByName(right)
    side = F.col("_side").desc() if strict else F.col("_side").asc()
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("_t", side, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    if not hot:
        carried = F.last("_rev", ignorenulls=True).over(upto("key"))
        return both.withColumn("_rev", carried).where(F.col("_side") == 1).select("key", request_id, F.col("_t").alias("at"), "_rev.*")
    # slices by quantiles of time; a time is in one slice, so ties stay together
    cuts = log.select(F.percentile_approx("ts", [i / SLICES for i in range(1, SLICES)], 10_000).alias("c")).first()["c"] or []
    place = F.aggregate(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>"), F.lit(0), lambda n, c: n + (F.col("_t") > c).cast("int"))
    both = both.withColumn("_slice", place)
    carried = both.withColumn("_rev", F.last("_rev", ignorenulls=True).over(upto("key", "_slice"))).where(F.col("_side") == 1)
    ends = both.where(F.col("_side") == 0).groupBy("key", "_slice").agg(F.max_by("_rev", F.struct("_t", "_tie")).alias("_end"))
    # the newest end of any slice before: one row a slice that holds revisions
    steps = Window.partitionBy("key").orderBy("_slice")
    ends = ends.select("key", (F.col("_slice") + 1).alias("_low"), F.lead("_slice").over(steps).alias("_next"), "_end")
    spread = ends.select("key", F.explode(F.sequence(F.col("_low"), F.coalesce("_next", F.lit(SLICES)))).alias("_slice"), "_end")
    joined = carried.join(spread, ["key", "_slice"], "left").withColumn("_rev", F.coalesce("_rev", "_end"))
    return joined.select("key", request_id, F.col("_t").alias("at"), "_rev.*")


def newest_of_sources(sources: list[DataFrame], at: int | None = None, order=ORDER) -> DataFrame:
    """The newest revision of each key over several sources (levels, runs), by one ``max_by``."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    if at is not None:
        rows = rows.where(F.col("ts") <= at)
    payload = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_r")).select("key", "_r.*")


def positional(keys: list, log: DataFrame, at: int | None = None) -> DataFrame:
    """One row for each requested key, in order; missing keys have no revision. A repeated key is an error."""
    if len(set(keys)) != len(keys):
        raise ValueError("a key is requested twice")
    spark = log.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos int, key string")
    wanted = log.join(F.broadcast(asked.select("key")), "key", "left_semi")
    return asked.join(snapshot(wanted, at), "key", "left")


def visible_from(log: DataFrame, horizon: int, order=ORDER) -> DataFrame:
    """The revisions that a read at or after the horizon can see: those after it, and of those upto it each key's newest, unless it is a delete."""
    old = Window.partitionBy("key", F.col("ts") <= horizon).orderBy(*[F.col(c).desc() for c in order])
    rows = log.withColumn("_n", F.row_number().over(old))
    return rows.where((F.col("ts") > horizon) | ((F.col("_n") == 1) & ~F.col("is_tombstone"))).drop("_n")


def compact(sources: list[DataFrame], partitions: int, horizon: int | None = None, order=ORDER) -> DataFrame:
    """All revisions of several sources as one sorted, range-partitioned run set.

    With a horizon, revisions that no read at or after it can see are dropped.
    """
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    if horizon is not None:
        rows = visible_from(rows, horizon, order)
    return rows.repartitionByRange(partitions, "key").sortWithinPartitions("key", *[F.col(c).desc() for c in order])
