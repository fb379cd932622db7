"""A table of revisions in files: sorted runs, versioned manifests, atomic commits.

Layout: ``runs/<id>`` is a Parquet folder of one key-sorted run set, written
once; ``manifest/v<N>.json`` lists the runs of version N with their key and
time ranges and level. A reader pins one version. A commit writes its runs
first and then creates the next manifest, which fails if another writer has
created it: a compare-and-swap, after which the writer checks again and retries.
All file access goes through Hadoop's file system, so any store that Spark
reads will do (the swap needs a store with exclusive creation).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import revisions as V
from ..operators.transactions import failed_preconditions

SCHEMA = "key string, ts long, tie long, value string, is_tombstone boolean"
#: Rows of one run file, as a target.
RUN_ROWS = 1_000_000


class Conflict(Exception):
    """Another commit came first, or a precondition doesn't hold."""


@dataclass(frozen=True)
class Run:
    id: str
    level: int
    lower: str
    upper: str
    min_ts: int
    max_ts: int
    rows: int


@dataclass
class Store:
    spark: SparkSession
    path: str
    retries: int = 10
    _fs: object = field(init=False, repr=False)

    def __post_init__(self):
        jvm = self.spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifest"))

    # Versions

    def version(self) -> int:
        """The newest version, 0 if nothing is committed."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self._fs.open(self._Path(f"{self.path}/manifest/v{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)]

    def _publish(self, version: int, runs: list[Run]) -> None:
        """Create a version's manifest, whole or not at all; raises Conflict if it exists.

        It is written aside and moved; the move doesn't replace a file, so of
        two writers one fails, and a reader never sees half a manifest.
        """
        path = self._Path(f"{self.path}/manifest/v{version}.json")
        draft = self._Path(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps([r.__dict__ for r in runs]).encode()))
        finally:
            out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        keep = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no option: don't replace
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(path), keep)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise

    # Reading

    def log(self, version: int | None = None, keys: V.KeyRange = V.KeyRange(), until: int | None = None, since: int | None = None) -> DataFrame:
        """All revisions of a version; runs whose ranges can't matter aren't opened."""
        wanted = [
            r
            for r in self.manifest(version)
            if (keys.lower is None or r.upper >= keys.lower) and (keys.upper is None or r.lower < keys.upper) and (until is None or r.min_ts <= until) and (since is None or r.max_ts >= since)
        ]
        if not wanted:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/runs/{r.id}" for r in wanted])
        rows = rows.where(keys.holds(F.col("key")))
        rows = rows if since is None else rows.where(F.col("ts") >= since)
        return rows if until is None else rows.where(F.col("ts") <= until)

    def snapshot(self, at: int | None = None, keys: V.KeyRange = V.KeyRange(), version: int | None = None) -> DataFrame:
        return V.snapshot(self.log(version, keys, at), at, keys)

    # Writing

    def _write(self, rows: DataFrame, level: int, partitions: int) -> Run | None:
        name = uuid.uuid4().hex
        sorted_rows = V.compact([rows.select("key", "ts", "tie", "value", "is_tombstone")], partitions)
        sorted_rows.write.parquet(f"{self.path}/runs/{name}")
        # the statistics come from the written files
        s = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/runs/{name}").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("ts").alias("c"), F.max("ts").alias("d"), F.count("*").alias("n")).first()
        return Run(name, level, s["a"], s["b"], s["c"], s["d"], s["n"]) if s["n"] else None

    def commit(self, writes: DataFrame, preconditions: DataFrame | None = None, partitions: int = 1) -> int:
        """Append ``writes`` (key, value or null for a delete), all at one new time, if every precondition (key, since) holds; returns the time.

        Raises Conflict for a failed precondition, or after too many lost swaps.
        """
        if not writes.take(1):
            raise ValueError("a write must hold something")
        for _ in range(self.retries):
            version = self.version()
            if preconditions is not None:
                # runs without the keys asked for, or older than every time asked for, aren't opened
                ends = preconditions.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("since").alias("t")).first()
                log = self.log(version, V.KeyRange(ends["a"], ends["b"] + "00"), since=ends["t"]) if ends["a"] is not None else None
                if log is not None and failed_preconditions(preconditions, log).take(1):
                    raise Conflict("a precondition doesn't hold")
            runs = self.manifest(version)
            ts = max((r.max_ts for r in runs), default=0) + 1
            rows = writes.select("key", F.lit(ts).alias("ts"), F.lit(0).cast("long").alias("tie"), F.col("value").cast("string").alias("value"), F.col("value").isNull().alias("is_tombstone"))
            run = self._write(rows, 0, partitions)
            try:
                self._publish(version + 1, [*runs, run])
                return ts
            except Conflict:
                self._fs.delete(self._Path(f"{self.path}/runs/{run.id}"), True)
        raise Conflict("too many other writers")

    def _swap(self, change) -> int:
        """Publish ``change(version)`` (the new runs, and those written for it) as the next version; a lost swap begins anew and leaves no run behind."""
        for _ in range(self.retries):
            version = self.version()
            runs, written = change(version)
            try:
                self._publish(version + 1, runs)
                return version + 1
            except Conflict:
                for run in written:
                    self._fs.delete(self._Path(f"{self.path}/runs/{run.id}"), True)
        raise Conflict("too many other writers")

    def load(self, rows: DataFrame, partitions: int = 8) -> int:
        """Append revisions that have their times already; returns the version."""
        run = self._write(rows, 1, partitions)
        return self._swap(lambda version: ([*self.manifest(version), *([run] if run else [])], []))

    def compact(self, horizon: int | None = None, level: int = 1) -> int:
        """All runs as one sorted set; with a horizon, revisions that no read at or after it sees are dropped. Reads of older versions stay valid."""

        def merged(version: int):
            runs, rows = self.manifest(version), self.log(version)
            run = self._write(rows if horizon is None else V.visible_from(rows, horizon), level, max(1, -(-sum(r.rows for r in runs) // RUN_ROWS)))
            return ([run] if run else []), ([run] if run else [])

        return self._swap(merged)

    # Levels

    def _write_pieces(self, rows: DataFrame, level: int, pieces: int, bounds: tuple[str, ...] = ()) -> list[Run]:
        """Disjoint sorted runs in one job: by ranges of about equal size, cut at ``bounds`` too; a key is never in two."""
        name, cuts = uuid.uuid4().hex, sorted(bounds)
        place = F.lit(0)
        for c in cuts:
            place = place + (F.col("key") >= c).cast("int")
        ordered = rows.select("key", "ts", "tie", "value", "is_tombstone").repartitionByRange(pieces, "key").withColumn("piece", F.spark_partition_id() * (len(cuts) + 1) + place)
        ordered.sortWithinPartitions("piece", "key", F.desc("ts"), F.desc("tie")).write.partitionBy("piece").parquet(f"{self.path}/runs/{name}")
        if not self._fs.globStatus(self._Path(f"{self.path}/runs/{name}/piece=*")):
            return []
        written = self.spark.read.schema(f"{SCHEMA}, piece int").parquet(f"{self.path}/runs/{name}")
        stats = written.groupBy("piece").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("ts").alias("c"), F.max("ts").alias("d"), F.count("*").alias("n")).orderBy("piece")
        return [Run(f"{name}/piece={s['piece']}", level, s["a"], s["b"], s["c"], s["d"], s["n"]) for s in stats.collect()]

    def merge(self, chosen, level: int, bounds: tuple[str, ...] = (), horizon: int | None = None) -> int:
        """Replace the runs that ``chosen(runs)`` names by disjoint runs of all their revisions at a level; returns the version.

        Runs of the target level that overlap them must be among them. With a
        horizon, which only the lowest level may have, revisions and deletes
        that no read at or after it sees are dropped.
        """

        def merged(version: int):
            runs = self.manifest(version)
            mine = {r.id for r in chosen(runs)}
            if not mine:
                return runs, []
            part = [r for r in runs if r.id in mine]
            rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/runs/{r.id}" for r in part])
            rows = rows if horizon is None else V.visible_from(rows, horizon)
            new = self._write_pieces(rows, level, max(1, -(-sum(r.rows for r in part) // RUN_ROWS)), bounds)
            rest = [r for r in runs if r.id not in mine]
            if level and overlapping([*(r for r in rest if r.level == level), *new]):
                raise ValueError("runs of one level would overlap")
            return [*rest, *new], new

        return self._swap(merged)

    def flush(self) -> int:
        """All of level 0, with what it overlaps of level 1, to level 1."""
        return self.merge(lambda runs: with_overlaps([r for r in runs if r.level == 0], runs, 1), 1)

    def push_down(self, level: int) -> int:
        """The largest run of a level, with what it overlaps below, to the next."""
        return self.merge(lambda runs: with_overlaps(sorted((r for r in runs if r.level == level), key=lambda r: (-r.rows, r.lower))[:1], runs, level + 1), level + 1)

    def split_runs(self, bounds: tuple[str, ...]) -> int:
        """Cut every run that a bound falls inside (above its first key, upto its last)."""
        inside = lambda r: any(r.lower < b <= r.upper for b in bounds)
        version = self.version()
        for level in sorted({r.level for r in self.manifest() if inside(r)}):
            version = self.merge(lambda runs: [r for r in runs if r.level == level and inside(r)], level, bounds)
        return version

    def maintain(self, level0: int, level1: int) -> int:
        """Compact until no level is too large: level 0 has ``level0`` rows at most, level n ``level1`` times ten to the power of n - 1."""
        while True:
            sizes: dict[int, int] = {}
            for r in self.manifest():
                sizes[r.level] = sizes.get(r.level, 0) + r.rows
            if sizes.get(0, 0) > level0:
                self.flush()
                continue
            full = [n for n, size in sorted(sizes.items()) if n > 0 and size > level1 * 10 ** (n - 1)]
            if not full:
                return self.version()
            self.push_down(full[0])


def overlapping(runs: list[Run]) -> bool:
    """Whether any two runs share a part of the key axis."""
    ordered = sorted(runs, key=lambda r: r.lower)
    return any(b.lower <= a.upper for a, b in zip(ordered, ordered[1:]))


def with_overlaps(chosen: list[Run], runs: list[Run], level: int) -> list[Run]:
    """The chosen runs and those of a level that overlap any of them."""
    return [*chosen, *(r for r in runs if r.level == level and r not in chosen and any(r.lower <= c.upper and c.lower <= r.upper for c in chosen))]
