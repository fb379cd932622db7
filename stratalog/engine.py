"""The engine's calls: groups, keyspaces, reads and writes over one store.

A group shares one split of the key axis among its keyspaces. All keyspaces
live in one store: a stored key is the keyspace in eight hex digits, then the
key in hex, so that a keyspace is a prefix range. Metadata is kept the same way,
in a store of its own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import revisions as V
from .sources.store import Conflict, Store


def text_of(keyspace: int) -> str:
    if not 0 <= keyspace < 1 << 24:
        raise ValueError("a keyspace has 24 bits")
    return f"{keyspace:08X}"


class Engine:
    """One key-value engine below a path that the whole cluster reaches. Keys are hex strings, values strings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.data, self.meta = Store(spark, f"{path}/data"), Store(spark, f"{path}/meta")

    # Metadata

    def _known(self, key: str) -> str | None:
        found = self.meta.snapshot(keys=V.KeyRange(key, key + "00")).take(1)
        return found[0]["value"] if found else None

    def _create(self, key: str, value: str) -> int:
        """Write a metadata key that must be new."""
        if self._known(key) is not None:
            raise Conflict("it exists")
        since = self.spark.createDataFrame([(key, 0)], "key string, since long")
        return self.meta.commit(self.spark.createDataFrame([(key, value)], "key string, value string"), since)

    def create_group(self, group: int, splits: list[str]) -> int:
        """A group whose key axis is split at ``splits``, which must ascend, differ and not be empty."""
        if any(a >= b for a, b in zip(splits, splits[1:])):
            raise ValueError("splits must ascend")
        if "" in splits:
            raise ValueError("a split can't be the lower end")
        return self._create(f"01{group:08X}", json.dumps(splits))

    def create_keyspace(self, keyspace: int, group: int) -> int:
        """A keyspace in a group that exists."""
        if self._known(f"01{group:08X}") is None:
            raise ValueError("no such group")
        return self._create(f"02{text_of(keyspace)}", str(group))

    def _prefix(self, keyspace: int) -> str:
        if self._known(f"02{text_of(keyspace)}") is None:
            raise ValueError("no such keyspace")
        return text_of(keyspace)

    # Reads

    def _rows(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.substr("key", F.lit(9)).alias("key"), "ts", "value")

    def get(self, keyspace: int, keys: list[str], at: int | None = None) -> DataFrame:
        """(pos, key, ts, value) of each key, in the order asked for; ts and value are null where there is none."""
        prefix = self._prefix(keyspace)
        wanted = [prefix + k for k in keys]
        log = self.data.log(keys=V.KeyRange(min(wanted), max(wanted) + "00"), until=at) if wanted else self.data.log().where("false")
        found = V.positional(wanted, log, at)
        return found.select("pos", F.substr("key", F.lit(9)).alias("key"), "ts", "value")

    def get_latest(self, keyspace: int, keys: list[str]) -> tuple[DataFrame, int]:
        """The newest values, and a time at which all of them hold: the largest of the keys' times, of all times if a key has none."""
        found = self.get(keyspace, keys)
        newest, missing = found.agg(F.max("ts"), F.count_if(F.col("ts").isNull())).first()
        return found, max([r.max_ts for r in self.data.manifest()], default=0) if missing or newest is None else newest

    def scan(self, keyspace: int, lower: str = "", upper: str | None = None, at: int | None = None, limit: int = V.MAX_PAGE, direction: str = "asc") -> tuple[DataFrame, tuple[str, str | None] | None]:
        """A page of live rows in order, and the (lower, upper) that is left, or None at the end."""
        prefix = self._prefix(keyspace)
        keys = V.KeyRange(prefix + lower, prefix + upper if upper is not None else V.successor(prefix))
        at = at if at is not None else max([r.max_ts for r in self.data.manifest()], default=0)
        page = V.scan_page(self.data.log(keys=keys, until=at), at, keys, direction, limit)
        left = page.next_range(keys)
        order: Column = F.col("key").asc() if direction == "asc" else F.col("key").desc()
        rest = None if left is None else (left.lower[8:], left.upper[8:] if left.upper and left.upper.startswith(prefix) else None)
        return self._rows(page.rows).orderBy(order), rest

    def history(self, keyspace: int, key: str, since: int | None = None, until: int | None = None, direction: str = "asc", limit: int | None = None) -> DataFrame:
        """A key's revisions, deletes included, in order of time."""
        stored = self._prefix(keyspace) + key
        rows = V.history(self.data.log(keys=V.KeyRange(stored, stored + "00"), until=until), stored, since, until, direction, limit)
        return rows.select(F.substr("key", F.lit(9)).alias("key"), "ts", "value", "is_tombstone")

    # Writes

    def write(self, mutations: DataFrame, preconditions: DataFrame | None = None) -> int:
        """Apply ``mutations`` (keyspace, key, value; null deletes) at one new time if every precondition (keyspace, key, since) holds: the key hasn't changed after ``since``.

        All or nothing. Raises ValueError for an empty write, an unknown
        keyspace or a key that stands twice, Conflict if a precondition fails.
        """
        stored = lambda rows, *more: rows.select(F.concat(F.lpad(F.hex(F.col("keyspace").cast("long")), 8, "0"), "key").alias("key"), *more)
        spaces = mutations.select("keyspace")
        if preconditions is not None:
            spaces = spaces.union(preconditions.select("keyspace"))
        for r in spaces.distinct().collect():
            self._prefix(r["keyspace"])
        rows = stored(mutations, "value")
        if rows.groupBy("key").count().where("count > 1").take(1):
            raise ValueError("a key is written twice")
        return self.data.commit(rows, None if preconditions is None else stored(preconditions, "since"))
