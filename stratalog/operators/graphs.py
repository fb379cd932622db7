"""Dependency graphs of histories: edges, strongly connected components, shortest cycles.

Graphs are DataFrames (src, dst). Loops checkpoint each round, so lineage stays
short and a lost executor costs one round.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# functions go to the workers whole, so those needn't find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def checkpointed(df: DataFrame) -> DataFrame:
    """Written as a table to the cluster's shared checkpoint folder and read again.

    A table's size is known from its files; ``DataFrame.checkpoint`` hands on
    its plan's estimate instead, which grows with each round of a loop. On one
    machine, without a folder set, one of our own is used.
    """
    spark = df.sparkSession
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if not current.isEmpty() else None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _least_reaching(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per vertex the smallest label that reaches it over edges, to the fixed point."""
    while True:
        pushed = edges.join(labels, F.col("src") == F.col("v")).groupBy(F.col("dst").alias("w")).agg(F.min("label").alias("new"))
        met = labels.join(pushed, F.col("v") == F.col("w"), "left")
        after = checkpointed(met.select("v", F.col("label").alias("was"), F.least("label", F.coalesce("new", "label")).alias("label")))
        if not after.where("was <> label").take(1):
            return after.select("v", "label")
        labels = after.select("v", "label")


def local_components(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices in components of two or more and their component's smallest vertex: Tarjan's algorithm without recursion, in linear time."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, tails = len(ids), at[: len(src)]
    order = np.argsort(tails, kind="stable")
    heads, ends = at[len(src) :][order].tolist(), np.searchsorted(tails[order], np.arange(n), side="right").tolist()
    next_ = [0, *ends[:-1]]  # the edge with which each vertex goes on
    place, low, part, seen = [-1] * n, [0] * n, [-1] * n, 0
    for root in range(n):
        if place[root] >= 0:
            continue
        open_, way = [root], [root]
        place[root] = low[root] = seen
        seen += 1
        while way:
            v = way[-1]
            if next_[v] < ends[v]:
                w = heads[next_[v]]
                next_[v] += 1
                if place[w] < 0:
                    place[w] = low[w] = seen
                    seen += 1
                    open_.append(w)
                    way.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], place[w])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[v])
            if low[v] == place[v]:
                while part[v] < 0:
                    part[open_.pop()] = v
    # ids ascend, so a part's first vertex is its smallest
    _, first, of, size = np.unique(np.array(part, np.int64), return_index=True, return_inverse=True, return_counts=True)
    many = size[of] > 1
    return ids[many], ids[first[of]][many]


def _components_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by group; a batch's whole groups are settled at once, its last one waits for its end."""

    def settled(parts: list[tuple]) -> pa.RecordBatch:
        v, component = local_components(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(component, pa.int64())], ["v", "component"])

    held = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = tuple(batch.column(name).to_numpy() for name in ("_group", "src", "dst"))
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut or (held and held[-1][0][-1] != rows[0][0]):
            yield settled([*held, tuple(x[:cut] for x in rows)])
            held = []
        held.append(tuple(x[cut:] for x in rows))
    if held:
        yield settled(held)


def grouped_components(edges: DataFrame, group: str) -> DataFrame:
    """``strong_components`` of edges with a column in whose groups most vertices keep to themselves.

    A vertex in several groups opens them. Closed groups hold their components
    whole: edges are dealt out by group once, and each group is settled in one
    task, which holds one group at a time. The open ones go round by round. The
    edges are read several times, so hand them over checkpointed.
    """
    # a hash as the group: groups that share one count as one group
    rows = edges.where("src <> dst").select(F.xxhash64(group).alias("_group"), "src", "dst")
    ends = rows.select("_group", F.col("src").alias("v")).union(rows.select("_group", "dst"))
    shared = checkpointed(ends.groupBy("v").agg(F.min("_group").alias("a"), F.max("_group").alias("b")).where("a <> b").select("v"))
    rest = None
    if shared.take(1):
        opened = checkpointed(ends.join(shared, "v", "left_semi").select("_group").distinct())
        rest = strong_components(rows.join(opened, "_group", "left_semi"))
        rows = rows.join(opened, "_group", "left_anti")
    found = rows.repartition("_group").sortWithinPartitions("_group").mapInArrow(_components_of_groups, "v long, component long")
    return found if rest is None else found.unionByName(rest)


def strong_components(edges: DataFrame) -> DataFrame:
    """(v, component) of all vertices in components of two or more; the component is its smallest vertex.

    Rounds of colouring: every vertex takes the smallest vertex that reaches
    it; those that reach that vertex back, within the colour, are its
    component. Found components leave, and edges between colours with them.
    """
    left = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        # vertices without a way in or out are in no cycle
        while True:
            n = left.count()
            left = checkpointed(left.join(left.select(F.col("dst").alias("d")).distinct(), F.col("src") == F.col("d"), "left_semi").join(left.select(F.col("src").alias("s")).distinct(), F.col("dst") == F.col("s"), "left_semi"))
            if left.count() == n:
                break
        if n == 0:
            break
        vertices = left.select(F.col("src").alias("v")).union(left.select("dst")).distinct()
        colour = _least_reaching(left, vertices.select("v", F.col("v").alias("label")))
        c1, c2 = colour.toDF("src", "c1"), colour.toDF("dst", "c2")
        inside = checkpointed(left.join(c1, "src").join(c2, "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("c")))
        # backwards from each colour's root
        far = F.lit(2**63 - 1)
        start = colour.select("v", F.when(F.col("v") == F.col("label"), F.col("label")).otherwise(far).alias("label"))
        back = _least_reaching(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)
        part = checkpointed(back.join(colour.toDF("v2", "colour"), (F.col("v") == F.col("v2")) & (F.col("label") == F.col("colour"))).select("v", F.col("label").alias("component")))
        found = part if found is None else checkpointed(found.unionByName(part))
        gone = part.select(F.col("v").alias("g"))
        left = checkpointed(inside.select("src", "dst").join(gone, F.col("src") == F.col("g"), "left_anti").join(gone, F.col("dst") == F.col("g"), "left_anti"))
    if found is None:
        return edges.sparkSession.createDataFrame([], "v long, component long")
    many = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(many, "component").select("v", "component")


def shortest_cycle(edges: DataFrame, start: int) -> int | None:
    """Edges of the shortest cycle through a vertex: breadth first, visited vertices left out, until none is new."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    front = edges.where(F.col("src") == start).select(F.col("dst").alias("v")).distinct()
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen, depth = None, 1
    while True:
        front = checkpointed(front)
        if not front.take(1):
            return None
        if front.where(F.col("v") == start).take(1):
            return depth
        # a union has the partitions of both: without coalesce they grow each round
        seen = front if seen is None else checkpointed(seen.union(front).coalesce(parts))
        front = edges.join(front, F.col("src") == F.col("v")).select(F.col("dst").alias("v")).distinct().join(seen, "v", "left_anti")
        depth += 1


def cycle_path(edges: DataFrame, start: int) -> list[tuple]:
    """The edges (with their other columns) of a shortest cycle through a vertex, in order; empty if there is none.

    Breadth first, keeping the smallest way into each vertex; then back from
    the start, one lookup an edge: only the cycle itself comes to the driver.
    """
    edges = checkpointed(edges)
    way = edges.where(F.col("src") == start).groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("via")).withColumn("depth", F.lit(1))
    seen, depth = None, 1
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        way = checkpointed(way)
        if not way.take(1):
            return []
        seen = way if seen is None else checkpointed(seen.unionByName(way).coalesce(parts))
        if way.where(F.col("v") == start).take(1):
            break
        depth += 1
        found = edges.join(way, F.col("src") == way["v"]).groupBy(F.col("dst").alias("w")).agg(F.min("src").alias("via"))
        way = found.join(seen.select("v"), F.col("w") == F.col("v"), "left_anti").select(F.col("w").alias("v"), "via", F.lit(depth).alias("depth"))
    path, at = [], start
    for d in range(depth, 0, -1):
        via = seen.where((F.col("v") == at) & (F.col("depth") == d)).select("via").first()["via"]
        path.append(tuple(edges.where((F.col("src") == via) & (F.col("dst") == at)).first()))
        at = via
    return path[::-1]
