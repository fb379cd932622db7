"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by their length and a hash of their id; a shard is
bounded in rows and in bytes. Each shard's graph is a few flat arrays (neighbours
of the bottom layer, and of each layer above) in one file of the cluster's
shared folder. Every query goes to every shard of its length: a task streams the
queries of its shards in order, opening each shard's file once, and the shards'
results are merged. Graphs are built and searched many vectors at a time.

A shard checks itself: it looks for the exact neighbours of some of its own
vectors with growing breadth until it finds nearly all of them, and keeps that
breadth for all its queries.

Copies of one vector are one vertex, so a group of copies neither crowds a
graph nor hides other vectors; with each vertex go its smallest ids, as many as
a result can hold.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, ensure_checkpoint_dir, materialize, maybe_broadcast
from .shards import filesystem

#: Neighbours below and above, breadth while building and (at least) while searching, share of vertices that rise a layer.
BOTTOM, UPPER, BUILD, SEARCH, RISE = 24, 12, 48, 112, 16
#: Shards of a length, if it has vectors enough; a shard's rows and bytes of vectors at most; queries of one task and shard.
SHARDS, SHARD_ROWS, SHARD_BYTES, QUERY_BLOCK = 8, 20_000, 1 << 25, 65_536
#: A shard's breadth doubles until so much of the exact neighbours of so many of its vectors is found.
FOUND, CHECKED = 0.96, 128
FIRST, BATCH = 256, 512


class Layer:
    """One layer: its vertices, in order of insertion, and a flat array of neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray, degree: int):
        self.vectors = vectors
        self.links = np.full((len(vectors), degree), -1, dtype=np.int32)
        self.filled = 0

    def search(self, queries: np.ndarray, entries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: (vertices, similarities), best first, -1 where there are fewer."""
        many, n = len(queries), self.filled
        breadth = min(breadth, n)
        expand = max(4, breadth // 28)  # heads at a time
        seen = np.zeros((many, n + 1), dtype=bool)  # the last column stands for "none"
        seen[:, n] = True
        rows = np.arange(many)[:, None]
        found = np.full((many, breadth), n, dtype=np.int64)
        near = np.full((many, breadth), -np.inf, dtype=np.float32)
        done = np.ones((many, breadth), dtype=bool)
        width = min(entries.shape[1], breadth)
        found[:, :width] = np.where(entries[:, :width] < 0, n, entries[:, :width])
        seen[rows, found] = True
        valid = found < n
        vectors = self.vectors
        near[valid] = np.einsum("ij,ij->i", queries[np.nonzero(valid)[0]], vectors[found[valid]])
        done = ~valid
        active = np.arange(many)
        while len(active):
            a, f = near[active], found[active]
            open_ = np.where(done[active], -np.inf, a)
            pick = np.argpartition(-open_, min(expand, breadth) - 1, axis=1)[:, :expand]
            chosen = np.take_along_axis(open_, pick, 1) > -np.inf
            going = chosen.any(axis=1)
            active, a, f, pick, chosen = active[going], a[going], f[going], pick[going], chosen[going]
            if not len(active):
                break
            d = done[active]
            np.put_along_axis(d, pick, True, 1)
            heads = np.where(chosen, np.take_along_axis(f, pick, 1), n)
            around = np.where(heads[:, :, None] < n, self.links[np.minimum(heads, n - 1)], -1).reshape(len(active), -1)
            around = np.where(around < 0, n, around)
            around.sort(axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = n
            fresh = ~seen[active[:, None], around]
            around = np.where(fresh, around, n)
            seen[active[:, None], around] = True
            r, c = np.nonzero(fresh)
            sims = np.full(around.shape, -np.inf, dtype=np.float32)
            sims[r, c] = np.einsum("ij,ij->i", queries[active[r]], vectors[around[r, c]])
            a = np.concatenate((a, sims), axis=1)
            f = np.concatenate((f, around), axis=1)
            d = np.concatenate((d, ~fresh), axis=1)
            best = np.argpartition(-a, breadth - 1, axis=1)[:, :breadth]
            near[active], found[active] = np.take_along_axis(a, best, 1), np.take_along_axis(f, best, 1)
            done[active] = np.take_along_axis(d, best, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
        return np.where(near > -np.inf, found, -1), near

    def choose(self, owners: np.ndarray, candidates: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Neighbours of each owner out of its candidates, best first: those nearer to it than to any chosen one, then the nearest others."""
        degree, c = self.links.shape[1], candidates.shape[1]
        order = np.argsort(-sims, axis=1, kind="stable")
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        valid = sims > -np.inf
        v = self.vectors[np.maximum(candidates, 0)]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros(candidates.shape, dtype=bool)
        for j in range(c):
            nearest = np.where(kept[:, :j], between[:, j, :j], -np.inf).max(axis=1) if j else np.full(len(owners), -np.inf)
            kept[:, j] = valid[:, j] & (sims[:, j] > nearest) & (kept[:, :j].sum(axis=1) < degree)
        rank = np.where(kept, 0, np.where(valid, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        chosen = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(candidates, order, 1), -1)
        return np.pad(chosen, ((0, 0), (0, max(0, degree - chosen.shape[1]))), constant_values=-1).astype(np.int32)

    def insert(self, upto: int, candidates: np.ndarray, sims: np.ndarray) -> None:
        """Vertices from ``filled`` to ``upto``, with what a search found for them; they also see each other."""
        new = np.arange(self.filled, upto)
        among = self.vectors[new] @ self.vectors[new].T
        np.fill_diagonal(among, -np.inf)
        k = min(BOTTOM, len(new) - 1)
        if k > 0:
            own = np.argpartition(-among, k - 1, axis=1)[:, :k]
            candidates = np.concatenate((candidates, new[own]), axis=1)
            sims = np.concatenate((sims, np.take_along_axis(among, own, 1)), axis=1)
        if candidates.shape[1] > 64:
            best = np.argpartition(-sims, 63, axis=1)[:, :64]
            candidates, sims = np.take_along_axis(candidates, best, 1), np.take_along_axis(sims, best, 1)
        self.filled = upto
        self.links[new] = self.choose(new, candidates, sims)
        # the way back: every neighbour weighs the newcomers against what it has
        degree = self.links.shape[1]
        source, column = np.nonzero(self.links[new] >= 0)
        target = self.links[new][source, column]
        source = new[source]
        weight = np.einsum("ij,ij->i", self.vectors[source], self.vectors[target])
        order = np.lexsort((-weight, target))
        source, target, weight = source[order], target[order], weight[order]
        owners, starts, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(starts, counts)
        keep = place < degree
        more = np.full((len(owners), degree), -1, dtype=np.int64)
        more[np.repeat(np.arange(len(owners)), counts)[keep], place[keep]] = source[keep]
        for at in range(0, len(owners), BATCH):
            o, m = owners[at : at + BATCH], more[at : at + BATCH]
            both = np.concatenate((self.links[o], m), axis=1).astype(np.int64)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.einsum("id,ijd->ij", self.vectors[o], self.vectors[np.maximum(both, 0)])
            self.links[o] = self.choose(o, both, np.where(both >= 0, s, -np.inf))


class Graph:
    """The layers over one shard's vectors, bottom first."""

    def __init__(self, vectors: np.ndarray):
        # an extra component makes all lengths equal, so the largest inner product is the nearest direction
        self.n, self.breadth = len(vectors), SEARCH
        norms = np.einsum("ij,ij->i", vectors, vectors)
        extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        data = np.concatenate((vectors, extra[:, None]), axis=1)
        scale = np.sqrt(norms.max(initial=1.0)) or 1.0
        data = (data / scale).astype(np.float32)
        #: vertex i is in layer l if it is among the first counts[l]: ids come in hash order, so any prefix is a random sample
        self.counts = [self.n]
        while self.counts[-1] // RISE >= 64:
            self.counts.append(self.counts[-1] // RISE)
        self.layers = [Layer(data[:c], BOTTOM if i == 0 else UPPER) for i, c in enumerate(self.counts)]
        for layer in self.layers[::-1]:
            self._build(layer)

    def _entries(self, layer: int, queries: np.ndarray) -> np.ndarray:
        entries = np.zeros((len(queries), 1), dtype=np.int64)
        for above in self.layers[:layer:-1]:
            found, _ = above.search(queries, entries, 12)
            entries = found[:, :4]
        return entries

    def _build(self, layer: Layer) -> None:
        at = self.layers.index(layer)
        first = min(FIRST, len(layer.vectors))
        layer.insert(first, np.empty((first, 0), dtype=np.int64), np.empty((first, 0), dtype=np.float32))
        while layer.filled < len(layer.vectors):
            upto = min(len(layer.vectors), layer.filled + min(BATCH, layer.filled))
            queries = layer.vectors[layer.filled : upto]
            entries = self._entries(at, queries)
            entries = np.where(entries < layer.filled, entries, 0)
            layer.insert(upto, *layer.search(queries, entries, BUILD))

    def tune(self, k: int) -> None:
        """Set the breadth that finds nearly all of the k exact nearest of a sample of the vertices."""
        sample = self.layers[0].vectors[: min(CHECKED, self.n), :-1].astype(np.float64)
        lengths = np.linalg.norm(sample, axis=1, keepdims=True)
        q = np.concatenate((sample / np.where(lengths > 0, lengths, 1.0), np.zeros((len(sample), 1))), axis=1).astype(np.float32)
        sims = q @ self.layers[0].vectors.T
        k = min(k, self.n)
        least = np.partition(sims, self.n - k, axis=1)[:, self.n - k]
        while self.breadth < self.n:
            found, near = self.layers[0].search(q, self._entries(0, q), max(self.breadth, k))
            if np.mean((near[:, :k] >= least[:, None] - 1e-6) & (found[:, :k] >= 0)) >= FOUND:
                break
            self.breadth *= 2

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, counts=np.array(self.counts), breadth=np.array([self.breadth]), vectors=self.layers[0].vectors, **{f"links{i}": x.links for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> "Graph":
        parts = np.load(io.BytesIO(blob))
        graph = cls.__new__(cls)
        graph.counts, data = parts["counts"].tolist(), parts["vectors"]
        graph.n, graph.layers, graph.breadth = len(data), [], int(parts["breadth"][0])
        for i, c in enumerate(graph.counts):
            layer = Layer.__new__(Layer)
            layer.vectors, layer.links, layer.filled = data[:c], parts[f"links{i}"], c
            graph.layers.append(layer)
        return graph

    def nearest(self, queries: np.ndarray, k: int) -> np.ndarray:
        """The vertices found for each query, 2 * k at most, -1 where there are fewer."""
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        q = np.concatenate((queries / np.where(lengths > 0, lengths, 1.0), np.zeros((len(queries), 1))), axis=1).astype(np.float32)
        found, _ = self.layers[0].search(q, self._entries(0, q), max(self.breadth, 2 * k))
        return found[:, : 2 * k]


class Shard:
    """A shard's ids, its vectors as they are, and their graph; one file each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, graph: Graph):
        self.ids, self.vectors, self.graph = ids, vectors, graph

    def save(self, folder: str, name: str) -> None:
        fs, path = filesystem(folder)
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, graph=np.frombuffer(self.graph.dump(), dtype=np.uint8))
        draft = f"{path}/.{name}.{uuid.uuid4().hex}"
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(draft) as stream:
            stream.write(out.getvalue())
        fs.move(draft, f"{path}/{name}")

    @classmethod
    def open(cls, folder: str, name: str) -> "Shard":
        fs, path = filesystem(folder)
        with fs.open_input_stream(f"{path}/{name}") as stream:
            parts = np.load(io.BytesIO(stream.read()))
        return cls(parts["ids"], parts["vectors"], Graph.load(parts["graph"].tobytes()))

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the k best found for each query, by exact score, then id."""
        found = self.graph.nearest(queries, k)
        r, c = np.nonzero(found >= 0)
        v = found[r, c]
        score, ids = np.einsum("ij,ij->i", queries[r], self.vectors[v]), self.ids[v]
        order = np.lexsort((ids, -score, r))
        r, ids, score = r[order], ids[order], score[order]
        first = np.searchsorted(r, r, side="left")
        best = np.arange(len(r)) - first < k
        return r[best], ids[best], score[best]


def _build_shard(folder: str, k: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "vec_id"], kind="stable")
        graph = Graph(vectors := np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        graph.tune(k)
        length, shard = int(rows["length"].iloc[0]), int(rows["shard"].iloc[0])
        Shard(rows["vec_id"].to_numpy(dtype=np.int64), vectors, graph).save(folder, f"{length}-{shard}.npz")
        return pd.DataFrame({"length": [length], "shard": [shard], "rows": [len(rows)], "breadth": [graph.breadth]})

    return build


def _search_shards(folder: str, k: int):
    """Queries in order of their shards: each shard is opened once, and BATCH queries are searched at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            lengths, shards, ids = (batch.column(i).to_numpy() for i in range(3))
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and end - at < BATCH and lengths[end] == lengths[at] and shards[end] == shards[at]:
                    end += 1
                if name != (lengths[at], shards[at]):
                    name, shard = (lengths[at], shards[at]), Shard.open(folder, f"{lengths[at]}-{shards[at]}.npz")
                q = np.asarray(batch.column(3).slice(at, end - at).flatten()).reshape(end - at, -1)
                r, found, score = shard.search(q, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + r]), pa.array(found), pa.array(score)], names=["query_id", "rep", "score"])
                at = end

    return search


def usable(embedding) -> "F.Column":
    """Not null, no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(embedding, lambda x: x != 0)


def nearest_neighbours(table: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition ``queries`` picks, the ``k`` others found nearest by inner product.

    Nearest first, ties by the smaller id; a row is no candidate of its own.
    Vectors that are null, zero, empty or hold a null or non-finite component
    take no part. An inner product needs equal lengths: a query's candidates
    are the vectors of its own length. Of rows that repeat an id the one with
    the smallest vector counts, and it asks if any of them does. A null id takes
    no part. Tables with fewer candidates give fewer rows; an empty one gives
    none. Other columns aren't read.
    """
    doubles = F.transform(column(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = table.select(column(key).cast("long").alias("vec_id"), doubles.alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    # only the ids that a result can hold stay with a vector; the limit is applied before rows are sent
    members = rows.select("vec_id", "embedding").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 2)
    members = materialize(members.withColumn("rep", F.first("vec_id").over(first)))
    vertices = members.where(F.col("place") == 1).select("vec_id", "embedding", F.size("embedding").alias("length"))
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("length")))))
    sizes = vertices.groupBy("length").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(shards), F.ceil(F.col("n") / CHECKED))).alias("shards"))
    sizes = maybe_broadcast(materialize(sizes))
    dealt = vertices.join(sizes, "length").select("vec_id", "embedding", "length", F.pmod(F.xxhash64("vec_id"), "shards").alias("shard"), F.xxhash64("vec_id", F.lit(1)).alias("place"))
    folder = f"{ensure_checkpoint_dir(table.sparkSession).rstrip('/')}/neighbours-{uuid.uuid4().hex}"
    index = materialize(dealt.groupBy("length", "shard").applyInPandas(_build_shard(folder, k + 1), "length int, shard long, rows long, breadth long"))

    asking = materialize(rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("length")))
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    held = index.groupBy("length").agg(F.collect_list("shard").alias("held"))
    asked = asking.join(maybe_broadcast(materialize(held)), "length").select("length", F.explode("held").alias("shard"), "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    asked = asked.repartition("length", "shard", "block").sortWithinPartitions("length", "shard").drop("block")
    found = asked.mapInArrow(_search_shards(folder, k + 1), "query_id long, rep long, score double")
    # a row's own vector may be among the vectors found, so one more is kept
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    best = materialize(found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1))
    ids = members.select("rep", "vec_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    joined = best.join(ids, "rep").where(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", "score")
    return joined.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
