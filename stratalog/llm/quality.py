"""Quality classifier: neighbours vote in a latent-semantic space.

A text is a histogram of hashed byte pairs with weights by document frequency;
a truncated singular value decomposition of a bounded sample of labelled texts
gives the latent space. The sample's vectors (a fixed bound, so their broadcast
is small) go to every task, which multiplies blocks of its documents with all of
them: exact cosines, no index. The most similar labelled texts vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts that are learned from at most, of both labels together.
SAMPLE = 4000
FEATURES, LATENT, NEIGHBOURS, SHARPNESS = 2048, 48, 25, 8
HELD_OUT_FOLDS, THRESHOLD = 5, 0.3
BLOCK = 1024
#: Columns after the byte pairs: words equal to the word before, to an earlier word, and all words.
EXTRA = 3

_table = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of each hashed byte pair, and of repeated words, of a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(FEATURES + EXTRA, dtype=np.float32)
    if len(data) > 1:
        codes = (data[:-1].astype(np.uint16) << 8) | data[1:]
        out[:FEATURES] = np.sqrt(np.bincount(_table[codes], minlength=FEATURES) / len(codes))
    words = (text or "").split()
    if words:
        n = len(words)
        again = sum(map(str.__eq__, words[1:], words))
        out[FEATURES:] = np.sqrt(again / n), np.sqrt(1 - len(set(words)) / n) / 2, 0.05
    return out


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.stack([features(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, FEATURES + EXTRA), dtype=np.float32)


class Model:
    """Latent vectors and labels of the sample."""

    def __init__(self, matrix: np.ndarray, labels: np.ndarray, latent: int = LATENT):
        present = (matrix > 0).sum(axis=0) / max(1, len(matrix))
        self.weights = np.log((1 + 1.0) / (present + 1.0 / max(1, len(matrix)))).clip(0.2, 6).astype(np.float32) if len(matrix) else np.ones(matrix.shape[1], dtype=np.float32)
        weighted = matrix * self.weights
        gram = (weighted.T @ weighted).astype(np.float64)
        # a few rounds of subspace iteration from a fixed start give the leading singular vectors
        basis = np.linalg.qr(np.random.default_rng(7).normal(size=(gram.shape[0], min(latent, gram.shape[0]))))[0]
        for _ in range(12):
            basis = np.linalg.qr(gram @ basis)[0]
        self.basis = basis.astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.vectors = self.project(matrix)

    def project(self, matrix: np.ndarray) -> np.ndarray:
        latent = (matrix * self.weights) @ self.basis
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.where(norms > 0, norms, 1)

    def scores(self, matrix: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Weighted votes; the share of label 1 in the sample for texts without features."""
        out = np.full(len(matrix), self.prior)
        if not len(self.labels):
            return out
        k = min(neighbours, len(self.labels))
        for at in range(0, len(matrix), BLOCK):
            some = self.project(matrix[at : at + BLOCK])
            cosines = some @ self.vectors.T
            nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            voted = (weight * self.labels[nearest]).sum(axis=1) / np.where(total > 0, total, 1)
            out[at : at + BLOCK] = np.where((total > 0) & (np.abs(some).sum(axis=1) > 0), voted, self.prior)
        return np.clip(out, 0.0, 1.0)


def held_out(key: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % HELD_OUT_FOLDS == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled texts, chosen by a hash of the id (null ids, labels and the held-out fold aside)."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out()).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    # at most ``sample`` rows of a few kB (a repeated id counts once), in an order that doesn't depend on tasks
    found = rows.mapInArrow(run, "doc_id long, y int, x binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.stack([np.frombuffer(b, dtype=np.float16) for b in found["x"]]).astype(np.float32) if len(found) else np.zeros((0, FEATURES + EXTRA), dtype=np.float32)
    return Model(x, found["y"].to_numpy(dtype=np.int64))


def classify(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row.

    A null text counts as empty; a text without words scores by its bytes, an
    empty one with the sample's share of label 1 (0.5 if nothing was learned).
    Repeated rows get equal results, an empty table an empty result. Only
    ``doc_id`` and ``text`` are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1)
            parts = [own.scores(_matrix(texts.slice(at, BLOCK))) for at in range(0, len(texts), BLOCK)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
