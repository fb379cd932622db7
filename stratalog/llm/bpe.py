"""Byte-level BPE with a segment tree.

A piece of text (one match of the pattern) starts as its bytes. A segment tree
over the byte positions stores, in each node, the smallest (rank, position) of
the pairs that begin below it; the root is therefore the leftmost pair of the
lowest rank. A merge kills the right part's position and changes the pairs of
the two live neighbours, which are three leaf updates of logarithmic cost.

Many pieces are merged side by side: one row of the tree arrays is one piece,
so each step is a handful of array operations. Distinct pieces are encoded once
and kept in a bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces that a worker remembers; beyond it starts anew.
REMEMBERED = 300_000
NONE = np.int64(1) << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a token in base64 and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks, and the pairs of tokens that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]
        #: Tokens by their id in decimal.
        self.strings = {str(rank): token for rank, token in self.tokens.items()}

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where a pair doesn't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[str]]:
    """Token ids of each piece, in decimal. A piece that is a token is that token."""
    out: list[list[str] | None] = [[str(vocabulary.ranks[p])] if p in vocabulary.ranks else ([] if not p else None) for p in pieces]
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if out[i] is None:
            by_width.setdefault(max(1, (len(p) - 1).bit_length()), []).append(i)
    for width, rows in by_width.items():
        step = max(1, (1 << 17) >> width)  # rows of one batch, by the size of their trees
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            for i, ids in zip(some, _merge([pieces[i] for i in some], width, vocabulary)):
                out[i] = ids
    return out


def _merge(pieces: list[bytes], width: int, vocabulary: Vocabulary) -> list[list[str]]:
    size, many = 1 << width, len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=many)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(many, size)
    inside = np.arange(size) < lengths[:, None]
    ids = np.where(inside, vocabulary.bytes[raw], -1)
    after = np.tile(np.arange(1, size + 1), (many, 1))  # the next live position
    before = np.tile(np.arange(-1, size - 1), (many, 1))
    # leaves hold rank << 20 | position, so that the minimum is the leftmost of the lowest rank
    bits = max(20, width)
    places = np.arange(size)
    tree = np.full((many, 2 * size), NONE, dtype=np.int64)
    rank = vocabulary.merged(ids[:, :-1], ids[:, 1:])
    rank[~inside[:, 1:]] = NONE
    tree[:, size : 2 * size - 1] = np.where(rank == NONE, NONE, rank << bits | places[:-1])
    for level in range(width - 1, -1, -1):
        low = 1 << level
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])

    flat = tree.reshape(-1)

    def update(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        base = rows * (2 * size)
        node = at + size
        flat[base + node] = values
        for _ in range(width):
            node = node >> 1
            child = base + 2 * node
            flat[base + node] = np.minimum(flat[child], flat[child + 1])

    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        root = tree[live, 1]
        left, new = root & ((1 << bits) - 1), root >> bits
        right = after[live, left]
        beyond = after[live, right]
        ids[live, left] = new
        ids[live, right] = -1
        after[live, left] = beyond
        has = beyond < lengths[live]
        before[live[has], beyond[has]] = left[has]
        value = np.full(len(live), NONE, dtype=np.int64)
        merged = vocabulary.merged(new[has], ids[live[has], beyond[has]])
        value[has] = np.where(merged == NONE, NONE, merged << bits | left[has])
        prior = before[live, left]
        has = prior >= 0
        merged = vocabulary.merged(ids[live[has], prior[has]], new[has])
        earlier = np.where(merged == NONE, NONE, merged << bits | prior[has])
        # the three leaves climb together: a level is computed from a complete level below
        update(
            np.concatenate((live, live, live[has])),
            np.concatenate((right, left, prior[has])),
            np.concatenate((np.full(len(live), NONE, dtype=np.int64), value, earlier)),
        )
        live = live[tree[live, 1] != NONE]
    keep = ids >= 0
    flat = list(map(str, ids[keep].tolist()))
    ends = np.cumsum(keep.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes texts; remembers the ids of distinct pieces."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.ids: dict[str, str] = {}

    def _learn(self, split: list[list[str]]) -> None:
        pieces = set(chain.from_iterable(split))
        new = list(pieces.difference(self.ids))
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            new = list(pieces)
        for p, ids in zip(new, encode_pieces([p.encode("utf-8", "replace") for p in new], self.vocabulary)):
            self.ids[p] = " ".join(ids)

    def decode(self, ids: str) -> bytes:
        """The bytes of ids in decimal, joined by a space."""
        return b"".join(map(self.vocabulary.strings.__getitem__, ids.split(" "))) if ids else b""

    def texts(self, texts: list[str]) -> Iterator[str]:
        """For each text its ids, in decimal and joined by a space."""
        split = [self.pattern.findall(t) for t in texts]
        at = 0
        while at < len(split):  # texts are learned together up to a bounded number of pieces
            end, seen = at, 0
            while end < len(split) and (end == at or seen + len(split[end]) <= REMEMBERED):
                seen += len(split[end])
                end += 1
            self._learn(split[at:end])
            ids = self.ids.__getitem__
            for pieces in split[at:end]:
                yield " ".join(map(ids, pieces))
            at = end


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def batches_of(texts: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts (null: empty) in lists of about ``limit`` code points."""
    some: list[str] = []
    held = 0
    for value in texts:
        t = value.as_py() or ""
        some.append(t)
        held += len(t)
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def encode(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each text as a list of int.

    A null text is empty and has no ids; repeated rows give repeated results;
    an empty table gives an empty result. Special tokens are never made: their
    names in a text are ordinary text. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [[int(x) for x in s.split()] for some in batches_of(batch.column(1)) for s in own.texts(some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the bytes of each list of ids; a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path, ".").vocabulary.tokens
        for batch in batches:
            decoded = [None if x.as_py() is None else b"".join(tokens[i] for i in x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=[key, "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, decoded binary")


def digests(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, digest the ids, decode them, digest the bytes.

    As ``encode`` for nulls, repeated rows and empty tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for some in batches_of(batch.column(1)):
                for ids in own.texts(some):
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
