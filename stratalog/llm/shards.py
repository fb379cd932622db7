"""Token ids in binary shards: a wavelet matrix per file.

Documents are encoded, dealt to shards by ranges of their id and written in
ascending order; a shard rotates its files at document boundaries once a file
has enough tokens, so memory is bounded however large a range is. A file holds
one bit-plane for each bit of the ids (each plane in the order that the plane
above sorts the tokens into), compressed in blocks, with running counts of ones:
any token can be read, a token's occurrences counted and located by opening one
block or two a plane.

Files go to the cluster's shared folder under their final name in one move, and
their content depends on the input alone, so a task that runs again after an
executor is lost writes the same file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, materialize, maybe_broadcast

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A file ends after so many tokens. A range of ids (one task, which streams its files) has about so many documents; beyond so many ranges they grow instead.
FILE_TOKENS, RANGE_DOCUMENTS, RANGES = 4_000_000, 8192, 65_536
#: Pieces (and odd stretches) that a worker remembers, at most; pieces in one call of the library; bytes of text cut at once (or one text).
REMEMBERED, ASKED, CUT = 600_000, 1024, 4 << 20
# Fixed value: how the tokenizer's file cuts a normalised text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stretches without characters that normalisation composes or that libraries may class differently.
LATIN = regex.compile(r"[\x21-\x7E\xA1-\u012F\u0131-\u024F]*").fullmatch
#: What arrays cut, by byte and by pair of bytes: ASCII without apostrophes and control characters, and LATIN letters and signs whose lower case has two bytes too. All else is odd.
BLANK, SIGN, DIGIT, LETTER, ODD = range(5)
KIND, KIND_PAIR = np.full(256, ODD, dtype=np.uint8), np.full(1 << 16, ODD, dtype=np.uint8)
LOWER, LOWER_PAIR = np.arange(256, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint16)
KIND[0x21:0x7F] = SIGN
KIND[list(b" \n")], KIND[ord("'")], KIND[list(b"0123456789")] = BLANK, ODD, DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
LOWER[0x41:0x5B] += 0x20
for _c in map(chr, range(0xA1, 0x250)):
    if LATIN(_c) and len(_c.lower().encode()) == 2 and not regex.match(r"\p{N}", _c):
        _pair = int.from_bytes(_c.encode())
        KIND_PAIR[_pair], LOWER_PAIR[_pair] = LETTER if regex.match(r"\p{L}", _c) else SIGN, int.from_bytes(_c.lower().encode())
MAGIC, HEADER, RANK_BLOCK, PLANE_BLOCK = b"WVMX0002", "<8sQIII", 2048, 1 << 18


class Plane:
    """One bit-plane: zstd blocks of PLANE_BLOCK bits, and the ones before each RANK_BLOCK bits."""

    def __init__(self, n: int, blocks: list[bytes], ranks: np.ndarray):
        self.n, self.blocks, self.ranks = n, blocks, ranks
        self.opened: tuple[int, np.ndarray] | None = None

    @classmethod
    def build(cls, one: np.ndarray, pack: zstandard.ZstdCompressor) -> "Plane":
        n = len(one)
        raw = np.packbits(one, bitorder="little").tobytes()
        padded = np.zeros(-(-n // RANK_BLOCK) * RANK_BLOCK, dtype=bool)
        padded[:n] = one
        ranks = np.concatenate(([0], padded.reshape(-1, RANK_BLOCK).sum(axis=1).cumsum())).astype("<u4")
        step = PLANE_BLOCK // 8
        return cls(n, [pack.compress(raw[at : at + step]) for at in range(0, len(raw), step)], ranks)

    def block(self, i: int) -> np.ndarray:
        """The bytes of a block; the last one asked for stays open."""
        if self.opened is None or self.opened[0] != i:
            self.opened = i, np.frombuffer(zstandard.decompress(self.blocks[i], max_output_size=PLANE_BLOCK // 8), dtype=np.uint8)
        return self.opened[1]

    def bit(self, i: int) -> int:
        at = i % PLANE_BLOCK
        return int(self.block(i // PLANE_BLOCK)[at >> 3]) >> (at & 7) & 1

    def ones(self, i: int) -> int:
        """Ones before a position."""
        start = i // RANK_BLOCK * RANK_BLOCK
        if start == i:
            return int(self.ranks[i // RANK_BLOCK])
        first = start % PLANE_BLOCK
        last = first + i - start
        bits = np.unpackbits(self.block(start // PLANE_BLOCK)[first >> 3 : (last + 7) >> 3], bitorder="little")[: last - first]
        return int(self.ranks[start // RANK_BLOCK]) + int(bits.sum())

    def select(self, one: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero, which must exist."""
        before = self.ranks.astype(np.int64) if one else np.minimum(np.arange(len(self.ranks), dtype=np.int64) * RANK_BLOCK, self.n) - self.ranks
        at = int(np.searchsorted(before, k, side="right")) - 1
        start = at * RANK_BLOCK
        first = start % PLANE_BLOCK
        bits = np.unpackbits(self.block(start // PLANE_BLOCK)[first >> 3 : (first + RANK_BLOCK) >> 3], bitorder="little")
        return start + int(np.flatnonzero(bits == one)[k - int(before[at])])

    def whole(self) -> np.ndarray:
        raw = b"".join(zstandard.decompress(x, max_output_size=PLANE_BLOCK // 8) for x in self.blocks)
        return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    """Compressed sequence of integers below ``2 ** bits``; nothing but the blocks that a call needs is unpacked."""

    def __init__(self, n: int, bits: int, planes: list[Plane]):
        self.n, self.bits, self.planes = n, bits, planes
        self.zeros = [n - int(p.ranks[-1]) for p in planes]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> "WaveletMatrix":
        a, planes, pack = values, [], zstandard.ZstdCompressor(level=1)
        for level in range(bits):
            one = (a & values.dtype.type(1 << (bits - 1 - level))) != 0
            planes.append(Plane.build(one, pack))
            a = np.concatenate((np.compress(~one, a), np.compress(one, a)))
        return cls(len(values), bits, planes)

    def access(self, i: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros):
            one, ones = plane.bit(i), plane.ones(i)
            value = value << 1 | one
            i = zeros + ones if one else i - ones
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where the token's occurrences among the first ``upto`` stand below the last plane."""
        start, end = 0, upto
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            a, b = plane.ones(start), plane.ones(end)
            start, end = (zeros + a, zeros + b) if token >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, upto: int) -> int:
        """Occurrences of a token among the first ``upto``."""
        start, end = self._range(token, upto)
        return end - start

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of a token, or -1: from its place below the last plane, up through all planes."""
        start, end = self._range(token, self.n)
        if k < 0 or k >= end - start:
            return -1
        at = start + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self.planes[level].select(one, at - self.zeros[level] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All tokens in order: planes are undone from the last to the first."""
        values = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one, z = self.planes[level].whole(), self.zeros[level]
            above = np.empty_like(values)
            above[np.flatnonzero(~one)] = values[:z]
            above[np.flatnonzero(one)] = values[z:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = above
        return values


def dump_shard(ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, bits: int) -> bytes:
    """A file: header, ids (and which aren't null), lengths, then for each plane its ranks, sizes of blocks and blocks; the header has the rest's CRC."""
    matrix = WaveletMatrix.build(tokens, bits)
    parts = [ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(), lengths.astype("<u4").tobytes()]
    for plane in matrix.planes:
        parts += [plane.ranks.tobytes(), np.array([len(x) for x in plane.blocks], dtype="<u4").tobytes(), *plane.blocks]
    body = b"".join(parts)
    return struct.pack(HEADER, MAGIC, len(tokens), len(ids), bits, zlib.crc32(body)) + body


def load_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """(ids, valid, lengths, matrix) of a file; raises ValueError if it is damaged."""
    magic, n, docs, bits, crc = struct.unpack_from(HEADER, data)
    at = struct.calcsize(HEADER)
    if magic != MAGIC or zlib.crc32(memoryview(data)[at:]) != crc:
        raise ValueError("not a token shard, or a damaged one")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    def plane() -> Plane:
        ranks, sizes = take("<u4", -(-n // RANK_BLOCK) + 1), take("<u4", -(-n // PLANE_BLOCK)).tolist()
        return Plane(n, [take("u1", size).tobytes() for size in sizes], ranks)

    ids, valid, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    return ids, valid, lengths, WaveletMatrix(n, bits, [plane() for _ in range(bits)])


class Encoder:
    """The tokenizers library, asked once for each distinct piece of the pre-tokenizer.

    The tokenizer drops white space and none of its tokens spans it, so a
    text's ids are those of its stretches between blanks, in order. Arrays cut
    and lower-case stretches of common letters, digits and signs for many texts
    at once and number the distinct pieces; the library is asked for many
    unseen pieces in one call, whose ids are told apart by the suffix that ends
    each piece. Odd stretches aren't cut by arrays: other Latin ones and those
    with apostrophes are cut by the pattern, the rest (other scripts, combining
    marks, names of added tokens) goes to the library whole. A file with another
    normalizer, pre-tokenizer or model isn't accepted.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as lines:
            parts = json.load(lines)
        check_tokenizer(parts)
        self.pattern = regex.compile(PIECES)
        added = [t["content"] for t in parts["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        self.added_bytes = regex.compile(b"|".join(regex.escape(t.encode()) for t in added) or rb"(?!)")
        self.tokenizer = Tokenizer.from_file(path)
        # for pieces, which are normalised and cut already
        self.pieced = Tokenizer.from_file(path)
        self.pieced.normalizer = None
        self.pieced.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.last = np.zeros(size, dtype=bool)
        self.last[[i for t, i in parts["model"]["vocab"].items() if t.endswith(parts["model"]["end_of_word_suffix"])]] = True
        #: ids of pieces and of odd stretches; an odd stretch that equals a piece has its ids
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """Each text's ids and ``end``, as bytes. A null text has ``end`` alone."""
        pieces, bounds, odd = self._cut(texts)
        coded = pieces.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            strange = np.zeros(len(distinct), dtype=bool)
            strange[codes[odd]] = True
            strange = strange[new].tolist()
            self._learn([distinct[i] for i, s in zip(new, strange) if not s], [distinct[i].decode() for i, s in zip(new, strange) if s])
            for i in new:
                found[i] = self.known[distinct[i]]
        ids = pa.array(found, pa.large_binary()).take(pa.array(codes))
        ends = buffer(ids, 1, np.int64)[bounds] // self.kind.itemsize if len(ids) else np.zeros(len(bounds), dtype=np.int64)
        tokens = np.insert(buffer(ids, 2, self.kind)[: ends[-1]], ends[1:], end)
        offsets = ((ends + np.arange(len(ends))) * self.kind.itemsize).astype(np.int32)
        forget(self.known, REMEMBERED)
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(tokens)])

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces of all texts, where each text's start and the last one's end, which ones are odd stretches)."""
        nothing, blank = pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary())
        joined = pc.binary_join_element_wise(texts.cast(pa.large_binary()).fill_null(nothing), nothing, blank)  # every text ends with a blank
        starts = buffer(joined, 1, np.int64)[: len(texts) + 1]
        raw = buffer(joined, 2, np.uint8)[: starts[-1]]
        kinds, data = KIND[raw], LOWER[raw]
        lead = np.flatnonzero(raw - np.uint8(0xC2) < 8)  # U+0080 to U+027F
        pairs = raw[lead].astype(np.uint16) << 8 | raw[lead + 1]
        kinds[lead] = kinds[lead + 1] = KIND_PAIR[pairs]
        data[lead], data[lead + 1] = LOWER_PAIR[pairs] >> 8, LOWER_PAIR[pairs] & 0xFF
        for m in self.added_bytes.finditer(raw):
            kinds[m.start()] = ODD
        filled = kinds != BLANK
        first = np.empty(len(raw), dtype=bool)
        first[:1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        first |= kinds == DIGIT
        first &= filled
        strange = np.empty(0, dtype=np.int64)
        if kinds.max(initial=BLANK) == ODD:
            after = np.flatnonzero(~filled)  # every stretch, empty or not, ends at a blank
            before = np.concatenate(([0], after[:-1] + 1))
            some = np.maximum.reduceat(kinds, before) == ODD
            strange, after = before[some], after[some]
            step = np.zeros(len(raw), dtype=np.int8)
            step[strange] = 1
            step[after] = -1
            inside = np.cumsum(step, dtype=np.int8).view(bool)
            np.copyto(data, raw, where=inside)
            first[inside] = False
            first[strange] = True
        at = np.flatnonzero(first)
        kept = data[filled]
        offsets = np.append(np.flatnonzero(first[filled]), len(kept))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        return pieces, np.searchsorted(at, starts), np.searchsorted(at, strange)

    def _learn(self, pieces: list[bytes], strange: list[str]) -> None:
        """Have the ids of unseen pieces and odd stretches ready."""
        known, cut, other = self.known, {}, []
        for s in strange:
            if LATIN(s) and not self.added.search(s):
                cut[s] = [p.encode() for p in self.pattern.findall(s.lower())]
            else:
                other.append(s)
        if cut:
            pieces = list(set().union(pieces, *cut.values()).difference(known))
        texts = [b" ".join(pieces[at : at + ASKED]).decode() for at in range(0, len(pieces), ASKED)]
        for at, e in zip(range(0, len(pieces), ASKED), self.pieced.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize).tolist()
            some, raw = pieces[at : at + ASKED], ids.tobytes()
            if len(ends) != len(some):
                raise ValueError("a piece isn't encoded as one")
            for p, a, b in zip(some, [0, *ends], ends):
                known[p] = raw[a:b]
        for s, c in cut.items():
            known[s.encode()] = b"".join(map(known.__getitem__, c))
        for at in range(0, len(other), ASKED):
            some = other[at : at + ASKED]
            for s, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[s.encode()] = array(self.code, e.ids).tobytes()


def buffer(values: pa.Array, i: int, kind) -> np.ndarray:
    """A buffer of an array without an offset."""
    return np.frombuffer(values.buffers()[i] or b"", dtype=kind)


def check_tokenizer(parts: dict) -> None:
    """Raises ValueError for tokenizer files that ``Encoder`` can't follow."""
    normalizers = (parts["normalizer"] or {}).get("normalizers", [])
    before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    split, model = before[0] if before else {}, parts["model"]
    fits = (
        [x["type"] for x in normalizers] == ["NFC", "Replace", "Lowercase"]
        and (normalizers[1]["pattern"], normalizers[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in before] == ["Split", "ByteLevel"]
        and (split["pattern"], split["behavior"], split["invert"]) == ({"Regex": PIECES}, "Removed", True)
        and not before[1]["add_prefix_space"]
        and not before[1]["use_regex"]
        and model["type"] == "BPE"
        and bool(model["end_of_word_suffix"])
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"])
    )
    if not fits:
        raise ValueError("this tokenizer doesn't lower-case, drop white space, cut into runs and end its words with a suffix")


def forget(memory: dict, most: int) -> None:
    """The older half goes once there are more than ``most``."""
    if len(memory) > most:
        for k in list(islice(memory, len(memory) // 2)):
            del memory[k]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_shards(documents: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end: int = 1, file_tokens: int = FILE_TOKENS, range_documents: int = RANGE_DOCUMENTS) -> DataFrame:
    """Write ``documents`` as token shards to ``folder`` and return their manifest (name, place, n_docs, n_tokens, base).

    Every document's ids end with ``end``. A null text has that id alone; null
    keys come first; rows with equal keys are ordered by their ids. An empty
    table gives no file and an empty manifest. Keys must be integers. Other
    columns aren't read.
    """
    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text"))
    n = rows.select("k").count()
    ranges = max(1, min(RANGES, -(-n // range_documents)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = np.array((rows.agg(F.percentile_approx("k", shares, max(20_000, 4 * ranges)).alias("b")).first()["b"] if shares else None) or [], dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            held = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(texts):  # a bounded number of bytes at a time
                upto = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + CUT, side="right")))
                part = keys.slice(at, upto - at)
                shard = np.searchsorted(bounds, part.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
                ids = own.encode(texts.slice(at, upto - at), end)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), part, ids], names=["shard", "k", "ids"])
                at = upto

    encoded = rows.mapInArrow(encode, "shard int, k long, ids binary")
    ordered = encoded.repartitionById(ranges, F.col("shard")).sortWithinPartitions("shard", "k", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        bits = max(1, (max(own.tokenizer.get_vocab_size() - 1, end)).bit_length())
        fs, path = filesystem(folder)
        keys: list[int | None] = []
        parts: list[bytes] = []
        held, part, shard = 0, 0, None

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // own.kind.itemsize for x in parts], dtype=np.uint32)
            tokens = np.frombuffer(b"".join(parts), dtype=own.kind)
            ids = np.array([k or 0 for k in keys], dtype=np.int64)
            data = dump_shard(ids, np.array([k is not None for k in keys]), lengths, tokens, bits)
            name = f"{shard:06d}-{part:06d}.wvmx"
            draft = f"{path}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(data)
            fs.move(draft, f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard << 24 | part], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([len(tokens)], pa.int64())], names=["name", "place", "n_docs", "n_tokens"])

        fs.create_dir(path, recursive=True)
        for batch in batches:
            for s, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if keys and (s != shard or held >= file_tokens):
                    yield flush()
                    part = part + 1 if s == shard else 0
                    keys, parts, held = [], [], 0
                shard = s
                keys.append(k)
                parts.append(x.as_py())
                held += len(parts[-1]) // own.kind.itemsize
        if keys:
            yield flush()

    manifest = materialize(ordered.mapInArrow(write, "name string, place long, n_docs long, n_tokens long"))
    # running sums inside each range of ids, and over the ranges (RANGES rows at most)
    ordered = lambda *of: (Window.partitionBy(*of) if of else Window).orderBy("shard", "place").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("shard", F.shiftright("place", 24))
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("t"), F.min("place").alias("place"))
    offsets = F.broadcast(totals.select("shard", F.coalesce(F.sum("t").over(ordered()), F.lit(0)).alias("offset")))
    based = files.withColumn("inside", F.coalesce(F.sum("n_tokens").over(ordered("shard")), F.lit(0))).join(offsets, "shard")
    return materialize(based.select("name", "place", "n_docs", "n_tokens", (F.col("offset") + F.col("inside")).alias("base")))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: every file is decoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                ids, valid, lengths, matrix = load_shard(content.as_py())
                tokens = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                view = memoryview(tokens).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                keys = pa.array(ids, pa.int64(), mask=valid == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(ids)), keys, pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["name", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    spark = manifest.sparkSession
    schema = "name string, doc_id long, local long, n_tokens long, ids_crc32 long"
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvmx").load(folder)
    decoded = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, schema)
    bases = maybe_broadcast(manifest.select("name", "base"))
    return decoded.join(bases, "name").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark) -> str:
    """A folder of its own below the cluster's shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
