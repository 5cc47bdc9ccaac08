"""Token shards: ids in wavelet matrices, one compressed file a shard.

A shard's ids are kept as bit-planes from the highest bit down; below each plane the ids
are split stably by its bit (zeros first). A plane is cut into blocks that are compressed
each for itself, and the file has the number of ones before each block. So one file gives
back any token, counts an id in any stretch, and finds its occurrences, and opens only the
blocks that this takes.

File format (all little-endian): magic ``KVW2``, uint32 bits, uint64 tokens, uint64
documents, documents x int64 ids, (documents + 1) x uint64 starts, then for each plane:
uint64 zeros, uint32 blocks, (blocks + 1) x uint64 ones before, blocks x uint32 bytes, the
blocks: packed bits (lowest bit first) compressed by zstd.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlog.llm.bpe import Library, made
from kvlog.llm.common import doc_id, keyed, save, ship
from kvlog.llm.text import slices

#: A shard is closed after the slice of texts that brings it to this many tokens.
TOKENS = 1 << 20
_MAGIC = b"KVW2"
#: Bits in a block.
_BLOCK = 1 << 18


class Plane:
    """Bits in compressed blocks, with rank and select for many places at once."""

    def __init__(self, n: int, zeros: int, before: np.ndarray, bodies: list):
        self.n, self.zeros, self.before, self.bodies = n, zeros, before, bodies
        self.open: dict[int, np.ndarray] = {}
        self.words: dict[int, np.ndarray] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's bits as 64-bit words, with an empty one after them, and ones before each."""
        if b not in self.open:
            raw = zstandard.ZstdDecompressor().decompress(self.bodies[b])
            words = np.frombuffer(raw + bytes(8 + -len(raw) % 8), "<u8")
            ones = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.words[b], self.open[b] = words, ones
        return self.words[b], self.open[b]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = np.minimum(i // _BLOCK, len(self.bodies) - 1)
        out = self.before[at].copy()
        for b in np.unique(at).tolist():
            own, (words, ones) = np.flatnonzero(at == b), self.block(b)
            place = i[own] - b * _BLOCK
            word = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            out[own] += ones[word] + np.bitwise_count(words[word] & below)
        return out

    def select(self, bit: int, j: np.ndarray) -> np.ndarray:
        """Places of the j-th (from 0) such bits."""
        starts = np.minimum(np.arange(len(self.before)) * _BLOCK, self.n)
        many = self.before if bit else starts - self.before
        at = np.searchsorted(many, j, "right") - 1
        out = np.empty(len(j), np.int64)
        for b in np.unique(at).tolist():
            own, (words, ones) = np.flatnonzero(at == b), self.block(b)
            sums = ones if bit else 64 * np.arange(len(ones), dtype=np.int32) - ones
            # Numbers of one width: otherwise all sums are widened for the search.
            left = (j[own] - many[b]).astype(np.int32)
            word = np.searchsorted(sums, left, "right") - 1
            found = words[word] if bit else ~words[word]
            inside = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = (np.cumsum(inside, axis=1, dtype=np.uint8) <= (left - sums[word])[:, None]).sum(1)
            out[own] = b * _BLOCK + 64 * word + inside
        return out

    def bits(self) -> np.ndarray:
        expand = zstandard.ZstdDecompressor()
        return np.unpackbits(np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(expand.decompress(x), np.uint8) for x in self.bodies]]), count=self.n, bitorder="little").view(bool)


class Wavelet:
    """A wavelet matrix over ids of ``len(planes)`` bits."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> Wavelet:
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
            raise ValueError(f"an id does not fit in {bits} bits")
        planes, squeeze = [], zstandard.ZstdCompressor(level=1)
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << level)) != 0
            raw, starts = np.packbits(one, bitorder="little"), np.arange(0, len(x), _BLOCK)
            sums = np.array([np.count_nonzero(one[at : at + _BLOCK]) for at in starts.tolist()], np.int64)
            bodies = [squeeze.compress(raw[at // 8 : (at + _BLOCK) // 8].tobytes()) for at in starts.tolist()]
            first = np.flatnonzero(~one)
            planes.append(Plane(len(x), len(first), np.concatenate([[0], np.cumsum(sums)]).astype(np.int64), bodies))
            x = np.concatenate([x.take(first), x.take(np.flatnonzero(one))])
        return cls(len(ids), planes)

    def access(self, i) -> np.ndarray:
        """The ids at these places."""
        i = np.asarray(i, np.int64)
        out = np.zeros(len(i), np.int64)
        for p in self.planes:
            ones = p.rank(i)
            bit = p.rank(i + 1) > ones
            out = out << 1 | bit
            i = np.where(bit, p.zeros + ones, i - ones)
        return out

    def _narrow(self, value: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for level, p in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            a, b = p.rank(lo), p.rank(hi)
            lo, hi = (p.zeros + a, p.zeros + b) if value >> level & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo, hi) -> np.ndarray:
        """How often the id occurs in each [lo, hi)."""
        if value >> len(self.planes) or not self.n:
            return np.zeros(len(lo), np.int64)
        a, b = self._narrow(value, np.asarray(lo, np.int64), np.asarray(hi, np.int64))
        return b - a

    def locate(self, value: int, j) -> np.ndarray:
        """Places of the j-th occurrences of the id, from 0."""
        i = self._narrow(value, np.zeros(1, np.int64), np.full(1, self.n))[0] + np.asarray(j, np.int64)
        for level, p in enumerate(reversed(self.planes)):
            bit = value >> level & 1
            i = p.select(bit, i - p.zeros if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest up."""
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, p in enumerate(reversed(self.planes)):
            one = p.bits()
            y = np.empty_like(x)
            y[np.flatnonzero(~one)] = x[: p.zeros]
            y[np.flatnonzero(one)] = x[p.zeros :] | x.dtype.type(1 << level)
            x = y
        return x


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    w = Wavelet.build(ids, bits)
    out = [_MAGIC, struct.pack("<IQQ", bits, len(ids), len(doc_ids)), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for p in w.planes:
        out += [struct.pack("<QI", p.zeros, len(p.bodies)), p.before.astype("<u8").tobytes(), np.array([len(x) for x in p.bodies], "<u4").tobytes(), *p.bodies]
    return b"".join(out)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, Wavelet]:
    """Document ids, starts and the wavelet matrix of a shard file, no block of it opened."""
    if data[:4] != _MAGIC:
        raise ValueError("not a token shard")
    bits, n, docs = struct.unpack_from("<IQQ", data, 4)
    at = 24
    ids = np.frombuffer(data, "<i8", docs, at)
    starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
    at += 16 * docs + 8
    planes, view = [], memoryview(data)
    for _ in range(bits):
        zeros, blocks = struct.unpack_from("<QI", data, at)
        before = np.frombuffer(data, "<u8", blocks + 1, at + 12).astype(np.int64)
        at += 20 + 8 * blocks
        ends = at + 4 * blocks + np.cumsum(np.frombuffer(data, "<u4", blocks, at), dtype=np.int64)
        cuts = [at + 4 * blocks, *ends.tolist()]
        planes.append(Plane(n, zeros, before, [view[a:b] for a, b in zip(cuts, cuts[1:])]))
        at = cuts[-1]
    return ids, starts, Wavelet(n, planes)


def id_bits(vocabulary: str, end: int = 0) -> int:
    """Bits that hold every id of a tokenizers file, and the end id."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    return max(1, max([end, *spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]]).bit_length())


def _write(vocabulary: str, end: int, bits: int, most: int):
    def run(batches):
        tok = made(Library, vocabulary)
        keys: list[np.ndarray] = []
        blobs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        part, seq, size = -1, 0, 0

        def shard():
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            body = pack(np.concatenate(keys), starts, np.concatenate(blobs), bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(starts[-1])]), pa.array([body], pa.binary())], ["part", "seq", "tokens", "file"])

        for batch in batches:
            for b in slices(batch):
                part = b.column(2)[0].as_py()
                ids, at = tok.encode(b.column(1))
                keys.append(b.column(0).to_numpy())
                blobs.append(np.insert(ids, at[1:], end))
                sizes.append(np.diff(at) + 1)
                size += len(blobs[-1])
                if size >= most:
                    yield shard()
                    keys, blobs, sizes, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield shard()

    return run


def write_shards(docs: DataFrame, vocabulary: str, end: int = 0, bits: int | None = None, tokens: int = TOKENS) -> DataFrame:
    """Write all ids in ascending ``doc_id`` order, ``end`` after each document. Ids have
    the bits that the vocabulary takes; with fewer asked for, an id that doesn't fit fails.

    Returns the saved table of shard files ``part, seq, tokens, file``; the order of
    shards is that of ``(part, seq)``. The files are written by Spark's own writer, which
    keeps one finished copy of each task's output.
    """
    ship(docs.sparkSession)
    bits = id_bits(vocabulary, end) if bits is None else bits
    ranged = keyed(docs).repartitionByRange("k", F.xxhash64("text")).sortWithinPartitions("k", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    return save(ranged.mapInArrow(_write(vocabulary, end, bits, tokens), "part int, seq int, tokens long, file binary"), "shards")


def read_shards(shards: DataFrame, with_ids: bool = False, end: int = 0) -> DataFrame:
    """Per document, from the shard files: ``doc_id, start`` (ids of all documents before
    it), ``n_tokens, ids_crc32``; ``first_id``, read by access, ``n_ends``, how often the
    end id occurs in it, by ranks, and ``last_end``, the place of the last such id among all
    ids, found by select; with ``with_ids``, ``ids``."""
    # Shards before a part: sums for each part, then one row a part is ordered.
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    base = shards.select("part", "seq", "tokens").withColumn("own", own).join(before, "part").select("part", "seq", (F.col("own") + F.col("base")).alias("base"))
    schema = "part int, seq int, k long, at long, n_tokens long, ids_crc32 long, first_id int, n_ends long, last_end long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                keys, starts, w = unpack(batch.column(2)[row].as_py())
                ids = w.decode().astype("<u4")
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                n = len(keys)
                cols = [pa.array([batch.column(i)[row].as_py()] * n, pa.int32()) for i in (0, 1)]
                cols += [pa.array(keys), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                ends = w.count(end, np.zeros(n, np.int64), starts[1:])
                cols += [pa.array(w.access(starts[:-1]), pa.int32()), pa.array(np.diff(ends, prepend=0)), pa.array(w.locate(end, ends - 1))]
                names = ["part", "seq", "k", "at", "n_tokens", "ids_crc32", "first_id", "n_ends", "last_end"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    out = shards.select("part", "seq", "file").mapInArrow(run, schema).join(base, ["part", "seq"])
    return out.select(doc_id(), (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "first_id", "n_ends", (F.col("last_end") + F.col("base")).alias("last_end"), *(["ids"] if with_ids else []))
