"""Packing of documents into sequences of fixed length, by a grouping genetic algorithm.

Pieces are dealt by a hash of their row number to groups of bounded size. Several islands, each a task of its
own, evolve solutions of one group: crossover injects whole well-filled bins of one
parent into the other, drops the bins that hold a document twice, and best-fits what was
displaced. After each epoch every island sends its elite to the next one. The best
solution of a group settles its well-filled bins; what lies in its worst bins is pooled
with other groups' and packed again, in an eighth of the groups at most, down to one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.llm.bpe import Library, made
from kvlog.llm.common import doc_id, drop, keyed, save, ship
from kvlog.llm.text import slices

CAPACITY = 4096
#: Pieces in a group; islands, epochs, solutions of an island, children in an epoch.
GROUP, ISLANDS, EPOCHS, POPULATION, CHILDREN = 8192, 3, 2, 4, 6
#: A bin this full settles; of a group's bins at most this share is packed again.
FULL, AGAIN = 0.998, 8


def best_fit(sizes: list[int], loads: list[int], capacity: int) -> list[int]:
    """Put each size, in this order, into the fullest bin that takes it, or a new one.
    ``loads`` is extended in place; returns each one's bin."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r left
    for i, load in enumerate(loads):
        left = capacity - load
        if left:
            free[left].append(i)
            open_ |= 1 << left
    out = []
    for size in sizes:
        fits = open_ >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                open_ ^= 1 << left
            loads[b] += size
        else:
            b, left = len(loads), capacity
            loads.append(size)
        left -= size
        if left:
            free[left].append(b)
            open_ |= 1 << left
        out.append(b)
    return out


def _fitness(loads: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(loads), float(((loads / capacity) ** 2).sum())


class Island:
    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes, capacity
        self.rng = np.random.default_rng(seed)
        self.least = -(-int(sizes.sum()) // capacity)
        self.people: list[np.ndarray] = []

    def loads(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.sizes).astype(np.int64)

    def seed(self, spread: float) -> np.ndarray:
        """Best fit in falling order of size, blurred by ``spread``."""
        order = np.argsort(-self.sizes * (1 + spread * self.rng.standard_normal(len(self.sizes))), kind="stable")
        bins = np.empty(len(order), np.int64)
        bins[order] = best_fit(self.sizes[order].tolist(), [], self.capacity)
        return bins

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        loads = self.loads(b)
        good = np.flatnonzero(loads >= np.quantile(loads, 0.5))
        chosen = np.zeros(len(loads), bool)
        chosen[self.rng.permutation(good)[: max(1, len(good) // 2)]] = True
        moved = chosen[b]
        hit = np.bincount(a, moved) > 0
        hit[self.rng.integers(0, len(hit))] = True  # mutation: one more bin is emptied
        loose = np.flatnonzero(hit[a] & ~moved)
        kept = ~hit[a] & ~moved
        child = np.full(len(a), -1)
        child[moved] = np.unique(b[moved], return_inverse=True)[1]
        n = int(chosen.sum())
        if kept.any():
            child[kept] = n + np.unique(a[kept], return_inverse=True)[1]
        done = child >= 0
        loads = np.bincount(child[done], self.sizes[done]).astype(np.int64).tolist()
        loose = loose[np.argsort(-self.sizes[loose], kind="stable")]
        child[loose] = best_fit(self.sizes[loose].tolist(), loads, self.capacity)
        return child

    def rank(self, x: np.ndarray) -> tuple[int, float]:
        return _fitness(self.loads(x), self.capacity)

    def evolve(self, given: list[np.ndarray], people: int, children: int) -> np.ndarray:
        """The best of the given solutions, fresh seeds and their children."""
        self.people = list(given) or [self.seed(0.0)]
        while True:
            best = max(self.people, key=self.rank)
            if self.rank(best)[0] == -self.least:
                return best
            if len(self.people) >= people:
                break
            self.people.append(self.seed(0.05 * len(self.people)))
        for _ in range(children):
            i, j = self.rng.choice(len(self.people), 2, replace=False)
            child = self.cross(self.people[i], self.people[j])
            worst = min(range(len(self.people)), key=lambda p: self.rank(self.people[p]))
            if self.rank(child) >= self.rank(self.people[worst]):
                self.people[worst] = child
            if -self.rank(child)[0] == self.least:
                return child
        return max(self.people, key=self.rank)


def _evolve(capacity: int, epoch: int, people: int, children: int):
    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                group, island = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                sizes = batch.column(2)[i].values.field("length").to_numpy()
                given = [np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in (batch.column(3)[i], batch.column(4)[i]) if x.is_valid]
                best = Island(sizes, capacity, hash((group, island, epoch)) & 0x7FFFFFFF).evolve(given, people, children)
                used, squares = _fitness(np.bincount(best, sizes), capacity)
                out.append((group, island, used, squares, best.astype("<i4").tobytes()))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["grp", "island", "used", "squares", "bins"])

    return run


_ITEM = "struct<length:long,k:long,piece:int,start:long,ids_crc32:long>"


def _place(capacity: int, rounds: int, last: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column(1)[i].values
                bins = np.frombuffer(batch.column(2)[i].as_py(), "<i4").astype(np.int64)
                size = items.field("length").to_numpy()
                loads = np.bincount(bins, size).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(size[order])
                offset = np.empty(len(bins), np.int64)
                offset[order] = ends - size[order] - (np.cumsum(loads) - loads)[bins[order]]
                again = np.zeros(len(loads), bool)
                if not last:
                    worst = np.argsort(loads, kind="stable")[: max(1, len(loads) // AGAIN)]
                    again[worst] = loads[worst] < FULL * capacity
                number = (np.int64(rounds) << 56) + (np.int64(batch.column(0)[i].as_py()) << 20) + bins
                names = ["length", "k", "piece", "start", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*[items.field(n) for n in names], pa.array(number), pa.array(offset), pa.array(again[bins])], [*names, "sequence_id", "offset", "again"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces (k, piece, start, length,
    ids_crc32)``, each length between 1 and ``capacity``. ``group`` is 2**20 at most.
    """
    spark = pieces.sparkSession
    todo = pieces.where(F.col("length") < capacity).select("length", "k", "piece", "start", "ids_crc32")
    whole = pieces.where(F.col("length") == capacity).select("length", "k", "piece", "start", "ids_crc32")
    done = [whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    total, rounds = todo.count(), 1
    while total:
        n = max(1, -(-total // group))
        # By row, not by value: rows that repeat each other spread over all groups.
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(rounds)), F.lit(n)).alias("grp")
        rows = todo.select(deal, F.struct("length", "k", "piece", "start", "ids_crc32").alias("item"))
        sets = save(rows.groupBy("grp").agg(F.sort_array(F.collect_list("item")).alias("items")), "groups")
        best = None
        for epoch in range(epochs):
            start = sets.select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "items")
            if best is None:
                none = F.lit(None).cast("binary")
                start = start.select("grp", "island", "items", none.alias("own"), none.alias("elite"))
            else:
                own = best.select("grp", "island", F.col("bins").alias("own"))
                elite = best.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("elite"))
                start = start.join(own, ["grp", "island"]).join(elite, ["grp", "island"]).select("grp", "island", "items", "own", "elite")
            start = start.repartition(F.col("grp"), F.col("island"))
            before, best = best, save(start.mapInArrow(_evolve(capacity, epoch, POPULATION, CHILDREN), "grp long, island int, used long, squares double, bins binary"), "islands")
            if before is not None:
                drop(before)
        top = best.groupBy("grp").agg(F.max(F.struct("used", "squares", "island", "bins")).alias("top"))
        placed = sets.join(top, "grp").select("grp", "items", "top.bins").mapInArrow(
            _place(capacity, rounds, n == 1), "length long, k long, piece int, start long, ids_crc32 long, sequence_id long, offset long, again boolean"
        )
        placed = save(placed, "placed")
        drop(sets, best)
        done.append(placed.where("not again").drop("again"))
        todo = placed.where("again").select("length", "k", "piece", "start", "ids_crc32")
        total, rounds = (todo.count() if n > 1 else 0), rounds + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ship(spark)
    return out


def pieces(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``(k, piece, start, length, ids_crc32)``: the ids of each text and ``end``, cut
    every ``capacity`` ids."""
    ship(docs.sparkSession)
    step = 4 * capacity

    def run(batches):
        tok = made(Library, vocabulary)
        for batch in batches:
            for b in slices(batch):
                rows = []
                ids, at = tok.encode(b.column(1))
                raw = np.insert(ids, at[1:], end).astype("<u4").tobytes()
                at = 4 * (at + np.arange(len(at)))
                for k, lo, hi in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                    for i, x in enumerate(range(lo, hi, step)):
                        y = min(x + step, hi)
                        rows.append((k, i, (x - lo) // 4, (y - x) // 4, zlib.crc32(raw[x:y])))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["k", "piece", "start", "length", "ids_crc32"])

    return keyed(docs).mapInArrow(run, "k long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only documents of more than ``capacity`` ids are cut; no sequence is longer, and its
    pieces follow each other without a gap from 0. Null and empty texts are one piece, the
    end id alone. Rows that repeat a ``doc_id`` are packed each for itself.
    """
    cut = save(pieces(docs, vocabulary, end, capacity), "pieces")
    return pack(cut, capacity).select(doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
