"""Levels of runs as flushes fill them, under four policies.

A level holds ``fanout ** level`` buffers. A flush goes to level 1; where that is full, runs
move down first, level by level, and moved runs merge. A run is counted by the buffers that
went into it, whatever merging left of them. ``Tree`` only decides; ``final_runs`` carries
out what it decided for any number of flushes in one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.operators.compaction import POLICIES


@dataclass
class Run:
    """``spans``: (first, last) flush of each stretch of flushes in it, newest first."""

    buffers: int
    min_k: int | None = None
    max_k: int | None = None
    spans: list[tuple[int, int]] = field(default_factory=list)

    @property
    def run_id(self) -> int:
        """Its newest flush."""
        return max(b for _, b in self.spans)


def joined(runs: list[Run]) -> Run:
    spans: list[tuple[int, int]] = []
    for a, b in sorted((s for r in runs for s in r.spans), reverse=True):
        if spans and spans[-1][0] == b + 1:
            spans[-1] = (a, spans[-1][1])
        else:
            spans.append((a, b))
    low = [r.min_k for r in runs if r.min_k is not None]
    high = [r.max_k for r in runs if r.max_k is not None]
    return Run(sum(r.buffers for r in runs), min(low, default=None), max(high, default=None), spans)


class Tree:
    """``levels[i]`` are the runs of level i + 1, newest first; ``merges`` counts by level."""

    def __init__(self, policy: str = "TIERED", fanout: int = 10, share: float = 0.5):
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy}; one of {', '.join(POLICIES)}")
        self.policy, self.fanout, self.share = policy, fanout, share
        self.levels: list[list[Run]] = [[]]
        self.flushes = 0
        self.merges: dict[int, int] = {}

    def used(self, level: int) -> int:
        return sum(r.buffers for r in self.levels[level - 1])

    def capacity(self, level: int) -> int:
        """In buffers."""
        return self.fanout**level

    def fits(self, level: int) -> bool:
        """Whether what fills the level above (a buffer above level 1) still goes in."""
        return self.used(level) + self.capacity(level - 1) <= self.capacity(level)

    def last(self, level: int) -> bool:
        return level == len(self.levels)

    def leveled(self, level: int) -> bool:
        """Whether all runs of the level are kept as one."""
        return self.policy == "LEVELED" or self.policy == "LAZY_LEVELED" and self.last(level)

    def flush(self, number: int, min_k: int | None = None, max_k: int | None = None) -> None:
        """Take in flush ``number``, later than all before it."""
        if not self.fits(1):
            self.move(1)
        new, top = Run(1, min_k, max_k, [(number, number)]), self.levels[0]
        if top and self.leveled(1):
            self._count(1)
            new, top = joined([new, *top]), []
        self.levels[0] = [new, *top]
        self.flushes += 1

    def _count(self, level: int) -> None:
        self.merges[level] = self.merges.get(level, 0) + 1

    def move(self, level: int) -> None:
        """Runs move to the next level until the level has room."""
        while not self.fits(level):
            if self.last(level):
                self.levels.append([])
            elif not self.fits(level + 1):
                self.move(level + 1)
            own, below = self.levels[level - 1], self.levels[level]
            start, stop = self.segment(own) if self.policy == "PARTIAL" else (0, len(own))
            moved, self.levels[level - 1] = own[start:stop], own[:start] + own[stop:]
            if self.leveled(level + 1):
                moved, below = moved + below, []
            if len(moved) > 1:
                self._count(level + 1)
            self.levels[level] = [joined(moved), *below]

    def segment(self, runs: list[Run]) -> tuple[int, int]:
        """The ``max(2, share of them)`` neighbours with the least key gaps between them,
        the newest of equal ones."""
        m = min(len(runs), max(2, round(self.share * len(runs) + 1e-9)))
        gap = [abs(b.min_k - a.max_k) if None not in (b.min_k, a.max_k) else 0 for a, b in zip(runs, runs[1:])]
        return min(((sum(gap[i : i + m - 1]), i, i + m) for i in range(len(runs) - m + 1)))[1:]

    def rows(self) -> list[tuple]:
        """(first flush, last flush, run_id, level, ord, buffers) of each span."""
        return [(a, b, r.run_id, i + 1, j, r.buffers) for i, level in enumerate(self.levels) for j, r in enumerate(level) for a, b in r.spans]


def grown(rows: DataFrame, policy: str, fanout: int, share: float = 0.5) -> Tree:
    """The tree after the flushes of ``rows (run_id, k, ...)``, epochs as ``entries`` makes
    them. Only PARTIAL looks at keys: two numbers a flush come to the driver for it, else
    the number of flushes."""
    tree = Tree(policy, fanout, share)
    if policy == "PARTIAL":
        for r in rows.groupBy("run_id").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("run_id").toLocalIterator():
            tree.flush(r.run_id, r.a, r.b)
    else:
        first, last = rows.agg(F.min("run_id"), F.max("run_id")).first()
        for number in range(first, last + 1) if first is not None else ():
            tree.flush(number)
    return tree


_SPANS = "a long, b long, run_id long, level int, ord long, buffers long"


def final_runs(rows: DataFrame, tree: Tree) -> DataFrame:
    """``(run_id, level, ord, buffers, k, seq, op, v)``: what each run of the tree holds, as
    if every merge had been carried out. Deletes stay unless nothing is older.

    Runs of the tree are few (a level's fanout for each level) but for PARTIAL, whose spans
    are counted before they are broadcast."""
    spark, spans = rows.sparkSession, tree.rows()
    at = spark.createDataFrame(spans, _SPANS)
    flush = rows.withColumnRenamed("run_id", "flush")
    if len(spans) <= 10_000:
        tagged = flush.join(F.broadcast(at), F.col("flush").between(F.col("a"), F.col("b")))
    else:
        tagged = flush.join(at.withColumn("flush", F.explode(F.sequence("a", "b"))), "flush")
    best = tagged.groupBy("run_id", "level", "ord", "buffers", "k").agg(F.max(F.struct("seq", "op", "v")).alias("x"))
    best = best.select("run_id", "level", "ord", "buffers", "k", "x.seq", "x.op", "x.v")
    # A merged run that is one stretch from the first flush on has nothing older outside it.
    bottom = min(spans, default=None)
    if bottom is None or bottom[1] == bottom[0] or sum(s[2] == bottom[2] for s in spans) > 1:
        return best
    return best.where((F.col("op") == "p") | (F.col("run_id") != bottom[2]))


def catalog(final: DataFrame, buffer: int) -> DataFrame:
    """A row for each run that holds something."""
    by = final.groupBy("run_id", "level", "ord", "buffers").agg(F.count("*").alias("n_entries"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
    return by.withColumn("cap_entries", F.col("buffers") * buffer).drop("buffers")
