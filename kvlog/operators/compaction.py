"""Merging of runs under four policies. A plan is which runs merge; the merge itself is
one newest-per-key aggregate, and a delete goes only where nothing older than it remains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("TIERED", "LEVELED", "LAZY_LEVELED", "PARTIAL")


def merge(rows: DataFrame, oldest: int | None) -> DataFrame:
    """The newest of each key. ``oldest``: the least ``seq`` outside the merge, None if there
    is nothing; a delete before it has nothing left to hide."""
    best = rows.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("x")).select("k", "x.seq", "x.op", "x.v")
    return best.where("op = 'p'") if oldest is None else best.where((F.col("op") == "p") | (F.col("seq") > oldest))


def plan(policy: str, runs: list[dict], level: int, segment: tuple[int, int] | None = None) -> list[int]:
    """Ids of the runs that become one run of ``level + 1`` when ``level`` is full.

    ``runs`` is the catalog (a row a run). Tiered: the level's runs; leveled: those and
    the next level's; lazy leveled: leveled only into the last level; partial: the
    ``segment`` (start, stop) of the level, which becomes one run of the next."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}; one of {', '.join(POLICIES)}")
    own = sorted((r for r in runs if r["level"] == level), key=lambda r: r["ord"])
    below = [r for r in runs if r["level"] == level + 1]
    deepest = max([r["level"] for r in runs], default=level)
    if policy == "PARTIAL" and segment is not None:
        own = own[segment[0] : segment[1]]
    with_next = policy == "LEVELED" or policy == "LAZY_LEVELED" and level + 1 >= deepest
    return [r["run_id"] for r in own + (below if with_next else [])]


def oldest_outside(runs: list[dict], merged: list[int]) -> int | None:
    """The least ``seq`` in runs that don't take part, None without any."""
    inside = set(merged)
    return min((r["min_seq"] for r in runs if r["run_id"] not in inside), default=None)


def compact(rows: DataFrame, runs: list[dict], policy: str, level: int, segment=None) -> tuple[DataFrame, list[dict]]:
    """New entries and catalog after one compaction of ``level``."""
    ids = plan(policy, runs, level, segment)
    if not ids:
        return rows, runs
    part = merge(rows.where(F.col("run_id").isin(ids)), oldest_outside(runs, ids)).withColumn("run_id", F.lit(max(ids)))
    kept = rows.where(~F.col("run_id").isin(ids))
    stats = part.agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"), F.min("seq").alias("c"), F.max("seq").alias("d")).first()
    catalog = [dict(r) for r in runs if r["run_id"] not in ids]
    # The level's other runs close up; the new run comes before those of the next level.
    for at in (level, level + 1):
        first = 1 if at > level and stats.n else 0
        for i, r in enumerate(sorted((r for r in catalog if r["level"] == at), key=lambda r: r["ord"])):
            r["ord"] = i + first
    if stats.n:
        cap = sum(r["cap_entries"] for r in runs if r["run_id"] in ids)
        catalog.append({"run_id": max(ids), "level": level + 1, "ord": 0, "n_entries": stats.n, "cap_entries": cap, "min_k": stats.a, "max_k": stats.b, "min_seq": stats.c, "max_seq": stats.d})
    return kept.unionByName(part.select(*kept.columns)), catalog


def flush_points(keys, capacity: int):
    """Numbers of the buffer each put in order goes to: a buffer closes when a key that
    it does not have arrives while it holds ``capacity``. Sequential by nature: for one
    ordered batch, not for a whole log."""
    seen: set = set()
    epoch, out = 0, []
    for k in keys:
        if k not in seen and len(seen) >= capacity:
            epoch, seen = epoch + 1, set()
        seen.add(k)
        out.append(epoch)
    return out
