"""Workloads by a seed: the same on any number of partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlog.plans.log import KEY_MAX, KEY_MIN


@dataclass(frozen=True)
class Workload:
    puts: int = 1000
    gets: int = 0
    ranges: int = 0
    deletes: int = 0
    misses: float = 0.5
    skew: float = 0.0
    gaussian: bool = False
    max_range: int | None = None
    seed: int = 13141


def _uniform(seed: int, *salt):
    return F.pmod(F.xxhash64(F.lit(seed), *[F.lit(s) if isinstance(s, (int, str)) else s for s in salt]), F.lit(2**53)) / float(2**53)


def generate(spark: SparkSession, w: Workload) -> DataFrame:
    """``(seq, op, k, v)``: exact counts in random order, a put first; ranges ``[k, v)``.

    Gets that hit, and deletes, take keys of earlier puts; with skew they favour few."""
    total = w.puts + w.gets + w.ranges + w.deletes
    i = F.col("id")
    op = F.when(i < w.puts, "p").when(i < w.puts + w.gets, "g").when(i < w.puts + w.gets + w.ranges, "r").otherwise("d")
    rows = spark.range(total).select("id", op.alias("op"), F.when(i == 0, F.lit(-1.0)).otherwise(_uniform(w.seed, "order", i)).alias("u"))
    # Numbered by ranges of u: a task for each, one count for each to put them in a row.
    rows = rows.withColumn("part", F.floor(F.greatest(F.col("u"), F.lit(0.0)) * max(1, total // 100_000)))
    base = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("op") == "p").alias("m"))
    order = Window.orderBy("part")
    base = base.select("part", (F.sum("n").over(order) - F.col("n")).alias("b"), (F.sum("m").over(order) - F.col("m")).alias("pb"))
    own = Window.partitionBy("part").orderBy("u", "id")
    rows = rows.withColumn("r", F.row_number().over(own)).withColumn("pr", F.sum(F.when(F.col("op") == "p", 1).otherwise(0)).over(own)).join(base, "part")
    rows = rows.select("id", "op", (F.col("r") + F.col("b") - 1).alias("seq"), (F.col("pr") + F.col("pb")).alias("puts"))

    def key(name: str):
        u, z = _uniform(w.seed, name, i), _uniform(w.seed, name + "2", i)
        if w.gaussian:
            g = F.sqrt(-2 * F.log(u + 1e-12)) * F.cos(2 * 3.141592653589793 * z) * (KEY_MAX / 3)
            return F.greatest(F.lit(KEY_MIN), F.least(F.lit(KEY_MAX), F.round(g).cast("long"))).cast("int")
        return (F.floor(u * (2.0 * KEY_MAX + 1)).cast("long") + KEY_MIN).cast("int")

    rows = rows.withColumn("own", key("key")).withColumn("val", key("val"))
    old = rows.where("op = 'p'").select(F.col("puts").alias("pick"), F.col("own").alias("old"))
    u = _uniform(w.seed, "pick", i)
    pick = F.greatest(F.lit(1), F.ceil(F.pow(u, 1.0 + 9.0 * w.skew) * F.col("puts"))).cast("long")
    wants = F.when(F.col("op") == "d", True).when(F.col("op") == "g", _uniform(w.seed, "miss", i) >= w.misses).otherwise(False)
    rows = rows.withColumn("pick", F.when(wants, pick)).join(old, "pick", "left")
    k = F.coalesce("old", "own")
    if w.max_range is None:
        lo, hi = F.least("own", "val"), F.greatest("own", "val")
    else:
        lo = F.col("own")
        hi = F.least(F.lit(KEY_MAX).cast("long"), F.col("own").cast("long") + 1 + F.floor(_uniform(w.seed, "size", i) * w.max_range)).cast("int")
    is_range = F.col("op") == "r"
    return rows.select("seq", "op", F.when(is_range, lo).otherwise(k).alias("k"), F.when(is_range, hi).when(F.col("op") == "p", F.col("val")).alias("v"))
