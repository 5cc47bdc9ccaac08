"""Run catalog: flush epochs, levels, fences, and the physical plans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the storage model: pairs on a page, penalty by level (5 and deeper alike).
FENCE = 4096
DISKS = [(1, "SSD", 1), (2, "HDD1", 5), (3, "HDD2", 15), (4, "HDD3", 45), (5, "HDD4", 135)]


def entries(log: DataFrame, size: int) -> DataFrame:
    """What each flush epoch of ``size`` sequence numbers leaves: the newest mutation of
    every key in it."""
    run = F.floor(F.col("seq") / size).cast("long")
    best = log.where("op in ('p', 'd')").groupBy(run.alias("run_id"), "k").agg(F.max(F.struct("seq", "op", "v")).alias("x"))
    return best.select("run_id", "k", "x.seq", "x.op", "x.v")


def catalog(rows: DataFrame, capacity: int) -> DataFrame:
    """A row for each epoch as a run of its own, before any merge; level L holds 2**L of
    them, the newest in level 1. ``ord`` counts epochs of a level from the newest. What the
    policies make of the epochs is in ``tree``."""
    runs = rows.groupBy("run_id").agg(
        F.count("*").alias("n_entries"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )
    # The newest epoch is one row beside all; levels and places follow by arithmetic.
    age = F.col("_last") - F.col("run_id") + 2
    runs = runs.crossJoin(F.broadcast(rows.agg(F.max("run_id").alias("_last"))))
    runs = runs.withColumn("level", F.floor(F.log2(age)).cast("int"))
    place = age - F.pow(F.lit(2.0), F.col("level")).cast("long")
    return runs.withColumn("ord", place).withColumn("cap_entries", F.lit(capacity).cast("long")).drop("_last")


def capacity(level: Column, buffer: int, fanout: int) -> Column:
    return F.pow(F.lit(float(fanout)), level).cast("long") * buffer


def fill(runs: DataFrame, buffer: int, fanout: int) -> DataFrame:
    by = runs.groupBy("level").agg(F.count("*").alias("runs"), F.sum("n_entries").alias("pairs"), F.sum("cap_entries").alias("cap_pairs"))
    room = capacity(F.col("level"), buffer, fanout)
    return by.select("level", "runs", "pairs", "cap_pairs", room.alias("capacity"), F.round(100 * F.col("cap_pairs") / room, 4).alias("pct_full"))


def disks(spark) -> DataFrame:
    return spark.createDataFrame(DISKS, "disk_level int, disk string, multiplier int")


def with_disk(df: DataFrame) -> DataFrame:
    """Levels past the last take the last disk. Five fixed rows: broadcast."""
    d = disks(df.sparkSession)
    return df.join(F.broadcast(d), F.least(F.col("level"), F.lit(5)) == d.disk_level).drop("disk_level")


def fences(rows: DataFrame, every: int = FENCE) -> DataFrame:
    """First key of every ``every`` entries of a run."""
    w = Window.partitionBy("run_id").orderBy("k")
    pos = rows.select("run_id", "k", (F.row_number().over(w) - 1).alias("pos"))
    return pos.groupBy("run_id", F.floor(F.col("pos") / every).cast("long").alias("page")).agg(F.min("k").alias("fence"))


def first_entries(rows: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pairs of each level, newest run first, keys ascending (n = -1: all)."""
    w = Window.partitionBy("level").orderBy("ord", "k")
    out = rows.join(runs.select("run_id", "level", "ord"), "run_id").withColumn("pos", F.row_number().over(w))
    return (out if n < 0 else out.where(F.col("pos") <= n)).select("level", "pos", "run_id", "k", "op", "v")


def gaps(runs: DataFrame, share: float = 0.5) -> DataFrame:
    """For each level the segment of ``max(2, round(share * runs))`` adjacent runs (all,
    if fewer) whose key gaps sum to least; ties to the newest."""
    w = Window.partitionBy("level").orderBy("ord")
    g = runs.withColumn("gap", F.abs(F.lead("min_k").over(w).cast("long") - F.col("max_k").cast("long")))
    n = F.count("*").over(Window.partitionBy("level"))
    g = g.withColumn("m", F.least(n, F.greatest(F.lit(2), F.round(n * share))).cast("int"))
    ends = F.sum(F.coalesce("gap", F.lit(0))).over(w)
    g = g.withColumn("upto", F.coalesce(ends - F.coalesce("gap", F.lit(0)), F.lit(0))).withColumn("n", n)
    ahead = g.select(F.col("level").alias("l2"), F.col("ord").alias("last"), F.col("upto").alias("end_sum"))
    j = g.join(ahead, (F.col("level") == F.col("l2")) & (F.col("last") == F.col("ord") + F.col("m") - 1))
    best = j.groupBy("level").agg(F.min(F.struct((F.col("end_sum") - F.col("upto")).alias("gap_sum"), F.col("ord").alias("start"), F.col("m"))).alias("x"))
    return best.select("level", "x.start", (F.col("x.start") + F.col("x.m")).alias("stop"), "x.gap_sum")


def opened(runs: DataFrame, keys: DataFrame, width: int = 64, step: int = 16, deal: int = 1) -> DataFrame:
    """``keys (k, ...)`` with each run that a point read of the key opens, when runs are pruned
    by their key range. A run takes buckets of the least width that cuts its range into
    ``step + 1`` at most; keys go to buckets of the widths taken, so it is an equi-join.
    With ``deal`` the runs of a bucket are dealt to so many, each with all its keys, and
    tasks are as many as partitions, however few bytes the runs have."""
    size = F.col("max_k").cast("long") - F.col("min_k") + 1
    widths = [width * step**i for i in range(33) if width * step**i < 2**33]
    wide = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        wide = F.when(size <= w * step, w).otherwise(wide)
    runs = runs.withColumn("_w", wide.cast("long"))
    spread = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("min_k") / F.col("_w")), F.floor(F.col("max_k") / F.col("_w")))))
    taken = runs.agg(F.collect_set("_w").alias("_ws"))  # one row of ten numbers at most
    asked = keys.crossJoin(F.broadcast(taken)).withColumn("_w", F.explode("_ws")).withColumn("_b", F.floor(F.col("k") / F.col("_w"))).drop("_ws")
    on = ["_w", "_b"]
    if deal > 1:
        on, parts = [*on, "_d"], int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = spread.withColumn("_d", F.pmod(F.xxhash64("run_id"), F.lit(deal)).cast("int")).repartition(parts, *on)
        asked = asked.withColumn("_d", F.explode(F.array(*map(F.lit, range(deal))))).repartition(parts, *on)
    return asked.join(spread, on).where("k between min_k and max_k").drop(*on)


def touched(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """How many runs all point reads open, by level."""
    return opened(runs, keys).groupBy("level").agg(F.count("*").alias("io"))
