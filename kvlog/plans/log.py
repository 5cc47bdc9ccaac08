"""The change log and what follows from it.

``log (seq, op, k, v)`` is append-only; ``op`` is ``p`` (put) or ``d`` (delete). A version
is visible to a reader at ``s`` iff ``seq < s <= seq_to``. ``seq`` alone decides recency.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Domain of keys and values; the least 32-bit integer marks a delete in binary files.
KEY_MIN, KEY_MAX, TOMBSTONE = -2147483647, 2147483647, -2147483648
FOREVER = 9223372036854775807
#: Sequence numbers in a slice. A key's rows are ordered slice by slice, so that one task
#: never orders more of a key than this many, and a row for each slice ties them together.
SLICE = 1 << 20


def mutations(log: DataFrame) -> DataFrame:
    return log.where(F.col("op").isin("p", "d"))


def sliced(log: DataFrame, size: int) -> DataFrame:
    return log.select("seq", "k", "op", "v", F.floor(F.col("seq") / size).alias("_s"))


def versions(log: DataFrame, size: int = SLICE) -> DataFrame:
    """All versions with the interval in which each is the newest: to the next one of its
    slice, else to the first of the key's next slice."""
    m = sliced(mutations(log), size)
    firsts = m.groupBy("k", "_s").agg(F.min("seq").alias("_first"))
    after = firsts.select("k", "_s", F.lead("_first").over(Window.partitionBy("k").orderBy("_s")).alias("_after"))
    own = F.lead("seq").over(Window.partitionBy("k", "_s").orderBy("seq"))
    m = m.withColumn("_next", own).join(after, ["k", "_s"])
    return m.select("seq", "k", "op", "v", F.coalesce("_next", "_after", F.lit(FOREVER)).alias("seq_to"))


def seen(log: DataFrame, size: int = SLICE) -> DataFrame:
    """``(seq, k, op, before)`` for every get, put and delete; ``before`` is the mutation
    (op, v) that it finds, null if there is none: the last one of its slice before it, else
    the newest of the key's earlier slices."""
    rows = sliced(log.where("op in ('p', 'd', 'g')"), size)
    change = F.col("op") != "g"
    own = F.last(F.when(change, F.struct("op", "v")), ignorenulls=True).over(Window.partitionBy("k", "_s").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    tops = rows.groupBy("k", "_s").agg(F.max(F.when(change, F.struct("seq", "op", "v"))).alias("_top"))
    carried = F.last("_top", ignorenulls=True).over(Window.partitionBy("k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("k", "_s", carried.alias("_carried"))
    out = rows.withColumn("_own", own).join(tops, ["k", "_s"])
    carried = F.when(F.col("_carried").isNotNull(), F.struct(F.col("_carried.op").alias("op"), F.col("_carried.v").alias("v")))
    return out.select("seq", "k", "op", F.coalesce("_own", carried).alias("before"))


def newest(log: DataFrame) -> DataFrame:
    """The newest mutation of each key, deletes included. Sums before the shuffle, so a
    hot key costs one row a task."""
    best = mutations(log).groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("x"))
    return best.select("k", "x.seq", "x.op", "x.v")


def snapshot(log: DataFrame) -> DataFrame:
    return newest(log).where("op = 'p'").select("k", "v")


def upsert(log: DataFrame, more: DataFrame) -> DataFrame:
    """Append ``more`` after the log, keeping its order."""
    top = log.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("base"))  # one row
    return log.unionByName(more.crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("base")).drop("base"))
