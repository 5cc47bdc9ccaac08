"""Point and range reads, each at its place in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlog.plans.log import KEY_MAX, KEY_MIN, SLICE, seen, versions

#: Keys in one bucket of a range join; each wider kind of bucket has this many of the last.
WIDTH, STEP = 64, 16


def get(snapshot: DataFrame, key: int) -> DataFrame:
    return snapshot.where(F.col("k") == key)


def scan(snapshot: DataFrame, a: int, b: int) -> DataFrame:
    """Keys in [a, b); bounds the wrong way round are swapped."""
    lo, hi = min(a, b), max(a, b)
    return snapshot.where((F.col("k") >= lo) & (F.col("k") < hi))


def gets_as_of(log: DataFrame, size: int = SLICE) -> DataFrame:
    """``(seq, k, v)`` for each get: the value visible there, null if none. A hot key is
    ordered slice by slice, and no get meets more than the one version it sees."""
    return seen(log, size).where("op = 'g'").select("seq", "k", F.when(F.col("before.op") == "p", F.col("before.v")).alias("v"))


def gets_by_window(log: DataFrame) -> DataFrame:
    """The same by one ordered pass over each key: less to do, where no key is hot."""
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("p", "d"), F.struct("op", "v")), ignorenulls=True).over(w)
    out = log.withColumn("last", last).where("op = 'g'")
    return out.select("seq", "k", F.when(F.col("last.op") == "p", F.col("last.v")).alias("v"))


def bounded(ranges: DataFrame) -> DataFrame:
    """``(seq, lo, hi)``: swapped where needed, empty and out-of-domain ranges left out."""
    r = ranges.select("seq", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return r.where((F.col("lo") < F.col("hi")) & (F.col("lo") >= KEY_MIN) & (F.col("hi").cast("long") <= KEY_MAX + 1))


def ranges_as_of(log: DataFrame, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(seq, lo, hi, k, v)``: the pairs each range sees, one null row where none.

    Ranges are cut into buckets and meet versions by bucket, so the join is an equi-join
    whatever the number of ranges. A range takes buckets of the least width that cuts it into
    ``STEP + 1`` at most, and versions go to buckets of the widths that some range takes."""
    r = bounded(ranges)
    size = F.col("hi").cast("long") - F.col("lo")
    widths = [width * STEP**i for i in range(10) if width * STEP**i < 2**33]
    wide = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        wide = F.when(size <= w * STEP, w).otherwise(wide)
    r = r.withColumn("w", wide.cast("long"))
    spread = r.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / F.col("w")), F.floor((F.col("hi").cast("long") - 1) / F.col("w")))))
    taken = r.agg(F.collect_set("w").alias("ws"))  # one row of ten numbers at most
    found = versions(log).where("op = 'p'").select(F.col("seq").alias("vs"), "k", "v", "seq_to")
    found = found.withColumn("ws", taken.scalar()).withColumn("w", F.explode("ws")).withColumn("b", F.floor(F.col("k") / F.col("w"))).drop("ws")
    r = r.drop("w")
    hit = spread.join(found, ["w", "b"]).where("k >= lo and k < hi and vs < seq and seq <= seq_to").select("seq", "k", "v")
    return r.join(hit, "seq", "left").select("seq", "lo", "hi", "k", "v")


def formatted(found: DataFrame) -> DataFrame:
    """A range's answer as text: ``k:v`` by ascending key."""
    pair = F.when(F.col("k").isNotNull(), F.struct("k", "v"))
    lists = found.groupBy("seq").agg(F.array_sort(F.collect_list(pair)).alias("x"))
    return lists.select("seq", F.concat_ws(" ", F.transform("x", lambda p: F.concat_ws(":", p.k, p.v))).alias("answer"))


def outcomes(log: DataFrame) -> DataFrame:
    """Gets with what a server and a replay call them: a deleted key is a server's hit."""
    return seen(log).where("op = 'g'").select("seq", "k", F.col("before").isNotNull().alias("hit"), _live().alias("found"))


def _live():
    return F.coalesce(F.col("before.op"), F.lit("d")) == "p"


def deletes(log: DataFrame) -> DataFrame:
    """Deletes and whether a live version was there to delete."""
    return seen(log.where("op in ('p', 'd')")).where("op = 'd'").select("seq", "k", _live().alias("succeeded"))


def counters(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """The evaluator's counters, a row each, from one pass over the gets, puts and deletes."""
    op = F.col("op")
    named = {
        "PUTS": F.count_if(op == "p"),
        "SUCC_GETS": F.count_if((op == "g") & _live()),
        "FAILED_GETS": F.count_if((op == "g") & ~_live()),
        "SUCC_DELS": F.count_if((op == "d") & _live()),
        "FAILED_DELS": F.count_if((op == "d") & ~_live()),
    }
    one = seen(log).agg(*[x.alias(n) for n, x in named.items()])
    rest = ranges.agg(F.count("*").alias("RANGES")).crossJoin(log.agg(F.count_if(op == "l").alias("LOADS")))
    one = one.crossJoin(rest)  # a row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in one.columns])).alias("x")).select("x.*")
