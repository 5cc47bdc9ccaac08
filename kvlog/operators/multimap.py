"""A multimap ``(k, v)``: every pair is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def get(pairs: DataFrame, n: int) -> DataFrame:
    """By key: how many values, and the ``n`` least, in order.

    Equal pairs are counted first, task by task; then a key's values are ranked once each, and
    of every value no more than ``n`` are listed. So a hot key costs its distinct values."""
    each = pairs.groupBy("k", "v").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("v"))
    few = F.when(F.col("r") <= n, F.struct("v", F.least("c", F.lit(n)).cast("int").alias("c")))
    by = each.withColumn("r", rank).groupBy("k").agg(F.sum("c").alias("found"), F.collect_list(few).alias("x"))
    vs = F.flatten(F.transform(F.array_sort("x"), lambda x: F.array_repeat(x.v, x.c)))
    return by.select("k", "found", F.slice(vs, 1, n).alias("vs"))


def erase(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    return pairs.join(keys.select("k").distinct(), "k", "left_anti")


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def size_for(count: int, load: float = 1.0, start: int = 11) -> int:
    """Buckets after growing to the next prime past double whenever the load is reached."""
    size = next_prime(start)
    while count >= size * load:
        size = next_prime(2 * size)
    return size


def buckets(pairs: DataFrame, size: int) -> DataFrame:
    return pairs.groupBy(F.pmod("k", F.lit(size)).alias("bucket")).agg(F.count("*").alias("pairs"))
