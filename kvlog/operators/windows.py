"""Count windows, bursts and differences. Whatever runs over all rows runs in two levels:
inside parts, and over one row a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a part.
PART = 100_000


def _parts(order: str, size: int = PART) -> Column:
    return F.floor(F.col(order) / size)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 1 as ``n`` in the order of the columns, the last of them a number.
    Parts are equal values of the first ones and stretches of the last."""
    *lead, last = order
    names = [f"_p{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(names, [*map(F.col, lead), _parts(last)])))
    n = ranged.groupBy(*names).agg(F.count("*").alias("_n"))
    base = n.select(*names, (F.sum("_n").over(Window.orderBy(*names)) - F.col("_n")).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*names).orderBy(last))
    return ranged.withColumn("_own", own).join(base, names).withColumn("n", F.col("_own") + F.col("_base")).drop("_own", "_base", *names)


def running(df: DataFrame, order: str, sums: dict[str, str], least: dict[str, str] | None = None, size: int = PART) -> DataFrame:
    """Add running sums and minima by ``order``: new names to the columns they run over."""
    least = least or {}
    x = df.withColumn("_part", _parts(order, size))
    tops = x.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.min(c).alias(f"_m_{n}") for n, c in least.items()])
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_s_{n}") for n in sums], *[F.min(f"_m_{n}").over(w).alias(f"_m_{n}") for n in least])
    own = Window.partitionBy("_part").orderBy(order)
    x = x.withColumns({f"_o_{n}": F.sum(c).over(own) for n, c in sums.items()} | {f"_o_{n}": F.min(c).over(own) for n, c in least.items()}).join(tops, "_part")
    new = {n: F.col(f"_o_{n}") + F.col(f"_s_{n}") for n in sums} | {n: F.least(f"_o_{n}", f"_m_{n}") for n in least}
    return x.select(*df.columns, *[v.alias(n) for n, v in new.items()])


def throughput(df: DataFrame, every: int) -> DataFrame:
    """By windows of ``every`` commands ``(seq, us)``: commands, microseconds, and running
    totals; with a column ``io`` also accesses and their running total."""
    io = ["io"] if "io" in df.columns else []
    w = numbered(df, "seq").withColumn("bucket", F.floor((F.col("n") - 1) / every).cast("long"))
    by = w.groupBy("bucket").agg(F.count("*").alias("commands"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), *[F.sum(c).alias(c) for c in io])
    by = running(by, "bucket", {"total_commands": "commands"} | {f"total_{c}": c for c in io}, {"start": "first_us"})
    by = by.withColumn("elapsed_us", F.col("last_us") - F.col("first_us")).withColumn("total_us", F.col("last_us") - F.col("start"))
    per = lambda n, us: F.when(us > 0, F.round(n / us * 1e6, 6))
    out = ["bucket", "commands", "elapsed_us", per(F.col("commands"), F.col("elapsed_us")).alias("cps"), "total_commands", "total_us", per(F.col("total_commands"), F.col("total_us")).alias("total_cps")]
    return by.select(*out, *io, *[f"total_{c}" for c in io])


def delta(df: DataFrame, by: str, order: str, col: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("delta", F.col(col) - F.lag(col).over(w))


def with_bursts(log: DataFrame) -> DataFrame:
    """Puts with ``burst``: how many other commands came before, equal in a run of puts."""
    others = log.withColumn("_other", F.when(F.col("op") != "p", 1).otherwise(0))
    return running(others, "seq", {"burst": "_other"}).where("op = 'p'").drop("_other")


def bursts(log: DataFrame) -> DataFrame:
    """Runs of consecutive puts: their bounds and sizes."""
    g = with_bursts(log).groupBy("burst")
    return g.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("puts")).drop("burst")
