"""A live snapshot: the newest mutation of each key, kept as commands arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.functions.text import command


def live_commands(lines: DataFrame) -> DataFrame:
    """Mutations of a streaming source ``(seq, value)`` of command lines."""
    c = lines.withColumn("c", command(F.col("value"))).where("c.op in ('p', 'd')")
    return c.select("seq", "c.op", F.col("c.a").alias("k"), F.col("c.b").alias("v"))


def live_snapshot(log: DataFrame) -> DataFrame:
    """State is one row a key; late arrivals lose to a greater ``seq``."""
    best = log.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("x"))
    return best.select("k", "x.seq", "x.op", "x.v")


def run_available(log: DataFrame, path: str) -> DataFrame:
    """Run a streaming ``log (seq, op, k, v)`` over all that has arrived and return its
    live snapshot. Each batch replaces a table of its own number below ``path``, so a
    repeated batch does no harm; the last one is the result. Nothing arrived: no rows."""
    spark: SparkSession = log.sparkSession
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        last.append(number)

    live = live_snapshot(log)
    stream = live.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    if not last:
        return spark.createDataFrame([], live.schema)
    return spark.read.schema(live.schema).parquet(f"{path}/batch-{max(last)}")
