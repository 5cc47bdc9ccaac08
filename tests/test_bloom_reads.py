"""Filters as packed words: the same answers as bit by bit, at every block size."""

import pytest
from kvlog import queries
from kvlog.operators import bloom as B
from kvlog.plans import runs as R
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _bit_by_bit(spark):
    rows, cat = queries._runs(spark, SF)
    keys = queries._t(spark, SF, "customer").select(F.col("c_custkey").cast("int").alias("k"))
    sizes = B.sizing(cat, 0.1)
    at = B.positions(F.col("k"), F.col("bf_bits"), F.col("bf_hashes"))
    bits = lambda x: x.join(sizes, "run_id").select("run_id", "k", at.alias("at")).collect()
    table = {(r.run_id, b) for r in bits(rows) for b in r["at"]}
    asked = bits(R.opened(cat, keys).select("run_id", "k").distinct())
    yes = {(r.run_id, r.k) for r in asked if all((r.run_id, b) in table for b in r["at"])}
    return {(r.run_id, r.k) for r in asked}, yes, {(r.run_id, r.k) for r in rows.collect()}


def test_measured_rate_without_a_row_a_bit(spark):
    asked, yes, real = _bit_by_bit(spark)
    got = queries.bloom_measured_rate(spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Before, reads were exploded into a row for each hash and met the table of bits.
    assert "need" not in plan
    for r in got.collect():
        mine = {x for x in asked if x[0] == r.run_id}
        want = len(mine & yes & real), len((mine & yes) - real), len(mine - yes - real), len((mine & real) - yes)
        assert (r.tp, r.fp, r.tn, r.fn) == want
        assert r.fpr == (want[1] / (want[1] + want[2]) if want[1] + want[2] else None)


@pytest.mark.parametrize("size", [64, 192, 1 << 16])
def test_blocks_of_filters(spark, size):
    rows = spark.range(900).select((F.col("id") % 3).alias("run_id"), (F.col("id") * 2).cast("int").alias("k"))
    sizes = B.sizing(spark.createDataFrame([(1, 0, 300), (1, 1, 40), (1, 2, 300), (2, 9, 5)], "level int, run_id long, cap_entries long"), 0.02)
    asked = spark.range(4000).select(F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 1, 2, 9)])).alias("run_id"), F.col("id").cast("int").alias("k"))
    table = B.bit_table(rows, sizes)
    at = B.positions(F.col("k"), F.col("bf_bits"), F.col("bf_hashes"))
    have = {tuple(r) for r in table.collect()}
    want = {(r.run_id, r.k) for r in asked.join(sizes, "run_id").select("run_id", "k", at.alias("at")).collect() if all((r.run_id, b) in have for b in r["at"])}
    got = [tuple(r) for r in B.probe(asked.union(asked), sizes, table, size).collect()]
    assert len(got) == len(want) and set(got) == want and {r for r, _ in got} == {0, 1, 2}


def test_membership_reads_each_key_once(spark):
    _, yes, _ = _bit_by_bit(spark)
    got = queries.bloom_membership(spark, SF)
    # Before, each read was a row for each of its bits: Generate of the bits, then a count.
    assert "need" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(yes) and set(found) == yes
    assert B.most_hashes(0.1) >= 3 and all(r.bf_hashes <= B.most_hashes(e) for e in (0.5, 0.1, 0.01, 1e-6) for r in B.sizing(spark.range(1, 300).selectExpr("1 level", "id run_id", "id cap_entries"), e).collect())


def test_runs_are_read_side_by_side(spark):
    # Runs 0-69 over all keys, 70-79 narrow and far apart (some below 0), 200 and -3 alone,
    # 201 without any entry that has a key; filters of two sizes and one of none.
    far = [(r, (-1) ** r * (r - 69) * 100_000 + i) for r in range(70, 80) for i in range(9)]
    data = [(r, (r * 37 + i * 211) % 5000) for r in range(70) for i in range(40)] + far + [(200, 7), (-3, 7), (-3, 4000), (201, None)]
    rows = spark.createDataFrame(data, "run_id long, k int").distinct()
    runs = rows.groupBy("run_id").agg(F.min("k").alias("min_k"), F.max("k").alias("max_k"))
    sizes = B.sizing(runs.select(F.lit(1).alias("level"), "run_id", F.when(F.col("run_id") % 5 == 0, 20).otherwise(45).cast("long").alias("cap_entries")), 0.1)
    sizes = sizes.withColumn("bf_bits", F.when(F.col("run_id") == 9, 0).otherwise(F.col("bf_bits")))
    keys = spark.createDataFrame([(k,) for k in [None, *range(-20, 5100, 3), *{k for _, k in far}]], "k int").distinct()
    x, y = B.key_hashes(F.col("k"))
    wide = B.together(runs, sizes, rows, 1 << 10, 4)
    got = [tuple(r) for r in B.let_through(R.opened(wide, keys.select("k", x.alias("x"), y.alias("y")), step=4, deal=3), 4).collect()]
    of = sizes.where("bf_bits > 0").select("run_id", "bf_bits", "bf_hashes")
    at = B.positions(F.col("k"), F.col("bf_bits"), F.col("bf_hashes")).alias("at")
    have = {(r.run_id, b) for r in rows.join(of, "run_id").select("run_id", at).collect() for b in r["at"]}
    asked = keys.crossJoin(runs).where("k between min_k and max_k").join(of, "run_id").select("run_id", "k", at).collect()
    want = {(r.run_id, r.k) for r in asked if all((r.run_id, b) in have for b in r["at"])}
    assert len(got) == len(want) and set(got) == want and {200, -3, 79} <= {r for r, _ in got} and len(want) < len(asked)
    # Before, each pair of a run and a key was a row: here they are read in a few rows a key.
    assert wide.count() < 30
    with pytest.raises(Exception, match="larger than its row"):
        B.together(runs, sizes, rows, 1 << 6, 4).collect()


def test_membership_deals_its_work(spark):
    # Before, the runs' few bytes made Spark put all pairs in one task.
    plan = queries.bloom_membership(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "words" in plan
