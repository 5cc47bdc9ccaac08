"""Bursts of puts in files of their own, written and read without listing a folder."""

import os
import struct

from kvlog import queries
from kvlog.sources import files
from pyspark.sql import functions as F


def test_bursts_go_on_through_batches(spark, tmp_path):
    ops = "pppppppppgppdpppppppppppppppppppppppppppppppg" + "pg" * 40
    rows = [(i, o, i - 5, None if o in "gd" else -i) for i, o in enumerate(ops)]
    log = spark.createDataFrame(rows, "seq long, op string, k int, v int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        lines = files.parse(files.write_external(log, str(tmp_path / "x"))).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, at = [], 0
    for run in ops.replace("g", " g ").replace("d", " d ").split():
        want.append((at, "l" if run[0] == "p" else run[0], [struct.pack("<2i", i - 5, -i) for i in range(at, at + len(run))]))
        at += len(run)
    assert [(r.seq, r.op) for r in lines] == [x[:2] for x in want]
    for r, (_, op, pairs) in zip(lines, want):
        if op == "l":
            with open(r.path.removeprefix("file://"), "rb") as f:
                assert f.read() == b"".join(pairs)
    assert sum(x.endswith(".dat") for x in os.listdir(tmp_path / "x")) == sum(x[1] == "l" for x in want)


def test_listed_files_as_all_files(spark, tmp_path, monkeypatch):
    for i, n in enumerate((0, 1, 5, 300)):
        (tmp_path / f"{i}.dat").write_bytes(b"".join(struct.pack("<2i", j - 3, -2147483648 if j % 7 == 0 else j) for j in range(n)) + b"\1" * (i % 3))
    paths = spark.createDataFrame([(f"file://{tmp_path}/{i}.dat",) for i in range(4)], "path string")
    key = lambda df: sorted((r.path.rsplit("/", 1)[1], r.pos, r.op, r.k, r.v or 0) for r in df.collect())
    want = key(files.read_pairs(spark, f"{tmp_path}/*.dat"))
    assert key(files.read_listed(paths)) == want and len(want) == 306
    monkeypatch.setattr(files, "STRETCH", 20)  # records across stretches
    assert sum(len(b) for b in files._listed_pairs(paths.toArrow().to_batches())) == 306


def test_external_puts_list_no_folder(spark):
    got = queries.external_puts(spark, "/root/testdata/sf0.001")
    # Before, Spark listed every burst's file on the driver, 32 of them a task.
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    puts = queries.events_log(spark, "/root/testdata/sf0.001").where("op = 'p'").count()
    assert got.agg(F.sum("pairs")).first()[0] == puts
