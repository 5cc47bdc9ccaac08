"""Change-log semantics: documented examples, random replays, compaction, plans."""

import random
import struct

import pytest
from kvlog.engine import CONSOLE_HELP, HELP, Engine, EngineConfig
from kvlog.functions import text as X
from kvlog.operators import bloom as B
from kvlog.operators import compaction as C
from kvlog.operators import multimap as M
from kvlog.operators import reads as Q
from kvlog.plans import log as L
from kvlog.plans import runs as R
from kvlog.plans import tree as T
from kvlog.sources import files
from kvlog.sources.workload import Workload, generate
from kvlog.streaming.live import live_commands, live_snapshot, run_available
from pyspark.sql import functions as F

LOG = "seq long, op string, k int, v int"


@pytest.mark.parametrize(
    "lines, answers",
    [
        (["p 10 7", "p 63 222", "p 10 5", "g 10"], ["", "", "", "5"]),
        (["p 10 7", "p 63 222", "g 10", "g 15", "p 15 5", "g 15"], ["", "", "7", "", "", "5"]),
        (["p 10 7", "p 13 2", "p 17 99", "p 12 22", "r 10 12", "r 10 15", "r 14 17", "r 0 100", "r 15 10"], [""] * 4 + ["10:7", "10:7 12:22 13:2", "", "10:7 12:22 13:2 17:99", "10:7 12:22 13:2"]),
        (["p 10 7", "p 12 5", "g 10", "d 10", "g 10", "g 12", "d 99"], ["", "", "7", "", "", "5", ""]),
        (["p x y", "p 1", "nonsense", "r 5 5", "p 1 -2147483648"], [HELP, HELP, HELP, "", "ERROR: value out of range"]),
    ],
)
def test_examples(spark, lines, answers):
    e = Engine(spark)
    assert [e.execute(x) for x in lines] == answers


def test_engine_state(spark, tmp_path):
    e = Engine(spark, EngineConfig(buffer_pairs=2))
    for x in ("p 1 1", "p 2 2", "d 1", "g 1", "g 7"):
        e.execute(x)
    assert e.pairs() == 1 and e.misses() == {"get_hits": 1, "get_misses": 1, "range_hits": 0, "range_misses": 0}
    assert e.execute("s").startswith("Logical Pairs: 1") and "level" in e.execute("i")
    assert abs(sum(b for _, b in e.monkey()) - sum(r.bf_bits for r in e.bloom().collect())) < 1e-6
    e.save(str(tmp_path))
    assert Engine.restore(spark, str(tmp_path)).execute("g 2") == "2"
    assert Engine.restore(spark, str(tmp_path / "none")).execute("g 2") == ""
    (tmp_path / "x.dat").write_bytes(struct.pack("<6i", 5, 6, 2, -2147483648, 7, 8) + b"\1\2")
    e.execute(f'l "{tmp_path / "x.dat"}"')
    assert [e.execute(x) for x in ("g 5", "g 2", "g 7")] == ["6", "", "8"]
    with pytest.raises(ValueError):
        EngineConfig(policy="NONE")


def _random_log(n, seed):
    rng = random.Random(seed)
    keys = [*range(-15, 15), 2147483647, -2147483647]
    return [(i, rng.choices("pdgr", (5, 2, 4, 2))[0], rng.choice(keys), rng.randrange(-50, 50)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_replay(spark, seed):
    rows = _random_log(600, seed)
    db, gets, ranges, dels = {}, {}, {}, {}
    for s, op, k, v in rows:
        if op == "p":
            db[k] = v
        elif op == "d":
            dels[s] = k in db
            db.pop(k, None)
        elif op == "g":
            gets[s] = db.get(k)
        else:
            lo, hi = min(k, v), max(k, v)
            if lo != hi:
                ranges[s] = {x: y for x, y in db.items() if lo <= x < hi}
    log = spark.createDataFrame([(s, o, k, None if o in "dg" else v) for s, o, k, v in rows], LOG)
    assert {r.k: r.v for r in L.snapshot(log).collect()} == db
    assert {r.seq: r.v for r in Q.gets_as_of(log).collect()} == gets
    assert {r.seq: r.v for r in Q.gets_by_window(log).collect()} == gets
    # A key whose rows lie in many slices.
    assert {r.seq: r.v for r in Q.gets_as_of(log, 7).collect()} == gets
    assert sorted(map(tuple, L.versions(log, 7).collect())) == sorted(map(tuple, L.versions(log).collect()))
    assert {r.seq: r.succeeded for r in Q.deletes(log).collect()} == dels
    asked = log.where("op = 'r'").select("seq", F.col("k").alias("a"), F.col("v").alias("b"))
    got = {s: {} for s in ranges}
    for r in Q.ranges_as_of(log, asked, 8).collect():
        if r.k is not None:
            got[r.seq][r.k] = r.v
    assert got == ranges
    # No policy changes what the log says, whichever level and segment is compacted.
    entries = R.entries(log, 30)
    runs = [r.asDict() for r in R.catalog(entries, 30).collect()]
    rng = random.Random(seed)
    for policy in C.POLICIES:
        for level in sorted({r["level"] for r in runs}):
            n = sum(r["level"] == level for r in runs)
            start = rng.randrange(n)
            after, catalog = C.compact(entries, runs, policy, level, (start, rng.randint(start + 1, n)))
            assert {r.k: r.v for r in L.snapshot(after).collect()} == db
            places = [(r["level"], r["ord"]) for r in catalog]
            assert len(catalog) <= len(runs) and len(set(places)) == len(places)


def test_a_delete_stays_while_something_older_lies_outside(spark):
    rows = spark.createDataFrame([(0, 1, 5, "p", 7), (1, 1, 15, "d", None), (1, 2, 16, "p", 3), (2, 3, 25, "p", 4)], "run_id long, k int, seq long, op string, v int")
    runs = [{"run_id": i, "level": lv, "ord": o, "n_entries": 1, "cap_entries": 10, "min_k": 1, "max_k": 9, "min_seq": 10 * i + 5, "max_seq": 10 * i + 9} for i, lv, o in ((2, 1, 0), (1, 1, 1), (0, 1, 2))]
    after, _ = C.compact(rows, runs, "PARTIAL", 1, (0, 2))
    assert {r.k: r.v for r in L.snapshot(after).collect()} == {2: 3, 3: 4} and after.where("op = 'd'").count() == 1
    after, catalog = C.compact(rows, runs, "PARTIAL", 1, (1, 3))
    assert {r.k: r.v for r in L.snapshot(after).collect()} == {2: 3, 3: 4} and after.where("op = 'd'").count() == 0
    assert sorted((r["level"], r["ord"]) for r in catalog) == [(1, 0), (2, 0)]


@pytest.mark.parametrize("policy", C.POLICIES)
@pytest.mark.parametrize("fanout", [2, 3])
def test_tree(policy, fanout):
    rng = random.Random(fanout)
    t = T.Tree(policy, fanout)
    for n in range(60):
        a = rng.randrange(100)
        t.flush(n, a, a + rng.randrange(50))
        spans = sorted(x[:2] for x in t.rows())
        assert [i for a, b in spans for i in range(a, b + 1)] == list(range(n + 1))
        for level in range(1, len(t.levels) + 1):
            assert t.used(level) <= t.capacity(level)
            if t.leveled(level):
                assert len(t.levels[level - 1]) <= 1
    assert sum(t.merges.values()) > 0 and len(t.levels) >= 3
    with pytest.raises(ValueError):
        T.Tree("NONE")


@pytest.mark.parametrize("policy", C.POLICIES)
def test_final_runs(spark, policy):
    rows = _random_log(400, 9)
    log = L.mutations(spark.createDataFrame([(s, o, k, v if o == "p" else None) for s, o, k, v in rows], LOG))
    entries = R.entries(log, 40)
    tree = T.grown(entries, policy, 2)
    final = T.final_runs(entries, tree)
    assert {r.k: r.v for r in L.snapshot(final).collect()} == {r.k: r.v for r in L.snapshot(log).collect()}
    assert {r.run_id for r in T.catalog(final, 40).collect()} <= {r.run_id for level in tree.levels for r in level}
    assert T.catalog(T.final_runs(entries.where("false"), T.Tree(policy, 2)), 40).count() == 0


@pytest.mark.parametrize("policy", C.POLICIES)
def test_engine_flushes_and_merges(spark, policy):
    e = Engine(spark, EngineConfig(buffer_pairs=4, fanout=2, policy=policy, report_every=10))
    rng, db = random.Random(5), {}
    for _ in range(34):
        k, v = rng.randrange(12), rng.randrange(100)
        if rng.random() < 0.3:
            e.delete(k)
            db.pop(k, None)
        else:
            e.put(k, v)
            db[k] = v
    assert {r.k: r.v for r in L.snapshot(e.log).collect()} == db and e.pairs() == len(db)
    assert len(e.buffer) <= 4 and e.files and all(r.cap_entries >= r.n_entries for r in e.runs().collect())
    assert [e.execute(f"g {k}") for k in range(12)] == [str(db.get(k, "")) for k in range(12)]
    assert e.execute("r 11 0") == " ".join(f"{k}:{db[k]}" for k in sorted(db) if k < 11)
    assert len(e.progress) == 4 and e.progress[0]["commands"] == 10 and sum(x[0] for x in e.io.values()) > 0


def test_engine_guards_and_loads(spark, tmp_path):
    e = Engine(spark)
    (tmp_path / "one.dat").write_bytes(struct.pack("<2i", 5, 900))
    e.load(str(tmp_path / "one.dat"))
    assert [e.execute(x) for x in ("p 5 1", "g 5")] == ["", "1"]
    assert [e.execute(x) for x in ("p 99999999999 1", "d -2147483648", "g 5")] == [HELP, HELP, "1"]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.dat").write_bytes(struct.pack("<4i", 1, 1, 2, 2))
    (tmp_path / "many" / "b.dat").write_bytes(struct.pack("<4i", 2, 3, 1, -2147483648))
    e.load(str(tmp_path / "many"))
    assert [e.execute(f"g {k}") for k in (1, 2, 5)] == ["", "3", "1"]
    e.save(f"file://{tmp_path}/state")
    back = Engine.restore(spark, f"file://{tmp_path}/state")
    assert [back.execute(f"g {k}") for k in (1, 2, 5)] == ["", "3", "1"] and back.seq == e.seq
    assert back.misses()["get_hits"] == e.misses()["get_hits"] + 3 and back.config == e.config
    back.execute("p 1 8")
    assert back.execute("g 1") == "8"


def test_engine_benchmark(spark, tmp_path):
    (tmp_path / "x.dat").write_bytes(struct.pack("<4i", 1, 50, 30, 60))
    lines = ["p 1 2", "g 1", f'l "{tmp_path / "x.dat"}"', "g 1", "r 0 100", "d 1", "g 1", "g 77", "r 0 5", "r 5 5", "junk", "p 3 4"]
    (tmp_path / "c.txt").write_text("\n".join(lines) + "\n")
    e = Engine(spark, EngineConfig(buffer_pairs=3))
    e.put(9, 9)
    assert e.execute(f"b {tmp_path / 'c.txt'}").split("\n") == ["2", "50", "1:50 9:9 30:60", "", "", "", ""]
    assert e.misses() == {"get_hits": 3, "get_misses": 1, "range_hits": 1, "range_misses": 1}
    assert [e.execute(f"g {k}") for k in (1, 3, 9, 30)] == ["", "4", "9", "60"]


def test_console(spark):
    e = Engine(spark, EngineConfig(buffer_pairs=2, fanout=2))
    for x in ("p 1 1", "p 2 2", "p 3 3", "p 4 4", "p 5 5", "g 1", "g 9"):
        e.execute(x)
    assert "bf_bits" in e.console("bloom") and "bits" in e.console("monkey") and "get_misses: 1" in e.console("misses")
    assert "penalised_us" in e.console("io") and e.console("help") == CONSOLE_HELP == e.console("what")
    rates = e.bloom_rates(spark.range(6).select(F.col("id").cast("int").alias("k"))).collect()
    assert len(rates) == 2 and all(r.fn == 0 for r in rates)
    assert {"pairs: 5", "buffer_pairs: 1", "runs: 2"} <= set(e.execute("i").split("\n"))
    e.console("qs")
    assert not e.open and Engine.restore(spark, f"{e.path}/saved").execute("g 4") == "4"


def test_lines_in_order_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("p 1 1\n")
    (tmp_path / "b.txt").write_text("".join(f"p 1 {i}\n" for i in range(2, 3000)))
    (tmp_path / "c.txt").write_text("d 1\ng 1\n")
    rows = files.read_commands(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows))) and [r.b for r in rows[:2999]] == list(range(1, 3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a file in many stretches
    cut = files.read_commands(spark, str(tmp_path))
    assert cut.rdd.getNumPartitions() > 3 and cut.orderBy("seq").collect() == rows
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    turns = files.read_clients(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.raw for r in turns[:5]] == ["p 1 1", "p 1 2", "d 1", "p 1 3", "g 1"]


def test_large_binary_files(spark, tmp_path, monkeypatch):
    pairs = [(i - 50, -i if i % 7 else -2147483648) for i in range(100)]
    (tmp_path / "x.dat").write_bytes(b"".join(struct.pack("<2i", *p) for p in pairs))
    small = files.read_pairs(spark, str(tmp_path / "x.dat")).orderBy("pos").drop("path").collect()
    monkeypatch.setattr(files, "LARGE", 100)
    assert files.read_pairs(spark, str(tmp_path / "x.dat")).orderBy("pos").drop("path").collect() == small
    assert [(r.k, r.v) for r in small] == [(k, v if v != -2147483648 else None) for k, v in pairs]


def test_ranges_have_no_nested_loop(spark):
    log = spark.createDataFrame(_random_log(50, 3), LOG)
    asked = log.where("op = 'r'").select("seq", F.col("k").alias("a"), F.col("v").alias("b"))
    plan = Q.ranges_as_of(log, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert L.snapshot(log).count() == 0 and Q.gets_as_of(log).count() == 0 and R.catalog(R.entries(log, 5), 5).count() == 0


def test_flush_points():
    assert C.flush_points([1, 2, 1, 3, 3, 4, 1], 2) == [0, 0, 0, 1, 1, 1, 2]


def test_memory_division():
    n = [1000, 1000, 8000, 9000, 60000]
    for per_key in (2, 5, 10):
        total = per_key * sum(n)
        best, greedy = B.allocate(n, total), B.allocate_greedy(n, total)
        cost = lambda bits: sum(B.cost(b, k) for b, k in zip(bits, n))
        assert abs(sum(best) - total) < 1e-6 * total and abs(cost(best) - cost(greedy)) < 1e-3
        assert cost(best) <= cost([total * k / sum(n) for k in n])
    assert B.allocate([], 5) == [] and B.allocate_greedy([], 5) == []


def test_bloom(spark):
    rows = spark.range(500).select(F.lit(0).cast("long").alias("run_id"), (F.col("id") * 2).cast("int").alias("k"))
    sizes = B.sizing(spark.createDataFrame([(1, 0, 500)], "level int, run_id long, cap_entries long"), 0.02)
    asked = spark.range(1000).select(F.lit(0).cast("long").alias("run_id"), F.col("id").cast("int").alias("k"))
    got = B.measured(asked, sizes, B.bit_table(rows, sizes), rows).first()
    assert got.tp == 500 and got.fn == 0 and got.fp < 40


def test_formats(spark):
    one = spark.range(1)
    row = one.select(X.format_micros(F.lit(3_723_450_000)), X.format_micros(F.lit(1_500_000)), X.add_commas(F.lit(1234567)), X.strip_quotes(F.lit('"a"')), X.strip_quotes(F.lit('"a')), X.percent(F.lit("12.5%")), X.number(F.lit("1,234"))).first()
    assert list(row) == ["1 hours, 2 minutes, 3.45 seconds", "1.50 seconds", "1,234,567", "a", '"a', 0.125, 1234]


def test_multimap(spark):
    pairs = spark.createDataFrame([(1, 3), (1, 1), (1, 1), (2, 5), (-3, 0)], "k int, v int")
    assert {r.k: (r.found, r.vs) for r in M.get(pairs, 2).collect()} == {1: (3, [1, 1]), 2: (1, [5]), -3: (1, [0])}
    assert M.erase(pairs, pairs.where("k = 1")).count() == 2
    assert {r.bucket: r.pairs for r in M.buckets(pairs, 7).collect()} == {1: 3, 2: 1, 4: 1}
    assert M.size_for(100) > 100


@pytest.mark.parametrize("gaussian", [False, True])
def test_workload(spark, gaussian):
    w = Workload(puts=300, gets=200, ranges=50, deletes=40, misses=0.3, max_range=100, gaussian=gaussian)
    rows = generate(spark, w).orderBy("seq").collect()
    assert rows == generate(spark.newSession(), w).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(590)) and rows[0].op == "p"
    assert {o: sum(r.op == o for r in rows) for o in "pgrd"} == {"p": 300, "g": 200, "r": 50, "d": 40}
    seen = set()
    for r in rows:
        assert -2147483647 <= r.k <= 2147483647
        if r.op == "p":
            seen.add(r.k)
        if r.op == "d":
            assert r.k in seen
        if r.op == "r":
            assert 0 < r.v - r.k <= 101


def test_sources(spark, tmp_path):
    rows = [(i, o, k, v if o in "pr" else None) for i, o, k, v in _random_log(80, 5)]
    log = spark.createDataFrame(rows, LOG)
    files.write_commands(log, str(tmp_path / "c"))
    got = files.as_log(files.read_commands(spark, str(tmp_path / "c"))).orderBy("seq").collect()
    assert [(r.op, r.k, r.v) for r in got] == [r[1:] for r in rows]
    (tmp_path / "t.csv").write_text('Policy,Total,Rate\nTiered,"1,234",0.84%\n')
    r = files.read_experiment(spark, str(tmp_path / "t.csv")).first()
    assert r["Total (number)"] == 1234 and abs(r["Rate (number)"] - 0.0084) < 1e-12 and r["Policy (number)"] is None
    (tmp_path / "tree.json").write_text('{"levels": [{"levelNum": 1, "runs": [{"size": 3, "maxKey": 9}]}]}')
    assert files.read_tree_json(spark, str(tmp_path / "tree.json")).first().asDict() == {"level": 1, "ord": 0, "maxKey": 9, "size": 3}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, "p 1 5"), (1, "p 2 6"), (2, "d 1"), (3, "junk"), (4, "p 2 7")], "seq long, value string").write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("seq long, value string").parquet(str(tmp_path / "in"))
    q = live_snapshot(live_commands(lines)).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: (r.op, r.v) for r in spark.table("live").collect()} == {1: ("d", None), 2: ("p", 7)}


def test_stream_runs(spark, tmp_path):
    schema = "seq long, op string, k int, v int"
    log = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    assert run_available(log(), str(tmp_path / "a")).count() == 0
    for part in ([(0, "p", 1, 5), (3, "p", 2, 6)], [(1, "p", 2, 9), (4, "d", 1, None)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(log(), str(tmp_path / "b")).collect()
    assert {r.k: (r.seq, r.op, r.v) for r in got} == {1: (4, "d", None), 2: (3, "p", 6)}


def test_queries_match_sql(spark):
    import __spark_entry__
    import duckdb
    import pandas as pd

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    from kvlog.queries import QUERIES, SQL

    assert __spark_entry__.entry(spark).count() > 0
    for name in ("kv_point_get", "kv_range_asof", "run_catalog", "throughput_windows", "put_bursts", "dsl_parse", "multimap_get", "stream_snapshot", "kv_eval_counters", "run_catalog_lazy_leveled", "compact_partial_merge", "command_roundtrip", "binary_load"):
        a = QUERIES[name](spark, sf).toPandas()
        b = con.sql(SQL[name]).df()[list(a.columns)]
        key = lambda x: sorted(str([None if pd.isna(v) else round(float(v), 4) if not isinstance(v, str) else v for v in r]) for r in x.astype(object).itertuples(index=False))
        assert key(a) == key(b), name
