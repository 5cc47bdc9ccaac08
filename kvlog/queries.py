"""Queries over the test tables as change logs, each with DuckDB SQL where SQL can say it.

``events`` is a log with reads in it: clicks and purchases put, errors delete, views get,
signups read the range [k, k+10). ``orders`` is a log of puts and deletes ('P'). The parts
of ``lineitem`` are a multimap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.functions import text as X
from kvlog.operators import bloom as B
from kvlog.operators import compaction as C
from kvlog.operators import multimap as M
from kvlog.operators import reads as Q
from kvlog.operators import windows as W
from kvlog.plans import log as L
from kvlog.plans import runs as R
from kvlog.plans import tree as T
from kvlog.sources import files as S

EPOCH, BUFFER, FANOUT = 1000, 1000, 2

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def events_log(spark: SparkSession, d: str) -> DataFrame:
    return _as_log(_t(spark, d, "events"))


def _as_log(events: DataFrame) -> DataFrame:
    e = F.col("event_type")
    op = F.when(e == "error", "d").when(e == "view", "g").when(e == "signup", "r").otherwise("p")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("int").alias("k"), op.alias("op"), F.round(F.col("value") * 100).cast("int").alias("v"))


def event_ranges(log: DataFrame, swap: bool = False) -> DataFrame:
    a, b = F.col("k"), F.col("k") + 10
    return log.where("op = 'r'").select("seq", (b if swap else a).alias("a"), (a if swap else b).alias("b"))


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "P", "d").otherwise("p")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("int").alias("k"), op.alias("op"), F.round("o_totalprice").cast("int").alias("v"))


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("k"), F.col("l_quantity").cast("int").alias("v"))


def _runs(spark, d):
    rows = R.entries(orders_log(spark, d), EPOCH)
    return rows, R.catalog(rows, EPOCH)


LOG = "log AS (SELECT event_id AS seq, CAST(user_id AS INT) AS k, CASE event_type WHEN 'error' THEN 'd' WHEN 'view' THEN 'g' WHEN 'signup' THEN 'r' ELSE 'p' END AS op, CAST(ROUND(value * 100) AS INT) AS v FROM events)"
VER = f"{LOG}, ver AS (SELECT seq, k, op, v, COALESCE(LEAD(seq) OVER (PARTITION BY k ORDER BY seq), 9223372036854775807) AS seq_to FROM log WHERE op IN ('p', 'd'))"
SNAP = f"{VER}, snap AS (SELECT k, v FROM ver WHERE op = 'p' AND seq_to = 9223372036854775807)"
HIT = f"{VER}, got AS (SELECT g.seq, g.k, x.op AS vop FROM log g LEFT JOIN ver x ON x.k = g.k AND x.seq < g.seq AND g.seq <= x.seq_to WHERE g.op = 'g')"
DEL = "del AS (SELECT seq, k, op, COALESCE(LAG(op) OVER (PARTITION BY k ORDER BY seq), 'd') = 'p' AS succeeded FROM log WHERE op IN ('p', 'd'))"
RANGES = f"{VER}, rng AS (SELECT seq, k AS lo, k + 10 AS hi FROM log WHERE op = 'r'), hit AS (SELECT r.seq, r.lo, r.hi, x.k, x.v FROM rng r LEFT JOIN (SELECT * FROM ver WHERE op = 'p') x ON x.k >= r.lo AND x.k < r.hi AND x.seq < r.seq AND r.seq <= x.seq_to)"
ORD = "olog AS (SELECT o_orderkey AS seq, CAST(o_custkey AS INT) AS k, CASE o_orderstatus WHEN 'P' THEN 'd' ELSE 'p' END AS op, CAST(ROUND(o_totalprice) AS INT) AS v FROM orders)"
ENT = f"{ORD}, ent AS (SELECT run_id, k, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(v, seq) AS v FROM (SELECT *, seq // {EPOCH} AS run_id FROM olog) GROUP BY run_id, k)"
CAT = f"{ENT}, cat0 AS (SELECT run_id, count(*) AS n_entries, min(k) AS min_k, max(k) AS max_k, min(seq) AS min_seq, max(seq) AS max_seq FROM ent GROUP BY run_id), cat AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY level ORDER BY run_id DESC) - 1 AS ord, CAST({EPOCH} AS BIGINT) AS cap_entries FROM (SELECT *, CAST(floor(log2(max(run_id) OVER () - run_id + 2)) AS INT) AS level FROM cat0))"
DISK = "(VALUES (1, 'SSD', 1), (2, 'HDD1', 5), (3, 'HDD2', 15), (4, 'HDD3', 45), (5, 'HDD4', 135)) AS disk(disk_level, disk, multiplier)"
PARTS = "pairs AS (SELECT CAST(l_partkey AS INT) AS k, CAST(l_quantity AS INT) AS v FROM lineitem)"


@query(f"WITH {SNAP} SELECT k, v FROM snap")
def kv_snapshot(spark, d):
    return L.snapshot(events_log(spark, d))


@query(f"WITH {VER} SELECT seq, k, op, v, seq_to FROM ver")
def kv_versions(spark, d):
    return L.versions(events_log(spark, d))


GETS = f"WITH {VER} SELECT g.seq, g.k, x.v FROM (SELECT * FROM log WHERE op = 'g') g LEFT JOIN (SELECT * FROM ver WHERE op = 'p') x ON x.k = g.k AND x.seq < g.seq AND g.seq <= x.seq_to"


@query(GETS)
def kv_point_get(spark, d):
    return Q.gets_as_of(events_log(spark, d))


@query(GETS)
def kv_point_get_window(spark, d):
    return Q.gets_by_window(events_log(spark, d))


@query(f"WITH {SNAP} SELECT k, v FROM snap WHERE k >= 20 AND k < 60")
def kv_range_scan(spark, d):
    return Q.scan(L.snapshot(events_log(spark, d)), 20, 60)


@query(f"WITH {RANGES} SELECT * FROM hit")
def kv_range_asof(spark, d):
    log = events_log(spark, d)
    return Q.ranges_as_of(log, event_ranges(log))


@query(f"WITH {RANGES} SELECT * FROM hit")
def kv_range_swapped(spark, d):
    log = events_log(spark, d)
    return Q.ranges_as_of(log, event_ranges(log, swap=True))


@query(f"WITH {RANGES} SELECT seq, COALESCE(string_agg(k || ':' || v, ' ' ORDER BY k), '') AS answer FROM hit GROUP BY seq")
def kv_range_format(spark, d):
    log = events_log(spark, d)
    return Q.formatted(Q.ranges_as_of(log, event_ranges(log)))


@query(f"WITH {VER} SELECT k, seq FROM ver WHERE op = 'd' AND seq_to = 9223372036854775807")
def kv_tombstones(spark, d):
    return L.newest(events_log(spark, d)).where("op = 'd'").select("k", "seq")


@query(f"WITH {ORD} SELECT k, arg_max(v, seq) AS v FROM olog GROUP BY k HAVING arg_max(op, seq) = 'p'")
def kv_upsert_orders(spark, d):
    return L.snapshot(orders_log(spark, d))


@query(f"WITH {SNAP} SELECT count(*) AS pairs FROM snap")
def kv_logical_pairs(spark, d):
    return L.snapshot(events_log(spark, d)).agg(F.count("*").alias("pairs"))


@query(f"WITH {HIT.replace('WITH ', '')}, r AS (SELECT seq, count(x.k) AS n FROM (SELECT seq, k AS lo, k + 10 AS hi FROM log WHERE op = 'r') q LEFT JOIN (SELECT seq AS vs, k, seq_to FROM ver WHERE op = 'p') x ON x.k >= q.lo AND x.k < q.hi AND x.vs < q.seq AND q.seq <= x.seq_to GROUP BY seq) SELECT (SELECT count(*) FROM got WHERE vop IS NOT NULL) AS get_hits, (SELECT count(*) FROM got WHERE vop IS NULL) AS get_misses, (SELECT count(*) FROM r WHERE n > 0) AS range_hits, (SELECT count(*) FROM r WHERE n = 0) AS range_misses")
def kv_hits_misses(spark, d):
    log = events_log(spark, d)
    g = Q.outcomes(log).agg(F.count_if("hit").alias("get_hits"), F.count_if(~F.col("hit")).alias("get_misses"))
    r = Q.ranges_as_of(log, event_ranges(log)).groupBy("seq").agg(F.count("k").alias("n"))
    r = r.agg(F.count_if(F.col("n") > 0).alias("range_hits"), F.count_if(F.col("n") == 0).alias("range_misses"))
    return g.crossJoin(r)  # one row each


@query(f"WITH {HIT}, {DEL} SELECT 'PUTS' AS counter, count(*) AS n FROM log WHERE op = 'p' UNION ALL SELECT 'SUCC_GETS', count(*) FROM got WHERE vop = 'p' UNION ALL SELECT 'FAILED_GETS', count(*) FROM got WHERE vop IS NULL OR vop = 'd' UNION ALL SELECT 'RANGES', count(*) FROM log WHERE op = 'r' UNION ALL SELECT 'SUCC_DELS', count(*) FROM del WHERE op = 'd' AND succeeded UNION ALL SELECT 'FAILED_DELS', count(*) FROM del WHERE op = 'd' AND NOT succeeded UNION ALL SELECT 'LOADS', count(*) FROM log WHERE op = 'l'")
def kv_eval_counters(spark, d):
    log = events_log(spark, d)
    return Q.counters(log, event_ranges(log))


@query(f"WITH {LOG}, {DEL} SELECT seq, k, succeeded FROM del WHERE op = 'd'")
def kv_delete_outcome(spark, d):
    return Q.deletes(events_log(spark, d))


@query(f"WITH {CAT} SELECT run_id, level, ord, n_entries, cap_entries, min_k, max_k, min_seq, max_seq FROM cat")
def run_catalog(spark, d):
    return _runs(spark, d)[1].select("run_id", "level", "ord", "n_entries", "cap_entries", "min_k", "max_k", "min_seq", "max_seq")


@query(f"WITH {CAT} SELECT * FROM (SELECT level, ROW_NUMBER() OVER (PARTITION BY level ORDER BY ord, k) AS pos, run_id, k, op, v FROM ent JOIN cat USING (run_id)) WHERE pos <= 20")
def run_topn_per_level(spark, d):
    rows, runs = _runs(spark, d)
    return R.first_entries(rows, runs, 20)


@query(f"WITH {ENT} SELECT run_id, CAST(pos // 64 AS BIGINT) AS page, min(k) AS fence FROM (SELECT run_id, k, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY k) - 1 AS pos FROM ent) GROUP BY run_id, page")
def run_fences(spark, d):
    return R.fences(_runs(spark, d)[0], 64)


@query(f"WITH {CAT}, q AS (SELECT CAST(c_custkey AS INT) AS k FROM customer) SELECT level, count(*) AS io FROM q JOIN cat ON k BETWEEN min_k AND max_k GROUP BY level")
def run_prune_minmax(spark, d):
    keys = _t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("k"))
    return R.touched(_runs(spark, d)[1], keys)


FILL = f"{CAT}, fill AS (SELECT level, count(*) AS runs, CAST(sum(n_entries) AS BIGINT) AS pairs, CAST(sum(cap_entries) AS BIGINT) AS cap_pairs, CAST(pow({FANOUT}, level) AS BIGINT) * {BUFFER} AS capacity FROM cat GROUP BY level)"


@query(f"WITH {FILL} SELECT *, ROUND(100.0 * cap_pairs / capacity, 4) AS pct_full FROM fill")
def level_fill(spark, d):
    return R.fill(_runs(spark, d)[1], BUFFER, FANOUT)


# A level holds FANOUT ** level flushes. What n flushes leave in tiers: from level to level
# the flushes that moved on, less one, in whole groups.
TREE = f"{ENT}, came_to AS (SELECT 1 AS level, CAST(1 AS BIGINT) AS size, max(run_id) + 1 AS n FROM ent UNION ALL SELECT level + 1, size * {FANOUT}, (n - 1) // {FANOUT} FROM came_to WHERE n > {FANOUT}), lev AS (SELECT level, size, ((n - 1) % {FANOUT}) + 1 AS have, n AS came FROM came_to), off AS (SELECT *, COALESCE(sum(have * size) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, max(level) OVER () AS deepest FROM lev)"
TREE = "RECURSIVE " + TREE


def _tree_sql(policy: str) -> str:
    one = {"TIERED": "false", "LEVELED": "true", "LAZY_LEVELED": "level = deepest"}[policy]
    place = f"CASE WHEN {one} THEN 0 ELSE (age - start) // size END"
    return f"""
WITH {TREE},
aged AS (SELECT *, run_id AS flush, max(run_id) OVER () - run_id AS age FROM ent),
put AS (SELECT a.flush, a.k, a.seq, a.op, a.v, o.level, CAST({place} AS BIGINT) AS ord FROM aged a JOIN off o ON a.age >= o.start AND a.age < o.start + o.have * o.size),
id AS (SELECT level, ord, max(flush) AS run_id, count(DISTINCT flush) AS buffers, min(flush) AS low FROM put GROUP BY level, ord),
best AS (SELECT level, ord, k, max(seq) AS seq, arg_max(op, seq) AS op FROM put GROUP BY level, ord, k),
final AS (SELECT b.*, i.run_id, i.buffers FROM best b JOIN id i USING (level, ord) WHERE b.op = 'p' OR i.buffers = 1 OR i.low > 0)
SELECT run_id, level, ord, count(*) AS n_entries, min(k) AS min_k, max(k) AS max_k, min(seq) AS min_seq, max(seq) AS max_seq, any_value(buffers) * {BUFFER} AS cap_entries FROM final GROUP BY run_id, level, ord
"""


def _grown(spark, d, policy: str) -> tuple[DataFrame, T.Tree]:
    rows = R.entries(orders_log(spark, d), EPOCH)
    tree = T.grown(rows, policy, FANOUT)
    return T.final_runs(rows, tree), tree


@query(_tree_sql("TIERED"))
def run_catalog_tiered(spark, d):
    return T.catalog(_grown(spark, d, "TIERED")[0], BUFFER)


@query(_tree_sql("LEVELED"))
def run_catalog_leveled(spark, d):
    return T.catalog(_grown(spark, d, "LEVELED")[0], BUFFER)


@query(_tree_sql("LAZY_LEVELED"))
def run_catalog_lazy_leveled(spark, d):
    return T.catalog(_grown(spark, d, "LAZY_LEVELED")[0], BUFFER)


@query()
def run_catalog_partial(spark, d):
    return T.catalog(_grown(spark, d, "PARTIAL")[0], BUFFER)


@query(f"WITH {ORD} SELECT k, arg_max(v, seq) AS v FROM olog GROUP BY k HAVING arg_max(op, seq) = 'p'")
def partial_snapshot(spark, d):
    """What all runs of a tree under PARTIAL say together."""
    return L.snapshot(_grown(spark, d, "PARTIAL")[0])


# An access each: gets of the customers' keys in each run whose key range holds the key,
# flushes in level 1, and merges in the level that they end in. Time is counted in entries:
# those of the runs that are opened, and a buffer for each flush and moved buffer.
IO = _tree_sql("TIERED").strip().removeprefix("WITH ").rsplit("SELECT run_id, level, ord, count(*)", 1)
IO = f"""{IO[0]}, cat AS (SELECT run_id, level, ord, count(*){IO[1]}),
q AS (SELECT CAST(c_custkey AS INT) AS k FROM customer),
acc AS (SELECT level, count(*) AS io, sum(n_entries) AS us FROM q JOIN cat ON k BETWEEN min_k AND max_k GROUP BY level),
io AS (SELECT level, CAST(sum(io) AS BIGINT) AS io, CAST(sum(us) AS BIGINT) AS us FROM (SELECT * FROM acc UNION ALL SELECT level, came, came * size * {BUFFER} FROM off) GROUP BY level)"""


def _io(spark, d):
    final, tree = _grown(spark, d, "TIERED")
    cat = T.catalog(final, BUFFER)
    keys = _t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("k"))
    opened = R.opened(cat, keys).groupBy("level").agg(F.count("*").alias("io"), F.sum("n_entries").alias("us"))
    made = [(1, tree.flushes, tree.flushes * BUFFER)] + [(level, n, n * FANOUT ** (level - 1) * BUFFER) for level, n in tree.merges.items()]
    written = spark.createDataFrame(made, "level int, io long, us long")
    return opened.unionByName(written).groupBy("level").agg(F.sum("io").alias("io"), F.sum("us").alias("us"))


@query(f"WITH {IO} SELECT level, io, us, disk, us * multiplier AS penalised_us FROM io JOIN {DISK} ON least(level, 5) = disk_level")
def level_disk_penalty(spark, d):
    return R.with_disk(_io(spark, d)).select("level", "io", "us", "disk", (F.col("us") * F.col("multiplier")).alias("penalised_us"))


@query(f"WITH {IO} SELECT CAST(level AS VARCHAR) AS level, io, us FROM io UNION ALL SELECT 'total', CAST(sum(io) AS BIGINT), CAST(sum(us) AS BIGINT) FROM io")
def io_by_level(spark, d):
    io = _io(spark, d).select(F.col("level").cast("string").alias("level"), "io", "us")
    return io.rollup("level").agg(F.sum("io").alias("io"), F.sum("us").alias("us")).select(F.coalesce("level", F.lit("total")).alias("level"), "io", "us")


def _merged(where: str, last: bool) -> str:
    live = "HAVING arg_max(op, seq) = 'p'" if last else ""
    return f"WITH {CAT} SELECT k, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(v, seq) AS v FROM ent JOIN (SELECT run_id, level FROM cat) USING (run_id) WHERE {where} GROUP BY k {live}"


def _compact(spark, d, policy: str, level: int):
    rows, cat = _runs(spark, d)
    runs = [r.asDict() for r in cat.collect()]  # the catalog, a row a run
    seg = None
    if policy == "PARTIAL":
        seg = next(((r.start, r.stop) for r in R.gaps(cat).collect() if r.level == level), None)
    ids = C.plan(policy, runs, level, seg)
    return C.merge(rows.where(F.col("run_id").isin(ids)), C.oldest_outside(runs, ids))


@query(_merged("level = 2", False))
def compact_merge_tiered(spark, d):
    return _compact(spark, d, "TIERED", 2)


@query(_merged("level IN (1, 2)", False))
def compact_merge_leveled(spark, d):
    return _compact(spark, d, "LEVELED", 1)


@query(_merged("level IN (SELECT max(level) FROM cat) OR level IN (SELECT max(level) - 1 FROM cat)", True))
def compact_lazy_leveled(spark, d):
    rows, cat = _runs(spark, d)
    return _compact(spark, d, "LAZY_LEVELED", cat.agg(F.max("level")).first()[0] - 1)


GAP = f"{CAT}, g AS (SELECT level, ord, LEAD(min_k) OVER (PARTITION BY level ORDER BY ord) AS next_min, max_k, count(*) OVER (PARTITION BY level) AS n FROM cat), h AS (SELECT *, abs(CAST(next_min AS BIGINT) - max_k) AS gap, CAST(least(n, greatest(2, round(n * 0.5))) AS BIGINT) AS m FROM g), s AS (SELECT a.level, a.ord AS start, a.ord + a.m AS stop, CAST(COALESCE((SELECT sum(b.gap) FROM h b WHERE b.level = a.level AND b.ord >= a.ord AND b.ord < a.ord + a.m - 1), 0) AS BIGINT) AS gap_sum FROM h a WHERE a.ord + a.m <= a.n)"


@query(f"WITH {GAP} SELECT level, start, stop, gap_sum FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY level ORDER BY gap_sum, start) AS r FROM s) WHERE r = 1")
def compact_partial_gap(spark, d):
    return R.gaps(_runs(spark, d)[1])


PARTIAL_GAP = GAP + ", seg AS (SELECT start, stop FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY level ORDER BY gap_sum, start) AS r FROM s) WHERE r = 1 AND level = 2), inside AS (SELECT run_id FROM cat, seg WHERE level = 2 AND ord >= start AND ord < stop), low AS (SELECT min(min_seq) AS low FROM cat WHERE run_id NOT IN (SELECT run_id FROM inside))"


@query(f"WITH {PARTIAL_GAP} SELECT k, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(v, seq) AS v FROM ent JOIN inside USING (run_id) GROUP BY k HAVING arg_max(op, seq) = 'p' OR max(seq) > (SELECT low FROM low)")
def compact_partial_merge(spark, d):
    return _compact(spark, d, "PARTIAL", 2)


@query(_merged("true", True))
def compact_drop_tombstones(spark, d):
    return C.merge(_runs(spark, d)[0], None)


@query(f"WITH {CAT} SELECT level, run_id, cap_entries, bf_bits, bf_hashes, ROUND(pow(1 - exp(-bf_hashes * cap_entries / CAST(bf_bits AS DOUBLE)), bf_hashes), 6) AS fpr FROM (SELECT *, CAST(greatest(1, ceil(ln(2) * floor(bf_bits / cap_entries))) AS INT) AS bf_hashes FROM (SELECT *, CAST(ceil(-(cap_entries * ln(0.01)) / ln(2) / ln(2)) AS BIGINT) AS bf_bits FROM cat))")
def bloom_sizing(spark, d):
    return B.sizing(_runs(spark, d)[1])


RATE = 0.1


def _asked(spark, d):
    """Entries, run catalog, sizes of filters, and the keys read, with their hashes."""
    rows, cat = _runs(spark, d)
    keys = _t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("k")).distinct()
    x, y = B.key_hashes(F.col("k"))
    return rows, cat, B.sizing(cat, RATE), keys.select("k", x.alias("x"), y.alias("y"))


def _probes(spark, d):
    """Entries; runs with their filters, which are small, since runs are of ``EPOCH``
    sequence numbers; keys with their hashes; and each key with each run that a read opens."""
    rows, cat, sizes, keys = _asked(spark, d)
    runs = B.with_filters(cat, sizes, B.bit_table(rows, sizes), B.BLOCK)
    return rows, runs, keys, R.opened(runs, keys).select("run_id", "k", B.passes(B.most_hashes(RATE)).alias("yes"))


@query()
def bloom_membership(spark, d):
    rows, cat, sizes, keys = _asked(spark, d)
    runs = B.together(cat, sizes, rows, B.BLOCK, B.most_hashes(RATE))
    return B.let_through(R.opened(runs, keys, step=8, deal=4), B.most_hashes(RATE))


@query()
def bloom_measured_rate(spark, d):
    rows, runs, keys, asked = _probes(spark, d)
    real = rows.select("run_id", "k").join(keys, "k").join(runs, "run_id")
    return B.measured_reads(asked, real.select("run_id", "k", B.passes(B.most_hashes(RATE)).alias("yes")))


def _monkey(spark, d, how):
    rows = B.sizing(_runs(spark, d)[1]).join(_runs(spark, d)[1].select("run_id", "n_entries"), "run_id").orderBy("level", F.desc("run_id")).collect()  # a row a run
    got = how([r.n_entries for r in rows], sum(r.bf_bits for r in rows)) if rows else []
    return spark.createDataFrame([(r.run_id, r.n_entries, round(b, 3)) for r, b in zip(rows, got)], "run_id long, n_entries long, bits double")


@query(f"WITH {CAT}, tot AS (SELECT sum(n_entries) AS n, sum(n_entries * ln(n_entries)) AS nln, sum(CAST(ceil(-(cap_entries * ln(0.01)) / ln(2) / ln(2)) AS BIGINT)) AS b FROM cat), lam AS (SELECT -(b * ln(2) * ln(2) + nln) / n AS l FROM tot) SELECT run_id, n_entries, ROUND(-n_entries / (ln(2) * ln(2)) * (l + ln(n_entries)), 3) AS bits FROM cat, lam")
def monkey_closed_form(spark, d):
    return _monkey(spark, d, B.allocate)


@query()
def monkey_greedy(spark, d):
    return _monkey(spark, d, B.allocate_greedy)


THROUGH = """
WITH e AS (SELECT CAST(epoch_us(ts) AS BIGINT) AS us, ROW_NUMBER() OVER (ORDER BY event_id) AS n FROM events),
b AS (SELECT CAST((n - 1) // 500 AS BIGINT) AS bucket, count(*) AS commands, min(us) AS f, max(us) AS l FROM e GROUP BY 1)
SELECT bucket, commands, l - f AS elapsed_us, CASE WHEN l > f THEN ROUND(commands / (l - f)::DOUBLE * 1e6, 6) END AS cps,
CAST(sum(commands) OVER w AS BIGINT) AS total_commands, l - min(f) OVER w AS total_us,
CASE WHEN l > min(f) OVER w THEN ROUND(sum(commands) OVER w / (l - min(f) OVER w)::DOUBLE * 1e6, 6) END AS total_cps FROM b WINDOW w AS (ORDER BY bucket)
"""


@query(THROUGH)
def throughput_windows(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return W.throughput(e, 500)


@query("SELECT event_type, event_id, CAST(value * 100 AS BIGINT) AS x, CAST(value * 100 AS BIGINT) - LAG(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id) AS delta FROM events".replace("CAST(value * 100 AS BIGINT)", "CAST(ROUND(value * 100) AS BIGINT)"))
def cum_delta(spark, d):
    e = _t(spark, d, "events").select("event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("x"))
    return W.delta(e, "event_type", "event_id", "x")


@query(f"WITH {LOG}, g AS (SELECT *, sum(CASE WHEN op <> 'p' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS g FROM log) SELECT min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS puts FROM g WHERE op = 'p' GROUP BY g")
def put_bursts(spark, d):
    return W.bursts(events_log(spark, d))


LINE = "CASE op WHEN 'g' THEN 'g ' || k WHEN 'd' THEN 'd ' || k WHEN 'r' THEN 'r ' || k || ' ' || (k + 10) ELSE 'p ' || k || ' ' || CASE WHEN seq % 50 = 0 THEN 'x' WHEN seq % 51 = 0 THEN '99999999999' ELSE CAST(v AS VARCHAR) END END"


@query(f"WITH {LOG}, l AS (SELECT *, {LINE} AS raw, op = 'p' AND (seq % 50 = 0 OR seq % 51 = 0) AS bad FROM log) SELECT seq, CASE WHEN NOT bad THEN op END AS op, CASE WHEN NOT bad THEN k END AS a, CASE WHEN NOT bad THEN CASE op WHEN 'p' THEN v WHEN 'r' THEN k + 10 END END AS b, raw FROM l")
def dsl_parse(spark, d):
    lines = events_log(spark, d).select("seq", F.expr(LINE.replace("VARCHAR", "STRING")).alias("value"))
    return S.parse(lines).select("seq", "op", "a", "b", "raw")


@query("WITH e AS (SELECT event_id, event_id * 1230000 AS us FROM events) SELECT event_id, CASE WHEN us >= 3600000000 THEN (us // 3600000000) || ' hours, ' ELSE '' END || CASE WHEN us % 3600000000 >= 60000000 THEN ((us % 3600000000) // 60000000) || ' minutes, ' ELSE '' END || printf('%.2f', CAST(ROUND((us % 60000000) / 1e6, 2) AS DOUBLE)) || ' seconds' AS t FROM e")
def format_micros(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") * 1230000).alias("us"))
    return e.select("event_id", X.format_micros(F.col("us")).alias("t"))


@query("SELECT o_orderkey, format('{:,}', CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS s FROM orders")
def add_commas(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.add_commas(F.round(F.col("o_totalprice") * 100)).alias("s"))


@query("SELECT p_partkey, p_name AS s FROM part")
def strip_quotes(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.strip_quotes(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("s"))


@query("SELECT o_orderkey, CAST(ROUND(o_totalprice) AS BIGINT) AS us, o_custkey AS io FROM orders")
def regex_log_extract(spark, d):
    line = F.concat(F.lit("done in "), F.round("o_totalprice").cast("long").cast("string"), F.lit(" microseconds, with "), F.col("o_custkey").cast("string"), F.lit(" I/O operations."))
    us, io = X.micros_and_io(line)
    return _t(spark, d, "orders").select("o_orderkey", us.alias("us"), io.alias("io"))


@query("SELECT p.policy, f.fanout, e.error FROM (VALUES ('TIERED'), ('LEVELED'), ('LAZY_LEVELED')) p(policy), (VALUES (2), (5), (10)) f(fanout), (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) e(error)")
def param_grid(spark, d):
    mk = lambda n, t, xs: spark.createDataFrame([(x,) for x in xs], f"{n} {t}")
    return mk("policy", "string", ["TIERED", "LEVELED", "LAZY_LEVELED"]).crossJoin(mk("fanout", "int", [2, 5, 10])).crossJoin(mk("error", "double", [0.01, 0.05]))


@query("SELECT o_orderstatus AS policy, o_orderpriority AS config, ROUND(avg(o_totalprice), 6) AS mean_time FROM orders GROUP BY ALL")
def mean_by_config(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("policy"), F.col("o_orderpriority").alias("config")).agg(F.round(F.avg("o_totalprice"), 6).alias("mean_time"))


@query("SELECT o_orderpriority AS config, " + ", ".join(f"ROUND(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 6) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_mean(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("config")).pivot("o_orderstatus", list("FOP")).agg(F.round(F.avg("o_totalprice"), 6))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN '1 client' WHEN 4 THEN '4 clients' END AS label FROM nation")
def label_map(spark, d):
    m = F.create_map(F.lit(1), F.lit("1 client"), F.lit(4), F.lit("4 clients"))
    return _t(spark, d, "nation").select("n_nationkey", F.try_element_at(m, F.col("n_regionkey")).alias("label"))


@query("SELECT DISTINCT o_orderstatus || '/' || o_orderpriority AS label FROM orders")
def concat_label(spark, d):
    return _t(spark, d, "orders").select(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("label")).distinct()


@query("SELECT l_orderkey, l_linenumber, ROUND(CAST(ROUND(l_discount * 100) AS BIGINT) / 100.0, 6) AS share, CAST(ROUND(l_extendedprice) AS BIGINT) AS price FROM lineitem")
def percent_parse(spark, d):
    pct = F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.percent(pct), 6).alias("share"), X.number(F.format_number(F.round("l_extendedprice"), 0)).alias("price"))


@query("SELECT 'wide' AS tree, l_linenumber AS threads, ROUND(avg(l_extendedprice), 6) AS cps FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL UNION ALL SELECT 'skinny', l_linenumber, ROUND(avg(l_extendedprice), 6) FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL")
def wide_vs_skinny_union(spark, d):
    x = _t(spark, d, "lineitem").groupBy(F.when(F.col("l_returnflag") == "R", "wide").otherwise("skinny").alias("tree"), F.col("l_linenumber").alias("threads"))
    return x.agg(F.round(F.avg("l_extendedprice"), 6).alias("cps"))


@query("SELECT o_orderstatus AS policy, CAST(floor(o_orderkey / 1000) AS INT) AS thousands, count(*) AS n, ROUND(avg(o_totalprice), 6) AS cps FROM orders WHERE o_totalprice <> 0 GROUP BY ALL")
def rate_by_size(spark, d):
    """Rows without a measurement left out, sizes in whole thousands, a mean for each."""
    x = _t(spark, d, "orders").where("o_totalprice <> 0")
    return x.groupBy(F.col("o_orderstatus").alias("policy"), X.scaled(F.col("o_orderkey"), 1000).alias("thousands")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("cps"))


@query("WITH x AS (SELECT event_type AS policy, CAST(ROUND(value * 100) AS BIGINT) AS faults, event_id, LAG(CAST(ROUND(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) SELECT policy, count(*) AS windows, ROUND(avg(faults - COALESCE(before, 0)), 6) AS mean_faults FROM x GROUP BY 1")
def faults_by_policy(spark, d):
    """Increase of a running count from window to window, as a mean for each policy."""
    x = _t(spark, d, "events").select(F.col("event_type").alias("policy"), "event_id", F.round(F.col("value") * 100).cast("long").alias("faults"))
    x = W.delta(x, "policy", "event_id", "faults").withColumn("more", F.coalesce("delta", "faults"))
    return x.groupBy("policy").agg(F.count("*").alias("windows"), F.round(F.avg("more"), 6).alias("mean_faults"))


@query("SELECT tree, threads, ROUND(avg(cps), 6) AS cps FROM (SELECT 'wide' AS tree, o_orderpriority AS threads, o_totalprice AS cps FROM orders UNION ALL SELECT 'skinny', c_mktsegment, c_acctbal FROM customer) GROUP BY 1, 2")
def two_inputs_union(spark, d):
    """Two inputs, each with its label, put together and averaged."""
    wide = _t(spark, d, "orders").select(F.lit("wide").alias("tree"), F.col("o_orderpriority").alias("threads"), F.col("o_totalprice").alias("cps"))
    skinny = _t(spark, d, "customer").select(F.lit("skinny").alias("tree"), F.col("c_mktsegment").alias("threads"), F.col("c_acctbal").alias("cps"))
    return wide.unionByName(skinny).groupBy("tree", "threads").agg(F.round(F.avg("cps"), 6).alias("cps"))


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS size, o_orderstatus AS q FROM orders")
def angle_extract(spark, d):
    """Numbers and names that lines of a log carry in angle brackets."""
    o = _t(spark, d, "orders")
    size, q = (F.concat(F.lit(a), F.lit(" <"), F.col(c).cast("string"), F.lit(">")) for a, c in (("node size", "o_custkey"), ("q", "o_orderstatus")))
    return o.select("o_orderkey", X.in_angles(size).cast("long").alias("size"), X.in_angles(q).alias("q"))


@query("SELECT o_orderstatus, list_aggregate(list_sort(list(DISTINCT o_orderpriority)), 'string_agg', '|') AS names, min(o_custkey) AS low, max(o_custkey) AS high, CAST(max(length(o_orderpriority)) AS INT) AS width FROM orders GROUP BY 1")
def unique_min_max(spark, d):
    """Distinct values, least and greatest, and the longest text of a column."""
    by = _t(spark, d, "orders").groupBy("o_orderstatus")
    names = F.concat_ws("|", F.array_sort(F.collect_set("o_orderpriority")))
    return by.agg(names.alias("names"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"), F.max(F.char_length("o_orderpriority")).alias("width"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS INT) AS thousands, format('{:,}', CAST(ROUND(o_orderkey * 1000000 / 1e6) AS BIGINT)) || 'M' AS millions, printf('%.2f%%', (o_orderkey % 100) / 100.0 * 100) AS share FROM orders")
def number_formats(spark, d):
    key = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", X.scaled(F.col("o_totalprice"), 1000).alias("thousands"), X.millions(key * 1_000_000).alias("millions"), X.share((key % 100) / F.lit(100.0)).alias("share"))


IO_WINDOWS = f"""
WITH {LOG}, e AS (SELECT *, seq // {EPOCH} AS run_id FROM log),
r AS (SELECT run_id, min(k) AS lo, max(k) AS hi FROM e WHERE op IN ('p', 'd') GROUP BY run_id),
g AS (SELECT g.seq, count(r.run_id) AS io FROM e g LEFT JOIN r ON g.op = 'g' AND r.run_id < g.run_id AND g.k BETWEEN r.lo AND r.hi GROUP BY g.seq),
t AS (SELECT g.seq, g.io + CASE WHEN (g.seq + 1) % {EPOCH} = 0 THEN 1 ELSE 0 END AS io FROM g),
b AS (SELECT seq // 500 AS bucket, CAST(sum(io) AS BIGINT) AS io, count(*) AS commands FROM t GROUP BY 1)
SELECT bucket, commands, io, CAST(sum(io) OVER (ORDER BY bucket) AS BIGINT) AS total_io FROM b
"""


@query(IO_WINDOWS)
def throughput_io(spark, d):
    """Accesses in windows of 500 commands: a get opens each earlier run whose key range
    holds its key, the last command of an epoch flushes."""
    log = events_log(spark, d)
    cat = R.catalog(R.entries(log, EPOCH), EPOCH)
    asked = log.where("op = 'g'").select("seq", "k", F.floor(F.col("seq") / EPOCH).alias("now"))
    opened = R.opened(cat, asked).where("run_id < now").groupBy("seq").agg(F.count("*").alias("n"))
    flush = F.when((F.col("seq") + 1) % EPOCH == 0, 1).otherwise(0)
    x = log.select("seq", F.col("seq").alias("us")).join(opened, "seq", "left")
    x = x.select("seq", "us", (F.coalesce("n", F.lit(0)) + flush).alias("io"))
    return W.throughput(x, 500).select("bucket", "commands", "io", "total_io")


@query("SELECT ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) AS n, p_size AS size FROM part")
def sorted_sizes(spark, d):
    x = _t(spark, d, "part").select(F.col("p_size").alias("size"), "p_partkey")
    return W.numbered(x, "size", "p_partkey").select("n", "size")


@query(f"WITH {PARTS} SELECT k, count(*) AS found, (list_sort(list(v)))[1:5] AS vs FROM pairs GROUP BY k".replace("(list_sort(list(v)))[1:5] AS vs", "array_to_string((list_sort(list(v)))[1:5], ',') AS vs"))
def multimap_get(spark, d):
    return M.get(part_pairs(spark, d), 5).select("k", "found", F.concat_ws(",", F.col("vs").cast("array<string>")).alias("vs"))


@query(f"WITH {PARTS} SELECT k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM pairs WHERE k NOT IN (SELECT CAST(p_partkey AS INT) FROM part WHERE p_size > 25) GROUP BY k")
def multimap_erase(spark, d):
    gone = _t(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").cast("int").alias("k"))
    return M.erase(part_pairs(spark, d), gone).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {PARTS} SELECT k % 127 AS bucket, count(*) AS pairs FROM pairs GROUP BY 1")
def multimap_buckets(spark, d):
    return M.buckets(part_pairs(spark, d), 127)


@query()
def workload_generate(spark, d):
    from kvlog.sources.workload import Workload, generate

    return generate(spark, Workload(puts=5000, gets=2000, ranges=500, deletes=500, skew=0.5, max_range=1000))


@query(f"WITH {ORD} SELECT ROW_NUMBER() OVER (ORDER BY seq) - 1 AS seq, k, op, CASE WHEN op = 'p' THEN v END AS v FROM olog")
def command_roundtrip(spark, d):
    """Orders as command lines, written, read in order and parsed again."""
    path = S.scratch(spark, "commands")
    S.write_commands(orders_log(spark, d), path)
    return S.read_commands(spark, path).select("seq", F.col("a").alias("k"), "op", F.col("b").alias("v"))


@query(f"WITH {ORD} SELECT k, op, CASE WHEN op = 'p' THEN v END AS v, ROW_NUMBER() OVER (ORDER BY seq) - 1 AS seq FROM olog")
def binary_load(spark, d):
    """Orders in binary files of 32-bit pairs, a file for 4,000 sequence numbers, loaded in order."""
    path, pairs = S.scratch(spark, "pairs"), orders_log(spark, d)
    v = F.when(F.col("op") == "p", F.col("v")).otherwise(L.TOMBSTONE)
    name = F.format_string("%s/%08d.dat", F.lit(path), F.floor(F.col("seq") / 4000))
    S.write_pairs(pairs.select("seq", "k", v.alias("v")).withColumn("path", name), path)
    return S.load_order(S.read_pairs(spark, f"{path}/*.dat"))


EXTERNAL = f"WITH {LOG}, g AS (SELECT *, sum(CASE WHEN op <> 'p' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS g FROM log), b AS (SELECT min(seq) AS seq, count(*) AS puts FROM g WHERE op = 'p' GROUP BY g)"


@query(f"{EXTERNAL} SELECT seq, 'l' AS op, puts AS pairs FROM b UNION ALL SELECT seq, op, 0 FROM log WHERE op <> 'p'")
def external_puts(spark, d):
    """Each run of puts in a binary file of its own, a load line in its place; the files are
    read again for the number of pairs that each line stands for."""
    path = S.scratch(spark, "bursts")
    lines = S.parse(S.write_external(events_log(spark, d), path))
    loads = lines.where("op = 'l'").select("seq", "op", "path")
    pairs = S.read_listed(loads.select("path")).groupBy("path").agg(F.count("*").alias("pairs"))
    zero = F.lit(0).cast("long")
    out = loads.join(pairs, "path", "left").select("seq", "op", F.coalesce("pairs", zero).alias("pairs"))
    return out.unionByName(lines.where("op is distinct from 'l'").select("seq", "op", zero.alias("pairs")))


@query("SELECT ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1 AS line, CAST(p_size AS BIGINT) AS n FROM part")
def integer_lines(spark, d):
    """Sorted sizes in a text file, an integer a line."""
    path = S.scratch(spark, "sizes")
    part = _t(spark, d, "part")
    part.repartitionByRange(1, "p_size", "p_partkey").sortWithinPartitions("p_size", "p_partkey").select(F.col("p_size").cast("string")).write.text(path)
    return S.read_integers(spark, path)


@query(f"WITH {ORD}, f AS (SELECT seq, k, op, v, seq % 3 AS client, seq // 3 AS line FROM olog), n AS (SELECT count(*) AS many FROM olog) SELECT line * 3 + client AS seq, k, op, CASE WHEN op = 'p' THEN v END AS v FROM f")
def client_turns(spark, d):
    """Orders dealt to the files of three clients, read in turns."""
    path = S.scratch(spark, "clients")
    log = orders_log(spark, d).withColumn("client", F.col("seq") % 3)
    for i in range(3):
        log.where(F.col("client") == i).repartitionByRange(1, "seq").sortWithinPartitions("seq").select(S.line().alias("value")).write.text(f"{path}/{i}")
    return S.read_clients(spark, [f"{path}/{i}" for i in range(3)]).select("seq", F.col("a").alias("k"), "op", F.col("b").alias("v"))


@query(SQL["run_catalog"])
def state_roundtrip(spark, d):
    runs = run_catalog(spark, d)
    path = S.scratch(spark, "state")
    S.write_state(runs, path)
    return S.read_state(spark, path, runs.schema)


@query(f"WITH {ENT} SELECT run_id, k, seq, op, v FROM ent WHERE k BETWEEN 100 AND 200")
def run_files(spark, d):
    """Entries written as run files sorted by key, then read by a key range."""
    path = S.scratch(spark, "runs")
    S.write_run(_runs(spark, d)[0], path, 100_000)
    return spark.read.parquet(path).where("k between 100 and 200").select("run_id", "k", "seq", "op", "v")


@query(f"WITH {LOG} SELECT k, max(seq) AS seq, arg_max(op, seq) AS op, CASE WHEN arg_max(op, seq) = 'p' THEN arg_max(v, seq) END AS v FROM log WHERE op IN ('p', 'd') GROUP BY k")
def stream_snapshot(spark, d):
    """The newest mutation of each key, from ``events`` read as a stream."""
    from kvlog.streaming.live import run_available

    source = _t(spark, d, "events")
    # a stream's plain path must be a folder; a pattern may match one file
    events = spark.readStream.schema(source.schema).parquet(f"{d.rstrip('/')}/events.parque[t]")
    log = L.mutations(_as_log(events))
    return run_available(log.withColumn("v", F.when(F.col("op") == "p", F.col("v"))), S.scratch(spark, "stream"))
