"""An engine that takes commands one at a time or by the file.

What is written goes to a buffer of distinct keys; a full buffer is flushed as a run, a
Parquet folder sorted by key, and runs move and merge as the policy says. Reads look in the
buffer and in the runs whose key range can hold the key. Files of commands are answered
as a whole, by joins.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.operators import bloom, reads
from kvlog.operators.compaction import POLICIES
from kvlog.plans import log as L
from kvlog.plans import runs as R
from kvlog.plans.tree import Run, Tree
from kvlog.sources import files

HELP = "p K V | g K | r A B | d K | l PATH | b PATH | s [N] | i | q"
CONSOLE_HELP = "bloom | monkey | misses | io | quit | qs | help"
_LOG = "seq long, op string, k int, v int"
_STATS = ["n_entries", "min_k", "max_k", "min_seq", "max_seq"]


@dataclass(frozen=True)
class EngineConfig:
    error_rate: float = 0.01
    buffer_pairs: int = 65_536
    fanout: int = 10
    policy: str = "TIERED"
    share: float = 0.5
    report_every: int = 0

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
        if self.fanout < 2:
            raise ValueError("fanout must be 2 or more")
        if not 0 < self.error_rate < 1:
            raise ValueError("error_rate must lie between 0 and 1")
        if self.buffer_pairs < 1:
            raise ValueError("buffer_pairs must be 1 or more")


def _key(k: int) -> int:
    if not L.KEY_MIN <= k <= L.KEY_MAX:
        raise ValueError("key out of range")
    return k


class Engine:
    """``execute`` answers one command line of a client as text, ``console`` one of the
    operator. ``log`` is all that the buffer and the runs hold."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, log: DataFrame | None = None, path: str | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.path = path or files.scratch(spark, "engine")
        self.tree = Tree(self.config.policy, self.config.fanout, self.config.share)
        #: By run id: where the run lies, and its numbers.
        self.files: dict[int, dict] = {}
        self.buffer: dict[int, tuple[int, str, int | None]] = {}
        self.seq, self.made = 0, 0
        self.counts = {"get_hits": 0, "get_misses": 0, "range_hits": 0, "range_misses": 0}
        #: By level: accesses and microseconds.
        self.io: dict[int, list[int]] = {}
        self.commands, self.began, self.progress = 0, time.time(), []
        self.open, self.saved_at = True, None
        if log is not None:
            self._bulk(log.select("seq", "op", "k", "v"))

    # Rows

    @property
    def log(self) -> DataFrame:
        own = self.spark.createDataFrame([(s, op, k, v) for k, (s, op, v) in self.buffer.items()], _LOG)
        return self._stored(self.files).select("seq", "op", "k", "v").unionByName(own) if self.files else own

    def _stored(self, ids) -> DataFrame:
        """Entries of runs, as one scan."""
        paths = [self.files[i]["path"] for i in ids]
        if not paths:
            return self.spark.createDataFrame([], "run_id long, " + _LOG)
        return self.spark.read.schema("run_id long, k int, seq long, op string, v int").parquet(*paths)

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def _count(self, level: int, began: float, n: int = 1) -> None:
        own = self.io.setdefault(level, [0, 0])
        own[0] += n
        own[1] += int((time.time() - began) * 1e6)

    def _tick(self) -> None:
        self.commands += 1
        every = self.config.report_every
        if every and self.commands % every == 0:
            now, io = time.time(), sum(x[0] for x in self.io.values())
            last = self.progress[-1] if self.progress else {"total_us": 0, "total_io": 0}
            total = int((now - self.began) * 1e6)
            self.progress.append({"commands": self.commands, "window_us": total - last["total_us"], "window_io": io - last["total_io"], "total_us": total, "total_io": io})

    # Writes

    def _add(self, op: str, k: int, v: int | None) -> None:
        if k not in self.buffer and len(self.buffer) >= self.config.buffer_pairs:
            self.flush()
        self.buffer[k] = (self.seq, op, v)
        self.seq += 1
        self._tick()

    def put(self, k: int, v: int) -> str:
        _key(k)
        if not L.KEY_MIN <= v <= L.KEY_MAX:
            return "ERROR: value out of range"
        self._add("p", k, v)
        return ""

    def delete(self, k: int) -> str:
        self._add("d", _key(k), None)
        return ""

    def flush(self) -> None:
        """The buffer becomes a run of level 1."""
        if not self.buffer:
            return
        rows = self.spark.createDataFrame([(self.made, k, s, op, v) for k, (s, op, v) in self.buffer.items()], "run_id long, k int, seq long, op string, v int")
        self.buffer = {}
        self._settle(rows)

    def _settle(self, rows: DataFrame) -> None:
        """Take in flushes ``(run_id, k, seq, op, v)`` numbered on from ``made``, and carry
        out all moves and merges that they cause in one job: each run that comes of them is
        the newest of each key of what goes into it."""
        began, stats = time.time(), {}
        oldest = {i: f["min_seq"] for i, f in self.files.items()}
        for r in rows.groupBy("run_id").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.min("seq").alias("s")).collect():  # a row a flush
            stats[r.run_id], oldest[r.run_id] = (r.a, r.b), r.s
        before = {r.run_id: r for level in self.tree.levels for r in level}
        merges = dict(self.tree.merges)
        for number in sorted(stats):
            self.tree.flush(number, *stats[number])
            self._count(1, began)
            self.made = number + 1
        after = {r.run_id: r for level in self.tree.levels for r in level}
        changed = {i: r for i, r in after.items() if i not in before or before[i].spans != r.spans}
        old = [i for i, r in before.items() if i in self.files and (i not in after or i in changed)]
        # A merge drops a delete that is older than all that lies outside the merge.
        outside = {i: min((s for j, s in oldest.items() if not any(a <= j <= b for a, b in r.spans)), default=None) for i, r in changed.items()}
        spans = self.spark.createDataFrame([(a, b, i, r.buffers > 1, outside[i]) for i, r in changed.items() for a, b in r.spans], "a long, b long, to long, merged boolean, outside long")
        full = rows.unionByName(self._stored(old))
        best = full.join(F.broadcast(spans), F.col("run_id").between(F.col("a"), F.col("b")))
        best = best.groupBy("to", "k", "merged", "outside").agg(F.max(F.struct("seq", "op", "v")).alias("x"))
        hides = F.coalesce(F.col("x.seq") > F.col("outside"), F.lit(False))
        best = best.where((F.col("x.op") == "p") | ~F.col("merged") | hides).select(F.col("to").alias("run_id"), "k", "x.seq", "x.op", "x.v")
        path = self._at("runs")
        files.write_runs(best, path, self.config.buffer_pairs * max(r.buffers for r in changed.values()))
        done = self.spark.read.schema("run_id long, k int, seq long, op string, v int").parquet(path)
        known = {r.run_id: r.asDict() for r in done.groupBy("run_id").agg(F.count("*").alias("n_entries"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")).collect()}  # a row a run
        gone = [self.files.pop(i)["path"] for i in old]
        for i, r in known.items():
            self.files[i] = {n: r[n] for n in _STATS} | {"path": f"{path}/to={i}"}
        for p in gone:
            files.unlink(self.spark, p)
        for level, n in self.tree.merges.items():
            if n > merges.get(level, 0):
                self._count(level, began, n - merges.get(level, 0))

    def _bulk(self, log: DataFrame) -> None:
        """Mutations of a whole log, after all before it: a flush for each buffer of them."""
        self.flush()
        base, size = self.made, self.config.buffer_pairs
        first, last = log.agg(F.min("seq"), F.max("seq")).first()
        if last is None:
            return
        rows = R.entries(log.withColumn("seq", F.col("seq") - first), size)
        rows = rows.select((F.col("run_id") + base).alias("run_id"), "k", (F.col("seq") + max(first, self.seq)).alias("seq"), "op", "v")
        self.seq = max(first, self.seq) + last - first + 1
        self._settle(files.kept(rows, self._at("load")))

    def load(self, path: str) -> str:
        """Bulk puts of binary files, after all before them."""
        self._bulk(files.load_order(files.read_pairs(self.spark, path)).withColumn("seq", F.col("seq") + self.seq))
        self._tick()
        return ""

    # Reads

    def levels(self) -> dict[int, int]:
        return {r.run_id: i + 1 for i, level in enumerate(self.tree.levels) for r in level if r.run_id in self.files}

    def _touched(self, lo: int, hi: int) -> list[int]:
        """Runs whose keys lie on both sides of [lo, hi], each an access."""
        at = self.levels()
        found = [i for i, f in self.files.items() if f["min_k"] <= hi and f["max_k"] >= lo]
        for i in found:
            self._count(at[i], time.time())
        return found

    def get(self, k: int) -> str:
        if not L.KEY_MIN <= k <= L.KEY_MAX:
            return ""
        self._tick()
        row = self.buffer.get(k)
        if row is None:
            ids, began = self._touched(k, k), time.time()
            best = self._stored(ids).where(F.col("k") == k).agg(F.max(F.struct("seq", "op", "v")).alias("x")).first().x if ids else None
            row = (best.seq, best.op, best.v) if best is not None else None
            if ids:
                self._count(self.levels()[ids[0]], began, 0)
        self.counts["get_misses" if row is None else "get_hits"] += 1
        return str(row[2]) if row is not None and row[1] == "p" else ""

    def scan(self, a: int, b: int) -> DataFrame:
        """``(k, v)`` of the keys in [a, b); bounds the wrong way round are swapped."""
        return reads.scan(L.snapshot(self.log), a, b)

    def range(self, a: int, b: int) -> str:
        lo, hi = min(a, b), max(a, b)
        if lo == hi or lo < L.KEY_MIN or hi > L.KEY_MAX + 1:
            return ""
        self._tick()
        self._touched(lo, hi - 1)
        rows = self.scan(lo, hi).orderBy("k").collect()  # the answer, as text
        self.counts["range_hits" if rows else "range_misses"] += 1
        return " ".join(f"{r.k}:{r.v}" for r in rows)

    def benchmark(self, path: str | list[str], clients: bool = False) -> DataFrame:
        """All commands of a file, or of several clients' files in turns: mutations and loads
        join the engine, gets and ranges are answered as of their places and counted. Returns
        ``(seq, op, answer)``; other lines are left out."""
        read = files.read_clients if clients else files.read_commands
        c = files.kept(read(self.spark, path).where("op in ('p', 'g', 'd', 'r', 'l')"), self._at("commands"))
        self.commands += c.count()
        here, loaded = F.col("seq"), None
        for r in c.where("op = 'l'").orderBy("seq").collect():  # a row a load
            pairs = files.load_order(files.read_pairs(self.spark, r.path))
            at, n = here, pairs.count()
            place = F.lit(r.seq)
            for before, size in loaded[1] if loaded else ():
                place = place + F.lit(size if before < r.seq else 0)
            pairs = pairs.withColumn("seq", F.col("seq") + place)
            here = at + F.when(F.col("seq") > r.seq, n).otherwise(0)
            loaded = (pairs if loaded is None else loaded[0].unionByName(pairs), [*(loaded[1] if loaded else []), (r.seq, n)])
        first = self.seq
        log = files.as_log(c).withColumn("seq", here)
        if loaded is not None:
            log = log.unionByName(loaded[0])
        log = log.withColumn("seq", F.col("seq") + first).select("seq", "op", "k", "v")
        base = self.log
        full = base.unionByName(log)
        gets = reads.gets_as_of(full).where(F.col("seq") >= first).select("seq", F.lit("g").alias("op"), F.coalesce(F.col("v").cast("string"), F.lit("")).alias("answer"))
        asked = log.where("op = 'r'").select("seq", F.col("k").alias("a"), F.col("v").alias("b"))
        ranges = reads.formatted(reads.ranges_as_of(L.mutations(full), asked)).select("seq", F.lit("r").alias("op"), "answer")
        empty = asked.where("a = b").select("seq", F.lit("r").alias("op"), F.lit("").alias("answer"))
        answers = files.kept(gets.unionByName(ranges).unionByName(empty), self._at("answers"))
        hit = reads.outcomes(full).where(F.col("seq") >= first).agg(F.count_if("hit"), F.count_if(~F.col("hit"))).first()
        found = answers.where("op = 'r'").join(asked.where("a <> b").select("seq"), "seq", "left_semi").agg(F.count_if(F.col("answer") != ""), F.count_if(F.col("answer") == "")).first()
        for name, n in zip(("get_hits", "get_misses", "range_hits", "range_misses"), (*hit, *found)):
            self.counts[name] += n
        self._bulk(L.mutations(log))
        return answers

    # Numbers

    def runs(self) -> DataFrame:
        rows = [(r.run_id, i + 1, j, *[self.files[r.run_id][n] for n in _STATS], r.buffers * self.config.buffer_pairs) for i, level in enumerate(self.tree.levels) for j, r in enumerate(level) if r.run_id in self.files]
        return self.spark.createDataFrame(rows, "run_id long, level int, ord long, n_entries long, min_k int, max_k int, min_seq long, max_seq long, cap_entries long")

    def pairs(self) -> int:
        return L.snapshot(self.log).count()

    def stats(self, n: int = -1) -> dict[str, DataFrame | int]:
        runs = self.runs()
        return {"pairs": self.pairs(), "levels": R.fill(runs, self.config.buffer_pairs, self.config.fanout), "entries": R.first_entries(self._stored(self.files), runs, n)}

    def bloom(self) -> DataFrame:
        return bloom.sizing(self.runs(), self.config.error_rate)

    def bloom_rates(self, keys: DataFrame) -> DataFrame:
        """True and false positives by run when ``keys (k)`` are looked up in every run whose
        key range holds them."""
        asked = keys.join(F.broadcast(self.runs().select("run_id", "min_k", "max_k")), F.col("k").between(F.col("min_k"), F.col("max_k"))).select("run_id", "k")
        rows = self._stored(self.files)
        found = bloom.measured(asked, self.bloom(), bloom.bit_table(rows, self.bloom()), rows)
        return self.bloom().join(found.withColumnRenamed("fpr", "fpr_measured"), "run_id", "left")

    def monkey(self) -> list[tuple[int, float]]:
        rows = self.bloom().join(self.runs().select("run_id", "n_entries"), "run_id").orderBy("level", "run_id").collect()  # a row a run
        got = bloom.allocate([r.n_entries for r in rows], sum(r.bf_bits for r in rows)) if rows else []
        return [(r.run_id, b) for r, b in zip(rows, got)]

    def misses(self) -> dict[str, int]:
        return dict(self.counts)

    def io_levels(self) -> DataFrame:
        """Accesses and time by level, with the penalty of the level's disk."""
        rows = [(level, n, us) for level, (n, us) in sorted(self.io.items())]
        io = self.spark.createDataFrame(rows, "level int, io long, us long")
        return R.with_disk(io).select("level", "io", "us", "disk", (F.col("us") * F.col("multiplier")).alias("penalised_us"))

    def info(self) -> DataFrame:
        """Levels: runs, pairs, how full, disk, and whether it is the last."""
        fill = R.with_disk(R.fill(self.runs(), self.config.buffer_pairs, self.config.fanout))
        return fill.withColumn("last", F.col("level") == len(self.tree.levels))

    def summary(self) -> dict:
        rate = [r.fpr for r in self.bloom().collect()]  # a row a run
        return {
            "pairs": self.pairs(),
            "buffer_pairs": len(self.buffer),
            "buffer_pct": round(100 * len(self.buffer) / self.config.buffer_pairs, 4),
            "false_positive_rate": round(sum(rate) / len(rate), 6) if rate else None,
            "io": sum(x[0] for x in self.io.values()),
            "io_us": sum(x[1] for x in self.io.values()),
            "runs": len(self.files),
            "levels": len(self.tree.levels),
        }

    # State

    def save(self, path: str) -> None:
        """Everything: runs, their Bloom bits, and as one line of JSON the configuration,
        counters, buffer and levels. The newest whole one counts."""
        at = f"{path.rstrip('/')}/state-{int(time.time() * 1e6)}"
        rows = self._stored(self.files)
        rows.write.parquet(f"{at}/runs")
        bloom.bit_table(rows, self.bloom()).write.parquet(f"{at}/bloom")
        state = {
            "config": asdict(self.config),
            "counts": self.counts,
            "io": self.io,
            "commands": self.commands,
            "seq": self.seq,
            "made": self.made,
            "buffer": [(k, *x) for k, x in self.buffer.items()],
            "merges": self.tree.merges,
            "levels": [[asdict(r) for r in level] for level in self.tree.levels],
            "files": {i: {n: f[n] for n in _STATS} for i, f in self.files.items()},
        }
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{at}/tree")
        self.saved_at = path

    @classmethod
    def restore(cls, spark: SparkSession, path: str, config: EngineConfig | None = None) -> Engine:
        """From the newest whole state; a missing folder gives an empty engine. What was
        saved of the configuration counts, not what is given."""
        found = [x for x in files.listed(spark, path) if x.startswith("state-") and "_SUCCESS" in files.listed(spark, f"{path}/{x}/tree")]
        if not found:
            return cls(spark, config)
        at = f"{path.rstrip('/')}/{found[-1]}"
        state = json.loads(spark.read.text(f"{at}/tree").first().value)
        e = cls(spark, EngineConfig(**state["config"]))
        e.counts, e.commands, e.seq, e.made = state["counts"], state["commands"], state["seq"], state["made"]
        e.io = {int(k): v for k, v in state["io"].items()}
        e.buffer = {k: (s, op, v) for k, s, op, v in state["buffer"]}
        e.tree.levels = [[Run(**(r | {"spans": [tuple(x) for x in r["spans"]]})) for r in level] for level in state["levels"]]
        e.tree.merges = {int(k): v for k, v in state["merges"].items()}
        if state["files"]:
            own = f"{e.path}/runs-restored"
            files.write_runs(spark.read.parquet(f"{at}/runs"), own, e.config.buffer_pairs)
            e.files = {int(i): f | {"path": f"{own}/to={i}"} for i, f in state["files"].items()}
        return e

    # Text

    def execute(self, line: str) -> str:
        p = line.split()
        try:
            match p[0] if p else "":
                case "p" if len(p) == 3:
                    return self.put(int(p[1]), int(p[2]))
                case "g" if len(p) == 2:
                    return self.get(int(p[1]))
                case "r" if len(p) == 3:
                    return self.range(int(p[1]), int(p[2]))
                case "d" if len(p) == 2:
                    return self.delete(int(p[1]))
                case "l" if len(p) >= 2:
                    return self.load(line.strip()[1:].strip().strip('"'))
                case "b" if len(p) >= 2:
                    found = self.benchmark(line.strip()[1:].strip().strip('"'))
                    return "\n".join(r.answer for r in found.orderBy("seq").toLocalIterator())
                case "s" if len(p) == 1 or len(p) == 2 and int(p[1]) > 0:
                    st = self.stats(int(p[1]) if len(p) == 2 else -1)
                    levels = ", ".join(f"LVL{r.level}: {r.pairs}" for r in st["levels"].orderBy("level").collect())
                    body = " ".join(f"{r.k}:{'DEL' if r.op == 'd' else r.v}:L{r.level}" for r in st["entries"].orderBy("level", "pos").toLocalIterator())
                    return f"Logical Pairs: {st['pairs']}\n{levels}\n{body}"
                case "i" if len(p) == 1:
                    head = "\n".join(f"{k}: {v}" for k, v in self.summary().items())
                    return "\n".join([head, *[str(r.asDict()) for r in self.info().orderBy("level").collect()]])
                case "q" if len(p) == 1:
                    self.save(self.saved_at or f"{self.path}/saved")
                    self.open = False
                    return ""
        except ValueError:
            pass
        return HELP

    def console(self, line: str) -> str:
        """An operator's command: reports, ``quit`` without and ``qs`` with saving."""
        table = lambda df: "\n".join(str(r.asDict()) for r in df.collect())
        match line.strip():
            case "bloom":
                return table(self.bloom().orderBy("level", "run_id"))
            case "monkey":
                return "\n".join(f"run {i}: {b:.1f} bits" for i, b in self.monkey())
            case "misses":
                return "\n".join(f"{k}: {v}" for k, v in self.misses().items())
            case "io":
                return table(self.io_levels().orderBy("level"))
            case "quit":
                self.open = False
                return ""
            case "qs":
                return self.execute("q")
        return CONSOLE_HELP
