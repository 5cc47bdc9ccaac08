"""Bloom filters: sizes, rates, bit tables, and the division of memory among runs."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN2 = math.log(2)
#: Bits of a filter in one row.
BLOCK = 1 << 16
#: Runs whose filters are read together, one bit of a word each.
LANES = 64


def bits(n: Column, rate: float) -> Column:
    return F.ceil(-(n * math.log(rate)) / LN2 / LN2).cast("long")


def hashes(m: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(LN2) * F.floor(m / n))).cast("int")


def rate(m: Column, n: Column, h: Column) -> Column:
    return F.pow(1 - F.exp(-h * n / m), h)


def sizing(runs: DataFrame, error: float = 0.01) -> DataFrame:
    n = F.col("cap_entries")
    out = runs.select("level", "run_id", "cap_entries", bits(n, error).alias("bf_bits"))
    out = out.withColumn("bf_hashes", hashes(F.col("bf_bits"), n))
    return out.withColumn("fpr", F.round(rate(F.col("bf_bits"), n, F.col("bf_hashes")), 6))


def key_hashes(k: Column) -> tuple[Column, Column]:
    return F.xxhash64(k, F.lit(1)), F.xxhash64(k, F.lit(2))


def positions(k: Column, m: Column, h: Column) -> Column:
    """Double hashing: ``(x + i*y) mod m``."""
    x, y = key_hashes(k)
    return F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.pmod(F.pmod(x, m) + i * F.pmod(y, m), m))


def bit_table(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(run_id, bit)``: the set bits of each run."""
    s = sizes.select("run_id", "bf_bits", "bf_hashes")
    x = rows.join(s, "run_id").select("run_id", F.explode(positions(F.col("k"), F.col("bf_bits"), F.col("bf_hashes"))).alias("bit"))
    return x.distinct()


def blocks(sizes: DataFrame, table: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(run_id, block, words)``: the filters as 64-bit words, ``size`` bits a row, from the
    set bits ``table (run_id, bit)``. Words without a set bit are there too."""
    at = lambda x, n: F.floor(x / n).cast("long")
    none = sizes.where("bf_bits > 0").select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), at(F.col("bf_bits") - 1, 64))).alias("word"), F.lit(0).cast("long").alias("bits"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = table.select("run_id", at(F.col("bit"), 64).alias("word"), one.alias("bits")).unionByName(none)
    words = words.groupBy("run_id", "word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy("run_id", at(F.col("word"), size // 64).alias("block")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("x"))
    return rows.select("run_id", "block", F.col("x.bits").alias("words"))


def all_set(words: Column, bits: Column) -> Column:
    """Whether the words of a block have all these bits, counted from the block's first."""
    return F.forall(bits, lambda b: _is_set(words, b))


def _is_set(words: Column, bit: Column) -> Column:
    word = F.get(words, F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def probe(keys: DataFrame, sizes: DataFrame, table: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(run_id, k)`` where every bit of the key is set; ``keys (run_id, k)`` are the runs
    that a read would open. A key meets each block of its run's filter that it has bits in."""
    s = sizes.select("run_id", "bf_bits", "bf_hashes")
    asked = keys.distinct().join(s, "run_id").select("run_id", "k", positions(F.col("k"), F.col("bf_bits"), F.col("bf_hashes")).alias("at"))
    block = lambda b: F.floor(b / size).cast("long")
    asked = asked.withColumn("in", F.array_distinct(F.transform("at", block))).withColumn("need", F.size("in")).withColumn("block", F.explode("in"))
    own = F.transform(F.filter("at", lambda b: block(b) == F.col("block")), lambda b: b % size)
    got = asked.join(blocks(sizes, table, size), ["run_id", "block"]).where(all_set(F.col("words"), own)).select("run_id", "k", "need")
    return got.groupBy("run_id", "k").agg(F.max("need").alias("need"), F.count("*").alias("have")).where("need = have").select("run_id", "k")


def with_filters(runs: DataFrame, sizes: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """``runs`` with ``bf_bits, bf_hashes`` and the whole filter as ``words``, which then go
    where the run goes. For filters of at most ``most`` bits; larger ones fail."""
    s = sizes.select("run_id", "bf_bits", "bf_hashes")
    fits = F.when(F.col("bf_bits") <= most, F.col("bf_bits")).otherwise(F.raise_error(F.lit("a filter is larger than its row")))
    s = s.withColumn("bf_bits", fits)
    return runs.join(s.join(blocks(sizes, table, most).drop("block"), "run_id"), "run_id", "left")


def most_hashes(rate: float) -> int:
    """Hashes of a filter for this rate at most, however many entries it has."""
    return max(1, math.ceil(LN2 * math.floor(1 - math.log(rate) / LN2**2)))


def passes(most: int) -> Column:
    """Whether the filter of a row from ``with_filters``, of at most ``most`` hashes, lets the
    key through that has the hashes ``x, y``. Said hash by hash, as Spark compiles no lambdas."""
    m, h = F.col("bf_bits"), F.col("bf_hashes")
    x, y = F.pmod(F.col("x"), m), F.pmod(F.col("y"), m)
    out = h <= most
    for i in range(most):
        bit = F.pmod(x + i * y, m)
        out = out & ((h <= i) | _is_set(F.col("words"), bit))
    return F.coalesce(out, F.lit(False))


def together(runs: DataFrame, sizes: DataFrame, rows: DataFrame, most: int, most_hashes: int, near: int = 1 << 10) -> DataFrame:
    """Runs side by side, up to ``LANES`` of following numbers, filters of one size and lowest
    keys that are near for the width of their ranges: ``run_id`` of the first place, ``min_k,
    max_k`` of all, ``lows, highs`` by place (null where none), ``bf_bits, bf_hashes`` and
    ``words``, which have for each bit of a filter the places of the runs that have it set by
    ``rows (run_id, k)``. For filters of at most ``most`` bits and ``most_hashes`` hashes;
    larger ones fail."""
    m, h = F.col("bf_bits"), F.col("bf_hashes")
    fits = F.when((m <= most) & (h <= most_hashes), m).otherwise(F.raise_error(F.lit("a filter is larger than its row")))
    wide = F.ceil(F.log2(F.col("max_k").cast("long") - F.col("min_k") + 1)).cast("int")
    cell = F.floor(F.col("min_k") / (F.pow(F.lit(2.0), wide) * near)).cast("long")
    place = F.pmod(F.col("run_id"), F.lit(LANES)).cast("int")
    s = sizes.where("bf_bits > 0").select("run_id", fits.alias("bf_bits"), "bf_hashes")
    lanes = runs.where("min_k is not null").join(s, "run_id").withColumns({"place": place, "first": F.col("run_id") - place, "wide": wide, "cell": cell})
    side = lanes.groupBy("first", "wide", "cell", "bf_bits", "bf_hashes").agg(F.min("run_id").alias("id"), F.min("min_k").alias("min_k"), F.max("max_k").alias("max_k"), F.collect_list(F.struct("place", "min_k", "max_k")).alias("x"))
    # The entries of a row of runs meet before they become bits, so few bits travel.
    own = side.select("id", "first", m, h, F.explode("x.place").alias("place")).withColumn("run_id", F.col("first") + F.col("place")).drop("first")
    own = rows.select("run_id", "k").join(own, "run_id").repartition("id")
    x, y = (F.pmod(x, m) for x in key_hashes(F.col("k")))
    at = F.array(*[F.when(h > i, F.pmod(x + i * y, m)) for i in range(most_hashes)])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    found = own.select("id", one.alias("at"), F.explode(at).alias("bit")).where("bit is not null").groupBy("id", "bit").agg(F.bit_or("at").alias("at"))
    none = side.select("id", F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("bit"), F.lit(0).cast("long").alias("at"))
    words = found.unionByName(none).groupBy("id", "bit").agg(F.bit_or("at").alias("at"))
    words = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bit", "at"))).alias("w"))
    ranges = F.map_from_entries(F.transform("x", lambda r: F.struct(r["place"], F.struct(r["min_k"], r["max_k"]))))
    side = side.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.try_element_at(ranges, i)))
    return side.join(words, "id").select(F.col("first").alias("run_id"), "min_k", "max_k", F.col("x.min_k").alias("lows"), F.col("x.max_k").alias("highs"), m, h, F.col("w.at").alias("words"))


def let_through(opened: DataFrame, most: int) -> DataFrame:
    """``(run_id, k)`` that pass, from keys with the hashes ``x, y`` beside rows of ``together``
    with filters of at most ``most`` hashes. A key reads a word a hash for all runs of a row."""
    m, h = F.col("bf_bits"), F.col("bf_hashes")
    x, y = F.pmod(F.col("x"), m), F.pmod(F.col("y"), m)
    hit = F.when(h <= most, F.lit(-1).cast("long"))
    for i in range(most):
        hit = hit.bitwiseAND(F.when(h > i, F.get("words", F.pmod(x + i * y, m).cast("int"))).otherwise(F.lit(-1).cast("long")))
    rows = opened.select("run_id", "k", "lows", "highs", hit.alias("hit"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(LANES)))).alias("place"))
    yes = F.call_function("shiftrightunsigned", F.col("hit"), F.col("place")).bitwiseAND(F.lit(1).cast("long")) == 1
    inside = (F.col("k") >= F.get("lows", F.col("place"))) & (F.col("k") <= F.get("highs", F.col("place")))
    return rows.where(yes & inside).select((F.col("run_id") + F.col("place")).alias("run_id"), "k")


def measured_reads(asked: DataFrame, real: DataFrame) -> DataFrame:
    """As ``measured``, from distinct reads ``asked (run_id, k, yes)`` and those of them whose
    key the run has, ``real (run_id, k, yes)``; only counts meet."""
    a = asked.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("yes").alias("hit"))
    r = real.groupBy("run_id").agg(F.count("*").alias("has"), F.count_if("yes").alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    x = a.join(r, "run_id", "left").select("run_id", "n", "hit", zero(F.col("tp")).alias("tp"), zero(F.col("has")).alias("has"))
    x = x.select("*", (F.col("hit") - F.col("tp")).alias("fp"), (F.col("has") - F.col("tp")).alias("fn"))
    return _rates(x.select("run_id", "tp", "fp", (F.col("n") - F.col("hit") - F.col("fn")).alias("tn"), "fn"))


def measured(keys: DataFrame, sizes: DataFrame, table: DataFrame, rows: DataFrame) -> DataFrame:
    """True and false positives by run, the false-discovery and the false-positive rate."""
    asked = keys.distinct()
    yes = probe(asked, sizes, table).withColumn("yes", F.lit(True))
    real = rows.select("run_id", "k").distinct().withColumn("real", F.lit(True))
    x = asked.join(yes, ["run_id", "k"], "left").join(real, ["run_id", "k"], "left")
    yes, real = F.coalesce("yes", F.lit(False)), F.coalesce("real", F.lit(False))
    by = x.groupBy("run_id").agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & ~real).alias("tn"), F.count_if(~yes & real).alias("fn"))
    return _rates(by)


def _rates(by: DataFrame) -> DataFrame:
    safe = lambda a, b: F.when(b > 0, a / b)
    return by.select("*", safe(F.col("fp"), F.col("fp") + F.col("tp")).alias("fdr"), safe(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def cost(b: float, n: int) -> float:
    return math.exp(-b / n * LN2**2)


def allocate(entries: list[int], total: float) -> list[float]:
    """Bits for each run that make the sum of false-positive rates least: the closed
    form; runs that would get less than none get none, and the rest is solved again."""
    c, active, out = LN2**2, set(range(len(entries))), [0.0] * len(entries)
    while active:
        n = sum(entries[i] for i in active)
        lam = -(total * c + sum(entries[i] * math.log(entries[i]) for i in active)) / n
        got = {i: -entries[i] / c * (lam + math.log(entries[i])) for i in active}
        bad = {i for i, b in got.items() if b < 0}
        if not bad:
            for i, b in got.items():
                out[i] = b
            break
        active -= bad
    return out


class _Shelf:
    """Numbers by index, the least first; equal ones lie together, the least index first."""

    def __init__(self, values: list[float]):
        self.now = values
        self.by: dict[float, list[int]] = {}
        for i, x in enumerate(values):
            self.by.setdefault(x, []).append(i)
        self.heap = list(self.by)
        heapq.heapify(self.heap)

    def put(self, i: int, x: float) -> None:
        self.now[i] = x
        if x not in self.by:
            self.by[x] = []
            heapq.heappush(self.heap, x)
        heapq.heappush(self.by[x], i)

    def _tidy(self) -> None:
        """Forget indices whose number is another by now, until the least has one."""
        while self.heap:
            own = self.by[self.heap[0]]
            while own and self.now[own[0]] != self.heap[0]:
                heapq.heappop(own)
            if own:
                return
            del self.by[heapq.heappop(self.heap)]

    def least(self) -> float:
        self._tidy()
        return self.heap[0]

    def first(self, fits) -> int:
        """The least index of a number that fits; those that fit come before all others."""
        out, seen = len(self.now), []
        while True:
            self._tidy()
            if not self.heap or not fits(self.heap[0]):
                break
            out = min(out, self.by[self.heap[0]][0])
            seen.append(heapq.heappop(self.heap))
        for x in seen:
            heapq.heappush(self.heap, x)
        return out


def allocate_greedy(entries: list[int], total: float) -> list[float]:
    """The same by moving ever smaller amounts between two runs while that helps: each time
    from the first run, to the first run, of those that help most. A move helps by what one
    run gains less what the other loses, so either is found by itself; no run gains more
    from bits than it loses with as many, so the two differ."""
    if not entries:
        return []
    out = [0.0] * len(entries)
    out[0] = float(total)
    delta = float(total)

    def loss(i):
        return math.inf if out[i] < delta else cost(out[i] - delta, entries[i]) - cost(out[i], entries[i])

    def less(i):
        return cost(out[i] + delta, entries[i]) - cost(out[i], entries[i])

    while delta > 1:
        lose, gain = (_Shelf([f(i) for i in range(len(out))]) for f in (loss, less))
        while True:
            low, high = lose.least(), -gain.least()
            best = high - low
            if not best > 1e-12:
                break
            i, j = lose.first(lambda x: high - x == best), gain.first(lambda x: -x - low == best)  # noqa: B023
            # Rounded differences may be equal where either number is not the best.
            j = j if -gain.now[j] - lose.now[i] == best else gain.first(lambda x: -x - lose.now[i] == best)  # noqa: B023
            out[i] -= delta
            out[j] += delta
            for at in (i, j):
                lose.put(at, loss(at))
                gain.put(at, less(at))
        delta /= 2
    return out
