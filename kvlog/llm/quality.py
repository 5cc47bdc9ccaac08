"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of each text feed random Fourier features that approximate a Gaussian
kernel. Each partition of the training rows sums its part of the normal equations; the
driver adds a fixed number of such sums and solves once. The raw scores of training
rows that took no part in the fit are then calibrated by isotonic regression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm.common import NULL_KEY, drop, save, ship
from kvlog.llm.text import _SEP, slices, words

#: Fourier features, ridge penalty, most labelled rows that a fit uses, partial sums.
FEATURES, PENALTY, SAMPLE, SUMS = 256, 1e-3, 200_000, 16
THRESHOLD = 0.3

NAMES = (
    "log_bytes log_words word_len upper lower digit stop_punct other_punct space lines not_ascii "
    "short long long_words distinct top_word first_upper all_upper marked digit_words repeat_lines bangs entropy utf"
).split()


def _per_text(hit: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[at])


def statistics(col: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text; all zero for a text without bytes."""
    w = words(col)
    d, off, many = w.data, w.off, np.diff(w.at)
    size, n = np.maximum(np.diff(off), 1), np.maximum(many, 1)
    kind = lambda lo, hi: (d >= lo) & (d <= hi)
    upper, lower, digit = kind(65, 90), kind(97, 122), kind(48, 57)
    ascii_ = d < 128
    punct = ascii_ & ~upper & ~lower & ~digit & ~_SEP[d] & (d > 32)
    stops = np.isin(d, np.frombuffer(b".,;:'\"-()?", np.uint8))
    sums = {k: _per_text(v, off) for k, v in (("upper", upper), ("lower", lower), ("digit", digit), ("stop", stops), ("other", punct & ~stops), ("space", _SEP[d]), ("lines", d == 10), ("high", ~ascii_), ("bang", d == 33), ("lead", d >= 0xC0))}
    lens = w.end - w.start
    by_word = lambda x: _per_text(x, w.at) / n
    cum = lambda x: np.concatenate([[0], np.cumsum(x)])
    ups, digs, odd = cum(upper), cum(digit), cum(punct & ~stops)
    up = ups[w.end] - ups[w.start]
    doc = w.doc
    order = np.lexsort((w.hash, doc))
    h, o = w.hash[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=len(many)) / n
    runs = np.diff(np.concatenate([np.flatnonzero(new), [len(h)]]))
    top = np.zeros(len(many))
    np.maximum.at(top, o[new], runs)
    spread = np.bincount(o[new], runs * np.log(np.maximum(runs, 1)), minlength=len(many)) / n
    text, again = d.tobytes(), np.zeros(len(many))
    for i in np.flatnonzero(sums["lines"] > 0).tolist():
        rows = [x for x in text[off[i] : off[i + 1]].split(b"\n") if x]
        again[i] = 1 - len(set(rows)) / max(len(rows), 1)
    x = np.stack([
        np.log1p(np.diff(off)), np.log1p(many), np.diff(off) / n, sums["upper"] / size, sums["lower"] / size, sums["digit"] / size,
        sums["stop"] / size, sums["other"] / size, sums["space"] / size, sums["lines"] / n, sums["high"] / size,
        by_word(lens <= 3), by_word(lens >= 13), np.log1p(_per_text(np.maximum(lens - 30, 0), w.at)), distinct, top / n,
        by_word(up > 0), by_word((up == lens) & (lens > 1)), by_word(odd[w.end] > odd[w.start]), by_word(digs[w.end] > digs[w.start]), again,
        sums["bang"] / n, np.log(n) - spread, sums["lead"] / size,
    ], axis=1)
    x[np.diff(off) == 0] = 0
    return x


def _stats(batches):
    for batch in batches:
        for b in slices(batch):
            x = statistics(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)), pa.array(x.ravel()))
            rest = [b.column(i) for i in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, *rest], ["k", "x", *b.schema.names[2:]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    values: np.ndarray  # calibrated

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        out = np.empty((len(x), len(self.phase) + 1))
        out[:, 1:] = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)
        out[:, 0] = 1
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing means of y in the order of x: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(y[np.argsort(x, kind="stable")].tolist(), weight[np.argsort(x, kind="stable")].tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    out = np.empty(len(x))
    out[np.argsort(x, kind="stable")] = np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])
    return out


def _matrix(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def fit(train: DataFrame, features: int = FEATURES, penalty: float = PENALTY) -> Model | None:
    """Fit on ``train (k, x, y)``; None without rows. A quarter of the rows, chosen by a
    hash of the key, takes no part in the fit and calibrates it. Where that quarter has no
    row, raw scores stand; where it has all, all scores are the mean of its labels."""
    spark = train.sparkSession
    train = save(train.withColumn("hold", F.pmod(F.xxhash64("k", F.lit(4)), F.lit(4)) == 0), "train")
    if train.isEmpty():
        return None
    moments = train.agg(*[f(F.col("x")[i]) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]).first()
    mean, dev = np.array(moments[::2], float), np.array(moments[1::2], float)
    rng = np.random.default_rng(11)
    model = Model(
        mean, np.where(dev > 1e-9, dev, 1.0), rng.normal(0, 1 / np.sqrt(len(NAMES)), (len(NAMES), features)), rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    shared = spark.sparkContext.broadcast(model)

    def normal(batches):
        m = shared.value
        a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                z, y = m.features(_matrix(batch, 0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                a += z.T @ z
                b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    sums = train.where(~F.col("hold")).select("x", "y").repartition(SUMS).mapInArrow(normal, "a binary, b binary").collect()
    a = sum(np.frombuffer(r.a).reshape(features + 1, -1) for r in sums)
    b = sum(np.frombuffer(r.b) for r in sums)
    model.weights = np.linalg.solve(a + np.eye(features + 1) * penalty * max(a[0, 0], 1.0), b)
    fitted = spark.sparkContext.broadcast(model)

    def raw(batches):
        for batch in batches:
            s = fitted.value.raw(_matrix(batch, 0)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1)], ["s", "y"])

    grid = train.where("hold").select("x", "y").mapInArrow(raw, "s double, y int").groupBy(F.round(F.greatest(F.least("s", F.lit(2.0)), F.lit(-1.0)), 4).alias("s"))
    grid = grid.agg(F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("s")  # 30,001 rows at most
    drop(train)
    if len(grid):
        model.knots = grid.s.to_numpy(float)
        model.values = isotonic(model.knots, grid.y.to_numpy(float), grid.n.to_numpy(float))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, learn=None, threshold: float = THRESHOLD, sample: int = SAMPLE, columns: list[str] | None = None, **options) -> DataFrame:
    """Per row of ``docs``: its columns, or those named, then ``score`` (0 to 1, higher is better) and
    ``predicted`` (1 from ``threshold`` on). Callers whose rows have columns of these names
    rename them first.

    ``labels (doc_id, quality)`` are learnt from where the condition ``learn`` on
    ``doc_id`` holds (all by default); rows with a null or other than 0 or 1 are
    left out, and of several labels for an id the greatest counts. Of more than ``sample``
    labels about that many are learnt from, chosen by a hash of the id. Without any label
    the score is 0.5. A null or empty text has statistics of zero and is scored so. Rows
    that repeat each other are scored each for itself, and learnt from as often.
    """
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    known = labels.where("quality in (0, 1) and doc_id is not null")
    if learn is not None:
        known = known.where(learn)
    known = save(known.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max("quality").cast("int").alias("y")), "labels")
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    # About ``sample`` rows of two numbers at most: broadcast, so texts stay where they are.
    train = docs.select(key, text).join(F.broadcast(known), "k").select("k", "text", "y")
    model = fit(train.mapInArrow(_stats, "k long, x array<double>, y int"), **options)
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns if columns is None else columns
    own = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]
    wide = docs.select(text, *own)
    fields = T.StructType([*wide.schema.fields[1:], T.StructField("score", T.DoubleType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            for b in slices(batch):
                s = model.score(statistics(b.column(0))) if model is not None else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s)], fields.names)

    out = wide.mapInArrow(run, fields)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
