"""Removal of passages that an earlier document already has.

Level-wise doubling. The first level looks at short windows of half the wanted
length. Of these it takes, for every wanted window, the one of least hash inside
it: equal windows have equal least parts, so a wanted window can only repeat if
its least part does, and about a quarter of all positions suffice. Only windows
whose part occurs in two documents go to the next level, which is twice as long
(the wanted length at most), and there the full window hashes are compared.
``repeats`` goes on doubling from there until no candidate survives.

Every step is a shuffle on 64-bit hashes with sums formed before it, so a passage
that a third of all documents share costs one row for each task and window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm.common import NULL_KEY, doc_id, drop, keyed, save, ship
from kvlog.llm.text import grams, signed, slices, words

WINDOW = 13


def _pairs(h: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(keys)], ["h", "k"])


def _least(w, window: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least hash of its parts, and the offsets by text."""
    g, at = grams(w, part)
    many = np.maximum(np.diff(w.at) - (window - 1), 0)
    to = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(at[:-1] - to[:-1], many) + np.arange(to[-1])
    low = g[first] if len(first) else np.zeros(0, np.uint64)
    for j in range(1, window - part + 1):
        np.minimum(low, g[first + j], out=low)
    return low, to


def _parts(window: int, part: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch):
                w = words(b.column(1))
                low, to = _least(w, window, part)
                own = np.repeat(b.column(0).to_numpy(), np.diff(to))
                new = np.ones(len(low), bool)
                new[1:] = low[1:] != low[:-1]
                new[to[:-1][np.diff(to) > 0]] = True
                yield _pairs(low[new], own[new])

    return run


def _found(col: pa.Array, owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether h is among the listed hashes of the row it belongs to."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lists = col.fill_null([]) if col.null_count else col
    known = lists.flatten().to_numpy().view(np.uint64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    salt = np.uint64(0x9E3779B97F4A7C15)
    # A hash counts only in its own row: both sides are mixed with the row's number.
    return np.isin(h ^ (owner.astype(np.uint64) * salt), known ^ (row.astype(np.uint64) * salt))


def _candidates(window: int, part: int, sampled: bool):
    """Windows that may repeat: their least part does, or (later levels) both halves do."""

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                w = words(b.column(1))
                g, at = grams(w, window)
                owner = np.repeat(np.arange(b.num_rows), np.diff(at))
                if sampled:
                    low, _ = _least(w, window, part)
                    keep = _found(b.column(2), owner, low)
                else:
                    short, short_at = grams(w, part)
                    row = np.repeat(np.arange(b.num_rows), np.diff(short_at))
                    ok = _found(b.column(2), row, short)
                    i = np.repeat(short_at[:-1] - at[:-1], np.diff(at)) + np.arange(len(g))
                    keep = ok[i] & ok[i + window - part] if len(i) else np.zeros(0, bool)
                yield _pairs(g[keep], b.column(0).to_numpy()[owner[keep]])

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """Hashes that occur in two documents at least, with the first of them."""
    low = rows.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    return low.where("first < last").select("h", "first")


def _level(docs: DataFrame, rows: DataFrame, repeated: DataFrame, window: int, part: int, sampled: bool, name: str) -> DataFrame:
    own = rows.join(repeated, "h").groupBy("k").agg(F.collect_set("h").alias("hs"))
    near = docs.join(own, "k").select("k", "text", "hs")
    return save(near.mapInArrow(_candidates(window, part, sampled), "h long, k long"), name)


def _windows(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Saved candidate windows ``(h, k)`` and the saved repeated ones ``(h, first)``."""
    part = max(1, (window + 1) // 2)
    parts = docs.mapInArrow(_parts(window, part), "h long, k long")
    short = save(_repeated(parts).select("h"), "repeat-part")
    rows = _level(docs, parts, short, window, part, True, "repeat-window")
    drop(short)
    return rows, save(_repeated(rows), "repeat-known")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, longest)``: for each document with a passage of ``window`` words or
    more that another document has too, the greatest length ``window * 2**i`` at
    which one of its windows repeats. Doubling ends when no candidate survives.
    """
    ship(docs.sparkSession)
    docs = keyed(docs)
    rows, known = _windows(docs, window)
    length, found = window, None
    while not known.isEmpty():
        level = rows.join(known, "h").select("k").distinct().withColumn("longest", F.lit(length).cast("long"))
        found = level if found is None else found.unionByName(level)
        rows = _level(docs, rows, known, 2 * length, length, False, "repeat-double")
        known, length = save(_repeated(rows), "repeat-known"), 2 * length
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, longest long")
    return found.groupBy("k").agg(F.max("longest").alias("longest")).select(doc_id(), "longest")


def _cut(window: int, with_text: bool, whole: list[str]):
    """``whole`` names the column that the text itself returns as, if any."""

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                w = words(b.column(1))
                g, at = grams(w, window)
                hit = _found(b.column(2), np.repeat(np.arange(b.num_rows), np.diff(at)), g)
                i = np.repeat(w.at[:-1] - at[:-1], np.diff(at)) + np.arange(len(g))
                i = i[hit]
                step = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(step, i, 1)
                np.add.at(step, i + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                many = np.diff(w.at)
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.at])
                raw = w.data.tobytes()
                digests, texts = [], []
                for row in range(b.num_rows):
                    lo, hi = w.at[row], w.at[row + 1]
                    if lost[row]:
                        stay = np.flatnonzero(~gone[lo:hi]) + lo
                        kept = b" ".join([raw[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())])
                    else:
                        kept = b" ".join(raw[w.off[row] : w.off[row + 1]].split())
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode() if lost[row] else None)
                place = pa.array(np.arange(b.num_rows), mask=b.column(3).to_numpy(zero_copy_only=False))
                text = [b.column(1).take(place).cast(pa.string()) for _ in whole]
                names = [*b.schema.names[4:], *whole, "n_words", "n_removed", "kept_sha256"]
                cols = [*b.columns[4:], *text, pa.array(many), pa.array(lost), pa.array(digests, pa.string())]
                if with_text:
                    cols.append(pa.array(texts, pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove every word that lies in a window whose words also start in a document
    of smaller id, as the input stands.

    Returns per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` (of the
    kept words joined by one space). With ``with_text``, all columns of ``docs`` and
    ``kept``: the kept words joined by one space where any word went, else null.

    Null and empty texts have no words: ``0, 0``, the digest of the empty text.
    Texts shorter than a window keep all. Rows of one ``doc_id`` never repeat each
    other, for neither id is smaller. A null id is smaller than all others.
    """
    ship(docs.sparkSession)
    # With texts, the other columns go along under names of our own; the text goes once.
    names = list(docs.columns) if with_text else ["doc_id"]
    whole = [f"_{i}" for i, f in enumerate(docs.schema.fields) if with_text and f.name.lower() == "text" and f.dataType == T.StringType()]
    rest = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names) if f"_{i}" not in whole]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    wide = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"), text, F.col("text").isNull().alias("none"), *rest)
    rows, known = _windows(keyed(docs), window)
    later = rows.join(known, "h").where("k > first").groupBy("k").agg(F.collect_set("h").alias("hs"))
    joined = wide.join(later, "k", "left")
    joined = joined.select("k", "text", "hs", *[c for c in wide.columns if c not in ("k", "text")])
    kinds = joined.schema.fields[4:] + [T.StructField(c, T.StringType()) for c in whole]
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.StringType())][: 4 if with_text else 3]
    out = joined.mapInArrow(_cut(window, with_text, whole), T.StructType([*kinds, *[T.StructField(n, t) for n, t in added]]))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], *[n for n, _ in added])
