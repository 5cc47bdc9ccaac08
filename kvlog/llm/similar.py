"""N-gram Jaccard join: which documents share at least a given part of their n-grams.

1. One pass over the texts gives each document its n-gram set (64-bit hashes), a
   128-bit digest of the set, and MinHash bands. Documents of equal sets form one
   class; one of them stands for all from here on.
2. A shuffle on band hashes ties every document to the least document of each
   bucket (a row for each member, never pairs). Their connected components are
   groups outside which no candidate lies.
3. Each group is checked on the full sets, all members against all, in blocks: a
   group of many n-grams is cut into blocks, and each pair of blocks is a task of its
   own. A block pair returns link counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.llm.common import doc_id, drop, keyed, save, ship
from kvlog.llm.text import U, grams, mix, signed, slices, words

N, THRESHOLD = 5, 0.8
#: Target: part of the pairs at the threshold that share a band.
RECALL = 0.9999
#: N-grams in one block of a group. A set counts as ``LEAST`` of them at least, which
#: bounds the sets of a block, whose links are a square.
BLOCK, LEAST = 60_000, 30


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, such
    that a pair at the threshold shares a band with probability ``recall`` and no more
    than ``most`` hashes are needed. Where that many don't do, one row a band, and as many
    bands as it takes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most or rows == 1:
            return bands, rows


def _sets(w, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, and their offsets by text. A text of
    one to n-1 words has one gram: all its words."""
    g, at = grams(w, n)
    many = np.diff(w.at)
    parts, counts = [g], np.diff(at)
    row = [np.repeat(np.arange(len(many)), counts)]
    for m in range(1, n):
        if (short := many == m).any():
            own, own_at = grams(w, m)
            at_most = own_at[:-1][short]
            parts.append(own[at_most])
            row.append(np.flatnonzero(short))
    h, r = np.concatenate(parts), np.concatenate(row)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(many) + 1))


def _digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    raw = h.tobytes()
    out = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _sketch(n: int, bands: int, rows: int):
    rng = np.random.default_rng(5)
    mult = rng.integers(0, 2**62, bands * rows, dtype=np.uint64) * U(2) + U(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                h, at = _sets(words(b.column(1)), n)
                full = np.flatnonzero(np.diff(at) > 0)
                keys = np.zeros((len(full), bands), U)
                for band in range(bands if len(full) else 0):
                    acc = np.full(len(full), U(band + 1))
                    for j in range(band * rows, (band + 1) * rows):
                        x = h * mult[j] + add[j]
                        x ^= x >> U(32)
                        x *= U(0xD6E8FEB86659FD93)
                        acc = mix(acc * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, at[full]))
                    keys[:, band] = acc
                sizes = np.zeros(b.num_rows, np.int64)
                sizes[full] = bands
                d = _digests(h, at)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.diff(at)), lists], ["k", "d1", "d2", "size", "bands"])

    return run


def _hashes(n: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch):
                h, at = _sets(words(b.column(1)), n)
                raw = h.tobytes()
                blobs = [raw[8 * x : 8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(blobs, pa.binary())], ["k", "comp", "blocks", "copies", "grams"])

    return run


def _links(sets: list[np.ndarray], group: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets reach the threshold, as a square of booleans; in ``group`` 0
    and 1 only pairs across, in one group all."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = many >= 2
    number = np.cumsum(twice) - 1
    row, col = row[twice[col]], number[col[twice[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, 4_000_000 // max(1, len(sets)))
    for lo in range(0, int(twice.sum()), step):
        a, b = np.searchsorted(col, (lo, lo + step))
        x = np.zeros((len(sets), step), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        both += x @ x.T
    total = size[:, None] + size[None, :] - both
    ok = both >= threshold * total - 1e-6
    np.fill_diagonal(ok, False)
    if group.any() and not group.all():
        ok &= group[:, None] != group[None, :]
    return ok


def _forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the matrix joins."""
    left, out = set(range(len(ok))), []
    while left:
        todo = [left.pop()]
        while todo:
            i = todo.pop()
            near = [j for j in np.flatnonzero(ok[i]).tolist() if j in left]
            left.difference_update(near)
            out += [(i, j) for j in near]
            todo += near
    return out


def _verify(threshold: float):
    def check(key, rows):
        rows = list({(x[3], x[4]): x for x in rows}.values())  # repeated rows are in ``copies``
        sets = [np.frombuffer(x[4], U) for x in rows]
        k = [x[3] for x in rows]
        copies = np.array([x[5] for x in rows], np.int64)
        side = np.array([x[6] == key[2] for x in rows]) if key[1] != key[2] else np.ones(len(rows), bool)
        ok = _links(sets, side, threshold)
        counts = ok @ copies
        for i in np.flatnonzero(counts).tolist():
            yield k[i], k[i], int(counts[i])
        for i, j in _forest(ok):
            if k[i] != k[j]:
                yield max(k[i], k[j]), min(k[i], k[j]), 0

    def run(batches):
        key, rows = None, []
        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*cols):
                if row[:3] != key:
                    if len(rows) > 1:
                        out += check(key, rows)
                    key, rows = row[:3], []
                rows.append(row)
            yield _edges(out)
        yield _edges(list(check(key, rows)) if len(rows) > 1 else [])

    return run


def _edges(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "links"])


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every node that has an edge and is not the least of its component,
    with the least. Large-star and small-star steps in turn until nothing changes; each
    round is written to the shared folder.

    What is joined to the edges of a node is written first: with plain scans on both
    sides the planner can split the edges of a node that has very many."""

    def mark(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = mark(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = save(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = mark(new)
        for x in (e, low, large, least):
            drop(x)
        e = new
        if now == was:
            break
        was = now
    return e


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``; ``class_id``, the least id that a
    chain of links reaches; ``set_id``, the least id with the same n-gram set;
    ``n_links``, how many other documents have at least ``threshold`` of the joint
    n-grams in common, copies counted.

    Documents of equal n-gram sets are linked whatever their number, and so are all
    those without words (null, empty and blank texts). Texts of fewer than n words have
    one n-gram: all their words. Rows that repeat a ``doc_id`` share its class.
    """
    ship(docs.sparkSession)
    docs = keyed(docs)
    bands, rows = bands_for(threshold, recall)
    sketch = save(docs.mapInArrow(_sketch(n, bands, rows), "k long, d1 long, d2 long, size long, bands array<long>"), "sketch")
    sets = sketch.groupBy("d1", "d2").agg(F.min("k").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("bands").alias("bands"))
    sets = save(sets, "sets")
    member = sets.select("rep", F.explode("bands").alias("band"))
    bucket = member.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band", "low")
    bucket = save(bucket, "buckets")
    tied = components(member.join(bucket, "band").where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v")))
    comp = tied.select(F.col("u").alias("rep"), F.col("v").alias("comp")).unionByName(tied.select(F.col("v").alias("rep"), F.col("v").alias("comp")).distinct())
    one = sets.groupBy("rep").agg(F.max("copies").alias("copies"), F.sum(F.greatest("size", F.lit(LEAST))).alias("size"))
    comp = grouped = save(comp.join(one, "rep"), "groups")
    drop(tied, bucket)
    cut = comp.groupBy("comp").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / block)).cast("int").alias("blocks"))
    comp = comp.join(cut, "comp").select(F.col("rep").alias("k"), "comp", "blocks", "copies")
    full = docs.join(comp.hint("merge"), "k").select("k", "text", "comp", "blocks", "copies").mapInArrow(_hashes(n), "k long, comp long, blocks int, copies long, grams binary")
    own = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    full = full.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    full = full.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "k", "grams", "copies", "own")
    found = full.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_verify(threshold), "u long, v long, links long")
    found = save(found, "links")
    drop(grouped)
    final = components(found.where("links = 0").select("u", "v"))
    links = found.where("links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    known = sets.select("d1", "d2", "rep", "copies").join(final.select(F.col("u").alias("rep"), F.col("v").alias("label")), "rep", "left")
    known = save(known.join(links.select(F.col("u").alias("rep"), "links"), "rep", "left"), "known")
    drop(sets, final, found)
    out = sketch.select("k", "d1", "d2").join(known, ["d1", "d2"])

    def id_of(c):
        return F.when(c != F.lit(-(2**63)), c)

    return out.select(
        doc_id(),
        id_of(F.coalesce("label", "rep")).alias("class_id"),
        id_of(F.col("rep")).alias("set_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
