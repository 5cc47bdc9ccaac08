"""Exact top-k by inner product: a KD-tree for each shard of the vectors.

A tree halves its shard at the median of the widest side until leaves are small; each
node has a tight bounding box. The greatest inner product of a query with a box is a sum
over the components of the better of its two corners, so nodes are visited best first
and the search ends when no node left can beat the kth score found. A query first
searches the shard it lies in; the kth score from there goes along to the others, and only
to those whose outermost box can beat it.

Vectors whose products might not be exact as doubles lie in shards of their own; there,
and for such queries, all sums are of Python's integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlog.llm.common import drop, save, ship

#: Vectors in a shard and in a leaf, queries in a block.
SHARD, LEAF, BLOCK = 16_384, 128, 1024
#: Bytes of outermost boxes that the driver may hand to all tasks.
BOXES = 64 << 20
_LOW, _HIGH = -(2**63), 2**63 - 1


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, low, high): rows of ``nodes`` are begin, end, left, right (0: a leaf)."""
    order = np.arange(len(x))
    nodes, low, high = [[0, len(x), 0, 0]], [x.min(0)], [x.max(0)]
    todo = [0]
    while todo:
        i = todo.pop()
        a, b = nodes[i][:2]
        side = high[i] - low[i]
        if b - a <= leaf or not side.any():
            continue
        mid = (a + b) // 2
        own = order[a:b]
        order[a:b] = own[np.argpartition(x[own, int(side.argmax())], mid - a)]
        for slot, (lo, hi) in ((2, (a, mid)), (3, (mid, b))):
            nodes[i][slot] = len(nodes)
            todo.append(len(nodes))
            part = x[order[lo:hi]]
            nodes.append([lo, hi, 0, 0])
            low.append(part.min(0))
            high.append(part.max(0))
    return order, np.array(nodes), np.array(low), np.array(high)


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Greatest inner product of each query with a point of each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def search(q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, x: np.ndarray, ids: np.ndarray, tree, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the k best of the shard for each query, without its own
    row and without those below its ``kth`` (the least long: no bound); ties to the smaller id."""
    nodes, low, high = tree
    bound = _bounds(q, low, high)
    shape = nodes.tolist()
    out = []
    for i, me in enumerate(q_ids.tolist()):
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        least = int(kth[i]) if kth[i] > _LOW else -float("inf")
        heap = [(-bound[i, 0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:
                break
            a, b, left, right = shape[node]
            if left:
                for c in (left, right):
                    if bound[i, c] >= least:
                        heapq.heappush(heap, (-bound[i, c], c))
                continue
            scores = x[a:b] @ q[i]
            for j in np.flatnonzero(scores >= least).tolist():
                if ids[a + j] == me:
                    continue
                item = (int(scores[j]), -int(ids[a + j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                least = max(least, best[0][0])
        out += [(me, -v, s) for s, v in best]
    return out


_whole = np.frompyfunc(int, 1, 1)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """As doubles where all sums of products stay exact, else as Python's integers."""
    most = [max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)]
    wide = max((a.shape[1] for a in arrays), default=0)
    return list(arrays) if most[0] ** 2 * max(wide, 1) < 2.0**53 else [_whole(a) if a.size else a for a in arrays]


def _vectors(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(len(col), -1))


def _plant(key, rows):
    x = _vectors(rows.column("v").combine_chunks())
    ids = rows.column("vec_id").to_numpy()
    if x.shape[1]:
        order, nodes, low, high = build(x)
    else:
        order, nodes, low, high = np.arange(len(x)), np.array([[0, len(x), 0, 0]]), x[:1], x[:1]
    body = [a.astype(kind).tobytes() for a, kind in ((ids[order], "<i8"), (x[order], "<f8"), (nodes, "<i8"), (low, "<f8"), (high, "<f8"))]
    box = [pa.array([a[0].tolist()], pa.list_(pa.float64())) for a in (low, high)]
    return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "shard": [key[1].as_py()], **{n: pa.array([b], pa.binary()) for n, b in zip(("ids", "vecs", "nodes", "low", "high"), body)}, "box_low": box[0], "box_high": box[1]})


_TREE = "dim int, shard long, ids binary, vecs binary, nodes binary, low binary, high binary, box_low array<double>, box_high array<double>"
#: Enough bytes for any product of doubles: scores beyond 64 bits are ordered by them.
_WIDE = 272


def _seek(k: int):
    def run(batches):
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                get = lambda n, kind="<i8": np.frombuffer(batch.column(batch.schema.get_field_index(n))[r].as_py(), kind)  # noqa: B023, E731
                dim, ids = batch.column(0)[r].as_py(), get("ids")
                block = batch.column(batch.schema.get_field_index("block"))[r].values
                arrays = [get(n, "<f8").reshape(-1, dim) if dim else np.zeros((m, 0)) for n, m in (("vecs", len(ids)), ("low", 1), ("high", 1))]
                x, low, high, q = _exact(*arrays, _vectors(block.field("v")) if dim else np.zeros((len(block), 0)))
                kth = block.field("kth").to_numpy(zero_copy_only=False)
                found += search(q, block.field("vec_id").to_numpy(), kth, x, ids, (get("nodes").reshape(-1, 4), low, high), k)
            q, v, s = (list(c) for c in zip(*found)) if found else ([], [], [])
            wide = [(x + (1 << 8 * _WIDE - 1)).to_bytes(_WIDE, "big") if abs(x) >= 2**62 else None for x in s]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (q, v, [min(max(x, _LOW), _HIGH) for x in s])], pa.array(wide, pa.binary())], ["query_id", "vec_id", "score", "wide"])

    return run


def _send(boxes: list):
    """Each query to the other shards whose box can beat its kth score. Bounds of wide
    shards or queries aren't exact as doubles: those are searched."""
    by_dim: dict[int, list] = {}
    for b in boxes:
        by_dim.setdefault(b.dim, []).append(b)
    sides = {d: (np.array([b.shard for b in of]), np.array([b.box_low for b in of]).reshape(len(of), -1), np.array([b.box_high for b in of]).reshape(len(of), -1)) for d, of in by_dim.items()}

    def run(batches):
        for batch in batches:
            dims, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            kth = batch.column(4).to_numpy()
            row, to = [], []
            for d in np.unique(dims).tolist():
                shard, low, high = sides[d]
                rows = np.flatnonzero(dims == d)
                q = _vectors(batch.column(3).take(pa.array(rows))) if d else np.zeros((len(rows), 0))
                with np.errstate(over="ignore", invalid="ignore"):
                    fits = ~(_bounds(q, low, high) < kth[rows, None]) | (shard < 0)[None, :] | (own[rows] < 0)[:, None] | (kth[rows] == _LOW)[:, None]
                fits &= shard[None, :] != own[rows, None]
                i, j = np.nonzero(fits)
                row.append(rows[i])
                to.append(shard[j])
            row = np.concatenate([np.zeros(0, np.int64), *row])
            cols = [batch.column(i).take(pa.array(row)) for i in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([cols[0], pa.array(np.concatenate([np.zeros(0, np.int64), *to])), *cols[1:]], ["dim", "shard", "vec_id", "v", "kth"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, shard: int = SHARD, boxes: int = BOXES) -> DataFrame:
    """For each row of ``vectors (vec_id, embedding)`` where ``is_query`` holds, the k
    other rows of greatest integer inner product: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``. Rows with a null id, a null vector or a
    null or non-finite component (also once scaled) take no part; vectors meet those of
    their own length only. Ties go to the smaller ``vec_id``. Rows that repeat a ``vec_id``
    with equal vectors are one; with different ones, each is searched and found for itself.
    Scores are exact whatever the components; one that 64 bits can't hold is ranked as it
    is and returned as the nearest that they can.
    """
    spark = vectors.sparkSession
    ship(spark)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    v = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & fine)
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)) + F.lit(0.0)).alias("v"), is_query.alias("asks"))
    v = save(v.distinct(), "vectors")
    dim = F.size("v")
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)) + 1
    wide = most * most * dim >= 2.0**53
    n_wide, total, n = v.agg(F.count_if(wide), F.count("*"), F.count_if("asks")).first()
    shards, wides = (max(1, -(-x // shard)) for x in (total - n_wide, n_wide))
    at = F.xxhash64("vec_id", F.lit(7))
    place = F.when(wide, -1 - F.pmod(at, F.lit(wides))).otherwise(F.pmod(at, F.lit(shards)))
    v = v.withColumn("dim", dim).withColumn("shard", place.cast("long"))
    trees = save(v.select("dim", "shard", "vec_id", "v").groupBy("dim", "shard").applyInArrow(_plant, _TREE), "trees")
    least = F.lit(_LOW).cast("long")
    asks = v.where("asks").select("dim", "shard", "vec_id", "v")
    got = ["dim", "shard", "block", "ids", "vecs", "nodes", "low", "high"]

    def found(queries: DataFrame, name: str) -> DataFrame:
        block = F.floor(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, -(-n // BLOCK)))))
        rows = queries.groupBy("dim", "shard", block.alias("b")).agg(F.collect_list(F.struct("vec_id", "v", "kth")).alias("block"))
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row holds a whole shard
        try:
            return save(rows.join(trees, ["dim", "shard"]).select(*got).mapInArrow(_seek(k), "query_id long, vec_id long, score long, wide binary"), name)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    home = found(asks.withColumn("kth", least), "home")
    best = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("low")).otherwise(least).alias("kth"))
    rest = asks.join(best, "vec_id", "left").withColumn("kth", F.coalesce("kth", least)).withColumnRenamed("shard", "own")
    outer = trees.select("dim", "shard", "box_low", "box_high")
    if (outer.agg(F.sum(F.col("dim") * 16 + 32)).first()[0] or 0) <= boxes:
        rest = rest.select("dim", "own", "vec_id", "v", "kth").mapInArrow(_send(outer.collect()), "dim int, shard long, vec_id long, v array<double>, kth long")
    else:
        every = F.sequence(F.lit(-wides), F.lit(shards - 1)).cast("array<bigint>")
        rest = rest.withColumn("shard", F.explode(every)).where("shard <> own").drop("own")
    away = found(rest, "away")
    drop(trees)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    both = home.unionByName(away).distinct()
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
