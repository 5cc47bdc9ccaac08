"""Language-model scores by a hierarchical Pitman-Yor model.

A text is its words and one end token. The restaurant that seats a token is that of
the token before it: every training word has its own, and so has the start of a text.
All share the unigram restaurant as parent, whose base is uniform over the training
words and one more. Seatings are sampled by Gibbs sweeps that move one customer at a time
(``seating``); a token's probability is the mean of its predictive probability over the
samples kept.

Words get numbers by falling training count, dealt to node shards by their hash. A node
shard holds for its words the training count, the tables of the word's own restaurant and
the word's seating in the parent; a pair shard holds pairs (word, word before it), dealt by
a hash of both, with their seatings. So no word, however frequent, gathers its pairs in
one task. In each sweep node shards tell pair shards the parent's probabilities and the
tables of restaurants, pair shards move customers and tell back how many tables came or
went. Pairs that occur once have one table and are not moved. The driver sees two sums a
sweep. Documents stay in chunks, which ask each shard once for what they score with.

Messages are rows ``shard, other, a..f``: to which shard, from whom, and packed arrays.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlog.llm.common import NULL_KEY, doc_id, drop, partitions, save, ship
from kvlog.llm.seating import start, sweep
from kvlog.llm.text import U, ascending, distinct, give_back, mix, slices, words

#: Sweeps before the first sample, samples.
BURN_IN, SAMPLES = 3, 3
#: Concentrations of the root and of the other restaurants.
ROOT_THETA, THETA = 1.0, 1.0
#: Bytes of text in a chunk, and for each shard.
CHUNK = SHARD = 8 << 20
_END = mix(np.array([0x5EED], U))[0]
_START = mix(np.array([0x57A7], U))[0]

_LETTERS = "abcdef"
_SQL = "shard int, other long, " + ", ".join(f"{x} binary" for x in _LETTERS) + ", stats array<long>"
_SCHEMA = pa.schema([("shard", pa.int32()), ("other", pa.int64()), *[(x, pa.binary()) for x in _LETTERS], ("stats", pa.list_(pa.int64()))])
#: ``other`` of the row that is a shard's own state.
_OWN = -1


def _rows(rows: list[tuple]) -> pa.Table:
    full = [(*r[:8], *[None] * (8 - len(r)), r[8] if len(r) > 8 else None) for r in rows]
    cols = list(zip(*full)) if full else [[]] * 9
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_SCHEMA, cols)})


_squeezer, _expander = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(x, kind: str = "<i8") -> bytes:
    """Compressed byte by byte: the high bytes of small numbers cost nothing. The first
    byte tells of whole numbers that are kept in four bytes."""
    a = np.ascontiguousarray(x, kind)
    top = int(a.max()) if kind == "<i8" and len(a) else 2**32
    short = 0 <= top < 2**32 and a.min() >= 0
    if short:
        a = a.astype("<u4")
    out = np.zeros((a.itemsize, len(a)), np.uint8)
    raw = a.view(np.uint8).reshape(-1, a.itemsize)
    for k in range((top.bit_length() + 7) // 8 if short else a.itemsize):
        out[k] = raw[:, k]
    return bytes([bool(short)]) + _squeezer.compress(out)


def expand(data: bytes, kind: str = "<i8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(_expander.decompress(memoryview(data)[1:]), np.uint8).reshape(4 if data[0] else size, -1)
    out = np.zeros((raw.shape[1], size), np.uint8)
    for k, own in enumerate(raw[:size]):
        if own.any():
            out[:, k] = own
    return out.reshape(-1).view(kind)


def _rising(x) -> bytes:
    return squeeze(np.diff(x, prepend=x[:1] * 0))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data))


def _chunks(batches):
    """(keys, training flags, token hashes, offsets) of about CHUNK bytes of text."""
    keys, train, hashes, sizes, size = [], [], [], [], 0
    for batch in batches:
        for b in slices(batch):
            w = words(b.column(1), lower=True)
            keys.append(b.column(0).to_numpy())
            train.append(b.column(2).to_numpy(zero_copy_only=False).astype(bool))
            hashes.append(np.insert(w.hash, w.at[1:], _END))
            sizes.append(np.diff(w.at) + 1)
            size += len(w.data)
            if size >= CHUNK:
                yield tuple(map(np.concatenate, (keys, train, hashes, sizes)))
                keys, train, hashes, sizes, size = [], [], [], [], 0
    if keys:
        yield tuple(map(np.concatenate, (keys, train, hashes, sizes)))


def _words(shards: int):
    """For each chunk a row with its tokens as numbers of its distinct words, and for each
    node shard a row with the words it names. The start counts as often as it is a context."""

    def run(batches):
        for keys, train, h, sizes in _chunks(batches):
            word, token = distinct(np.append(h, _START))
            first, token = token[-1], token[:-1]
            seen = np.bincount(token, np.repeat(train, sizes), len(word)).astype(np.int64)
            seen[first] = train.sum()
            chunk = uuid.uuid4().int >> 65
            cuts = [0, *np.searchsorted(word, _edges(shards)).tolist(), len(word)]
            out = [(-1, chunk, squeeze(keys), squeeze(sizes, "<u4"), squeeze(train, "u1"), squeeze(token, "<u4"), squeeze(np.diff(cuts), "<u4"), squeeze([first]))]
            for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    out.append((q, chunk, squeeze(np.diff(word[a:b], prepend=U(0)), "<u8"), squeeze(seen[a:b], "<u4")))
            yield from _rows(out).to_batches()

    return run


def _edges(shards: int) -> np.ndarray:
    """First hash of each node shard but the first."""
    return np.array([i * 2**64 // shards for i in range(1, shards)], U)


def _name(key, rows):
    """Numbers within the shard and training counts for the words of each chunk; the own
    row has the counts by number, and words, training words and training tokens."""
    give_back()
    chunks = rows.column("other").to_pylist()
    hs = [np.cumsum(expand(x, "<u8"), dtype=U) for x in rows.column("a").to_pylist()]
    word, at = distinct(np.concatenate(hs))
    count = np.bincount(at, np.concatenate([expand(x, "<u4") for x in rows.column("b").to_pylist()]), len(word)).astype(np.int64)
    falling = np.argsort(-count, kind="stable")
    number = np.empty(len(word), np.int64)
    number[falling] = np.arange(len(word))
    real = word != _START
    q, cuts = key[0].as_py(), np.cumsum([0, *map(len, hs)])
    out = [(q, _OWN, squeeze(count[falling]), None, None, None, None, None, [int((count[real] > 0).sum()), int(count[real].sum())])]
    for chunk, a, b in zip(chunks, cuts, cuts[1:]):
        out.append((q, chunk, squeeze(number[at[a:b]]), squeeze(count[at[a:b]])))
    return _rows(out)


def _pairs(token: np.ndarray, sizes: np.ndarray, first: int, many: int):
    """Distinct (word, context) pairs of a chunk and each token's pair."""
    before = np.append(first, token[:-1])
    before[np.cumsum(sizes)[:-1]] = first
    pair, at = distinct(token * np.int64(many) + before)
    return pair // many, pair % many, at


def _pair_shard(w: np.ndarray, u: np.ndarray, shards: int) -> np.ndarray:
    return (mix(mix(w.astype(U)) + u.astype(U) * U(0x9E3779B97F4A7C15)) % U(shards)).astype(np.int32)


def _ask(shards: int):
    """Chunks with their words by number (a number is ``place * shards + shard``), and what
    they ask: pairs of the pair shards, with their training counts."""

    def run(key, chunk, names):
        give_back()
        names = names.take(np.argsort(names.column("shard").to_numpy()))
        get = lambda n, kind="<i8": expand(chunk.column(n)[0].as_py(), kind)
        place = np.concatenate([expand(x) for x in names.column("a").to_pylist()])
        count = np.concatenate([expand(x) for x in names.column("b").to_pylist()])
        own = np.repeat(np.arange(shards), get("e", "<u4"))
        gid = place * shards + own
        rising = ascending(gid)
        rank = np.empty(len(gid), np.int64)
        rank[rising] = np.arange(len(gid))
        gid, count, token, first = gid[rising], count[rising], rank[get("d", "<u4")], int(rank[get("f")[0]])
        sizes, train, chunk_id = get("b", "<u4").astype(np.int64), get("c", "u1"), key[0].as_py()
        out = [(-1, chunk_id, chunk.column("a")[0].as_py(), chunk.column("b")[0].as_py(), squeeze(token, "<u4"), _rising(gid), squeeze(count), squeeze([first]))]
        w, u, at = _pairs(token, sizes, first, len(gid))
        seen = np.bincount(at, np.repeat(train, sizes), len(w)).astype(np.int64)
        w, u = gid[w], gid[u]
        for p, i in _by(_pair_shard(w, u, shards), shards):
            out.append((p, chunk_id, _rising(w[i]), squeeze(u[i]), squeeze(seen[i], "<u4")))
        return _rows(out)

    return run


def _by(shard: np.ndarray, shards: int):
    """Places of the rows of each shard, in order."""
    order = np.argsort(shard.astype(np.uint16) if shards < 2**16 else shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def _learn(key, rows):
    """One shard of pairs: words, contexts and training counts, in order of the first two."""
    give_back()
    w = np.concatenate([_risen(x) for x in rows.column("a").to_pylist()])
    u = np.concatenate([expand(x) for x in rows.column("b").to_pylist()])
    n = np.concatenate([expand(x, "<u4") for x in rows.column("c").to_pylist()]).astype(np.int64)
    at = np.flatnonzero(n)
    at = at[_order(w[at], u[at])]
    w, u, n = w[at], u[at], n[at]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
    n = np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
    return _rows([(key[0].as_py(), _OWN, _rising(w[new]), squeeze(u[new]), squeeze(n), None, None, None, [int((n == 1).sum()), int((n == 2).sum())])])


def _order(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Order of pairs; as one number each, where they are small enough."""
    many = int(u.max()) + 1 if len(u) else 1
    if len(w) and (int(w.max()) + 1) * many < 2**63:
        return ascending(w * many + u)
    return np.lexsort((u, w))


def _model(row_a, row_b, row_c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _risen(row_a), expand(row_b), expand(row_c)


def _sides(w: np.ndarray, u: np.ndarray, shards: int):
    """The distinct numbers of either side by node shard, and each pair's place in the list."""
    out = []
    for x in (w, u):
        ids, at = np.unique(x, return_inverse=True)
        order = np.lexsort((ids, ids % shards))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        out.append((ids[order], place[at]))
    return out


def _introduce(shards: int):
    """What a pair shard tells the node shards at first: pairs by word and by context, and
    the words and contexts whose news it wants, those of pairs that can move."""

    def run(batches):
        for batch in batches:
            for p, *abc in zip(*[batch.column(n).to_pylist() for n in ("shard", "a", "b", "c")]):
                w, u, n = _model(*abc)
                many = n > 1
                out: dict[int, list] = {}
                for slot, x in enumerate((w, u)):
                    ids, number = np.unique(x, return_counts=True)
                    for q, i in _by(ids % shards, shards):
                        out.setdefault(q, [None] * 6)[2 * slot : 2 * slot + 2] = _rising(ids[i] // shards), squeeze(number[i])
                for slot, (ids, _) in enumerate(_sides(w[many], u[many], shards)):
                    for q, i in _by(ids % shards, shards):
                        out[q][4 + slot] = _rising(ids[i] // shards)
                yield from _rows([(q, p, *x) for q, x in out.items()]).to_batches()

    return run


_STATE = "shard int, counts binary, tables binary, customers binary, seats binary, sizes binary, kept array<binary>, who array<int>, words array<binary>, contexts array<binary>, stats array<long>"
_STATE_ARROW = pa.schema([("shard", pa.int32()), *[(n, pa.binary()) for n in ("counts", "tables", "customers", "seats", "sizes")], ("kept", pa.list_(pa.binary())), ("who", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())), ("contexts", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64()))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(schema, cols)})


def _node(key, rows):
    """The first state of a node shard: one table a pair."""
    give_back()
    other = rows.column("other").to_pylist()
    at = other.index(_OWN)
    counts = expand(rows.column("a")[at].as_py())
    customers, tables = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    who, lists = [], ([], [])
    for i in np.argsort(other).tolist():
        if i == at:
            continue
        a, b, c, d, e, f = (rows.column(n)[i].as_py() for n in _LETTERS)
        for x, y, to in ((a, b, customers), (c, d, tables)):
            if x is not None:
                to[_risen(x)] += expand(y)
        if e is not None or f is not None:
            who.append(other[i])
            lists[0].append(e)
            lists[1].append(f)
    return _table([(key[0].as_py(), squeeze(counts), squeeze(tables), squeeze(customers), None, None, [], who, *lists, [0, int(customers.sum())])], _STATE_ARROW)


class Totals:
    """What all shards share: discounts, training words, customers and tables of the root."""

    def __init__(self, types: int, tokens: int, one: int, two: int, customers: int, tables: int, root_d: float = 0.5):
        self.types, self.tokens, self.customers, self.tables = types, tokens, customers, tables
        self.d = float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))
        self.root_d = root_d

    def root_weight(self) -> float:
        """Weight of a new table of the root."""
        return (ROOT_THETA + self.root_d * self.tables) / (self.types + 1)

    def parent(self, m: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The parent's probabilities of words with m customers at r tables."""
        return (np.maximum(m - self.root_d * r, 0) + self.root_weight()) / (ROOT_THETA + self.customers)

    def rest(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """What restaurants leave to the parent."""
        return (THETA + self.d * tables) / (THETA + customers)


def _tell(totals: Totals):
    """A node shard's news for each pair shard that wants them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda n: batch.column(batch.schema.get_field_index(n))[i].as_py()  # noqa: B023, E731
                m, tables = expand(get("customers")), expand(get("tables"))
                r = expand(get("seats")) if get("seats") is not None else np.minimum(m, 1)
                base = totals.parent(m, r)
                out = []
                for p, w, u in zip(get("who"), get("words"), get("contexts")):
                    news = [squeeze(x[_risen(at)], kind) if at is not None else None for x, at, kind in ((base, w, "<f8"), (tables, u, "<i8"))]
                    out.append((p, get("shard"), *news))
                yield from _rows(out).to_batches()

    return run


def _move(totals: Totals, number: int, keep: bool, shards: int):
    """A sweep over one shard of pairs. Own rows: places of words and contexts in the lists
    of news, counts; tables, sizes and the sum of the tables in the samples kept; how many
    words and how many contexts each node shard tells of."""

    def run(key, rows):
        give_back()
        p, other = key[0].as_py(), rows.column("other").to_pylist()
        at = other.index(_OWN)
        a, b, c, d, e, f, many = (rows.column(n)[at].as_py() for n in (*_LETTERS, "stats"))
        w_at, u_at, n = expand(a), expand(b), expand(c)
        order = [i for i in np.argsort(other).tolist() if i != at]
        news = [np.concatenate([np.zeros(0), *[expand(x.as_py(), kind) for i in order if (x := rows.column(name)[i]).is_valid]]) for name, kind in (("a", "<f8"), ("b", "<i8"))]
        weight = (THETA + totals.d * news[1][u_at]) * news[0][w_at]
        rng = np.random.default_rng([number, p])
        t, sizes = (expand(d), expand(e)) if d is not None else start(n, weight, totals.d, rng)
        old = np.ones(len(n), np.int64) if d is None else t
        t, sizes = sweep(t, sizes, weight, totals.d, rng)
        total = (expand(f) if f is not None else np.zeros(len(n), np.int64)) + (t if keep else 0)
        out = [(p, _OWN, a, b, c, squeeze(t), squeeze(sizes), squeeze(total), many)]
        sent: dict[int, list] = {}
        for slot, place in enumerate((w_at, u_at)):
            ends = np.cumsum([0, *many[slot * shards : (slot + 1) * shards]])
            change = np.bincount(place, t - old, ends[-1]).astype(np.int64)
            for q in np.flatnonzero(np.diff(ends)).tolist():
                sent.setdefault(q, [None, None])[slot] = squeeze(change[ends[q] : ends[q + 1]])
        return _rows(out + [(-1 - q, p, *x) for q, x in sent.items()])

    return run


def _update(totals: Totals, number: int, keep: bool):
    """A node shard takes up what the pair shards tell, and moves the parent's customers."""

    def run(key, state, told):
        give_back()
        get = lambda n: state.column(n)[0].as_py()
        tables, m = expand(get("tables")).copy(), expand(get("customers"))
        change = np.zeros(len(m), np.int64)
        told = dict(zip(told.column("other").to_pylist(), zip(told.column("a").to_pylist(), told.column("b").to_pylist())))
        for p, w, u in zip(get("who"), get("words"), get("contexts")):
            for at, x, to in zip((w, u), told.get(p, (None, None)), (change, tables)):
                if at is not None and x is not None:
                    to[_risen(at)] += expand(x)
        rng = np.random.default_rng([number, key[0].as_py(), 1])
        weight = np.full(len(m), totals.root_weight())
        if get("seats") is None:
            seats, sizes = start(m + change, weight, totals.root_d, rng)
        else:
            seats, sizes = sweep(expand(get("seats")), expand(get("sizes")), weight, totals.root_d, rng, change)
        m = m + change
        kept = get("kept") + ([squeeze(tables), squeeze(m), squeeze(seats)] if keep else [])
        row = (key[0].as_py(), get("counts"), squeeze(tables), squeeze(m), squeeze(seats), squeeze(sizes), kept, get("who"), get("words"), get("contexts"), [int(seats.sum()), int(m.sum())])
        return _table([row], _STATE_ARROW)

    return run


def _ask_nodes(shards: int):
    def run(batches):
        for batch in batches:
            for chunk, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                gid = _risen(d)
                yield from _rows([(q, chunk, _rising(gid[i] // shards)) for q, i in _by(gid % shards, shards)]).to_batches()

    return run


def _answer_nodes(totals: list[Totals]):
    """For the words a chunk asks for: their counts as contexts, what their restaurants
    leave to the parent and the parent's probability of them, by samples."""

    def run(key, asks, state):
        give_back()
        kept = [expand(x) for x in state.column("kept")[0].as_py()]
        counts = expand(state.column("counts")[0].as_py())
        rest = [THETA + x.d * kept[3 * s] for s, x in enumerate(totals)]
        base = [x.parent(kept[3 * s + 1], kept[3 * s + 2]) for s, x in enumerate(totals)]
        out = []
        for chunk, a in zip(asks.column("other").to_pylist(), asks.column("a").to_pylist()):
            at = _risen(a)
            out.append((key[0].as_py(), chunk, squeeze(counts[at]), squeeze(np.concatenate([x[at] for x in rest]), "<f4"), squeeze(np.concatenate([x[at] for x in base]), "<f4")))
        return _rows(out)

    return run


def _answer_pairs(d: float, samples: int):
    """For the pairs a chunk asks for what their own tables give, times the restaurant's
    customers, as a mean over the samples."""

    def run(key, asks, model):
        give_back()
        if model.num_rows:
            w, u, n = _model(*[model.column(x)[0].as_py() for x in "abc"])
            total = np.full(len(n), samples, np.int64)
            if model.column("f")[0].is_valid:
                total[n > 1] = expand(model.column("f")[0].as_py())
            left = np.append(n - d * total / samples, 0)
        else:
            w = u = np.zeros(0, np.int64)
            left = np.zeros(1)
        asked = [(chunk, _risen(a), expand(b)) for chunk, a, b in zip(*[asks.column(x).to_pylist() for x in ("other", "a", "b")])]
        if max((int(x.max()) for x in (w, u, *[y for _, *of in asked for y in of]) if len(x)), default=0) < 2**31:
            pair = lambda w, u: w << 32 | u
        else:  # numbers of numbers
            ws, us = np.unique(w), np.unique(u)
            pair = lambda w, u: _places(ws, w) * (len(us) + 1) + _places(us, u)
        known, out = pair(w, u), []
        for chunk, a, b in asked:
            asked_for = pair(a, b)
            out.append((key[0].as_py(), chunk, None, None, None, squeeze(left[_places(known, asked_for)], "<f4")))
        return _rows(out)

    return run


def _places(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where ``x`` stands in ``sorted_``, else its length."""
    at = np.searchsorted(sorted_, x)
    if len(sorted_):
        at[sorted_[np.minimum(at, len(sorted_) - 1)] != x] = len(sorted_)
    return at


def _finish(tokens: int, types: int, samples: int, shards: int):
    def run(key, chunk, answers):
        give_back()
        answers = answers.take(np.argsort(answers.column("shard").to_numpy(), kind="stable"))
        get = lambda n, kind="<i8": expand(chunk.column(n)[0].as_py(), kind)
        parts = lambda n, kind: [expand(x, kind) for x in answers.column(n).to_pylist() if x is not None]
        keys, sizes, token, gid, count = get("a"), get("b", "<u4").astype(np.int64), get("c", "<u4").astype(np.int64), _risen(chunk.column("d")[0].as_py()), get("e")
        order = np.argsort(gid % shards, kind="stable")
        rest, base, customers = np.empty((samples, len(gid))), np.empty((samples, len(gid))), np.empty(len(gid))
        customers[order] = np.concatenate(parts("a", "<i8"))
        for name, to in (("b", rest), ("c", base)):
            to[:, order] = np.concatenate([x.reshape(samples, -1) for x in parts(name, "<f4")], 1)
        w, u, at = _pairs(token, sizes, int(get("f")[0]), len(gid))
        own = np.empty(len(w))
        own[np.argsort(_pair_shard(gid[w], gid[u], shards), kind="stable")] = np.concatenate(parts("d", "<f4"))
        for s in range(samples):
            own += rest[s][u] * base[s][w] / samples
        p = np.log10(own / (THETA + customers[u]))[at]
        begin = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, begin)
        return pa.table({"k": keys, "n_tokens": sizes, "n_known": add((count > 0)[token].astype(np.int64)), "base_score": add(np.log10((count + 1) / (tokens + types + 1))[token]), "score": add(p)})

    return run


def language_scores(docs: DataFrame, train: Column, burn_in: int = BURN_IN, samples: int = SAMPLES, shards: int | None = None) -> DataFrame:
    """Score every text, learning from the rows where ``train`` (on ``doc_id``) holds.

    Returns per row ``doc_id, n_tokens, n_known`` (tokens seen in training),
    ``train_tokens, base_score`` (add-one unigram) and ``score``, log10 probabilities of
    the text with its end. A-Z count as a-z. Null and empty texts are one token, the
    end. Without training rows every token is unknown and its probability 1.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("_train"))
    d = texts.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("_train").alias("train"))
    if shards is None:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(4, -(-size // SHARD))
    parts = max(partitions(spark), -(-shards // 4))
    # Bytes say little about the work in a shard, so tasks are not merged by them.
    by = lambda df, key="shard": df.repartition(parts, key).groupBy(key)
    found = save(d.mapInArrow(_words(shards), _SQL), "words")
    names = save(by(found.where("shard >= 0")).applyInArrow(_name, _SQL), "names")
    types, tokens = (x or 0 for x in names.where(F.col("other") == _OWN).agg(F.sum(F.col("stats")[0]), F.sum(F.col("stats")[1])).first())
    chunks = by(found.where("shard < 0"), "other").cogroup(by(names.where(F.col("other") != _OWN), "other"))
    asked = save(chunks.applyInArrow(_ask(shards), _SQL), "asked")
    drop(found)
    asks = asked.where("shard >= 0")
    model = save(by(asks.select("shard", "a", "b", "c")).applyInArrow(_learn, _SQL), "pairs")
    intro = model.select("shard", "a", "b", "c").mapInArrow(_introduce(shards), _SQL)
    state = save(by(names.where(F.col("other") == _OWN).unionByName(intro)).applyInArrow(_node, _STATE), "nodes")
    drop(names)
    one, two = (x or 0 for x in model.agg(F.sum(F.col("stats")[0]), F.sum(F.col("stats")[1])).first())
    customers = state.agg(F.sum(F.col("stats")[1])).first()[0] or 0
    totals, used = Totals(types, tokens, one, two, customers, types), []
    pairs = model.select("shard", "a", "b", "c").mapInArrow(_movable(shards), _SQL)
    for number in range(burn_in + samples):
        keep = number >= burn_in
        told = state.mapInArrow(_tell(totals), _SQL)
        seated = save(by(pairs.unionByName(told)).applyInArrow(_move(totals, number, keep, shards), _SQL), "seats")
        sent = seated.where(F.col("shard") < 0).select((-1 - F.col("shard")).alias("shard"), "other", "a", "b")
        new = save(by(state).cogroup(by(sent)).applyInArrow(_update(totals, number, keep), _STATE), "nodes")
        tables, customers = (x or 0 for x in new.agg(F.sum(F.col("stats")[0]), F.sum(F.col("stats")[1])).first())
        totals = Totals(types, tokens, one, two, customers, tables, totals.root_d)
        drop(state)
        drop(pairs)
        state, pairs = new, seated.where(F.col("shard") >= 0)
        pairs._kvlog_path = seated._kvlog_path
        if keep:
            used.append(totals)
    words_asked = asked.where("shard < 0").select("other", "d").mapInArrow(_ask_nodes(shards), _SQL)
    of_nodes = by(words_asked).cogroup(by(state)).applyInArrow(_answer_nodes(used), _SQL)
    final = model.select("shard", "a", "b", "c").join(pairs.select("shard", "f"), "shard", "left")
    of_pairs = by(asks.select("shard", "other", "a", "b")).cogroup(by(final)).applyInArrow(_answer_pairs(totals.d, samples), _SQL)
    answers = save(of_nodes.unionByName(of_pairs), "answers")
    drop(state)
    drop(pairs)
    drop(model)
    texts = by(asked.where("shard < 0").drop("stats"), "other").cogroup(by(answers.drop("stats"), "other"))
    out = texts.applyInArrow(_finish(tokens, types, samples, shards), "k long, n_tokens long, n_known long, base_score double, score double")
    return out.select(doc_id(), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _movable(shards: int):
    """The pairs that occur twice or more, as a pair shard's own row before the first sweep."""

    def run(batches):
        for batch in batches:
            out = []
            for p, a, b, c in zip(*[batch.column(n).to_pylist() for n in ("shard", "a", "b", "c")]):
                w, u, n = _model(a, b, c)
                many = n > 1
                (ws, w_at), (us, u_at) = _sides(w[many], u[many], shards)
                told = [np.bincount(ids % shards, minlength=shards) for ids in (ws, us)]
                out.append((p, _OWN, squeeze(w_at), squeeze(u_at), squeeze(n[many]), None, None, None, np.concatenate(told).tolist()))
            yield from _rows(out).to_batches()

    return run
