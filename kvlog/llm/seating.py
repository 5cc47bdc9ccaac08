"""Chinese-restaurant seating of many dishes at once, sampled by Gibbs.

A dish has ``n`` customers at tables; ``weight`` is what a new table weighs, an old one of
``s`` customers weighs ``s - d``. One move takes a customer, chosen evenly, from its table
and seats it anew, so every move leaves the posterior as it is. All dishes move side by
side; tables are kept as sizes, dish after dish, in one array.

Dishes of many customers move all of them at once. The law of a seating, ``weight`` for each
table times ``(1-d)(2-d)..(s-1-d)``, is that of customers who choose among the jumps J of a
Poisson process of intensity ``weight J^(-1-d) e^-J / Gamma(1-d)``, each in proportion to J.
Given a seating, a table's jump is Gamma(s-d), with sum S over the tables, and the other jumps
have a tempered stable sum U. Given the jumps, customers choose evenly by J; with v, which is
Gamma(n) / (S+U), in place of U, the number m of customers at new tables has the law
``n!/(n-m)! a_m / (S(1+v))^m``, where ``sum a_m z^m = exp(weight (1+v)^d (1-(1-z)^d) / d)``; the
others are multinomial, and the new tables are drawn one by one. So each sweep draws every
customer's seat anew, whatever their number.
"""

from __future__ import annotations

import numpy as np

#: Customers of a dish that move one after the other; more move all at once (``_at_once``).
MOVES = 16
#: Cells of a table of sizes that is worked on at once.
CELLS = 2_000_000
#: Numbers of customers at new tables, few and more, and weights of one, whose laws come from
#: one table; what its powers are scaled by, as doubles would not hold them.
TERMS, HEAVY, SCALE = (128, 256), 100.0, 30.0


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums down the columns, in place; few rows one by one, which is faster."""
    if len(x) > 64:
        return np.cumsum(x, axis=0, out=x)
    for j in range(1, len(x)):
        x[j] += x[j - 1]
    return x


def _join(sizes: np.ndarray, dishes: np.ndarray, weight: np.ndarray, d: float, rng) -> None:
    """Seat one more customer of each of the ``dishes``, the columns of ``sizes``."""
    own = sizes if len(dishes) == sizes.shape[1] else sizes[:, dishes]
    at = own - d
    at = _sums(np.maximum(at, 0, out=at))
    x = rng.random(len(dishes)) * (weight + at[-1])
    spot = (at <= x).sum(0)
    new = np.flatnonzero(x >= at[-1])
    spot[new] = (own[:, new] == 0).argmax(0)
    sizes[spot, dishes] += 1


def _leave(sizes: np.ndarray, dishes: np.ndarray, rng) -> None:
    """Take one customer of each of the ``dishes`` away."""
    at = _sums(sizes.copy() if len(dishes) == sizes.shape[1] else sizes[:, dishes])
    sizes[(at <= rng.random(len(dishes)) * at[-1]).sum(0), dishes] -= 1


def _come(sizes: np.ndarray, many: int, weight: float, d: float, rng) -> np.ndarray:
    """The tables of a dish after ``many`` more customers sat down one after the other. When
    new tables open depends on how many there are; until the next one the others fill as an
    urn does, which is one draw."""
    n = int(sizes.sum())
    while many:
        old = weight + n - d * len(sizes)  # what all tables and a new one weigh
        step, free, found = int(min(2 * old / weight, CELLS)) + 16, 0, False
        while free < many and not found:
            x = rng.random(min(step, many - free))
            hit = x * (old + free + np.arange(len(x))) < weight
            found = bool(hit.any())
            free += int(hit.argmax()) if found else len(x)
        if free:
            jumps = rng.standard_gamma(sizes - d)
            sizes = sizes + rng.multinomial(free, jumps / jumps.sum())
        if found:
            sizes = np.append(sizes, 1)
        n, many = n + free + found, many - free - found
    return sizes


def _go(sizes: np.ndarray, many: int, rng) -> np.ndarray:
    """The tables of a dish after ``many`` customers, chosen evenly, went."""
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    less, picked = min(many, n - many), np.zeros(0, np.int64)
    while len(picked) < less:
        picked = np.unique(np.append(picked, rng.integers(0, n, less - len(picked))))
    picked = np.bincount(np.searchsorted(ends, picked, "right"), minlength=len(sizes))
    out = picked if less < many else sizes - picked
    return out[out > 0]


def _change(tables: np.ndarray, sizes: np.ndarray, weight: np.ndarray, d: float, rng, change: np.ndarray, rows: np.ndarray):
    """Tables by dish and sizes after the changes of some dishes."""
    ends = np.cumsum(tables)
    others = np.ones(len(tables), bool)
    others[rows] = False
    done = [(np.repeat(np.flatnonzero(others), tables[others]), sizes[np.repeat(others, tables)])]
    for i in rows.tolist():
        own, many = sizes[ends[i] - tables[i] : ends[i]], int(change[i])
        own = _come(own, many, weight[i], d, rng) if many > 0 else _go(own, -many, rng)
        done.append((np.full(len(own), i), own))
    return _ordered(done, len(tables))


def _flat(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.ascontiguousarray(x.T)
    live = x > 0
    return np.repeat(rows, live.sum(1)), x[live].astype(np.int64)


def _ordered(done: list, many: int) -> tuple[np.ndarray, np.ndarray]:
    if not done:
        return np.zeros(many, np.int64), np.zeros(0, np.int64)
    owner, sizes = (np.concatenate(x) for x in zip(*done))
    return np.bincount(owner, minlength=many), sizes[np.argsort(owner, kind="stable")]


def _blocks(width: np.ndarray):
    """Dishes of about equal width together, in blocks of bounded size."""
    order = np.argsort(width, kind="stable")
    at = 0
    while at < len(order):
        # The widest of a block decides its width: double the narrowest at most.
        least = int(width[order[at]])
        to = int(np.searchsorted(width[order], 2 * least + 1, "right"))
        to = min(to, at + max(1, CELLS // (2 * least + 2)))
        yield order[at:to]
        at = to


def start(n: np.ndarray, weight: np.ndarray, d: float, rng, moves: int = MOVES) -> tuple[np.ndarray, np.ndarray]:
    """A first seating ``(tables by dish, sizes)``: customers come one after the other. Past
    ``moves`` of them the others are spread as is expected of them; where a chain begins
    does not change what it samples."""
    many = np.minimum(n, moves)
    late = np.floor(weight * np.log((weight + n) / (weight + many))).astype(np.int64)
    late = np.minimum(late, n - many)
    done = []
    for rows in _blocks(many + late):
        rows = rows[np.argsort(-many[rows], kind="stable")]  # those with more to come stand first
        x = np.zeros((int((many + late)[rows].max()) + 1, len(rows)))
        x[0] = n[rows] > 0
        for j in range(1, int(many[rows].max())):
            live = np.arange(np.count_nonzero(many[rows] > j))
            _join(x[:, : len(live)], live, weight[rows[live]], d, rng)
        great = np.flatnonzero(n[rows] > many[rows])
        if len(great):
            own, r = x[:, great], rows[great]
            opened, rest = (own > 0).sum(0), n[r] - many[r] - late[r]
            share = np.maximum(own - d, 0)
            share = np.floor(share / share.sum(0) * rest)
            share[0] += rest - share.sum(0)
            place = np.arange(len(x))[:, None]
            x[:, great] = own + share + ((place >= opened) & (place < opened + late[r]))
        done.append(_flat(rows, x))
    return _ordered(done, len(n))


_found: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def _powers(d: float) -> tuple[np.ndarray, np.ndarray]:
    """``c_j``, and for each k and m what ``(weight / SCALE)^k`` counts for in ``a_m``: the
    coefficients of ``((1-(1-z)^d) SCALE / d)^k / k!``. All are positive, so nothing cancels.
    They fit all dishes."""
    if d not in _found:
        _found.clear()
        j = np.arange(1, TERMS[-1] + 1)
        c, out = np.concatenate([[1.0], np.cumprod((j - d) / j)]), np.zeros((len(j) + 1, len(j) + 1))
        out[0, 0] = 1.0
        for k in range(len(j)):
            out[k + 1, 1:] = np.convolve(out[k], c)[: len(j)] * SCALE / j
        _found[d] = c, out
    return _found[d]


def _from_powers(n: np.ndarray, total: np.ndarray, weight: np.ndarray, d: float, most: int):
    """Logarithms of ``a_m`` and of the law of m up to ``most``, and which rows that is enough for."""
    powers = _powers(d)[1][: most + 1, : most + 1]
    # Powers past these count for nothing, least of all for smaller weights.
    parts = (weight.max() / SCALE) ** np.arange(most + 1)[:, None] * powers
    last = np.flatnonzero((parts > 1e-20 * parts.sum(0)).any(1))[-1] + 1
    with np.errstate(divide="ignore"):
        loga = np.log((weight[:, None] / SCALE) ** np.arange(last) @ powers[:last])
        fall = np.log(np.maximum(n[:, None] - np.arange(most), 0)) - np.log(total)[:, None]
    logb = loga.copy()
    logb[:, 1:] += np.cumsum(fall, axis=1)
    # Past the mode the terms only fall, faster and faster.
    whole = (n <= most) | ((logb[:, -4:] < logb.max(1)[:, None] - 60) & (logb[:, -4:] <= logb[:, -5:-1])).all(1)
    return loga, logb, whole


def _terms(n: np.ndarray, total: np.ndarray, weight: np.ndarray, d: float):
    """Logarithms of ``c_j``, of ``a_m`` and of the law of m, a row a dish, so far that what is
    left out is below what doubles tell apart: from one table of powers where that is long
    enough, else term by term."""
    done, log_c, rest = [], np.log(_powers(d)[0]), np.arange(len(n))
    for terms in TERMS:
        rows = rest[weight[rest] <= HEAVY]
        if len(rows):
            loga, logb, whole = _from_powers(n[rows], total[rows], weight[rows], d, min(int(n[rows].max()), terms))
            if whole.all() and len(rows) == len(n):
                return log_c[: loga.shape[1]], loga, logb
            done.append((rows[whole], loga[whole], logb[whole]))
            rest = np.setdiff1d(rest, rows[whole], assume_unique=True)
    if len(rest):
        long_c, *more = _term_by_term(n[rest], total[rest], weight[rest], d)
        log_c = long_c if len(long_c) > len(log_c) else log_c
        done.append((rest, *more))
    out = [np.full((len(n), max(x.shape[1] for _, x, _ in done)), -np.inf) for _ in range(2)]
    for rows, *own in done:
        for to, x in zip(out, own):
            to[rows, : x.shape[1]] = x
    return log_c[: out[0].shape[1]], *out


def _term_by_term(n: np.ndarray, total: np.ndarray, weight: np.ndarray, d: float):
    """The same, each term from those before; a few at a time are weighed."""
    room, many, step = 64, len(n), 8
    loga, logb = (np.zeros((many, 1)) for _ in range(2))
    a, shift = np.zeros((many, room)), np.zeros(many)  # a_m / exp(shift)
    a[:, 0] = 1.0
    c, log_total, log_n, m = np.ones(1), np.log(total)[:, None], int(n.max()), 0
    found, fallen = [(loga, logb)], np.zeros((many, 1))
    top, before, low = np.zeros(many), logb, np.zeros(many, bool)
    while m < log_n and not low.all():
        to = min(m + step, log_n)
        if to >= room:
            a = np.concatenate([a, np.zeros_like(a)], axis=1)
            room *= 2
        if len(c) <= to:
            j = np.arange(1, room)
            c = np.concatenate([[1.0], np.cumprod((j - d) / j)])
        for i in range(m, to):
            a[:, i + 1] = weight * (a[:, : i + 1] @ c[i::-1]) / (i + 1)
        with np.errstate(divide="ignore"):
            loga = np.log(a[:, m + 1 : to + 1]) + shift[:, None]
            fall = np.log(np.maximum(n[:, None] - np.arange(m, to), 0)) - log_total
        great = np.flatnonzero(a[:, to] > 1e200)
        if len(great):
            a[great, : to + 1] *= 1e-200
            shift[great] += 200 * np.log(10)
        fall = fallen + np.cumsum(fall, axis=1)
        logb, fallen, m = loga + fall, fall[:, -1:], to
        found.append((loga, logb))
        top = np.maximum(top, logb.max(1))
        # Past the mode the terms only fall, faster and faster.
        last = np.concatenate([before, logb], axis=1)[:, -5:]
        low = ((last[:, 1:] < top[:, None] - 60) & (last[:, 1:] <= last[:, :-1])).all(1) & (last.shape[1] == 5)
        before = last
    if len(c) <= m:
        c = np.concatenate([[1.0], np.cumprod((np.arange(1, m + 1) - d) / np.arange(1, m + 1))])
    return np.log(c[: m + 1]), *(np.concatenate(x, axis=1) for x in zip(*found))


def _draw(logs: np.ndarray, rng) -> np.ndarray:
    """A column of each row, by weights given as logarithms."""
    p = np.cumsum(np.exp(logs - logs.max(1)[:, None]), axis=1)
    return (p <= (rng.random(len(p)) * p[:, -1])[:, None]).sum(1)


def _stable(weight: np.ndarray, d: float, rng) -> np.ndarray:
    """Sums of the jumps of Poisson processes of intensity ``weight J^(-1-d) e^-J / Gamma(1-d)``:
    positive stable numbers (Kanter), thinned by ``e^-x``, of parts that mostly are kept."""
    parts = np.maximum(1, np.ceil(weight / d)).astype(np.int64)
    owner = np.repeat(np.arange(len(weight)), parts)
    scale, out = (weight / d / parts) ** (1 / d), np.zeros(len(weight))
    while len(owner):
        u, e = rng.random(len(owner)) * np.pi, rng.standard_exponential(len(owner))
        x = np.sin(d * u) / np.sin(u) ** (1 / d) * (np.sin((1 - d) * u) / e) ** ((1 - d) / d) * scale[owner]
        fine = rng.random(len(owner)) < np.exp(-x)
        out += np.bincount(owner[fine], x[fine], len(out))
        owner = owner[~fine]
    return out


def _at_once(x: np.ndarray, weight: np.ndarray, d: float, rng):
    """Seat all customers of the dishes anew, whose tables are the rows of ``x``. Returns the
    row and the size of each table that stays, how many customers of each row are at new
    tables, and of these the logarithms of ``c_j``, and of ``a_j`` to that number, row after row."""
    n = x.sum(1).astype(np.int64)
    jumps = rng.standard_gamma(np.where(x > 0, x - d, 1)) * (x > 0)
    total = jumps.sum(1)
    v = rng.standard_gamma(n) / (total + _stable(weight, d, rng))
    log_c, loga, logb = _terms(n, total * (1 + v), weight * (1 + v) ** d, d)
    m = _draw(logb, rng)
    old = rng.multinomial(n - m, jumps / total[:, None])
    return np.nonzero(old)[0], old[old > 0], m, log_c[: m.max() + 1], loga[np.arange(loga.shape[1]) <= m[:, None]]


def _new_tables(laws: list, rng) -> tuple[np.ndarray, np.ndarray]:
    """The new tables, dish and size, of all dishes: their customers, laws as by ``_at_once``."""
    dish, m = (np.concatenate([law[i] for law in laws]) for i in (0, 1))
    log_c, flat = max((law[2] for law in laws), key=len), np.concatenate([law[3] for law in laws])
    begin = np.cumsum(m + 1) - (m + 1)
    own, sizes = [], []
    some = np.flatnonzero(m)
    for rows in _blocks(m[some]):
        rows = some[rows]
        while len(rows):
            # The table of the first of the m: s customers with weight c_(s-1) a_(m-s).
            most = int(m[rows].max())
            at = m[rows][:, None] - 1 - np.arange(most)
            logs = np.where(at >= 0, log_c[:most] + flat[begin[rows][:, None] + np.maximum(at, 0)], -np.inf)
            s = _draw(logs, rng) + 1
            own.append(dish[rows])
            sizes.append(s)
            m[rows] -= s
            rows = rows[m[rows] > 0]
    return (np.concatenate(own), np.concatenate(sizes)) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def sweep(tables: np.ndarray, sizes: np.ndarray, weight: np.ndarray, d: float, rng, change: np.ndarray | None = None, moves: int = MOVES) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep: first ``change`` customers come or go, then every customer moves, one
    at a time or, where a dish has more than ``moves``, all at once. Returns tables by dish
    and sizes. A dish without customers has no tables."""
    owner = np.repeat(np.arange(len(tables)), tables)
    n = np.bincount(owner, sizes, len(tables)).astype(np.int64)
    change = np.zeros(len(n), np.int64) if change is None else change
    after = n + change
    many = np.flatnonzero(np.abs(change) > moves)
    if len(many):
        tables, sizes = _change(tables, sizes, weight, d, rng, change, many)
        owner, n, change = np.repeat(np.arange(len(tables)), tables), n.copy(), change.copy()
        n[many], change[many] = after[many], 0
    begin = np.cumsum(tables) - tables
    steps = np.where((after > 1) & (after <= moves), after, 0)
    great = after > moves
    still = (change == 0) & (steps == 0) & ~great
    done = [(owner[still[owner]], sizes[still[owner]])]
    # Of two customers the one that moves meets the other alone at a table.
    two = (change == 0) & (n == 2)
    apart = np.flatnonzero(two)
    apart = apart[rng.random(len(apart)) * (weight[apart] + 1 - d) < weight[apart]]
    alone = np.setdiff1d(np.flatnonzero(two), apart, assume_unique=True)
    done += [(alone, np.full(len(alone), 2)), (np.repeat(apart, 2), np.ones(2 * len(apart), np.int64))]
    ready = great & (change == 0)
    todo = np.flatnonzero(~still & ~two & ~ready)
    # A dish can't have more tables than customers, nor open more than it takes steps.
    width = np.minimum(np.maximum(n, after), tables + steps + np.maximum(change, 0))
    late = [(owner[ready[owner]], sizes[ready[owner]])]
    for rows in _blocks(width[todo]):
        rows = todo[rows]
        rows = rows[np.argsort(-steps[rows], kind="stable")]  # those with more to come stand first
        t = tables[rows]
        at = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        x = np.zeros((int(width[rows].max()) + 1, len(rows)))
        x[at, np.repeat(np.arange(len(rows)), t)] = sizes[np.repeat(begin[rows], t) + at]
        for j in range(int(np.abs(change[rows]).max())):
            come, go = np.flatnonzero(change[rows] > j), np.flatnonzero(change[rows] < -j)
            if len(come):
                _join(x, come, weight[rows[come]], d, rng)
            if len(go):
                _leave(x, go, rng)
        for j in range(int(steps[rows].max())):
            live = np.arange(np.count_nonzero(steps[rows] > j))
            own = x[:, : len(live)]
            _leave(own, live, rng)
            _join(own, live, weight[rows[live]], d, rng)
        own = great[rows]
        done.append(_flat(rows[~own], x[:, ~own]))
        if own.any():
            late.append(_flat(rows[own], x[:, own]))
    t, own = _ordered(late, len(n))
    begin, great = np.cumsum(t) - t, np.flatnonzero(great)
    new = []
    # Dishes of about equal size together: their sums are about equally long.
    for part in _blocks(after[great]):
        # Neither tables nor terms of a dish are more than its customers, double the least here.
        for rows in np.array_split(great[part], -(-len(part) // max(1, min(1024, CELLS // 8 // int(after[great[part]].max()))))):
            i = np.repeat(np.arange(len(rows)), t[rows])
            at = np.arange(len(i)) - np.repeat(np.cumsum(t[rows]) - t[rows], t[rows])
            x = np.zeros((len(rows), int(t[rows].max())))
            x[i, at] = own[np.repeat(begin[rows], t[rows]) + at]
            i, size, *law = _at_once(x, weight[rows], d, rng)
            done.append((rows[i], size.astype(np.int64)))
            new.append((rows, *law))
    if new:
        done.append(_new_tables(new, rng))
    return _ordered(done, len(n))
