"""The greedy division of memory: the same moves as by trying every pair, on many runs too."""

import random
import time

from kvlog.operators import bloom as B


def _every_pair(entries, total):
    out = [0.0] * len(entries)
    out[0] = delta = float(total)
    while delta > 1:
        best = None
        for i in range(len(out)):
            if out[i] < delta:
                continue
            lose = B.cost(out[i] - delta, entries[i]) - B.cost(out[i], entries[i])
            for j in range(len(out)):
                if i != j:
                    gain = B.cost(out[j], entries[j]) - B.cost(out[j] + delta, entries[j])
                    if gain - lose > 1e-12 and (best is None or gain - lose > best[0]):
                        best = (gain - lose, i, j)
        if best is None:
            delta /= 2
        else:
            out[best[1]] -= delta
            out[best[2]] += delta
    return out


def test_same_moves_as_every_pair():
    rng = random.Random(3)
    for n in (1, 2, 5, 12, 25):
        for entries in ([rng.choice((964, 965, 966, 1000)) for _ in range(n)], [rng.randrange(1, 10 ** rng.randrange(1, 6)) for _ in range(n)]):
            for total in (0, 1, 3 * sum(entries), 9586 * n):
                assert B.allocate_greedy(entries, total) == _every_pair(entries, total)


def test_thousands_of_runs():
    rng, start = random.Random(4), time.monotonic()
    entries = [rng.randrange(955, 980) for _ in range(3000)]
    got = B.allocate_greedy(entries, 9586 * 3000)
    assert abs(sum(got) - 9586 * 3000) < 1 and time.monotonic() - start < 20
