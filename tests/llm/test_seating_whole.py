"""Every customer of a dish moves in a sweep, however many there are."""

import numpy as np
import pytest
from kvlog.llm import seating


@pytest.mark.parametrize("n, weight, d", [(20, 0.4, 0.7), (60, 6.0, 0.6), (300, 2.0, 0.8), (200, 900.0, 0.3), (1000, 8.0, 0.7)])
def test_sweeps_forget_a_bad_start(n, weight, d):
    law = np.full(n + 2, -np.inf)
    law[1], t = 0.0, np.arange(n + 2)
    for j in range(1, n):
        with np.errstate(divide="ignore"):
            law[1:] = np.logaddexp(law[1:] + np.log(np.maximum(j - d * t[1:], 0)), law[:-1])
    law = law + t * np.log(weight)
    law = np.exp(law - law.max())
    law /= law.sum()
    mean, sd = (law * t).sum(), np.sqrt((law * t**2).sum() - (law * t).sum() ** 2)
    rng, rows = np.random.default_rng(1), 1000
    # All at one table; with 16 moves a sweep 1000 customers stay near it.
    tables, sizes = np.ones(rows, np.int64), np.full(rows, n)
    for _ in range(50):
        tables, sizes = seating.sweep(tables, sizes, np.full(rows, weight), d, rng)
    assert sizes.sum() == n * rows and tables.sum() == len(sizes) and sizes.min() > 0
    assert abs(tables.mean() - mean) < max(0.2 * sd, 0.05) and 0.85 * sd < tables.std() < 1.15 * sd
