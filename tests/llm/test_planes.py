"""Ranks and selects of a plane: the same as by counting, without a number for each bit."""

import numpy as np
import pytest
from kvlog.llm import shards


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, (1 << 18) - 1, 1 << 18, (1 << 18) + 1, (1 << 19) + 77])
@pytest.mark.parametrize("share", [0.0, 0.03, 0.5, 1.0])
def test_rank_and_select(n, share):
    bits = np.random.default_rng(n).random(n) < share
    p = shards.Wavelet.build(bits.astype(np.int64), 1).planes[0]
    assert (p.bits() == bits).all()
    at = np.unique(np.concatenate([np.arange(0, n + 1, max(1, n // 999)), np.arange(max(0, n - 70), n + 1)]))
    ones = np.concatenate([[0], np.cumsum(bits)])
    assert (p.rank(at[::-1]) == ones[at[::-1]]).all()
    for bit in (0, 1):
        places = np.flatnonzero(bits == bit)
        j = np.unique(np.linspace(0, len(places) - 1, 500).astype(np.int64)) if len(places) else np.zeros(0, np.int64)
        assert (p.select(bit, j) == places[j]).all()
    # Before, an opened block held a 32-bit number for each of its bits.
    held = sum(x.nbytes for x in [*p.open.values(), *getattr(p, "words", {}).values()])
    assert p.open and held <= n // 3 + 100 * len(p.open)
