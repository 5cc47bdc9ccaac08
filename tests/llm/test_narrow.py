"""Ranks and places in narrow numbers."""

import numpy as np
from kvlog.llm import shards


def test_block_sums_are_narrow_and_right():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 5, shards._BLOCK * 2 + 77)
    w = shards.Wavelet.build(ids, 3)
    for value in range(5):
        at = np.flatnonzero(ids == value)
        assert (w.locate(value, np.arange(len(at))) == at).all()
        assert w.count(value, [0, 9], [len(ids), shards._BLOCK + 5]).tolist() == [len(at), int((ids[9 : shards._BLOCK + 5] == value).sum())]
    some = rng.integers(0, len(ids), 500)
    assert (w.access(some) == ids[some]).all()
    # Before, every opened block was widened to 64 bits a sum.
    assert {x.dtype for p in w.planes for x in p.open.values()} == {np.dtype(np.int32)}
