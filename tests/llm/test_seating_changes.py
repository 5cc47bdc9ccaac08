"""Many customers who come or go at once, and the new tables of all dishes."""

import numpy as np
import pytest
from kvlog.llm import seating
from kvlog.llm.text import ascending, distinct


def _tables(dishes: list) -> np.ndarray:
    return np.array([(len(x), x.max(), x[0]) for x in dishes]).T


@pytest.mark.parametrize("sizes, many, weight, d", [([3, 1, 9], 40, 2.0, 0.6), ([50, 2], 100, 0.5, 0.5), ([], 30, 1.0, 0.7), ([5], 40, 30.0, 0.3)])
def test_many_come_as_one_by_one(sizes, many, weight, d):
    rng, rows = np.random.default_rng(3), 3000
    got = [seating._come(np.array(sizes, np.int64), many, weight, d, rng) for _ in range(rows)]
    assert {int(x.sum()) for x in got} == {sum(sizes) + many} and min(x.min() for x in got) > 0
    x = np.zeros((len(sizes) + many + 1, rows))
    x[: len(sizes)] = np.array(sizes).reshape(-1, 1)
    for _ in range(many):
        seating._join(x, np.arange(rows), np.full(rows, weight), d, rng)
    want = np.array([(x > 0).sum(0), x.max(0), x[0]])
    assert (abs(_tables(got).mean(1) - want.mean(1)) < 5 * want.std(1) * (2 / rows) ** 0.5 + 1e-9).all()


def test_many_come_where_no_table_opens():
    rng = np.random.default_rng(8)
    assert seating._come(np.array([7, 2]), 100, 1e-320, 0.5, rng).sum() == 109  # 2 / weight is no double


@pytest.mark.parametrize("sizes, many", [([30, 5, 1, 9], 20), ([30, 5, 1, 9], 40), ([3, 3, 40], 46), ([3, 3, 40], 0)])
def test_many_go_as_one_by_one(sizes, many):
    rng, rows = np.random.default_rng(4), 3000
    got = [seating._go(np.array(sizes), many, rng) for _ in range(rows)]
    assert {int(x.sum()) for x in got} == {sum(sizes) - many}
    x = np.repeat(np.array(sizes, float)[:, None], rows, 1)
    for _ in range(many):
        seating._leave(x, np.arange(rows), rng)
    for own, want in ([len(g) for g in got], (x > 0).sum(0)), ([g.max(initial=0) for g in got], x.max(0)):
        assert abs(np.mean(own) - want.mean()) < 5 * want.std() * (2 / rows) ** 0.5 + 1e-9


def test_great_changes_take_few_steps(monkeypatch):
    """Work doesn't grow with the customers that come or go: one step each, before."""
    steps = []
    for name in ("_join", "_leave"):
        own = getattr(seating, name)
        monkeypatch.setattr(seating, name, lambda *x, own=own: steps.append(1) or own(*x))
    rng, n, w = np.random.default_rng(5), np.array([3000, 2500, 40, 3, 0]), np.full(5, 0.7)
    t, sizes = seating.start(n, w, 0.5, rng)
    steps.clear()
    change = np.array([2000, -2400, -38, 4000, 700])
    t, sizes = seating.sweep(t, sizes, w, 0.5, rng, change)
    assert np.bincount(np.repeat(np.arange(5), t), sizes, 5).tolist() == (n + change).tolist() and sizes.min() > 0
    assert len(steps) <= 4 * seating.MOVES


def test_new_tables_of_all_parts_go_together(monkeypatch):
    """Draws of new tables are counted by the widths of dishes, not once more by each part."""
    draws, own = [], seating._draw
    monkeypatch.setattr(seating, "_draw", lambda *x: draws.append(1) or own(*x))
    monkeypatch.setattr(seating, "CELLS", 8 * 2000)
    rng, n = np.random.default_rng(6), np.full(4000, 40)
    t, sizes = seating.start(n, np.full(4000, 3.0), 0.6, rng)
    t, sizes = seating.sweep(t, sizes, np.full(4000, 3.0), 0.6, rng)
    assert np.bincount(np.repeat(np.arange(4000), t), sizes).tolist() == n.tolist()
    parts = -(-4000 // 50)
    assert len(draws) < 3 * parts


@pytest.mark.parametrize("top", [2**3, 2**40, 2**64 - 1])
def test_order(top):
    rng = np.random.default_rng(7)
    x = rng.integers(0, top, 5000, np.uint64, endpoint=True)[rng.zipf(1.5, 20_000) % 5000]
    near = np.repeat(x[:50] & ~np.uint64(7), 9)[::-1] + rng.integers(0, 8, 450, np.uint64)  # alike in the high bits
    for own in (x, near, x[:1], x[:0]):
        assert (ascending(own) == np.argsort(own, kind="stable")).all()
        for got, want in zip(distinct(own), np.unique(own, return_inverse=True)):
            assert (got == want).all()
