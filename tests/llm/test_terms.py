"""Laws of the customers at new tables: from one table of powers as term by term."""

import numpy as np
import pytest
from kvlog.llm import seating


def _slow(n: int, total: float, weight: float, d: float, most: int) -> np.ndarray:
    a, c, out, fall = [1.0], [1.0], [1.0], 1.0
    for j in range(1, most + 1):
        c.append(c[-1] * (j - d) / j)
    for m in range(most):
        a.append(weight * sum(a[k] * c[m - k] for k in range(m + 1)) / (m + 1))
        fall *= max(n - m, 0) / total
        out.append(a[-1] * fall)
    return np.array(out) / sum(out)


@pytest.mark.parametrize("d", [0.05, 0.5, 0.95])
@pytest.mark.parametrize("most", [30, 120, 3000])
def test_laws(d, most, monkeypatch):
    rng = np.random.default_rng(most)
    n = rng.integers(17, most, 60)
    total, weight = n * rng.uniform(1.5, 3, 60), 10 ** rng.uniform(-6, 1, 60)
    calls, own = [], seating._term_by_term
    monkeypatch.setattr(seating, "_term_by_term", lambda *x: calls.append(1) or own(*x))
    log_c, _, logb = seating._terms(n, total, weight, d)
    assert not calls and len(log_c) == logb.shape[1]  # before, every dish took a step a term
    for more in (logb, own(n, total, weight, d)[2]):
        law = np.exp(more - more.max(1)[:, None])
        law /= law.sum(1)[:, None]
        for i in range(0, 60, 7):
            want = _slow(int(n[i]), total[i], weight[i], d, min(int(n[i]), 400))[: law.shape[1]]
            assert np.abs(law[i, : len(want)] - want).max() < 1e-12


def test_heavy_dishes_are_mixed_in():
    n, total, weight = np.array([900, 40, 900]), np.array([1800.0, 80.0, 1500.0]), np.array([2000.0, 0.1, 3.0])
    log_c, loga, logb = seating._terms(n, total, weight, 0.6)
    for i in range(3):
        _, a, b = seating._term_by_term(n[i : i + 1], total[i : i + 1], weight[i : i + 1], 0.6)
        k = min(a.shape[1], loga.shape[1])
        assert np.allclose(loga[i, :k][np.isfinite(loga[i, :k])], a[0, :k][np.isfinite(loga[i, :k])], rtol=1e-12)
        p, q = (np.exp(x - x.max()) for x in (logb[i], b[0]))
        assert np.abs(p[:k] / p.sum() - q[:k] / q.sum()).max() < 1e-12
    assert len(log_c) == loga.shape[1] == logb.shape[1]
