"""Gradients of heads against differences; training itself is in test_training."""

import numpy as np
import pytest

from pairlens.operators import heads


def example(n=60, d=6, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n, d))
    y = np.minimum(1.0, np.abs(a[:, 0] - b[:, 0]) / 2)
    return a, b, y


@pytest.mark.parametrize("hidden", [0, 4])
def test_gradients(hidden):
    rng = np.random.default_rng(3)
    head = {"w1": rng.normal(size=(6, hidden or 3)), "b1": rng.normal(size=hidden or 3)}
    if hidden:
        head |= {"w2": rng.normal(size=(4, 3)), "b2": rng.normal(size=3)}
    ex = example(12)
    grads, _ = heads._pair_step(head, *ex)
    for name, w in head.items():
        at = (0,) * w.ndim
        step = np.zeros_like(w)
        step[at] = 1e-6
        up, down = (heads._pair_step(head | {name: w + s}, *ex)[1].mean() for s in (step, -step))
        assert grads[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
