"""What the quality classifier's fit takes lines to be, against a plain version, and that groups of chains don't matter."""

import numpy as np
import pytest

from granary.llm import quality


def test_targets_look_at_no_padding():
    """A chain of 3 lines beside one of 50: padded places are never the worst line."""
    rng = np.random.default_rng(1)
    n, y = np.array([3, 50, 4, 1]), np.array([0, 0, 1, 0])
    good = rng.random((4, 50)) * 0.4 + 0.55
    for i, k in enumerate(n):
        good[i, k:] = 0.01  # what padding holds is of no meaning
    got = quality.targets(good, n, y)
    for i, k in enumerate(n):
        p = good[i, :k]
        want = np.ones(k) if y[i] else (p > 0.5).astype(float)
        if not y[i]:
            want[min(range(k), key=lambda j: p[j])] = 0
        assert (got[i, :k] == want).all()
        assert y[i] or (got[i, :k] == 0).any()


@pytest.mark.parametrize("seed", [2, 3])
def test_fit_does_not_depend_on_groups(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    y = np.array([0, 1] * 12)
    docs = []
    for label in y:
        k = int(rng.choice([1, 2, 3, 30]))
        x = rng.normal(0.3 * label, 1, (k, quality._OWN)).astype(np.float32)
        docs.append((x, np.full(k, 10.0)))
    fits = []
    for cells in (1, 40, 10**6):
        monkeypatch.setattr(quality, "_CELLS", cells)
        fits.append(quality.train(docs, y, np.ones(len(y)), rounds=2, steps=25))
    for m in fits[1:]:
        assert np.allclose(m.theta, fits[0].theta, atol=1e-3) and np.allclose(m.moves, fits[0].moves, atol=1e-3)
