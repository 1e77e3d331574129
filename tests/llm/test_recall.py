"""Recall of the forest at sizes that a comparison of all pairs can't reach: pairs planted near the threshold, and whether some tree has both in one leaf."""

import numpy as np
import pytest

from gustline.llm import neardup


def found(n, dim=64, threshold=0.9, seed=0):
    """The share of planted pairs that some tree has in one leaf, and the leaves of a vector over all trees."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = n // 20
    a, o = x[:pairs], rng.normal(size=(pairs, dim))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(threshold + 0.001, threshold + 0.03, (pairs, 1))
    x[pairs : 2 * pairs] = c * a + np.sqrt(1 - c * c) * o
    sample = x[rng.permutation(n)[: neardup.SAMPLE_ROWS]]
    leaf = max(8, neardup.LEAF_ROWS * len(sample) // n)
    together, copies = np.zeros(pairs, bool), 0
    for t in range(neardup.TREES):
        tree = neardup.Tree(sample, leaf, neardup.spill_of(dim, threshold), np.random.default_rng([11, t]))
        rows, codes = tree.leaves(x)
        copies += len(rows)
        width = len(tree.left)
        mine, theirs = rows < pairs, (rows >= pairs) & (rows < 2 * pairs)
        own, other = rows[mine] * width + codes[mine], (rows[theirs] - pairs) * width + codes[theirs]
        together[np.unique(np.intersect1d(own, other) // width)] = True
    return together.mean(), copies / n


@pytest.mark.parametrize("n", [6_000, 50_000])
def test_pairs_near_the_threshold_meet(n):
    recall, copies = found(n)
    assert recall >= 0.99 and copies < 25
