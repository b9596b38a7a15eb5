"""What the kernel of pair joins holds where most pairs are near."""

import tracemalloc

import numpy as np

from recollect.operators import metric


def test_near_pairs_are_copied_in_bounded_parts():
    x = np.random.default_rng(7).normal(size=(1500, 128)) + 2
    tracemalloc.start()
    n = sum(len(i) for i, _, _ in metric.hits(x, None, 0.35))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(peak >> 20)
    assert n == 1500 * 1499 // 2
    assert peak < 100 << 20  # copies of TOLD vectors of both sides alone would be 512 MB
