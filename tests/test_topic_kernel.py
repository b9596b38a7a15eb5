"""The topic tree's kernel over many leaves: the same leaves as the plain rule gives, in a time that a layer's bound allows."""

import time

import numpy as np

from recollect.operators import topics


def leaves(n, seed=5):
    b = topics.Builder(np.random.default_rng(seed).standard_normal((n, 16)), [set() for _ in range(n)])
    b.leaves = [topics.Leaf([i], b.x[i].copy()) for i in range(n)]
    return b


def test_the_budget_merges_the_most_similar_leaves_first():
    b = leaves(300)
    own = list(b.leaves)
    while len(own) > b.t.topic_leaf_budget:
        c = np.array([x.centroid for x in own])
        s = c @ c.T
        np.fill_diagonal(s, -2)
        i, j = sorted(divmod(int(s.argmax()), len(c)))
        own = [x for n, x in enumerate(own) if n not in (i, j)] + [b.fit(sorted(own[i].members + own[j].members))]
    b.budget()
    assert [x.members for x in b.leaves] == [x.members for x in own]


def test_thousands_of_leaves_take_seconds():
    b = leaves(3000)
    began = time.time()
    b.merge()
    b.absorb()
    b.budget()
    assert len(b.leaves) <= b.t.topic_leaf_budget and sorted(m for x in b.leaves for m in x.members) == list(range(3000))
    assert time.time() - began < 20
