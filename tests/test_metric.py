"""Pruned cosine joins against all pairs, and how much of the work the pruning leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import cluster, metric

ROWS = "g string, id string, embedding array<float>, mode int"


def clustered(n, centres, spread, seed=0, size=16):
    """Unit-free vectors around some centres."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, size))
    return (c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, size))).astype(np.float32)


def brute(rows, low, high=2.0):
    out = {}
    for x, (g, i, v, m) in enumerate(rows):
        for h, j, w, k in rows[:x]:
            if g != h or v is None or w is None or len(v) != len(w) or {m, k} in ({0}, {2}) or i == j:
                continue
            v64, w64 = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            p = np.linalg.norm(v64) * np.linalg.norm(w64)
            if p and low < v64 @ w64 / p <= high:
                out[g, min(i, j), max(i, j)] = v64 @ w64 / p
    return out


@pytest.mark.parametrize("modes", [[1], [0, 1], [0, 0, 0, 1, 2]])
@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_pairs_like_brute_force(spark, monkeypatch, modes, spread):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 16)
    monkeypatch.setattr(metric, "RINGS", 40)
    x = clustered(220, 9, spread, seed=len(modes))
    rows = [("ab"[i % 3 == 0], f"m{i}", v.tolist(), modes[i % len(modes)]) for i, v in enumerate(x)]
    rows += [("a", "copy", rows[1][2], 1), ("a", "zero", [0.0] * 16, 1), ("a", "null", None, 1), ("a", "short", [1.0, 2.0], 1), ("a", "short2", [1.0, 2.1], 1)]
    got = metric.near_pairs(spark.createDataFrame(rows, ROWS), 0.55, 0.99, pivots=7).collect()
    found = {(r.g, r.a, r.b): r.similarity for r in got}
    want = brute(rows, 0.55, 0.99)
    assert len(got) == len(found) and found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want) and len(want) > 50


def test_clusters_leave_out_most_of_the_work(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 64)
    n = 3000
    x = clustered(n, 30, 0.15)
    df = spark.createDataFrame([("", f"m{i}", v.tolist(), 1) for i, v in enumerate(x)], ROWS)
    at, pairs = metric.plan(df, 0.78)
    multiplied = pairs.agg(F.sum("products")).first()[0]
    assert multiplied < 0.15 * n * n / 2, "blocks that meet hold under a seventh of all pairs"
    assert at.count() < 1.6 * n, "few rows are sent to another cell"
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((np.triu(unit.astype(float) @ unit.T.astype(float), 1) > 0.78).sum())
    assert abs(metric.near_pairs(df, 0.78).count() - want) <= 1


def test_work_grows_with_new_rows(spark, monkeypatch):
    """Twice as many old rows are twice, not four times, the products; old rows never meet."""
    monkeypatch.setattr(metric, "BLOCK_ROWS", 64)
    work = []
    for n in (1000, 2000):
        x = clustered(n + 100, 5, 1.0, seed=1)
        df = spark.createDataFrame([("", f"m{i}", v.tolist(), int(i >= n)) for i, v in enumerate(x)], ROWS)
        pairs = metric.plan(df, 0.55)[1]
        assert pairs.where("role_x = 0").isEmpty()
        work.append(pairs.agg(F.sum("products")).first()[0])
    assert work[0] <= 100 * 1100 * 1.1 and work[1] < 2.4 * work[0]


def test_one_hot_cell_is_cut_into_blocks(spark, monkeypatch):
    """All vectors equal: no block is larger than two blocks' worth, and every pair is there."""
    monkeypatch.setattr(metric, "BLOCK_ROWS", 32)
    df = spark.createDataFrame([("", f"m{i}", [1.0, 2.0, 3.0], 1) for i in range(200)], ROWS)
    at, _ = metric.plan(df, 0.9)
    assert at.groupBy("cell", "role", "block", "part").count().agg(F.max("count")).first()[0] <= 64
    assert metric.near_pairs(df, 0.9).count() == 200 * 199 / 2
    assert metric.near_pairs(df.where("false"), 0.9).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        metric.near_pairs(df, 0.0)


def test_vectors_without_clusters_are_not_sent_to_every_cell(spark):
    """Pivots can't prune random vectors at a low cosine, so each row is placed about once and blocks meet without cells."""
    x = np.random.default_rng(3).normal(size=(1500, 48)).astype(np.float32)
    rows = [("a", f"m{i}", v.tolist(), 1) for i, v in enumerate(x)]
    lonely = [("old only", f"o{i}", v.tolist(), 0) for i, v in enumerate(x[:50])] + [("probes only", f"p{i}", v.tolist(), 2) for i, v in enumerate(x[:50])]
    df = spark.createDataFrame(rows + lonely, ROWS)
    assert metric.plan(df, 0.35)[0].count() <= 2 * len(x), "rows are not copied to all cells; groups without partners are left out"
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert metric.near_pairs(df, 0.35).count() == int((np.triu(unit @ unit.T, 1) > 0.35).sum())


def test_hits_are_exact_in_tiles(monkeypatch):
    monkeypatch.setattr(metric, "TILE", 7)
    monkeypatch.setattr(metric, "TOLD", 5)
    x = np.random.default_rng(4).normal(size=(40, 8))
    y = np.vstack([x[:3] * 2, np.zeros((1, 8)), np.random.default_rng(5).normal(size=(30, 8))])
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for other, want in ((y, unit(x) @ unit(y).T), (None, np.triu(unit(x) @ unit(x).T, 1) - 2 * np.tri(40))):
        for low in (0.3, -0.2):
            got = {(i, j) for a, b, _ in metric.hits(x, other, low) for i, j in zip(a.tolist(), b.tolist())}
            assert got == set(zip(*(c.tolist() for c in np.nonzero(want > low))))


def test_components_from_few_links(spark, monkeypatch):
    """Blocks tell spanning forests: as many components as all combined pairs have, from fewer links than pairs."""
    monkeypatch.setattr(metric, "BLOCK_ROWS", 64)
    monkeypatch.setattr(metric, "TILE", 16)
    x = clustered(150, 6, 0.4, seed=8)
    tags = [["a", None], ["a", "b"], [], ["c"], None]
    rows = [(f"m{i:03}", v.tolist(), tags[i % 5]) for i, v in enumerate(x)] + [("null", None, ["a"]), ("zero", [0.0] * 16, ["a"]), ("short", [1.0], ["a"])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, tags array<string>")
    pairs = cluster.combined_pairs(df, 0.6).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = cluster.combined_links(df, 0.6)
    want = {(r.node, r.component) for r in cluster.connected(pairs).collect()}
    assert {(r.node, r.component) for r in cluster.connected(links).collect()} == want and len(want) > 50
    assert links.count() < pairs.count() / 3
