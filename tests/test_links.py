"""Links that are told as spanning forests, and their components."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recollect.llm import _graph
from recollect.operators import cluster, metric


def test_components_of_links_that_differ_when_computed_again(spark):
    """A block's spanning forest depends on the order of its rows, so each computation may tell other links."""

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                at = np.random.default_rng().permutation(10) + 10 * g + 10_000
                names = [str(i) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(names[:-1]), pa.array(names[1:])], ["src", "dst"])

    links = spark.range(20).mapInArrow(path, "src string, dst string")
    found = {(r.node, r.component) for r in cluster.connected(links).collect()}
    assert found == {(str(i), str(i // 10 * 10)) for i in range(10_000, 10_200)}
    assert cluster.connected(links.where(F.lit(False))).count() == 0


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """Whatever the ids' type, one task gives the components that rounds of joins give."""
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    for kind in ("long", "string"):
        edges = spark.createDataFrame(pairs, "src long, dst long").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).where("src <> dst")
        with monkeypatch.context() as m:
            m.setattr(cluster, "FEW", 0)
            want = set(map(tuple, cluster.connected(edges).collect()))
            m.setattr(cluster, "FEW", 1 << 20)
            m.setattr(DataFrame, "join", None)
            got = cluster.connected(edges)
        assert set(map(tuple, got.collect())) == want and got.count() == len(want) > 100 and got.schema.simpleString() == f"struct<node:{got.dtypes[0][1]},component:{got.dtypes[0][1]}>"


def test_few_rows_meet_without_pivots(spark, monkeypatch):
    """A table of a few blocks is joined without a job that chooses or measures pivots; probes still meet old rows."""
    monkeypatch.setattr(metric, "choose_pivots", None)
    rows = [("g", f"{m}{i}", [1.0, i / 100], m) for m in (metric.OLD, metric.NEW, metric.PROBE) for i in range(3)] + [("h", "x", [1.0], metric.PROBE), ("h", "y", [2.0], metric.OLD)]
    found = metric.near_pairs(spark.createDataFrame(rows, "g string, id string, embedding array<float>, mode int"), 0.9).collect()
    want = {("g", f"{a}{i}", f"{b}{j}") for a in range(3) for b in range(a, 3) for i in range(3) for j in range(3) if (a, b) not in ((0, 0), (2, 2)) and (a < b or i < j)}
    assert {(r.g, r.a, r.b) for r in found} == want | {("h", "x", "y")} and len(found) == len(want) + 1


@pytest.mark.parametrize("spread", [0.3, 1.2])
def test_rounds_over_many_blocks_lose_no_link(spark, monkeypatch, spread):
    """Of many blocks most pairs need not meet, and components are those of all pairs; blocks are dealt to several tasks."""
    monkeypatch.setattr(metric, "BLOCK_ROWS", 16)
    rng, seen = np.random.default_rng(9), []
    centres = rng.normal(size=(12, 16))
    x = (centres[np.minimum(rng.integers(60, size=400), 11)] + spread * rng.normal(size=(400, 16))).astype(np.float32)
    tags = [["a"], ["a", "b"], [], ["c"], ["b", "c"]]
    rows = [(f"m{i:03}", v.tolist(), tags[i % 5]) for i, v in enumerate(x)] + [(f"s{i}", [1.0, float(i)], ["a"]) for i in range(40)] + [("short", [1.0], ["a"])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, tags array<string>")
    links = cluster.combined_links(df, 0.6)
    pairs = cluster.combined_pairs(df, 0.6).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    want = set(map(tuple, cluster.connected(pairs).collect()))
    assert set(map(tuple, cluster.connected(links).collect())) == want and len(want) > 100
    assert links.join(pairs.union(pairs.select("dst", "src")), ["src", "dst"], "left_anti").isEmpty()
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: seen.append(a[1:]) or repartition(self, *a))
    cluster.combined_links(df, 0.6)
    assert len(seen) > 2 and set(seen) == {("n", "x", "y")}


def test_components_of_documents_from_few_edges_take_no_rounds(spark, monkeypatch):
    """One task gives what rounds of joins give, also for ids below 0."""
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in np.random.default_rng(7).integers(-200, 200, (250, 2))], "src long, dst long").where("src <> dst")
    monkeypatch.setattr(_graph, "FEW", 0)
    want = set(map(tuple, _graph.components(edges).collect()))
    monkeypatch.setattr(_graph, "FEW", 1 << 20)
    monkeypatch.setattr(_graph, "Observation", rounds := _Counted)
    rounds.made = 0
    assert set(map(tuple, _graph.components(edges).collect())) == want and len(want) > 100
    assert rounds.made == 1
    assert _graph.components(edges.where("src is null")).count() == 0


class _Counted(Observation):
    """An observation that counts how many were made: one, and one more for each round."""

    made = 0

    def __init__(self):
        super().__init__()
        _Counted.made += 1


def test_groups_split_by_one_task_or_by_rounds_are_the_same(spark, monkeypatch):
    """Also with equal vectors, whose ties go by ids."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=8) + 0.7 * rng.normal(size=(60, 8))).astype(np.float32)
    x[50:] = x[:10]
    tags = [["a"], ["a", "b"], ["b", "c"]]
    df = spark.createDataFrame([(f"m{i:02}", v.tolist(), tags[i % 3]) for i, v in enumerate(x)], "id string, embedding array<float>, tags array<string>")
    found = []
    for rows in (30, 2048):
        monkeypatch.setattr(cluster, "TOGETHER", rows)
        found.append(set(map(tuple, cluster.clusters(df, 0.45).collect())))
    assert found[0] == found[1] and len(found[0]) > 50 and len({c for c, _ in found[0]}) > 5
