"""What label propagation leaves to the driver."""

import pytest
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.llm import _graph
from recollect.operators import cluster, dedup


@pytest.fixture
def ran(spark):
    """Calls a function; its result and the operators of each SQL execution since."""
    store = spark._jsparkSession.sharedState().statusStore()

    def run(f):
        bus = spark.sparkContext._jsc.sc().listenerBus()
        bus.waitUntilEmpty(30_000)
        before = store.executionsCount()
        out = f()
        bus.waitUntilEmpty(30_000)
        new = store.executionsList()
        names = []
        for k in range(before, new.size()):
            nodes = store.planGraph(new.apply(k).executionId()).allNodes()
            names.append([nodes.apply(i).name() for i in range(nodes.size())])
        return out, names

    return run


@pytest.mark.parametrize("components", [_graph.components, cluster.connected])
def test_rounds_send_no_labels_to_the_driver(spark, ran, components):
    edges = spark.range(40).where("id % 10 <> 9").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found, names = ran(lambda: components(edges))
    assert {(r.node, r.component) for r in found.collect()} == {(i, i // 10 * 10) for i in range(40)}
    assert not any("Broadcast" in n for own in names for n in own)
    # One execution a round, which counts what it changes, and one each for edges and first labels.
    joined = [own for own in names if any(n.startswith("SortMergeJoin") for n in own)]
    assert len(names) == 2 + len(joined)
    none = components(edges.where("src < 0"))
    assert none.count() == 0


def test_buffer_pairs_are_made_once(spark, ran):
    rows = [(f"m{i}", [1.0, i / 1000]) for i in range(6)]
    m = spark.createDataFrame(rows, "id string, embedding array<double>").withColumns(
        {"layer": F.lit(S.BUFFER), "namespace": F.lit("n"), "created_at": F.lit(1).cast("long"), "access_count": F.lit(1).cast("long"), "importance": F.lit(0.5), "tags": F.array(F.lit("t"))}
    )
    out, names = ran(lambda: dedup.dedup_buffer(m, 0.9).collect())
    assert sum(n == "FlatMapGroupsInArrow" for own in names for n in own) == 1
    assert len(out) == 6 and sum(r.removed for r in out) == 5
