"""What a recall moves, and that both ways to join its hits agree."""

from conftest import SMALL
from pyspark.sql import functions as F

from recollect.plans import catalogue_index, recall
from recollect.plans.catalogue import mem
from recollect.sources import adapters as A


def page(spark, memories):
    found = recall.recall_expanding(memories, A.facts(spark, SMALL), catalogue_index.UNKNOWN, A.NOW_MS, lambda query: catalogue_index.EXPANSIONS)
    return found.select("rank", "id", F.round("score", 6).alias("score"), "relevance")


def test_hits_are_broadcast_and_texts_stay(spark, monkeypatch):
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    # As at sizes at which Spark broadcasts nothing by itself.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalogue_index.QUERIES["recall_auto_expanded"](spark, SMALL).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    bus.waitUntilEmpty(30_000)
    new, joins = store.executionsList(), []
    for k in range(before, new.size()):
        nodes = store.planGraph(new.apply(k).executionId()).allNodes()
        joins += [(nodes.apply(i).name(), nodes.apply(i).desc()) for i in range(nodes.size()) if "SortMergeJoin" in nodes.apply(i).name()]
    # Only the bounded hits are merged with the linked ids, if with anything.
    assert all("FullOuter" in desc for _, desc in joins)

    few = page(spark, mem(spark, SMALL)).collect()
    monkeypatch.setattr(recall, "LINKED_BROADCAST", -1)
    assert few and page(spark, mem(spark, SMALL)).collect() == few == page(spark, mem(spark, SMALL, True)).collect()
