"""Ingestion: extraction, both dedupes, facts with their memories, topic distillation."""

from pyspark.sql import functions as F

from recollect import schema as S
from recollect.plans import ingest
from recollect.plans.consolidate import State
from test_operators import facts, ids, memories


def state(spark, *rows):
    return State(memories(spark, *rows), facts(spark), spark.createDataFrame([], S.TRASH_DDL), 1)


def test_remember_reinforces_or_inserts(spark):
    m = memories(spark, {"content": "the user prefers dark mode in all applications", "embedding": [0.8, 0.5, 0.3, 0.1]}, {"content": "another", "embedding": [0.0, 0.0, 0.0, 1.0]})
    new = spark.createDataFrame([("n1", "the user prefers dark mode in applications and code editors", [0.82, 0.48, 0.32, 0.08]), ("n2", "a new thing", [-1.0, 0.0, 0.0, 0.0])], "id string, content string, embedding array<float>")
    got = {r.id: r for r in ingest.remember(m, new, 9, 1).collect()}
    assert set(got) == {"m0", "m1", "n2"} and got["m0"].repetition_count == 1 and got["m0"].content.endswith("editors")


def test_capture_and_import(spark):
    turns = spark.createDataFrame([("t", "The deployment always goes through the staging cluster first. ran cargo build on the project again today. " * 2)], "id string, content string")
    out = ingest.capture_batch(state(spark), turns, 5).memories.collect()
    assert [(r.content, r.source, r.tags) for r in out] == [("The deployment always goes through the staging cluster first", "proxy", ["auto-extract"])]
    numbered = spark.createDataFrame([("a", "1. first fact\nx\n2. second")], "id string, text string")
    out = ingest.import_numbered(state(spark), numbered, 5).memories.collect()
    assert sorted((r.id, r.layer) for r in out) == [("a-1", 2), ("a-2", 2)]


def test_facts_get_memories(spark):
    new = spark.createDataFrame([("f", "alice", "likes", "tea", "", "default", 3, None, None, None)], S.FACT_DDL)
    out = ingest.add_facts(state(spark), new, 7)
    assert [(r.id, r.content) for r in out.memories.collect()] == [("fact-f", "alice likes tea")]
    assert out.facts.where("memory_id = 'fact-f'").count() == 1
    assert ingest.report(out.memories, out.facts).first().active_facts == 1


def test_topics_are_distilled(spark):
    s = state(spark, *[{"content": f"note {i}", "created_at": i} for i in range(10)], {"id": "other"})
    nodes = spark.createDataFrame([("kb1", None, 0, 10, True, 1.0, [1.0])], "node_id string, parent_id string, depth int, size int, leaf boolean, avg_sim double, centroid array<double>")
    members = s.memories.where("id <> 'other'").select(F.lit("kb1").alias("node_id"), F.col("id").alias("memory_id"))
    out = ingest.distil_topics(s, nodes, members, lambda t: f"{len(t)} notes", 8)
    assert ids(out.memories) == ["other", "topic-8-kb1"] and out.trash.count() == 10
