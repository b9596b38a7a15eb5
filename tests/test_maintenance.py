"""A full consolidation: each step on rows with known outcomes, and runs that are stopped after each step."""

import math

import pytest
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.plans import maintenance as P
from recollect.plans.consolidate import State
from test_operators import facts, memories

HOUR = S.HOUR_MS
NOW = 1_000 * HOUR


def unit(plane, degrees=0.0):
    """A vector in one of several planes, so that only vectors of one plane are alike."""
    v = [0.0] * 16
    v[2 * plane], v[2 * plane + 1] = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return v


def start(spark, *rows, **more):
    none = spark.createDataFrame([], "key string")
    return P.Run(State(memories(spark, *rows), facts(spark, ("a", "p", "x")), spark.createDataFrame([], S.TRASH_DDL), 5), more.pop("kept", none), **more)


def by_id(run):
    return {r.id: r for r in run.state.memories.collect()}


def gone(run):
    return sorted(r.id for r in run.state.trash.collect())


def test_reconcile(spark):
    rows = [
        dict(layer=2, embedding=unit(0), tags=["old"], importance=0.9, access_count=3),  # m0 goes, its namespace stays
        dict(layer=2, embedding=unit(0, 45), created_at=2 * HOUR, namespace="x", tags=["new"], access_count=4),
        dict(layer=3, embedding=unit(1), namespace="x", created_at=HOUR),  # m2 goes for a Buffer row, which becomes Core
        dict(layer=1, embedding=unit(1, 44), namespace="x", created_at=5 * HOUR),
        dict(layer=2, embedding=unit(2), namespace="x"),  # m4, m5: too far apart for the default hook
        dict(layer=2, embedding=unit(2, 55), namespace="x", created_at=9 * HOUR),
        dict(layer=3, embedding=unit(3), namespace="x"),  # m6, m7: the newer is of a lower layer
        dict(layer=2, embedding=unit(3, 45), namespace="x", created_at=9 * HOUR),
        dict(layer=2, embedding=unit(4), namespace="y"),  # m8, m9: other namespaces
        dict(layer=2, embedding=unit(4, 45), namespace="z", created_at=9 * HOUR),
    ]
    run = P.reconcile(start(spark, *rows), NOW, P.Hooks())
    m = by_id(run)
    assert gone(run) == ["m0", "m2"] and [r.key for r in run.kept.collect()] == ["m4:m5"] and run.reconciled_ms == NOW
    assert (m["m1"].namespace, sorted(m["m1"].tags), m["m1"].importance, m["m1"].access_count, m["m1"].content) == ("default", ["new", "old"], 0.9, 7, "text 1")
    assert m["m3"].layer == 3 and m["m5"].layer == 2 and run.state.facts.count() == 0
    # A merged text comes with a new vector; old rows don't meet again, and kept pairs are not asked.
    asked = []

    def relation(pairs):
        asked.extend(r.key for r in pairs.collect())
        return pairs.select("key", F.lit("absorb").alias("decision"), F.lit(" one text ").alias("content"))

    run = P.reconcile(start(spark, *rows, kept=run.kept), NOW, P.Hooks(relation=relation))
    assert sorted(asked) == ["m0:m1", "m2:m3"] and by_id(run)["m1"].content == "one text" and len(by_id(run)["m1"].embedding) == 64
    asked.clear()
    later = P.reconcile(start(spark, *rows, reconciled_ms=6 * HOUR), NOW, P.Hooks(relation=relation))
    assert asked == ["m4:m5"] and gone(later) == ["m4"]


def test_distil(spark):
    note = dict(source="session", layer=1)
    rows = [
        *[note | dict(namespace="x", content=f"Note number {i}. More of it.", created_at=i) for i in range(3)],
        *[note | dict(namespace="y", content=f"The river runs high {w}. And so on.", created_at=1) for w in ("today", "now", "again")],
        dict(namespace="y", layer=2, content="The river runs high today. The river runs high now. The river runs high again.", embedding=None),
        *[note | dict(namespace="z", content="only two notes")] * 2,
        *[note | dict(namespace="w", content="w" * 900)] * 3,
    ]
    rows = [r | {"id": f"m{i:02}"} for i, r in enumerate(rows)]
    run = P.distil(start(spark, *rows), NOW, P.Hooks(summarise=lambda texts: "" if "w" * 99 in texts[0] else " ".join(t.split(". ")[0] + "." for t in texts), embed=lambda df: df.withColumn("embedding", F.lit(None).cast("array<float>"))))
    m = by_id(run)
    made = m.pop(f"distilled-{NOW}-x")
    assert made.content == "Note number 0. Note number 1. Note number 2." and made.tags == ["project-status", "auto-distilled"] and made.kind == "episodic" and made.importance == 0.7
    assert gone(run) == ["m00", "m01", "m02"] and not any(i.startswith("distilled") for i in m)
    assert {i for i, r in m.items() if "distilled" in r.tags} == {"m03", "m04", "m05"}


def test_merge(spark):
    long = "This is said once more at length, and then again. " * 4
    rows = [
        dict(layer=2, embedding=unit(0), content=long, tags=["a"], access_count=1, importance=0.2, created_at=5),
        dict(layer=2, embedding=unit(0, 10), content=long, tags=["b"], access_count=2, importance=0.8, created_at=9, namespace="x"),
        dict(layer=2, embedding=unit(0, 20), content=long, tags=["c"], access_count=4, created_at=7),
        dict(layer=1, embedding=unit(0, 5), content=long),  # another layer
        dict(layer=3, embedding=unit(1), content="short"),  # m4, m5: the merged text is no shorter
        dict(layer=3, embedding=unit(1, 9), content="short"),
    ]
    run = P.merge(start(spark, *rows), NOW, P.Hooks(merge=lambda texts: "Said once." if len(texts[0]) > 50 else "longer than both of them"))
    m = by_id(run)
    assert gone(run) == ["m0", "m2"] and sorted(m) == ["m1", "m3", "m4", "m5"] and run.merged_ms == NOW
    w = m["m1"]
    assert (w.content, w.namespace, w.importance, w.access_count, w.tags, len(w.embedding)) == ("Said once.", "default", 0.8, 7, ["a", "b", "c"], 64)
    again = P.merge(run, NOW + 1, P.Hooks())
    assert gone(again) == ["m0", "m2"] and by_id(again)["m4"].content == "short"


def everything(spark):
    rows = []
    for i in range(60):
        rows.append(dict(layer=i % 3 + 1, embedding=unit(i % 7, 9.0 * (i // 7)), created_at=i * HOUR, modified_at=i * HOUR, last_accessed=i * HOUR, importance=(i % 10) / 10, access_count=i % 8, repetition_count=i % 4, namespace=["default", "x"][i % 5 > 1], content=f"Row number {i} says something. " * 3, source="session" if i % 6 == 1 else "test", tags=[f"t{i % 3}"]))
    return start(spark, *rows)


def frozen(run):
    tables = (run.state.memories, run.state.facts, run.state.trash, run.kept)
    return [sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in tables] + [run.reconciled_ms, run.merged_ms, run.state.epoch]


def test_a_stopped_run_ends_as_one_that_was_not(spark, tmp_path):
    first = everything(spark)
    whole, reports = P.run_steps(first, f"{tmp_path}/whole", NOW, merging=True)
    want = frozen(whole)
    names = [r.step for r in reports.orderBy("n").collect()]
    assert names == ["cycle", "reconcile", "distil", "dedupe", "triage", "merge"] and whole.state.epoch == 6
    assert whole.state.trash.count() > 5 and whole.kept.count() > 0
    other = P.Hooks(relation=lambda pairs: pytest.fail("a finished step ran again"))
    folder = f"{tmp_path}/parts"
    for k, name in enumerate(names):
        part, done = P.run_steps(first, folder, NOW, merging=True, stop_after=name, hooks=P.Hooks() if k < 2 else other)
        assert done.count() == k + 1 and (frozen(part) == want) == (k == len(names) - 1)
    # A step that was cut off has no report and is written again, from the state before it.
    import shutil

    shutil.rmtree(f"{folder}/5-merge/report")
    shutil.rmtree(f"{folder}/4-triage/report")
    shutil.rmtree(f"{folder}/4-triage/trash")
    again, _ = P.run_steps(first, folder, NOW, merging=True, hooks=other)
    assert frozen(again) == want


def test_level_off_compares_no_texts(spark, tmp_path):
    run, reports = P.run_steps(everything(spark), str(tmp_path), NOW, level="off", merging=True)
    assert [r.step for r in reports.orderBy("n").collect()] == ["cycle", "dedupe", "triage"] and run.kept.count() == 0 and run.reconciled_ms == 0
