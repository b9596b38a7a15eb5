"""Context of windows against plain loops, and what extraction stores."""

import numpy as np
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators.positions import newest_before, reached, running
from recollect.plans import extraction as P
from recollect.plans.consolidate import State
from test_operators import facts, memories


def test_newest_like_a_loop(spark):
    """Many rows of one moment, windows before, at and after it; more than ``most`` in time, and fewer."""
    rng = np.random.default_rng(1)
    rows = [(f"m{i:03}", int(t)) for i, t in enumerate(rng.choice([100, 100, 100, 250, 400, 401, 900], 120))]
    asked = [(f"w{k}", k) for k in (50, 100, 101, 250, 399, 401, 600, 2_000)]
    got = newest_before(spark.createDataFrame(asked, "window_id string, at long"), spark.createDataFrame(rows, "id string, created_at long"), 300, 7).collect()
    want = {(w, n + 1, i) for w, at in asked for n, (t, i) in enumerate(sorted(((t, i) for i, t in rows if at - 300 <= t <= at), reverse=True)[:7])}
    assert {(r.window_id, r["rank"], r.id) for r in got} == want and len(got) == len(want) > 20


def test_positions_are_a_permutation(spark):
    df = spark.range(500).select(F.pmod("id", F.lit(3)).alias("a"), "id")
    got = running(df, ["a", "id"], {"position": F.lit(1), "total": F.col("id")}).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 501)) and [(r.a, r.id) for r in got] == sorted((r.a, r.id) for r in got)
    assert [r.total for r in got] == np.cumsum([r.id for r in got]).tolist()
    assert running(df.where("false"), ["a", "id"], {"position": F.lit(1)}).count() == 0


def test_reached_follows_all_steps(spark):
    nexts = {i: i + 1 + i % 5 for i in range(1, 200)}
    got = reached(spark.createDataFrame(list(nexts.items()), "i long, next long"), 1)
    want, i = [], 1
    while i in nexts:
        want.append(i)
        i = nexts[i]
    assert sorted(r.i for r in got.collect()) == want


HOUR = S.HOUR_MS
LONG = "The deploy of the service failed because the disk was full again today. Nobody had looked at the alerts of the week before that."


def test_windows_see_recent_memories_only(spark):
    m = memories(spark, dict(content="known line " * 30, created_at=9 * HOUR), dict(content="too old", created_at=1 * HOUR), dict(content="newer", created_at=10 * HOUR), dict(content="later", created_at=12 * HOUR))
    windows = spark.createDataFrame([("a", 11 * HOUR, LONG), ("b", 11 * HOUR, "short"), ("c", 0, LONG)], "window_id string, at long, content string")
    seen = P.extract(windows, m, lambda text, known: [P.Entry(f"{len(text)} chars", 0.7, "episodic", ["t"], [("a", "b", k[:12]) for k in known])]).collect()
    got = {r.window_id: r for r in seen}
    assert sorted(got) == ["a", "c"] and got["a"].content == f"{len(LONG)} chars"
    assert [f.object for f in got["a"].facts] == ["newer", "known line k"] and got["c"].facts == []
    default = P.extract(windows, memories(spark, dict(content=LONG.split(". ")[0], created_at=10 * HOUR)))
    assert [r.content for r in default.where("window_id = 'a'").collect()] == [LONG.split(". ")[1].rstrip(".")]


def test_what_is_new_is_stored_with_its_facts(spark):
    vector = lambda *x: [float(v) for v in x]
    texts = {"known one": vector(1, 0.1), "a fine new thing": vector(0, 1), "a fine new thing too": vector(0, 1), "let x = foo(); // fix the bug in main.rs": vector(-1, 0), "no weight": vector(0, 1), "y" * 201: vector(0, 1)}
    entries = spark.createDataFrame(
        [(f"w-{n}", "w", c, 0.2 if c == "no weight" else 0.6, "semantic", ["x"], [{"subject": "s", "predicate": "p", "object": c[:5]}]) for n, c in enumerate(texts)], P.ENTRY
    )
    table = spark.createDataFrame(list(texts.items()), "content string, embedding array<float>")
    m = memories(spark, dict(embedding=vector(1, 0), namespace="other"), dict(embedding=vector(-1, -1)))
    state = State(m, facts(spark, ("s", "p", "old")), spark.createDataFrame([], S.TRASH_DDL), 4)
    new = P.store(state, entries, 77, lambda df: df.join(table, "content"))
    rows = {r.id: r for r in new.memories.collect()}
    assert rows["m0"].repetition_count == 1 and rows["m1"].repetition_count == 0
    added = [r for i, r in rows.items() if not i.startswith("m")]
    assert [(r.id, r.content, sorted(r.tags), r.source, r.created_at) for r in added if r.id == "w-1"] == [("w-1", "a fine new thing", ["auto-extract", "x"], "proxy", 77)]
    assert not any(r.content.startswith(("known", "a fine new thing too", "no", "y")) for r in added)
    linked = {r.id: (r.memory_id, r.object, r.valid_until) for r in new.facts.collect()}
    assert linked["w-1-0"] == ("w-1", "a fin", None) and linked["f0"][2] is not None
