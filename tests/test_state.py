"""Settings, caches, sessions, tree totals, two-sided vector joins, batches, CJK terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import scalars as X
from recollect.operators import cluster, lifecycle, meta, scans, text, topics, usage, vector
from recollect.sources import tables


def test_settings(spark):
    table = spark.createDataFrame([("a:1", "x"), ("a:2", "y"), ("b", "z")], meta.META_DDL)
    table = meta.put(table, spark.createDataFrame([("a:1", "new"), ("a:1", "newer"), ("c", "1")], meta.META_DDL))
    assert meta.get(table, "a:1") == "newer" and meta.get(table, "none") is None
    assert [r.key for r in meta.with_prefix(table, "a:").collect()] == ["a:1", "a:2"]
    assert {r.key for r in meta.clear_prefix(table, "a:").collect()} == {"b", "c"}


def test_a_session_is_flushed_when_it_is_large_and_quiet(spark):
    rows = [(i, s, "x" * n, at) for i, (s, n, at) in enumerate([("large", 20_000, 0), ("fresh", 20_000, 90_000), *[("many", 1, 0)] * 8, ("small", 1, 0)])]
    turns = spark.createDataFrame(rows, "id long, session_key string, content string, created_at long")
    ready = usage.should_flush(turns, 100_000)
    assert {r.session_key for r in ready.collect()} == {"large", "many"}
    gone, left = usage.drain(turns, ready)
    assert gone.count() == 2 and {r.session_key for r in left.collect()} == {"fresh", "small"}
    every, none = usage.drain(turns)
    assert every.count() == 4 and none.count() == 0


def test_cache(spark):
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "key string, created_at long")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "key string, created_at long")
    assert sorted(map(tuple, usage.cache_put(cache, new, 2).collect())) == [("b", 9), ("c", 3)]
    hit, missed = usage.cache_load(cache, new)
    assert [r.key for r in hit.collect()] == ["b"] and [r.key for r in missed.collect()] == ["c"]
    assert tuple(usage.cache_counters(cache, new.union(new)).select("size", "hits", "misses").first()) == (2, 2, 2)


def test_tree_totals_and_naming(spark):
    rows = [("kb1", None, 0, 5, False), ("kb2", "kb1", 1, 2, True), ("kb3", "kb1", 1, 3, False), ("kb4", "kb3", 2, 3, True), ("kb5", None, 0, 1, True)]
    nodes = spark.createDataFrame([(*r, None, [1.0, 0.0] if r[0] != "kb5" else [0.0, 1.0]) for r in rows], topics.NODES)
    got = {r.node_id: (r.is_leaf, r.total_members, r.leaf_count, r.height) for r in topics.tree_totals(nodes).collect()}
    assert got == {"kb1": (False, 5, 2, 2), "kb2": (True, 2, 1, 0), "kb3": (False, 3, 1, 1), "kb4": (True, 3, 1, 0), "kb5": (True, 1, 1, 0)}
    members = spark.createDataFrame([("kb2", "a"), ("kb2", "b"), ("kb4", "c"), ("kb4", "d"), ("kb4", "e"), ("kb5", "f")], topics.MEMBERS)
    named = spark.createDataFrame([("kb2",), ("kb4",)], "node_id string")
    assert tuple(topics.naming_work(members, named).first()) == (3, 1, True)
    assert tuple(topics.naming_work(members, named.where("false")).first()) == (3, 3, True)
    assert topics.naming_work(members.union(spark.createDataFrame([("kb5", x) for x in "ghij"], topics.MEMBERS)), named.where("false")).first().put_off is False
    new = spark.createDataFrame([("x", [0.1, 1.0]), ("y", [-1.0, -1.0]), ("z", None)], "id string, embedding array<float>")
    placed = {r.memory_id: r.node_id for r in topics.insert_into(nodes, members, new).collect()}
    assert len(placed) == 8 and placed["x"] == "kb5" and placed["y"] == "new-y"


def test_two_sided_similarities(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(20, 6)).astype(np.float32), rng.normal(size=(30, 6)).astype(np.float32)
    frame = lambda x, p: spark.createDataFrame([(f"{p}{i}", v.tolist()) for i, v in enumerate(x)] + [(f"{p}none", None), (f"{p}zero", [0.0] * 6), (f"{p}other", [1.0])], "id string, embedding array<float>")
    got = {(r.new_id, r.old_id): round(r.similarity, 6) for r in vector.similar_across(frame(a, "a"), frame(b, "b"), 0.4).collect()}
    x, y = a.astype(float), b.astype(float)
    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert got == {(f"a{i}", f"b{j}"): round(float(s[i, j]), 6) for i, j in zip(*np.nonzero(s > 0.4))} | {("aother", "bother"): 1.0}
    assert vector.similar_across(frame(a, "a").where("false"), frame(b, "b"), 0.4).count() == 0


def test_approximate_search_finds_what_the_exact_one_does(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    found = 0
    for i in range(5):
        q = (x[i] + 0.1 * rng.normal(size=16)).tolist()
        exact = {r.id for r in vector.search(df, q, 10).collect()}
        found += len(exact & {r.id for r in vector.lsh_neighbours(df, q, 10).collect()})
    assert found >= 0.9 * 50


def test_batches_are_filled_in_order(spark):
    rng = np.random.default_rng(3)
    for sizes in ([4, 4, 4, 20, 1, 9, 1], [0, 0, 25, 0, 3, 8, 0], rng.integers(0, 14, 120).tolist(), [11] * 5, [0] * 4):
        want, batch, used = [], 0, 0
        for n in sizes:
            if used and used + n > 10:
                batch, used = batch + 1, 0
            used += n
            want.append(batch)
        df = spark.createDataFrame(list(enumerate(map(int, sizes))), "id long, size long")
        assert [r.batch for r in cluster.packed(df, "size", 10).orderBy("id").collect()] == want
    assert cluster.packed(df.where("false"), "size", 10).count() == 0


def test_cjk_terms_of_queries_and_texts(spark):
    assert text.query_terms("Deploy部署服务 v2 器") == ["deploy", "部署", "署服", "服务", "v2", "器"]
    df = spark.createDataFrame([("a", "部署服务 now"), ("b", "plain café text"), ("c", ""), ("d", "x y x")], "id string, t string")
    spaced = df.select("id", X.spaced(X.fold(F.col("t"))).alias("s"), X.tokens(F.col("t")).alias("w"))
    got = {r.id: r for r in spaced.select("*", X.tokens_in(F.col("s")).alias("n"), X.times_in(F.col("s"), "x").alias("x"), X.times_in(F.col("s"), "部署").alias("cjk"), X.times_in(F.col("s"), "cafe").alias("cafe")).collect()}
    assert all(r.n == len(r.w) for r in got.values())
    assert got["d"].x == 2 and got["a"].cjk == 1 and got["b"].cafe == 1 and got["c"].n == 0


@pytest.mark.parametrize(
    "tags,off,auto",
    [
        ([], "open", "open"),
        (["_gate_pending_epoch:197"], "wait", "wait"),
        (["_gate_pending_epoch:196"], "open", "open"),
        (["gate-rejected", "_gate_epoch:153"], "wait", "wait"),
        (["gate-rejected", "_gate_epoch:152"], "retry", "retry"),
        (["gate-rejected"], "retry", "retry"),
        (["gate-rejected-2", "_gate_epoch:57"], "wait", "final"),
        (["gate-rejected-2", "_gate_epoch:56"], "retry", "final"),
        (["gate-rejected-2", "gate-rejected", "_gate_epoch:190"], "wait", "final"),
        (["gate-rejected-2", "_gate_pending_epoch:199"], "wait", "wait"),
    ],
)
def test_every_gate_state(spark, tags, off, auto):
    df = spark.createDataFrame([(tags,)], "tags array<string>")
    assert tuple(df.select(lifecycle.gate_state(200, "off"), lifecycle.gate_state(200, "auto")).first()) == (off, auto)


def test_triaged_rows_are_not_judged_again(spark):
    rows = [(1, ["_triaged"], 0), (1, [], 0), (1, [], 500_000), (1, ["distilled"], 0), (2, [], 0)]
    df = spark.createDataFrame(rows, "layer int, tags array<string>, created_at long")
    got = [tuple(r) for r in df.select(lifecycle.triage_eligible(1_000_000), lifecycle.triage_eligible(1_000_000, True)).collect()]
    assert got == [(True, False), (True, True), (False, False), (False, False), (False, False)]


def test_topic_entries_number_every_row(spark):
    """More than 10,000 rows of a layer are all numbered, layers and importance from the top, ids as strings."""
    rows = spark.range(10_050).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("layer"), (F.col("id") % 7 / 10).alias("importance"), F.array(F.lit(1.0)).alias("embedding"))
    rows = rows.union(spark.createDataFrame([("a", 3, 0.1, [1.0]), ("b", 3, 0.9, [1.0]), ("c", 3, 0.9, None)], "id string, layer int, importance double, embedding array<double>"))
    got = {r.id: r.idx for r in scans.topic_entries(rows, keep=["id"]).collect()}
    want = sorted(((-r.layer, -r.importance, r.id) for r in rows.collect() if r.embedding is not None))
    assert got == {key[2]: k for k, key in enumerate(want)}
    assert scans.topic_entries(rows, 5).count() == 7


def test_a_compacted_table_has_files_of_a_size(spark, tmp_path):
    """What one task rewrites is bounded by bytes: a larger table has more files, not one."""
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "id long, text string")
    table.write(spark.range(0, 4000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")))
    assert table.compact(file_bytes=80_000) == 2 and 2 <= len(table.read().inputFiles()) < 8
    assert table.compact() == 3 and len(table.read().inputFiles()) == 1 and table.read().count() == 4000
