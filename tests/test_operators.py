"""Operators on small fixtures with known outcomes."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import noise
from recollect.functions import scalars as X
from recollect.operators import cluster, dedup, lifecycle, mutations, scans, text, topics, usage, vector
from recollect.operators import facts as G
from recollect.plans import recall as R
from recollect.plans.consolidate import State, consolidate, dedup_and_triage, distill_sessions
from recollect.sources import tables as T

DEFAULT = dict(layer=1, importance=0.5, created_at=0, last_accessed=0, access_count=0, repetition_count=0, decay_rate=1.0, source="test", tags=[], namespace="default", embedding=None, kind="semantic", modified_at=0, modified_epoch=0)
DAY = 86_400_000


def memories(spark, *rows):
    full = [DEFAULT | {"id": f"m{i}", "content": f"text {i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in S.MEMORY_COLS) for r in full], S.MEMORY_DDL)


def facts(spark, *rows):
    full = [(f"f{i}", s, p, o, f"m{i}", "default", i, None, None, None) for i, (s, p, o) in enumerate(rows)]
    return spark.createDataFrame(full, S.FACT_DDL)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


# Scalars


@pytest.mark.parametrize("s,least,most", [("", 1, 1), ("你好世界测试", 4, 4), ("hello world this is a test", 7, 7)])
def test_estimate_tokens(spark, s, least, most):
    assert least <= one(spark, X.estimate_tokens(F.lit(s))) <= most


@pytest.mark.parametrize("s,want", [("alice是谁", True), ("部署流程", True), ("how to deploy", False), ("", False), ("hi", False), ("这是一个非常长的中文查询句子", False)])
def test_short_cjk(spark, s, want):
    assert one(spark, X.is_short_cjk_query(F.lit(s))) is want


@pytest.mark.parametrize("rate,hours,check", [(float("inf"), 1, lambda x: 0 < x < math.inf), (float("nan"), 1, lambda x: 0 < x <= 1), (-5.0, 1, lambda x: x == 1), (0.0, 99, lambda x: x == 1), (1.0, -10, lambda x: x == 1), (0.1, 10_000, lambda x: x < 0.01)])
def test_recency(spark, rate, hours, check):
    now = 10**12
    assert check(one(spark, X.recency(F.lit(now - hours * S.HOUR_MS), F.lit(rate), now)))


@pytest.mark.parametrize("s,want", [("ran cargo build successfully", True), ("fixed the compilation issue in the module", False), ("refactor: rename function to new name", True), ("decision: refactor and rename", False), ("the weather is nice", False)])
def test_code_noise(spark, s, want):
    assert one(spark, noise.is_code_noise(F.lit(s))) is want


def test_cosine_edges(spark):
    a = lambda v: F.lit(v).cast("array<float>") if not v else F.array(*map(F.lit, v))
    assert one(spark, X.cosine(a([1.0, 0.0]), a([1.0, 0.0]))) == pytest.approx(1)
    assert one(spark, X.cosine(a([1.0]), a([1.0, 0.0]))) == 0
    assert one(spark, X.cosine(a([0.0, 0.0]), a([1.0, 0.0]))) == 0


def test_tags_and_labels(spark):
    row = spark.createDataFrame([([" a ", "", "b", "a"],)], "t array<string>").select(X.sanitize_tags(F.col("t")).alias("x"), X.merge_tags(F.col("t"), F.array(F.lit("z")), 3).alias("y")).first()
    assert row.x == ["a", "b"] and len(row.y) == 3
    assert one(spark, X.importance_from_label(F.lit("HIGH"))) == 0.7
    assert one(spark, X.unwrap_json(F.lit('so: [1, 2] ok'))) == "[1, 2]"
    assert one(spark, noise.strip_trailing_stopwords(F.lit("Deploy of the"))) == "Deploy"
    assert one(spark, X.title_case(F.lit("deploy-flow"))) == "Deploy Flow"


def test_validation(spark):
    m = memories(spark, {"content": "  "}, {"content": "x" * 8193}, {"layer": 4}, {"source": "s" * 65}, {"tags": [str(i) for i in range(21)]}, {"tags": ["t" * 33]}, {"kind": "odd"}, {})
    got = [r.e for r in m.orderBy("id").select(X.validation_error().alias("e")).collect()]
    assert got == ["empty content", "content too long", "bad layer", "source too long", "too many tags", "tag too long", "bad kind", None]


# Text


def test_noise_only_query_finds_nothing(spark):
    m = memories(spark, *[{"content": f"common repeated word here doc {i}"} for i in range(10)])
    assert text.search(m, "common", 5).count() == 0


def test_small_corpus_has_no_noise(spark):
    m = memories(spark, {"content": "alice here"}, {"content": "alice there"})
    assert text.search(m, "Alice", 5).count() == 2


def test_index_and_scan_agree(spark):
    m = memories(spark, *[{"content": c, "tags": ["rare"] if i == 2 else []} for i, c in enumerate(["rust compiler notes", "lunch", "Étion rust", "go compiler", "x", "y"])])
    n, mean = m.select(F.size(X.tokens(text.searchable())).alias("d")).agg(F.count("*"), F.avg("d")).first()
    a = [(r.id, round(r.bm25, 9)) for r in text.search(m, "rust etion rare rust", 9).collect()]
    b = [(r.id, round(r.bm25, 9)) for r in text.search_postings(text.postings(m), n, mean, "rust etion rare rust", 9).collect()]
    assert a == b and a[0][0] == "m2"


def test_repair_index(spark):
    m = memories(spark, {"content": "one"}, {"content": "two"})
    index = text.postings(m.where("id = 'm0'").unionByName(memories(spark, {"id": "gone", "content": "old"})))
    assert sorted(r.term for r in text.repair_index(index, m).collect()) == ["one", "two"]


def test_segment(spark):
    out = one(spark, text.segment(F.lit("alice是谁")))
    assert out.startswith("alice 是谁") and one(spark, text.segment(F.lit("plain text"))) == "plain text"


def test_textual_duplicates(spark):
    a = "the user always prefers tabs over spaces when writing any code"
    m = memories(spark, {"content": a}, {"content": a + " here"}, {"content": "too short"}, {"content": "something else entirely and on another matter"})
    assert [(r.a, r.b) for r in text.jaccard_pairs(m, 0.8).collect()] == [("m0", "m1")]


# Vectors


def test_search_keeps_positive_and_namespace(spark):
    m = memories(spark, {"embedding": [1.0, 0.0]}, {"embedding": [-1.0, 0.0]}, {"embedding": [1.0, 1.0], "namespace": "x"}, {})
    assert ids(vector.search(m, [1.0, 0.0], 5)) == ["m0", "m2"]
    assert ids(vector.search(m, [1.0, 0.0], 5, "x")) == ["m2"]
    assert vector.duplicate_of(m, [1.0, 0.0], 0.65).first().id == "m0"


def test_codec_and_means(spark):
    df = spark.createDataFrame([("a", bytearray(vector.encode_vector([1.5, 2.0])))], "id string, v binary")
    assert vector.decode_vectors(df, "v").first().v == [1.5, 2.0]
    m = memories(spark, {"embedding": [3.0, 0.0]}, {"embedding": [0.0, 4.0]})
    c = vector.mean_vector(m, "namespace").first().centroid
    assert c == pytest.approx([0.6, 0.8])


def test_pairs_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    m = memories(spark, *[{"embedding": v.tolist(), "namespace": "ab"[i % 2]} for i, v in enumerate(x)])
    monkeypatch.setattr(vector, "BLOCK_ROWS", 7)
    got = {(r.a, r.b) for r in vector.similar_pairs(m, 0.3, by="namespace").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {tuple(sorted((f"m{i}", f"m{j}"))) for i in range(60) for j in range(i) if i % 2 == j % 2 and u[i] @ u[j] > 0.3}
    assert got == want


# Facts


def test_supersede(spark):
    f = G.supersede(facts(spark, ("alice", "city", "West"), ("Alice", "CITY", "West"), ("alice", "city", "East"), ("bob", "city", "West")))
    got = {r.id: (r.valid_until, r.superseded_by) for r in f.collect()}
    assert got == {"f0": (2, "f2"), "f1": (2, "f2"), "f2": (None, None), "f3": (None, None)}


def test_insert_supersedes_active_only(spark):
    old = G.supersede(facts(spark, ("a", "p", "x"), ("a", "p", "y")))
    new = spark.createDataFrame([("n", "A", "p", "z", "m", "default", 9, None, None, None)], S.FACT_DDL)
    got = {r.id: r.superseded_by for r in G.insert(old, new).collect()}
    assert got == {"f0": "f1", "f1": "n", "n": None}


def test_two_hops_and_cycle(spark):
    f = facts(spark, ("alice", "works_at", "Acme"), ("Acme", "located_in", "East"))
    start = spark.createDataFrame([("alice",)], "entity string")
    assert sorted(len(r.path) for r in G.multihop(f, start, 2).collect()) == [1, 2]
    f = facts(spark, ("A", "likes", "B"), ("B", "likes", "A"))
    chains = G.multihop(f, spark.createDataFrame([("A",)], "entity string"), 3).collect()
    assert len(chains) == 2 and max(len(r.path) for r in chains) == 2


def test_conflicts_history_lookup(spark):
    f = G.supersede(facts(spark, ("alice", "location", "West"), ("alice", "location", "East")))
    assert G.conflicts(f, "ALICE", "location").count() == 2
    assert [r.object for r in G.history(f, "alice", "location").collect()] == ["West", "East"]
    assert [r.object for r in G.lookup(f, "Alice").collect()] == ["East"]
    assert G.lookup(f, "").count() == 0


# Recall


def test_important_row_ranks_first(spark):
    m = memories(spark, {"content": "very important fact about rust", "importance": 0.95}, {"content": "trivial note about lunch", "importance": 0.1}, {"content": "medium importance work log about rust compiler", "importance": 0.5})
    page = R.recall(m, facts(spark), R.Request("rust"), 0).collect()
    assert [r.id for r in page][0] == "m0" and {r.id for r in page} == {"m0", "m2"}


def test_prefilter_changes_results(spark):
    rows = [{"id": "garden", "content": "gardening", "embedding": [1.0, 0.0, 0.0]}] + [{"id": f"p{i}", "content": f"padding {i}", "embedding": [0.0, 0.0, 1.0]} for i in range(4)]
    rows += [{"id": f"v{i}", "content": f"compiler optimization technique variant_{i}", "embedding": [0.6, 0.8, 0.1 * i]} for i in range(6)]
    page = R.recall(memories(spark, *rows), facts(spark), R.Request("compiler optimization", [1.0, 0.0, 0.0], limit=2), 0).collect()
    assert len(page) == 2 and "garden" not in {r.id for r in page}


def test_pages_are_disjoint(spark):
    rows = [{"content": f"padding document {i} with unrelated words"} for i in range(5)] + [{"id": f"e{i}", "content": f"entry_{i} about topic number {i}", "importance": 0.5 + 0.01 * i} for i in range(5)]
    m = memories(spark, *rows)
    first = [r.id for r in R.recall(m, facts(spark), R.Request("topic", limit=2), 0).collect()]
    second = [r.id for r in R.recall(m, facts(spark), R.Request("topic", limit=2, offset=2), 0).collect()]
    assert len(first) == len(second) == 2 and not set(first) & set(second)
    assert R.recall(m, facts(spark), R.Request("topic", offset=100), 0).count() == 0


def test_linked_rows_and_chains(spark):
    m = memories(spark, {"content": "unrelated"}, {"content": "nothing"})
    f = facts(spark, ("alice", "works_at", "acme"), ("acme", "in", "east"))
    page = R.recall(m, f, R.Request("alice"), 0).collect()
    assert [(r.id, r.relevance) for r in page] == [("m0", 1.0)]
    assert R.touched(R.recall(m, f, R.Request("alice"), 0)).count() == 1
    assert R.fact_chains(f, R.Request("alice")).count() == 1


def test_budget_keeps_first(spark):
    m = memories(spark, {"content": "topic " + "x" * 4000, "importance": 0.9}, {"content": "topic y"})
    assert len(R.recall(m, facts(spark), R.Request("topic", budget=10), 0).collect()) == 1


# Lifecycle


def test_core_candidates(spark):
    now = 30 * DAY
    m = memories(spark, {"layer": 2, "importance": 0.8, "access_count": 5, "created_at": now}, {"layer": 2, "importance": 0.5, "access_count": 1, "created_at": now}, {"layer": 2, "importance": 0.6, "access_count": 1, "created_at": now - 8 * DAY}, {"layer": 2, "importance": 0.6, "access_count": 1, "created_at": now - 1000}, {"layer": 2, "importance": 0.9, "access_count": 5, "source": "session"}, {"layer": 2, "importance": 0.9, "access_count": 5, "tags": ["ephemeral"]})
    assert ids(lifecycle.core_candidates(m, now)) == ["m0", "m2"]


def test_buffer_promotion_and_cap(spark):
    m = memories(spark, {"importance": 0.5, "access_count": 6}, {"importance": 0.1, "access_count": 3})
    assert ids(lifecycle.buffer_promotions(m, 1)) == ["m0"]
    m = memories(spark, *[{"importance": 0.2, "created_at": i} for i in range(8)])
    gone = ids(lifecycle.evictions(m, 1, 5))
    assert gone == ["m0", "m1", "m2"]


def test_gate_tags(spark):
    m = memories(spark, {"tags": ["gate-rejected", "_gate_epoch:3", "a"]}, {"tags": ["gate-rejected-2", "_gate_epoch:3"]}, {"tags": []})
    got = [r.t for r in m.orderBy("id").select(lifecycle.reject_tags(9).alias("t")).collect()]
    assert got == [["a", "gate-rejected-2", "_gate_epoch:9"], ["gate-rejected-final", "_gate_epoch:9"], ["gate-rejected", "_gate_epoch:9"]]
    state = [r.s for r in m.orderBy("id").select(lifecycle.gate_state(10).alias("s")).collect()]
    assert state == ["wait", "wait", "open"]


def test_consolidate(spark):
    now = 100 * DAY
    m = memories(spark, {"layer": 3, "tags": ["session"], "last_accessed": now - 1}, {"layer": 1, "importance": 0.9, "access_count": 9, "last_accessed": now - 1}, {"layer": 1, "importance": 0.01, "decay_rate": 5.0}, {"layer": 2, "importance": 0.9, "access_count": 9, "last_accessed": now - 1}, {"layer": 1, "importance": 0.3, "kind": "procedural", "last_accessed": now - 1, "id": "proc", "decay_rate": 0.0})
    new, report = consolidate(State(m, facts(spark), spark.createDataFrame([], S.TRASH_DDL), 4), now)
    got = {r.id: (r.layer, r.tags) for r in new.memories.collect()}
    assert {k: v[0] for k, v in got.items()} == {"m0": 2, "m1": 2, "m3": 3, "proc": 2} or got["proc"][0] in (1, 2)
    assert ids(new.trash) == ["m2"] and new.epoch == 5
    assert report.first().demote == 1


def test_dedupe_buffer_uses_starting_values(spark):
    v = [1.0, 0.0, 0.0]
    m = memories(spark, {"id": "m1", "access_count": 1, "importance": 0.3, "created_at": 1000, "tags": ["a"], "embedding": v}, {"id": "m2", "access_count": 2, "importance": 0.5, "created_at": 2000, "tags": ["b"], "embedding": v}, {"id": "m3", "access_count": 3, "importance": 0.7, "created_at": 3000, "tags": ["c"], "embedding": v}, {"id": "far", "embedding": [0.0, 1.0, 0.0]})
    got = {r.id: r for r in dedup.dedup_buffer(m).collect()}
    assert got["m1"].removed and got["m2"].removed and not got["m3"].removed and "far" not in got
    assert got["m3"].access_count == 5 and {"b", "c"} <= set(got["m3"].tags)
    assert {r.id: r for r in dedup.dedup_buffer(m, accumulate=True).collect()}["m3"].access_count == 6
    after = dedup_and_triage(State(m, facts(spark), spark.createDataFrame([], S.TRASH_DDL), 1), 10**9)
    assert ids(after.memories) == ["far", "m3"]


def test_distil_sessions(spark):
    m = memories(spark, *[{"source": "session", "content": f"note {i}.", "created_at": i} for i in range(3)], {"id": "other"})
    out = distill_sessions(State(m, facts(spark), spark.createDataFrame([], S.TRASH_DDL), 1), 5, lambda t: " ".join(t))
    rows = {r.id: r for r in out.memories.collect()}
    assert len(rows) == 2 and [r.content for k, r in rows.items() if k != "other"] == ["note 0. note 1. note 2."]


# Mutations


def test_insert_merges_duplicates(spark):
    old = memories(spark, {"content": "the user likes to write code with tabs and never with spaces", "tags": ["habit"], "importance": 0.5})
    new = spark.createDataFrame([("n1", "the user likes to write code with tabs and never with blanks", 0.7, ["preference"]), ("n2", "quite another thing that was said today", None, ["lesson"])], "id string, content string, importance double, tags array<string>")
    got = {r.id: r for r in mutations.insert(old, new, 5, 2).collect()}
    assert set(got) == {"m0", "n2"} and got["m0"].importance >= 0.7 and set(got["m0"].tags) == {"habit", "preference"} and got["m0"].repetition_count == 1
    assert got["n2"].importance == 0.75 and got["n2"].layer == 1


def test_insert_batch_rejects(spark):
    new = spark.createDataFrame([("a", "fine"), ("b", " ")], "id string, content string")
    good, bad = mutations.insert_batch(memories(spark), new, 1, 1)
    assert ids(good) == ["a"] and [(r.id, r.error) for r in bad.collect()] == [("b", "empty content")]


def test_promote_demote_touch(spark):
    m = memories(spark, {"layer": 1, "kind": "episodic"}, {"layer": 1}, {"layer": 3, "importance": 1.0})
    every = m.select("id")
    assert [r.layer for r in mutations.promote(m, every, 3, 1, 1).orderBy("id").collect()] == [1, 3, 3]
    assert [r.decay_rate for r in mutations.promote(m, every, 2, 1, 1).orderBy("id").collect()] == [1.0, 0.3, 1.0]
    assert [r.layer for r in mutations.demote(m, every, 2, 1, 1).orderBy("id").collect()] == [1, 1, 2]
    assert [round(r.importance, 2) for r in mutations.touch(m, every, 1).orderBy("id").collect()] == [0.53, 0.53, 1.0]


def test_update_fields(spark):
    m = memories(spark, {}, {})
    done, bad = mutations.update_fields(m, spark.createDataFrame([("m0", "new", None), ("m1", None, 9)], "id string, content string, layer int"), 7, 3)
    got = {r.id: (r.content, r.layer, r.modified_at) for r in done.collect()}
    assert got == {"m0": ("new", 1, 7), "m1": ("text 1", 1, 0)} and ids(bad) == ["m1"]


# Clusters and topics


def test_stars(spark):
    m = memories(spark, {"embedding": [1.0, 0.0, 0.0]}, {"embedding": [0.999, 0.01, 0.0]}, {"embedding": [0.0, 1.0, 0.0]})
    assert {(r.seed, r.id) for r in cluster.star_clusters(m, 0.85).collect()} == {("m0", "m0"), ("m0", "m1")}


def test_tag_boost(spark):
    a, b = [0.0] * 128, [0.0] * 128
    a[0], b[1] = 1.0, 1.0
    m = memories(spark, {"embedding": a, "tags": ["lesson", "deploy"]}, {"embedding": b, "tags": ["lesson", "deploy"]})
    assert cluster.clusters(m, 0.25).select("cluster").distinct().count() == 1
    assert cluster.clusters(m, 0.50).count() == 0


def test_cluster_cap_and_labels(spark):
    m = memories(spark, *[{"embedding": [1.0, 0.0], "tags": ["deploy"]} for _ in range(15)])
    got = cluster.clusters(m, 0.5)
    n = {r.cluster: r["count"] for r in got.groupBy("cluster").count().collect()}
    assert sum(n.values()) == 15 and max(n.values()) <= 10 and len(n) >= 2
    assert {r.label for r in cluster.labels(got, m).collect()} == {"deploy"}


def test_packed(spark):
    df = spark.createDataFrame([(str(i), 4) for i in range(5)], "id string, size int")
    assert [r.batch for r in cluster.packed(df, "size", 10).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_topic_tree_properties(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    m = memories(spark, *[{"embedding": (centres[i % 6] + 0.2 * rng.normal(size=16)).tolist(), "tags": [f"t{i % 6}"]} for i in range(90)])
    nodes, members = topics.topic_tree(scans.topic_entries(m))
    rows = {r.node_id: r for r in nodes.collect()}
    assert sorted(r.memory_id for r in members.collect()) == sorted(f"m{i}" for i in range(90))
    assert all(abs(np.linalg.norm(r.centroid) - 1) < 1e-6 for r in rows.values())
    assert all(r.parent_id is None or r.parent_id in rows for r in rows.values())
    assert sum(r.leaf for r in rows.values()) <= 256
    names = topics.leaf_names(members, m)
    assert names.count() == sum(r.leaf for r in rows.values())
    kept = topics.inherit_names(members, names, members)
    assert kept.count() == names.count()
    assert topics.needs_rebuild(m, m) == "same"


# Sources, usage


def test_versions(spark, tmp_path):
    t = T.VersionedTable(spark, str(tmp_path / "m"), S.MEMORY_DDL)
    assert t.read().count() == 0
    assert t.write(memories(spark, {})) == 1 and t.write(memories(spark, {}, {})) == 2
    assert t.read().count() == 2 and t.compact() == 3 and t.read().count() == 2


def test_json_round_trip(spark, tmp_path):
    T.write_json(T.export_rows(memories(spark, {"tags": ["a"]})), str(tmp_path / "j"))
    (tmp_path / "one.json").write_text(json.dumps([{"id": "x", "content": "c", "layer": 9}]))
    row = T.read_json(spark, str(tmp_path / "one.json")).first()
    assert row.layer == 1 and row.kind == "semantic" and row.namespace == "default" and row.tags == []


def test_payload_parsers(spark):
    sse = 'data: {"choices":[{"delta":{"content":"hello "}}]}\ndata: {"delta":{"text":"world"}}\ndata: [DONE]\n'
    assert one(spark, T.assistant_text(F.lit(sse))) == "hello world"
    assert one(spark, T.assistant_text(F.lit('{"choices":[{"message":{"content":"hi"}}]}'))) == "hi"
    assert one(spark, T.user_text(F.lit('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]'))) == "a b"
    assert one(spark, T.user_text(F.lit('"plain"'))) == "plain"


def test_import_skips_and_renames(spark):
    got = T.import_rows(memories(spark, {}, {}), memories(spark, {}, {"namespace": "other"}, {"id": "new"})).collect()
    assert len(got) == 2 and {r.namespace for r in got} == {"other", "default"} and "m1" not in {r.id for r in got}


def test_newest_entries(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(200)], "key string, created_at long")
    assert usage.newest_entries(df).agg(F.min("created_at")).first()[0] == 72


def test_watermark_stream(spark, tmp_path):
    from recollect.streaming import capture

    say = lambda n: [("user" if i % 2 == 0 else "assistant", f"q{i}") for i in range(n)]
    rows = [("s", 1, say(2)), ("s", 2, say(4)), ("s", 3, say(2)), ("s", 4, say(3)), ("t", 1, say(3))]
    spark.createDataFrame(rows, capture.REQUEST).write.parquet(str(tmp_path / "in"))
    got = []
    q = capture.start(capture.new_turns(spark.readStream.schema(capture.REQUEST).parquet(str(tmp_path / "in"))), lambda b, n: got.extend((r.session_key, r.seq, r.text) for r in b.collect()), str(tmp_path / "c"))
    q.awaitTermination()
    assert got == [("s", 2, "q2"), ("s", 4, "q2")]


def test_providers(spark):
    from recollect import providers

    df = providers.embed(memories(spark, {"content": "a b"}, {"content": ""}).drop("embedding"), batch=1)
    assert [len(r.embedding) for r in df.collect()] == [64, 64]
    assert providers.first_sentences(["One. Two.", "Three."]) == "One. Three."


def test_resolve_prefix(spark):
    m = memories(spark, {"id": "abc1"}, {"id": "abc2"}, {"id": "x"})
    assert scans.resolve_prefix(m, "x") == "x" and scans.resolve_prefix(m, "q") is None
    with pytest.raises(scans.AmbiguousPrefix):
        scans.resolve_prefix(m, "abc")


def test_default_rows_merge_with_every_namespace(spark):
    rows = [("1", 2, "default", [1.0, 0.0]), ("2", 2, "p", [1.0, 0.1]), ("3", 2, "q", [1.0, 0.2]), ("4", 2, "default", [1.0, 0.3]), ("5", 3, "p", [1.0, 0.0]), ("6", 2, "p", [1.0, 0.4])]
    m = spark.createDataFrame(rows, "id string, layer int, namespace string, embedding array<float>")
    got = sorted((r.layer, r.namespace, *sorted((r.a, r.b))) for r in dedup.merge_pairs(m, 0.5).collect())
    assert got == [(2, "default", "1", "2"), (2, "default", "1", "3"), (2, "default", "1", "4"), (2, "default", "1", "6"), (2, "default", "2", "4"), (2, "default", "3", "4"), (2, "default", "4", "6"), (2, "p", "2", "6")]


def test_word_sets_meet_by_rare_words(spark):
    """Texts of frequent words and a few rare ones: the pairs are those of a plain loop, and few others are compared."""
    rng = np.random.default_rng(8)
    usual = [f"w{n}" for n in range(400)]
    texts = [[*rng.choice(usual, 60, False), *[f"rare{i}x{j}" for j in range(25)]] for i in range(300)]
    texts += [[*t[: int(rng.integers(70, 85))], *[f"new{i}x{j}" for j in range(int(rng.integers(0, 12)))]] for i, t in enumerate(texts[:60])]
    texts += [[f"a{i}", "b", "c", "d", "e"][: 3 + i % 3] for i in range(9)]
    m = spark.createDataFrame([(f"m{i:03}", "en" if i % 7 else "de", " ".join(t)) for i, t in enumerate(texts)], "id string, namespace string, content string")
    sets, ids = [set(t) for t in texts], [f"m{i:03}" for i in range(len(texts))]
    for threshold in (0.5, 0.8):
        loop = {(ids[i], ids[j]): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets))}
        want = {p: x for p, x in loop.items() if x > threshold}
        assert len(want) > 20
        assert {(r.a, r.b): r.jaccard for r in text.jaccard_pairs(m, threshold).collect()} == pytest.approx(want)
        old, new = m.where("id < 'm200'"), m.where("id >= 'm200'")
        space = {i: "en" if k % 7 else "de" for k, i in enumerate(ids)}
        across = {p: x for p, x in want.items() if p[0] < "m200" <= p[1] and space[p[0]] == space[p[1]]}
        assert {(r.old_id, r.new_id): r.jaccard for r in text.jaccard_join(new, old, threshold).collect()} == pytest.approx(across) and across
    # With counts of single words, no prefix of a text with rare words holds a usual one.
    rows = text.word_sets(m)
    keys = text.prefixes(rows, "id", text.frequent_words(rows), 0.8)
    assert keys.where("id < 'm300'").groupBy("word").count().agg(F.max("count")).first()[0] == 1
