"""The inverted-list index: exact with all lists, recall with few, changes, ghosts, pruning of lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import vector, vector_index
from test_metric import clustered

MEMORY = "id string, namespace string, embedding array<float>"


def table(spark, x, start=0):
    return spark.createDataFrame([(f"m{i + start}", "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], MEMORY)


def exact(x, q, k, ids):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ (np.float32(q).astype(float) / np.linalg.norm(np.float32(q).astype(float)))
    return [ids[i] for i in np.lexsort((ids, -s)) if s[i] > 0][:k]


@pytest.fixture(scope="module")
def rows():
    return clustered(1200, 12, 0.6, seed=4)


@pytest.fixture(scope="module")
def index(spark, rows):
    return vector_index.build(table(spark, rows), lists=24)


def found(index, spark, q, k, **more):
    return [r.id for r in vector_index.search(index, spark, list(map(float, q)), k, **more).collect()]


def test_all_lists_are_exact_and_few_find_nearly_all(spark, rows, index):
    ids = np.array([f"m{i}" for i in range(len(rows))])
    hit = 0
    for i in range(0, 200, 20):
        q = rows[i] + np.float32(0.05)
        want = exact(rows, q, 10, ids)
        assert found(index, spark, q, 10, probes=24) == want
        hit += len(set(want) & set(found(index, spark, q, 10, probes=6)))
    assert hit >= 90
    assert all(int(i[1:]) % 2 == 0 for i in found(index, spark, rows[5], 10, probes=24, namespace="a"))


def test_a_table_of_queries_gives_what_single_ones_do(spark, rows, index):
    asked = spark.createDataFrame([(i, rows[i].tolist()) for i in range(0, 60, 6)] + [(900, None), (901, [0.0] * 16)], "query_id long, embedding array<float>")
    got = {}
    for r in vector_index.search_all(index, asked, 5, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: found(index, spark, rows[i], 5, probes=4) for i in range(0, 60, 6)}
    every = vector_index.search_all(index, asked, 5, 24)
    probes = vector_index.probes_for(index, asked, 5, 0.9)
    shares = [vector_index.recall(vector_index.search_all(index, asked, 5, p), every) for p in (probes, max(1, probes - 1))]
    assert shares[0] >= 0.9 and (shares[1] < 0.9 or probes == 1)
    assert vector_index.recall(vector_index.search_all(index, asked, 5, 8), every) >= 0.9 and vector_index.recall(every, every) == 1


def test_only_probed_lists_are_read(spark, rows, index):
    q = rows[3].tolist()
    df = vector_index.search(index, spark, q, 5, probes=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    files = index.rows(spark).where(F.col("list").isin([0, 5])).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("list=0" in r.f or "list=5" in r.f for r in files)


def test_changes_and_rebuild(spark, rows):
    x = rows[:300]
    index = vector_index.build(table(spark, x[:200]), lists=8)
    grown = vector_index.insert(index, table(spark, x[200:], 200))
    assert vector_index.live(grown, spark).count() == 300 and vector_index.ghost_share(grown, spark) == 0
    # A row again, with another vector: the newer counts.
    moved = vector_index.insert(grown, table(spark, -x[:1]))
    assert vector_index.live(moved, spark).count() == 300
    assert found(moved, spark, -x[0], 1, probes=8) == ["m0"] and found(moved, spark, x[0], 300, probes=8)[0] != "m0"
    less = vector_index.remove(moved, spark.createDataFrame([(f"m{i}",) for i in range(0, 300, 4)], "id string"))
    assert vector_index.live(less, spark).where("cast(substring(id, 2) as int) % 4 = 0").isEmpty()
    back = vector_index.insert(less, table(spark, x[4:5], 4))
    assert vector_index.live(back, spark).where("id = 'm4'").count() == 1
    share = vector_index.ghost_share(back, spark)
    assert share == pytest.approx(1 - 226 / 302)
    assert vector_index.rebuild(back, spark, most=0.3) is back
    new = vector_index.rebuild(back, spark)
    assert new.folder != back.folder and vector_index.ghost_share(new, spark) == 0 and new.rows(spark).count() == 226
    q = x[9].tolist()
    assert found(new, spark, q, 20, probes=8) == found(back, spark, q, 20, probes=8)


def test_empty_and_odd_vectors(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", [0.0, 0.0]), ("c", None, [1.0, 0.5])], MEMORY)
    index = vector_index.build(df)
    assert found(index, spark, [1.0, 0.0], 5) == ["c"] and found(index, spark, [0.0, 0.0], 5) == []
    none = vector_index.build(df.where("false"))
    assert vector_index.search_all(none, df.select(F.col("id").alias("query_id"), "embedding"), 3).count() == 0


def test_rows_and_queries_meet_in_blocks(spark, monkeypatch):
    """Blocks smaller than a list, equal vectors, and the rows that are told of each block: at most k a query."""
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    rng = np.random.default_rng(8)
    v = np.repeat(rng.standard_normal((30, 4)).round(1), 3, axis=0)
    df = spark.createDataFrame([(f"r{i:03d}", "n", [float(np.float32(x)) for x in row]) for i, row in enumerate(v)], "id string, namespace string, embedding array<float>")
    index = vector_index.build(df, lists=3)
    asked = df.where("id < 'r020'").select(F.col("id").alias("query_id"), "embedding")
    found = vector_index.search_all(index, asked, 4, 3)
    x = v.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): (r.id, round(r.similarity, 9)) for r in found.collect()}
    for i in range(20):
        s = (unit @ unit[i]).round(9)
        for rank, j in enumerate(sorted(range(90), key=lambda j: (-s[j], j))[:4], 1):
            assert got[f"r{i:03d}", rank] == (f"r{j:03d}", s[j])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan
