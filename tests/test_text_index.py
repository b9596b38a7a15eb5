"""The kept full-text index: the same answers as a search of the live rows, pruned buckets, merging, repair."""

import pytest
from pyspark.sql import functions as F

from recollect.operators import text, text_index
from test_operators import memories

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def rows(n, start=0):
    return [{"id": f"m{i:03}", "content": " ".join(WORDS[(i * k) % 8] for k in range(1, 2 + i % 5)), "namespace": "ab"[i % 2], "tags": ["omega"] if i % 6 == 0 else []} for i in range(start, start + n)]


def answers(df):
    return [(r.id, round(r.bm25, 9)) for r in df.collect()]


def same(spark, index, left, query="alpha gamma alpha omega", limit=12, namespace=None):
    want = answers(text.search(left, query, limit, namespace).select("id", "bm25"))
    assert answers(text_index.search(index, spark, query, limit, namespace)) == want
    return want


def test_changes_give_what_a_search_of_the_rows_gives(spark):
    index = text_index.build(memories(spark, *rows(40)), buckets=8)
    assert same(spark, index, memories(spark, *rows(40)))
    grown = text_index.insert(index, memories(spark, *rows(20, 40), {"id": "blank", "content": "", "namespace": "a"}))
    blank = {"id": "blank", "content": "", "namespace": "a"}
    same(spark, grown, memories(spark, *rows(60), blank), namespace="b")
    less = text_index.remove(grown, spark.createDataFrame([(f"m{i:03}",) for i in range(0, 60, 3)] + [("unknown",), ("blank",)], "id string"))
    left = [r for i, r in enumerate(rows(60)) if i % 3]
    same(spark, less, memories(spark, *left))
    # A row again with another text.
    new = {"id": "m001", "content": "alpha alpha alpha omega", "namespace": "b"}
    again = text_index.insert(less, memories(spark, new))
    left = [new if r["id"] == "m001" else r for r in left]
    assert same(spark, again, memories(spark, *left))[0][0] == "m001"
    assert text_index.totals(again, spark)[0] == len(left)
    # Merged, nothing is dead and the answers are the same; the folder before is as it was.
    assert text_index.dead_share(again, spark) > 0.2
    merged = text_index.merge(again, spark)
    assert merged.folder != again.folder and text_index.dead_share(merged, spark) == 0
    same(spark, merged, memories(spark, *left))
    same(spark, again, memories(spark, *left))
    assert text_index.merge(merged, spark) is merged


def test_only_buckets_of_the_terms_are_read(spark):
    index = text_index.build(memories(spark, *rows(40)), buckets=8)
    own = {r[0] for r in spark.createDataFrame([("alpha",), ("omega",)], "t string").select(index.bucket(F.col("t"))).collect()}
    df = text_index.live(index, spark, ["alpha", "omega"])
    assert {r.bucket for r in df.select("bucket").distinct().collect()} <= own and len(own) < 8
    plan = text_index.search(index, spark, "alpha omega", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [bucket") + plan.count("PartitionFilters: [isnotnull(bucket") >= 2
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan


def test_counts_and_document_frequency(spark):
    m = memories(spark, *rows(50))
    index = text_index.build(m, buckets=4)
    queries = ["alpha zeta", "omega alpha nothing"]
    one, two = text.count_terms(m, queries), text_index.term_counts(index, spark, queries)
    assert (one.terms, one.df, one.n) == (two.terms, two.df, two.n) and one.mean == pytest.approx(two.mean)
    assert all([(i, round(x, 9)) for i, x in one.best(q, 20)] == [(i, round(x, 9)) for i, x in two.best(q, 20)] for q in queries)
    got = {r.term: r.df for r in text_index.document_frequency(index, spark, ["alpha", "omega", "none"]).collect()}
    assert got == {r.term: r.df for r in text.term_document_frequency(m, ["alpha", "omega", "none"]).collect()} and got["none"] == 0


def test_repair_and_empty(spark):
    index = text_index.build(memories(spark, *rows(20)), buckets=4)
    now = memories(spark, *rows(15, 8))
    fixed, orphans, missing = text_index.repair(index, now)
    assert (orphans, missing) == (8, 3)
    same(spark, fixed, now)
    assert text_index.repair(fixed, now)[1:] == (0, 0)
    none = text_index.build(memories(spark, *rows(2)).where("false"))
    assert answers(text_index.search(none, spark, "alpha", 5)) == [] and answers(text_index.search(index, spark, " ", 5)) == []


def test_postings_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([("a", "x y x", ["t"], "n"), ("b", "", [], "n"), ("c", None, ["y"], None)], "id string, content string, tags array<string>, namespace string")
    found = text.postings(df)
    assert {(r.term, r.id, r.namespace, r.dl, r.tf) for r in found.collect()} == {("x", "a", "n", 4, 2), ("y", "a", "n", 4, 1), ("t", "a", "n", 4, 1), ("y", "c", None, 1, 1)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
