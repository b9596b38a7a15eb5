"""Periodic runs against brute force, the planted query against plain Python, and odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import periodic_runs, queries
from test_llm import DOC, ODD, words


def brute(w, least=6, powers=4):
    """Every period by itself: stretches where words a period apart agree; those with a smaller period are left out."""
    n, out = len(w), []
    for q in range(1, n):
        t = 0
        while t < n - q:
            if w[t] != w[t + q]:
                t += 1
                continue
            e = t
            while e < n - q and w[e] == w[e + q]:
                e += 1
            s, size = t, e - t + q
            smaller = any(all(w[s + i] == w[s + i + d] for i in range(size - d)) for d in range(1, q))
            if size >= max(least, powers * q) and not smaller:
                out.append((s, size, q))
            t = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts += [f"w{x}" for x in rng.integers(0, 3, rng.integers(1, 7))] * int(rng.integers(1, 9))
        yield "  ".join(parts)


@pytest.mark.parametrize("least,powers", [(6, 4), (2, 2), (5, 3)])
def test_runs_match_brute_force(spark, monkeypatch, least, powers):
    monkeypatch.setattr(periodic_runs, "CANDIDATES", 64)
    rows = list(enumerate(texts(120, powers)))
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), least=least, powers=powers).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(rows[r.doc_id][1])
        want = brute(w, least, powers)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, collapsed(w, want))


def test_names_are_equal_where_stretches_are():
    w = np.array([int(c) for c in "0120120121001201"])
    for k, names in enumerate(periodic_runs.name_levels(w, len(w))):
        size = 1 << k
        stretches = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        assert [[a == b for b in stretches] for a in stretches] == [[a == b for b in names] for a in names]


def test_query_matches_plain_python(spark, tmp_path):
    """All of the contract once more, word for word, on documents of which a tenth goes on periodically."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 40, rng.integers(0, 90)))) for i in range(300)] + [(300, None), (301, "\t "), (300, "a a a a a a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = [], 0
    for doc, text in rows:
        w, h = words(text), zlib.crc32(str(doc).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        planted += bool(runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w, runs))]
        want.append((doc, len(runs), *top, top[1] and 1000 * top[1] // top[2], *digests))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert planted > 10 and sorted(got, key=repr) == sorted(want, key=repr)


def test_runs_odd_rows(spark):
    odd = spark.createDataFrame([*ODD, (None, "q q q q q q", None, None, None, None, None)], DOC).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = periodic_runs.periodic_runs(odd).collect()
    assert len(got) == len(ODD) + 1
    by = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by[7] == ([(0, 40_000, 1)], "w") and by[None] == ([(0, 6, 1)], "q") and by[1] == by[2] == by[3] == ([], "")
    assert by[8] == ([(0, 120, 4)], "é ß 部署 😀") and by[6] == ([], "x" * 70_000)
    assert periodic_runs.periodic_runs(odd.where("false")).count() == 0
