"""Personal data: patterns against plain regular expressions, the tagger's gradients, held-out spans, reconciliation, odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from recollect.llm import pii, queries
from recollect.llm._tagger import Tagger, symbols
from test_llm import DOC, ODD

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The patterns as they are written, leftmost and non-overlapping, then their checks."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_like_plain_expressions():
    rng = np.random.default_rng(4)
    mixed, digits = list("0123456789") * 2 + list("..@@ -+()ab%É\n"), list("0123456789") * 4 + list(" -.+")
    dotted = list("0123....")
    hits = Counter()
    for i in range(4000):
        text = "".join(rng.choice((mixed, digits, dotted)[i % 3], rng.integers(0, 60)))
        want = brute(text)
        hits.update(k for _, k, _ in want)
        assert pii.base_spans(text) == want, text
    assert all(hits[k] > 20 for k in range(4)), hits


@pytest.mark.parametrize("text", ["x" * 70_000, "1" * 70_000, "@" * 70_000, "+1" * 35_000, "1." * 35_000, "a@b" * 23_000, "1 " * 35_000, "." * 70_000 + "@a.b"])
def test_patterns_are_linear(text):
    pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    m = Tagger.new(4, 5)
    m.weights = {k: v.astype(float) + 0.1 * rng.normal(size=v.shape) for k, v in m.weights.items()}
    x, y = rng.integers(40, 60, (3, 7)), rng.integers(0, 4, (3, 7))
    x[1, 5:] = x[2, 2:] = 0
    y[x == 0] = 0
    grads = m.loss(x, y)[1]
    for k, v in m.weights.items():
        at = (x[0, 3], 2) if k.startswith("in_") else tuple(int(rng.integers(s)) for s in v.shape)
        old, sides = v[at], []
        for e in (1e-3, -1e-3):
            v[at] = old + e
            sides.append(m.loss(x, y)[0])
        v[at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - grads[k][at]) < 1e-4, k


def test_decode_is_the_best_sequence():
    from itertools import product

    rng = np.random.default_rng(1)
    m = Tagger.new(3, 4)
    m.weights = {k: (v + rng.normal(size=v.shape)).astype(np.float32) for k, v in m.weights.items()}
    x = rng.integers(40, 60, (4, 5))
    x[3, 3:] = 0
    e, tags = m.emissions(x), m.decode(x)[0]
    for r in range(4):
        n = int((x[r] > 0).sum())

        def score(p, r=r, n=n):
            return m.weights["first"][p[0]] + sum(e[t, r, p[t]] for t in range(n)) + sum(m.weights["moves"][p[t - 1], p[t]] for t in range(1, n))

        assert tuple(tags[r, :n]) == max(product(range(3), repeat=n), key=score)


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return pii.train(pii.sample(docs, "text", 80))


def windows(text):
    chars = symbols(text)
    at = np.unique(np.flatnonzero(pii.TRIGGERS[chars]) // pii.STRIDE)
    return [(0, j * pii.STRIDE, chars[j * pii.STRIDE : j * pii.STRIDE + pii.WINDOW], len(chars)) for j in np.union1d(at, at[at > 0] - 1).tolist()]


def test_tagger_on_held_out_documents(spark, tagger):
    """Spans as the patterns see them, and rewritten ones that they miss, in documents the tagger has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 2 == 1)
    rng, seen, hit, hidden, caught, wrong = np.random.default_rng(9), 0, 0, 0, 0, 0
    for row in docs.where("text rlike '[0-9@]'").select("text").collect():
        text = row.text
        base = pii.base_spans(text)
        if not base:
            wrong += len(pii.reconciled(text, base, [s[1:] for s in pii._tagged(tagger, windows(text))])) if windows(text) else 0
            continue
        got = {s[1:4] for s in pii._tagged(tagger, windows(text))}
        seen, hit = seen + len(base), hit + sum(s in got for s in base)
        start, kind, end = base[0]
        new = pii.rewritten(kind, text[start:end], rng)
        if pii.acceptable(kind, new):
            text = text[:start] + new + text[end:]
            base = pii.base_spans(text)
            hidden += 1
            caught += (start, kind, start + len(new)) in pii.reconciled(text, base, [s[1:] for s in pii._tagged(tagger, windows(text))]) + base
    assert seen > 200 and hit / seen > 0.9
    assert hidden > 100 and caught / hidden > 0.8
    assert wrong <= 2


def test_windows_are_reconciled(tagger):
    """Wherever the windows' edges are, a span is found once; sums of scores decide between overlapping ones."""
    whole = 0
    for at in range(0, 200, 7):
        text = "lorem ipsum dolor " * 12
        text = text[:at] + " anna.12@mail3.example.com " + text[at:]
        got = pii.reconciled(text, [], [s[1:] for s in pii._tagged(tagger, windows(text))])
        assert len(got) <= 1
        whole += got == [(at + 1, 0, at + 26)]
    assert whole > 15
    text = "a@b.cc @d.ee (200) 555-1234 9"
    found = [(0, 0, 6, 1.0), (0, 0, 6, 2.0), (13, 3, 27, 5.0), (13, 3, 29, 4.0), (2, 0, 12, 1.5)]
    assert pii.reconciled(text, [], found) == [(0, 0, 6), (13, 3, 27)]
    assert pii.reconciled(text, [(20, 2, 21)], found) == [(0, 0, 6)]


def test_query_is_complete(spark, docs_small=f"{SMALL}/documents.parquet"):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(docs_small).collect()}
    got = queries.op12_pii(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        want = brute(rows[r.doc_id])
        line = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == pii.KINDS[x] for _, x, _ in want) for k in pii.KINDS]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert set(line) <= {":".join(s) for s in spans}
        assert spans == sorted(spans, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))


def test_pii_odd_rows(spark):
    odd = spark.createDataFrame([*ODD, (None, "mail a.b@c.de or 10.0.0.1", None, None, None, None, None)], DOC).withColumn("spans", F.lit(1))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(odd, epochs=1).collect()}
    assert got.pop(None) == [("email", 5, 13, True), ("ip", 17, 25, True)]
    assert set(got) == {r[0] for r in ODD} and not any(got.values())
    assert pii.find_pii(odd.where("false")).count() == 0
    assert all(not r.spans for r in pii.find_pii(odd.where("doc_id < 5")).collect())


def test_sample_is_bounded_and_the_same_in_any_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    one, many = (pii.sample(docs.repartition(n), "text", 30) for n in (1, 7))
    assert one == many and Counter(s for s, _, _ in one) == {k: 30 for k in range(5)}
