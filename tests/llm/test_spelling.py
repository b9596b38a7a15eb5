"""Spelling variants against brute force, ties, crowded keys, chains and odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from recollect.llm import queries, spelling
from test_llm import DOC, ODD


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        near = sorted((x for x in counts if one_edit(w, x)), key=lambda x: (-counts[x], x))
        form[w] = near[0] if near and counts[near[0]] >= ratio * n else None
        out[w] = [form[w], None, n, len(near), counts.get(form[w])]
    for w in counts:
        end = w
        while form[end]:
            end = form[end]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def family(seed, letters="abÿé", low=1, high=8, n=400):
    """Words of few letters, so that many are near, with counts that tie."""
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(n)}
    return {w: int(rng.choice([5, 5, 7, 30, 160, 900, 5000])) for w in sorted(words)}


@pytest.mark.parametrize("crowd,group,queries_at_once", [(4096, 1 << 20, 1 << 17), (3, 200, 5)])
def test_variants_match_brute_force(spark, monkeypatch, crowd, group, queries_at_once):
    counts = family(crowd)
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "GROUP_CHARS", group)
    monkeypatch.setattr(spelling, "QUERIES", queries_at_once)
    got = found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    want = brute(counts)
    assert got == want
    assert any(v[1] != v[0] for v in want.values() if v[0]), "some chain has two steps"


def test_crowded_keys_are_cut(spark, monkeypatch):
    """One first half for all words: no group gets them all, none is lost."""
    monkeypatch.setattr(spelling, "CROWD", 8)
    monkeypatch.setattr(spelling, "GROUP_CHARS", 2000)
    counts = {"commonly" + w: n for w, n in family(2, letters="abc", low=4, high=7, n=300).items()}
    assert found(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        a, b, c, d = (np.array(x) for x in zip(*[(*sorted(rng.integers(0, n + 1, 2)), *sorted(rng.integers(0, n + 1, 2))) for _ in range(50)]))
        query, value = tree.report(a, b, c, d)
        want = sorted((q, v) for q in range(50) for v in values[a[q] : b[q]].tolist() if c[q] <= v < d[q])
        assert sorted(zip(query.tolist(), value.tolist())) == want


def test_query_matches_plain_python(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = ["Häuser", "houses", "HOUSES", "schöner", "abcdef", "abcdeg", "abcdefg", "übersicht", "longerword", "short", "x×y÷zz"]
    rows = [(i, " ".join(rng.choice(base, rng.integers(0, 60))) + "_a1") for i in range(150)] + [(3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import re

    counts, shortened = Counter(), 0
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{doc}:{w}".encode())
            if h % 199 == 0:
                w, shortened = w[: h % len(w)] + w[h % len(w) + 1 :], shortened + 1
            if len(w) >= 6:
                counts[w] += 1
    assert shortened
    assert found(queries.op13_spelling_variants(spark, str(tmp_path))) == brute({w: n for w, n in counts.items() if n >= 5})


def test_spelling_odd_rows(spark):
    odd = spark.createDataFrame([*ODD, *[(None, "Commonly commonlx", None, None, None, None, None)] * 6], DOC)
    words = spelling.lexicon(queries.with_planted_typos(spelling.letter_runs(odd)))
    assert found(spelling.variants(words)) == {"commonly": (None, "commonly", 6, 1, None), "commonlx": (None, "commonlx", 6, 1, None)}
    alone = spelling.variants(spelling.lexicon(spelling.letter_runs(odd), least_count=1))
    assert found(alone)["x" * 70_000] == (None, "x" * 70_000, 1, 0, None)
    rows = spark.createDataFrame([(None, 3), ("", 9), ("a", 1), ("ab", 8), ("😀b", 8)], "word string, n long")
    want = {None: (None, None, 3, 0, None), "": (None, "", 9, 0, None), "a": ("ab", "ab", 1, 1, 8), "ab": (None, "ab", 8, 2, None), "😀b": (None, "😀b", 8, 1, None)}
    assert found(spelling.variants(rows)) == want
    assert spelling.variants(rows.where("false")).count() == 0 and spelling.lexicon(spelling.letter_runs(odd.where("false"))).count() == 0
