"""Operators of the llm subpackage against SQL, brute force, held-out accuracy and edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, same_rows
from recollect.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, neighbours, pieces, quality, queries, span_dedup, url_filter
from recollect.llm._words import WordHasher, windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, component_id string, text_sha256 int"

#: Nulls everywhere, empty and very long texts, ties and repeated rows, columns with the names of results.
ODD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, " \t\n", "en", "a", 3, "x", 1), (4, "one two three four five six seven eight", "en", "b", 5, None, None),
    (4, "one two three four five six seven eight", "en", "b", 5, None, None), (5, "one two three four five six seven eight", None, None, 5, "y", 2), (6, "x" * 70_000, "de", "b", 9, "y", 2),
    (7, "w " * 40_000, "de", "b", 9, "y", 2), (8, "é ß 部署 😀\n" * 30, "fr", "é", 9, "y", 2), (9, "A.", "en", "a", 2, "y", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    assert same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLE_SQL[name])


# Words


def test_word_hashes_are_of_the_words():
    text = b"the cat  \x0b the\tdog " + b"q" * 50 + "é\xa0é the".encode()
    starts, ends, h = WordHasher().words(text)
    assert [text[a:b] for a, b in zip(starts, ends)] == WORD.findall(text)
    assert h[0] == h[2] and len(set(h.tolist())) == len({*WORD.findall(text)})
    assert len(windows(h, 3)) == len(h) - 2 and len(windows(h[:2], 3)) == 0


def test_hashes_do_not_depend_on_place(monkeypatch):
    import recollect.llm._words as w

    text = b" ".join(b"w%d" % (i % 50) for i in range(5000))
    want = WordHasher().words(text)[2]
    monkeypatch.setattr(w, "SPAN", 64)
    assert (WordHasher().words(text)[2] == want).all()


# 1 near dedup


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = top(i), top(j)
                up[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {rows[i][0]: (len(sets[i]), rows[top(i)][0]) for i in range(len(rows))}


def variants(n, seed):
    """A base text and copies with one to six words changed, and chains of copies."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base) if rng.random() < 0.7 else words(rows[rng.integers(len(rows))][1])
        for k in rng.choice(120, rng.integers(0, 7), replace=False):
            own[k] = f"v{rng.integers(40)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_components_match_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_dedup, "REST", 16)
    monkeypatch.setattr(near_dedup, "ALL", 32)
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    rows = variants(150, width)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    want = brute_components(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_miss_rate_holds_at_every_threshold(spark):
    for percent in (60, 70, 80, 85, 90, 100):
        j, n = percent / 100, near_dedup.chunks(percent)
        assert (1 - j**6 - 6 * j**5 * (1 - j)) ** n < 6.5e-6
    assert near_dedup.chunks(85) == 8 and near_dedup.chunks(80) == 12


def test_near_odd_rows(spark, odd):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert got[(1, 0)] == (1, True) and got[(3, 0)] == (3, True) and got[(5, 4)] == (4, False) and got[(7, 1)] == (7, True)
    assert near_dedup.near_duplicates(odd.where("false")).count() == 0
    assert near_dedup.near_duplicates(odd.withColumn("doc_id", F.lit(None).cast("long"))).where("kept").count() == len(ODD)


def test_near_texts_of_one_id(spark):
    """An id with two texts, one of them a near copy of another id's: in any order only that one is linked."""
    a = " ".join(f"w{i}" for i in range(24))
    rows = [(1, a), (2, a + " more"), (2, "other words here now"), (3, "other words here now"), (2, a + " more")]
    for k in range(len(rows)):
        turned = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string").coalesce(1)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(turned).collect())
        assert got == [(1, 20, 1, True), (2, 1, 2, True), (2, 21, 1, False), (2, 21, 1, False), (3, 1, 2, False)]


# 2 language


def test_language_held_out(spark, docs):
    got = queries.op2_language_id(spark, SMALL).join(docs, "doc_id").where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 20 and right / n > 0.95


def test_language_like_kernels_of_sets(spark, docs):
    """The whole method again with sets of n-grams, on few documents."""
    few = docs.where("length(text) < 1500").limit(60)
    rows = [(r.doc_id, r.text.lower().encode(), r.lang) for r in few.withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()]
    sets = [[{t[i : i + n] for i in range(len(t) - n + 1)} for n in (1, 2, 3)] for _, t, _ in rows]
    kernel = np.array([[sum(len(x & y) / max(1, len(x) * len(y)) ** 0.5 for x, y in zip(a, b)) for b in sets] for a in sets])
    learnt = [k for k, r in enumerate(rows) if r[2] is not None and re.search(r"[^\W\d_]", r[1].decode())]
    names = sorted({rows[k][2] for k in learnt})
    marks = [k for v in names for k in [k for k in learnt if rows[k][2] == v][: language_id.LANDMARKS_PER_LANGUAGE]]
    values, vectors = np.linalg.eigh(kernel[np.ix_(marks, marks)])
    root = vectors[:, values > values[-1] * 1e-8] / np.sqrt(values[values > values[-1] * 1e-8])
    z = np.concatenate([kernel[:, marks] @ root, np.ones((len(rows), 1))], 1)
    y = np.array([names.index(rows[k][2]) for k in learnt])
    weight = len(y) / len(names) / np.bincount(y)[y]
    a = np.concatenate([z[learnt] * weight[:, None] ** 0.5, (language_id.RIDGE * len(y)) ** 0.5 * np.eye(z.shape[1])])
    b = np.concatenate([np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0) * weight[:, None] ** 0.5, np.zeros((z.shape[1], len(names)))])
    raw = z @ np.linalg.lstsq(a, b, rcond=None)[0]
    chance = np.exp(language_id.SHARPNESS * raw)
    chance /= chance.sum(1, keepdims=True)
    got = {r.doc_id: r for r in language_id.identify(few, few).collect()}
    for (i, *_), own in zip(rows, chance):
        assert got[i].lang_pred == names[own.argmax()] and got[i].score == pytest.approx(own.max(), abs=2e-3)


@pytest.mark.parametrize("broadcast", [8 << 20, 0])
def test_sample_is_bounded(spark, monkeypatch, broadcast):
    monkeypatch.setattr(language_id, "BROADCAST_BYTES", broadcast)
    df = spark.createDataFrame([(i, f"text {i}", f"l{i % 7}" if i % 2 else "hot") for i in range(3000)], "doc_id long, text string, lang string")
    n = {r.lang: r["count"] for r in language_id.training_sample(df, "doc_id", "text", "lang", 40).groupBy("lang").count().collect()}
    assert n == {"hot": 40} | {f"l{i}": 40 for i in range(7)}
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 20)
    assert language_id.training_sample(df, "doc_id", "text", "lang", 40).count() == 16


def test_language_alone_and_in_company(spark, docs):
    few = docs.limit(40)
    together = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language_id.identify(few, docs).collect()}
    one = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language_id.identify(few.where("doc_id = 3"), docs).collect()}
    assert one[3] == together[3]


def test_language_odd_rows(spark, odd):
    got = {r.doc_id: r for r in language_id.identify(odd, odd).collect()}
    assert len(got) == len({r[0] for r in ODD}) and got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(odd, odd.where("false")).collect()} == {"und"}
    assert language_id.identify(odd.where("false"), odd).count() == 0


# 3 pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


@pytest.mark.parametrize("remembered", [64 << 20, 30_000, 10])
def test_pieces_like_the_library(spark, docs, library, monkeypatch, remembered):
    monkeypatch.setattr(pieces, "FREQUENT_UNITS", 300)
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", remembered)
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == docs.count()
    assert all(list(r.token_ids) == library.encode(r.text) and r.decoded == r.text for r in rows)


def test_merge_rules(library):
    p, rng = pieces.Pieces.load(), np.random.default_rng(5)
    for n in (1, 2, 7, 30, 48, 49, 200):
        for _ in range(30):
            w = "".join(rng.choice(list("aeinrstéñ部ßlo"), n))
            assert p.merge(" " + w) == library.encode(w)


def test_pieces_odd_rows(spark, odd, library):
    rows = pieces.decode(pieces.encode(odd)).collect()
    assert all(list(r.token_ids) == (library.encode(r.text) if r.text else []) for r in rows if len(r.text or "") < 50_000)
    assert all(r.decoded == (r.text or "") for r in rows)
    assert pieces.decode(pieces.encode(odd.where("false"))).count() == 0


# 4 lines


def brute_lines(rows, edits, least):
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, old = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
        return d[-1]

    every = sorted((i, n, t.strip(" ")) for i, text in rows if text is not None for n, t in enumerate(text.split("\n")) if len(t.strip(" ")) >= least)
    return {(i, n) for k, (i, n, t) in enumerate(every) if any((j, m) < (i, n) and abs(len(u) - len(t)) <= edits and distance(u, t) <= edits for j, m, u in every[:k])}


def test_lines_match_brute_force(spark):
    rng, rows = np.random.default_rng(4), []
    stems = ["".join(rng.choice(list("abcdeé😀 "), rng.integers(22, 34))) for _ in range(12)]
    for i in range(60):
        lines = []
        for _ in range(3):
            s = list(stems[rng.integers(12)])
            for _ in range(rng.integers(0, 4)):
                k, what = rng.integers(len(s)), rng.integers(3)
                s[k : k + (what != 1)] = [] if what == 0 else ["z"]
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for edits in (1, 2):
        assert {tuple(r) for r in line_dedup.line_removals(df, max_edits=edits).collect()} == brute_lines(rows, edits, line_dedup.MIN_CHARS)


def test_bit_parallel_distance(spark):
    rng = np.random.default_rng(41)
    rows = [("", ""), ("", "ab"), ("", "abc"), ("abc", ""), ("ab", "ba"), ("x" * 70, "x" * 72), ("é😀部", "é部署")]
    for _ in range(400):
        s = list("".join(rng.choice(list("abé😀"), rng.integers(0, 40))))
        t = list(s)
        for _ in range(rng.integers(0, 6)):
            k, what = int(rng.integers(len(t) + 1)), rng.integers(3)
            t[k : k + (what != 1)] = [] if what == 0 else ["z"]
        rows.append(("".join(s), "".join(t)))
    df = spark.createDataFrame(rows, "one string, two string")
    for k in (0, 1, 2, 3, 4):
        assert df.where(line_dedup.within("one", "two", k) != (F.levenshtein("one", "two") <= k)).count() == 0


def test_family_of_lines_is_not_laid_out(spark, monkeypatch):
    sizes, plain = [], line_dedup.cut

    def counted(df):
        out = plain(df)
        if set(out.columns) == {"a", "c"}:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    rows = [(i, f"Invoice number {chr(97 + i // 26 % 26)} and {chr(97 + i % 26)} of the year, page {chr(97 + i // 676)} of the whole book") for i in range(1200)]
    got = {tuple(r) for r in line_dedup.line_removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_family(rows)
    assert sum(sizes) < 30 * len(rows)


def brute_family(rows):
    """Lines of equal length that differ by substitutions alone."""
    return {(i, 0) for k, (i, t) in enumerate(rows) if any(sum(x != y for x, y in zip(t, u)) <= 2 for _, u in rows[:k])}


def test_hot_lines_are_laid_out_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_TIMES", 3)
    rows = [(i, "a line that all of the documents have\n" + ("a line that all of the documents hav!" if i == 7 else f"own {i}")) for i in range(10)]
    got = {tuple(r) for r in line_dedup.line_removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(1, 10)} | {(7, 1)}


def test_short_lines_match_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(24)
    stems = ["".join(rng.choice(list("abcé😀"), n)) for n in (1, 2, 8, 9, 22, 23, 24, 25, 40)] + ["", "  ", "\t", " \r", "All rights reserved."]
    rows = []
    for i in range(40):
        picked = [stems[k] for k in rng.integers(len(stems), size=6)]
        rows.append((i, "\n".join(" " * int(rng.integers(2)) + (s[:-1] + "z" if s and rng.random() < 0.3 else s) for s in picked)))
    rows += [(50, "Erheed. Titionly.\nown\nErheed. Titionly.\nErheed. Titionly."), (None, "own\nown"), (51, None), (52, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    # Equal to an earlier line at any length, or both of 24 characters at least and within two edits.
    seen, gone = set(), brute_lines([r for r in rows if r[0] is not None], 2, 24)
    for i, text in rows[:-4] + rows[-4:-3]:
        for n, t in enumerate(x.strip(" ") for x in text.split("\n")):
            if t.strip():
                gone |= {(i, n)} if t in seen else set()
                seen.add(t)
    want = {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == want
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    assert {r.doc_id: (r.text, r.n_chars) for r in stage(spark, df, SMALL).collect()} == {i: (t, None if t is None else len(t)) for i, t in want.items()}
    assert want[50] == "Erheed. Titionly.\nown" and want[None] == "own\nown"


def test_lines_odd_rows(spark, odd):
    done = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("clash")))
    got = {r.doc_id: r for r in done.collect()}
    assert done.count() == len(ODD) and got[1].text is None and got[2].text == "" and got[5].text == "" and got[5].n_removed == 1
    assert "_gone" not in done.columns and line_dedup.dedup_lines(odd.where("false")).count() == 0


# 5 neighbours


def test_neighbours_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 5)
    monkeypatch.setattr(neighbours, "QUERY_NUMBERS", 4)
    monkeypatch.setattr(neighbours, "CANDIDATE_NUMBERS", 20)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)] + [(50, None), (51, [0.0, 0.0]), (52, [nan, 1.0]), (53, [inf, 1.0]), (54, [None, 1.0]), (55, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = neighbours.nearest(df, df.where("vec_id % 10 = 0"), 4).collect()
    good = [(i, v) for i, v in rows if i is not None and i < 40]
    for q, v in good[::10]:
        want = sorted(((-(v[0] * w[0] + v[1] * w[1]), i) for i, w in good if i != q))[:4]
        assert [(r.rank, r.vec_id, -r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(n, i, s) for n, (s, i) in enumerate(want, 1)]
    assert {r.query_id for r in got} == {0, 10, 20, 30}
    assert neighbours.nearest(df.where("false"), df, 4).count() == 0 and neighbours.nearest(df, df.where("false"), 4).count() == 0


# 6 mixing


def fill(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in held)
        free = [s for s in order if s not in held]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in held else share[s] for s in order}
        held |= over


def test_targets_and_taken(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("w" * 3 for _ in range(int(rng.integers(1, 200)))), "big" if i % 3 == 0 else ["a", "b", None, "c"][i % 4]) for i in range(600)] + [(900, None, "none"), (901, "", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = fill(sizes, mixing.WEIGHTS, 3)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.5
    assert all(r.size == len(words(t)) for r, (_, t, _) in zip(sorted(got, key=lambda r: r.doc_id), rows)) and all(r.taken <= 3 * r.size for r in got)
    assert all(sum((s.high - s.low) * s.repeats for s in r.spans) == r.taken for r in got)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_schedule_is_spread_and_small(spark):
    rows = [(i, "w " * 1000, "large" if i else "tiny") for i in range(600)] + [(1000, "two words", "tiny2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shares = mixing.targets(df.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size")))
    slots = mixing.schedule(shares, 4096).collect()
    sources, total = {r.source: r.target for r in shares.collect()}, 599 * 1000 + 1000 + 2
    assert len(slots) <= total / 4096 + 2 * len(sources) and len({r.slot for r in slots}) == len(slots)
    for s, target in sources.items():
        own = sorted((r for r in slots if r.source == s), key=lambda r: r.slot)
        assert [r.rank for r in own] == list(range(len(own))) and sum(r.words for r in own) == round(target)
    # In every stretch of the mix a source has its share of slots, but for the discrepancy of the sequence.
    order = [r.source for r in sorted(slots, key=lambda r: r.slot)]
    for n in range(1, len(order)):
        assert abs(order[:n].count("large") - n * order.count("large") / len(order)) < 5


@pytest.mark.parametrize("slots", [0, 1, 2, 3, 4, 100, 1597, 1 << 30])
def test_lattice_is_a_permutation(slots):
    modulus, step = mixing.lattice(slots)
    assert modulus >= slots and modulus * modulus < 1 << 62 and pow(step, -1, modulus) * step % modulus == 1 % modulus
    if modulus < 5000:
        assert len({i * step % modulus for i in range(modulus)}) == modulus


def mixed_in_order(spark, df):
    import corpus_pipeline

    return [(r.doc_id, r.source, len(words(r.text))) for r in corpus_pipeline.mixing_stage(spark, df, SMALL).collect()]


def test_every_part_of_the_mix_has_its_shares(spark, monkeypatch):
    """Prefixes of the mixing stage's rows hold each source by its target; without the golden ratio they don't, and the rows differ."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{i}" for _ in range(int(rng.integers(20, 90)))), "abc"[i % 3], 7) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    monkeypatch.setattr(mixing, "SLOT_WORDS", 128)
    targets = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    total = sum(targets.values())

    def worst(order):
        """The largest distance of a source from its share, in words, at any row."""
        sums, far = dict.fromkeys(targets, 0), 0.0
        for _, source, n in order:
            sums[source] += n
            far = max(far, *(abs(sums[s] - t / total * sum(sums.values())) for s, t in targets.items()))
        return far

    golden = mixed_in_order(spark, df)
    assert worst(golden) < 10 * 128 and golden == mixed_in_order(spark, df.repartition(5))
    slots = {r.doc_id: r.spans for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "lattice", lambda n: (n, 1) if n else (2, 1))
    plain = mixed_in_order(spark, df)
    assert sorted(plain) == sorted(golden) and worst(plain) > 50 * 128
    other = {r.doc_id: r.spans for r in mixing.mix(df).collect()}
    assert sum(other[i] != slots[i] for i in slots) > 600


def test_mixing_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(odd.where("false")).count() == 0
    assert {r.taken for r in mixing.mix(odd.where("doc_id < 4")).collect()} == {0}


# 7 URLs


def test_url_parts_and_rules(spark):
    urls = [None, "nothing", "http://A.Example.COM/en/x?y", "https://www.example.com/en/", "http://example.com", "x://net/fr/1", "x://bnet/fr/1", "a://sub.net/es/#x", "http://free-bets.example.org/en", "http://h/p?u=http://com/", "ftp://com/\nx"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("example.com", "", None, "allow"),
        ("net", "/fr/1", "net/fr/", "block"), ("bnet", "/fr/1", None, "allow"), ("sub.net", "/es/", "net/es/", "block"), ("free-bets.example.org", "/en", None, "block"), ("h", "/p", None, "allow"), ("com", "/\nx", "com/", "allow"),
    ]
    assert url_filter.filter_urls(df.where("false"), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_many_rules_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(7)
    hosts = [".".join(rng.choice(list("abcde"), rng.integers(1, 4))) for _ in range(60)]
    rules = queries.URL_RULES + [url_filter.host_rule(h, "/" + "/".join(rng.choice(list("xy"), rng.integers(0, 3))), "block" if i % 2 else "allow") for i, h in enumerate(hosts)]
    urls = [f"http://{'.'.join(rng.choice(list('abcde'), rng.integers(1, 5)))}/{'/'.join(rng.choice(list('xyz'), rng.integers(0, 4)))}" for _ in range(300)]
    urls += [None, "", "nothing", "http://", "http://a/x", "http://a/x", "http://bet.org/", "x://a.b/" + "long/" * 20_000, "x://" + "a." * 20_000 + "com/"]
    df = spark.createDataFrame([(i // 2, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    literal = sorted(map(str, url_filter.filter_urls(df, rules).collect()))
    monkeypatch.setattr(url_filter, "PLAN_RULES", 0)
    assert sorted(map(str, url_filter.filter_urls(df, rules).collect())) == literal and len(literal) == len(urls)
    assert url_filter.filter_urls(df.where("false"), rules).count() == 0

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in rules if r.name and any(host == h or host.endswith("." + h) for h in [r.name.split("/")[0]]) and path.startswith("/" + r.name.split("/", 1)[1])]
        return min(((-len(r.name), r.name, r.verdict) for r in fits), default=None)

    got = {(r.host, r.path): (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    for u in urls:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        want = judge(u)
        if want:
            assert got[(m[1].lower(), m[2])] == (want[1], want[2])


def test_rules_are_filed_under_their_rarest_word():
    filed = url_filter.index([url_filter.host_rule("a.com", "/", "allow"), url_filter.host_rule("b.com", "/", "block"), url_filter.host_rule("com", "/", "allow")])
    assert {k: [r.name for r in v] for k, v in filed.items()} == {"a": ["a.com/"], "b": ["b.com/"], "com": ["com/"]}


# 8 quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op8_quality(spark, d).join(labels, "doc_id").where("held_out")
    n = got.count()
    assert n > 50 and got.where("quality = predicted").count() / n > 0.93
    assert got.where("quality = 1 and predicted = 0").count() / n < 0.05


def test_isotonic_is_the_best_rising_curve():
    at, value = quality.isotonic(np.arange(6.0), np.array([0.0, 2, 1, 1, 4, 3]), np.array([2.0, 2, 2, 2, 4, 4]))
    assert (np.diff(value) > 0).all() and value == pytest.approx([0, 2 / 3, 7 / 8])


def test_quality_like_one_solve_over_all_rows(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    got = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels).collect()}
    label = dict(labels.where("quality is not null").toPandas().values.tolist())
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    hasher = WordHasher()
    x = np.concatenate([quality._statistics(t.encode(), np.zeros(1, np.int64), hasher) for _, t in rows])
    learnt = [k for k, (i, _) in enumerate(rows) if i in label]
    y = np.array([label[rows[k][0]] for k in learnt], float)
    z = np.clip((x - x[learnt].mean(0)) / np.where(x[learnt].std(0) > 1e-9, x[learnt].std(0), 1), -quality.REACH, quality.REACH)
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, np.sqrt(2 * quality.GAMMA), (x.shape[1], quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    phi = np.concatenate([np.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))], 1)
    # Ridge regression as least squares over all rows at once, with rows of the penalty.
    a = np.concatenate([phi[learnt], np.sqrt(quality.RIDGE) * np.eye(phi.shape[1])])
    raw = phi @ np.linalg.lstsq(a, np.concatenate([y, np.zeros(phi.shape[1])]), rcond=None)[0]
    at = np.clip(np.floor((raw[learnt] + 0.5) * quality.BINS / 2), 0, quality.BINS - 1)
    bins = np.unique(at)
    # Isotonic regression by its min-max formula: of mean labels over bins i to j.
    good, n = np.array([y[at == v].sum() for v in bins]), np.array([(at == v).sum() for v in bins])
    mean = np.array([[good[i : j + 1].sum() / n[i : j + 1].sum() if j >= i else np.nan for j in range(len(bins))] for i in range(len(bins))])
    value = np.array([max(np.nanmin(mean[i, k:]) for i in range(k + 1)) for k in range(len(bins))])
    knots = [((bins[value == v] * n[value == v]).sum() / n[value == v].sum(), v) for v in np.unique(value)]
    want = np.interp(raw, [(p + 0.5) * 2 / quality.BINS - 0.5 for p, _ in knots], [v for _, v in knots])
    assert np.abs(want - [got[i] for i, _ in rows]).max() < 1e-6


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 0), (4, 1), (7, 0), (8, 1), (None, 1), (9, None)], "doc_id long, label int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.predicted for r in quality.classify(odd, labels.where("false")).collect()} == {1}
    assert quality.classify(odd.where("false"), labels).count() == 0


# 9 spans


def brute_spans(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_spans_match_brute_force(spark):
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):
        a = int(rng.integers(0, 40))
        own = [f"w{rng.integers(9)}" for _ in range(30)] + passage[a : a + int(rng.integers(5, 20))] + ["x"] * int(rng.integers(0, 30))
        rows.append((int(rng.permutation(1000)[0]) * 100 + i, " \n".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in span_dedup.remove_repeats(df).collect()}
    assert got == brute_spans(rows, 13)


def test_spans_odd_rows(spark, odd):
    got = {r.doc_id: r for r in span_dedup.remove_repeats(odd, width=4).collect()}
    assert got[1].n_words == 0 and got[2].kept_text == "" and got[4].n_removed == 0 and got[5].n_removed == 8 and got[7].n_words == 40_000
    assert span_dedup.remove_repeats(odd.where("false")).count() == 0
    bare = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert span_dedup.remove_repeats(bare).agg(F.sum("n_removed")).first()[0] == 0


# 10 exact


def test_exact_odd_rows(spark, odd):
    for every in (True, False):
        got = exact_dedup.exact_dedup(odd, digest_all=every).collect()
        assert len(got) == len(ODD)
        by = {r.doc_id: r for r in got}
        assert by[2].keep_id == 1 and by[2].group_size == 2 and not by[2].kept and by[3].group_size == 1 and by[5].keep_id == 4 and by[5].group_size == 3
        want = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", ODD[3][1]).encode()).hexdigest()
        assert by[4].text_sha256 == want and (by[9].text_sha256 is not None) == every
    assert exact_dedup.exact_dedup(odd.where("false")).count() == 0


@pytest.mark.parametrize("every", [True, False])
def test_exact_null_ids(spark, every):
    """Of null ids alone one row stays; beside an id none does."""
    rows = [(None, "same text"), (None, "same  text"), (None, "same\ttext"), (None, "other"), (7, "third"), (None, "third"), (None, "third"), (None, None), (None, "")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest_all=every).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == sorted(
        [(0, 0, 3, True), (0, 0, 3, False), (0, 0, 3, False), (0, 0, 1, True), (7, 7, 3, True), (0, 7, 3, False), (0, 7, 3, False), (0, 0, 2, True), (0, 0, 2, False)]
    )


# Pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    d, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SMALL)
        seen.append((name, out.columns))
        d = spark.createDataFrame(out.toPandas(), out.schema) if name != "pieces" else out
        if name == "mixing":
            mixed = d
    assert all(c == docs.columns for _, c in seen[:-1])
    assert d.where("round_trip").count() == d.count() == mixed.count() > 100


def test_pipeline_stages_follow_brute_force(spark, docs):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SMALL).collect()}
    assert kept == {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed = {}
    for r in corpus_pipeline.mixing_stage(spark, docs, SMALL).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(words(r.text))
    assert mixed == {i: n for i, n in taken.items() if n}
    lines = corpus_pipeline.line_stage(spark, docs, SMALL)
    gone = {(r.doc_id, r.line_no) for r in line_dedup.line_removals(docs, short=True).collect()}
    text = dict(rows)
    assert all(r.text == "\n".join(x for n, x in enumerate(text[r.doc_id].split("\n")) if (r.doc_id, n) not in gone) for r in lines.collect())


def test_stages_on_odd_rows(spark, odd, docs):
    import corpus_pipeline as c

    bare = odd.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long")))
    many = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    texts = lambda df, null: sorted(r.text or "" for r in df.where(F.col("doc_id").isNull() == null).collect())
    accepted = c.quality_stage(spark, many, SMALL)
    assert texts(accepted, True) == texts(accepted, False) and 0 < accepted.count() < many.count()
    assert texts(c.line_stage(spark, bare, SMALL), True) == texts(c.near_stage(spark, bare, SMALL), True) == sorted(t or "" for _, t, *_ in ODD)
    assert c.pieces_stage(spark, bare, SMALL).where("doc_id is null and round_trip").count() == len(ODD)
    for df in (bare, many.unionByName(docs.limit(40))):
        taken, got = {}, {}
        for r in mixing.mix(df).collect():
            taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
        for r in c.mixing_stage(spark, df, SMALL).collect():
            got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(words(r.text))
        assert got == {k: n for k, n in taken.items() if n} and any(i is None for i, _ in got)
    assert c.quality_stage(spark, bare, SMALL).columns == bare.columns


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['recollect.llm'] = None; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)
