"""Spelling variants: words within one edit of each other, by two-dimensional range reporting.

Words x of length L that differ from w at place k begin with w's first k code points and end with what follows the place.
In forward order the former are an interval, in the order of the reversed words the latter are, too;
a wavelet tree over the permutation between both orders reports the words in both. An inserted code point is asked for from
the shorter word, so a deletion is an insertion seen from the longer one. Every pair has one place: of an
insertion, which can fit at several places in a row, the last.

The lexicon is dealt out by what an edit leaves alone: an edit is in the first or the second half of the longer word, so
words meet under (length, half, the other half). Where over ``CROWD`` words share such a key, the half is cut in two again, and
so on down to one code point, where only as many words as there are letters can share it. A key whose words are alone is
dropped before. Keys are packed to groups of some ``GROUP_CHARS`` code points, each a task with its own trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._session import cut, small_batches

LETTERS = r"A-Za-zÀ-ÿ"
#: Indexed words of a key before its part of the word is cut in two; code points of the rows of a group, on average.
CROWD, GROUP_CHARS = 4096, 1 << 20
#: Range queries that go down a tree together.
QUERIES = 1 << 17
LAST = 0x10FFFF


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6) -> DataFrame:
    """(doc_id, word): each maximal run of letters of at least ``least`` code points, A-Z lower-cased; null text has none."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("word"))
    return rows.withColumn("word", F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def lexicon(runs: DataFrame, least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the words of at least ``least_chars`` code points that occur at least ``least_count`` times."""
    return runs.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """Reports which of the places [a, b) of a permutation hold values in [c, d)."""

    def __init__(self, values: np.ndarray):
        self.zeros: list[np.ndarray] = []
        self.bits = max(1, int(len(values) - 1).bit_length())
        for k in reversed(range(self.bits)):
            low = (values >> k) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(low))))
            values = np.concatenate((values[low], values[~low]))

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all queries; a node is left once its places or its values are outside."""
        query, base = np.arange(len(a)), np.zeros(len(a), np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            a0, b0 = zeros[a], zeros[b]
            a = np.concatenate((a0, zeros[-1] + a - a0))
            b = np.concatenate((b0, zeros[-1] + b - b0))
            base = np.concatenate((base, base + width))
            query = np.concatenate((query, query))
            stay = (b > a) & (base < d[query]) & (base + width > c[query])
            a, b, base, query = a[stay], b[stay], base[stay], query[stay]
        return query, base


def _padded(chars: np.ndarray, size: int, fill: int) -> np.ndarray:
    """Rows of code points as strings of ``size``, filled up at the end."""
    out = np.full((len(chars), size), fill, np.uint32)
    out[:, : chars.shape[1]] = chars
    return out.view(f"U{size}").ravel()


def _interval(order: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a sorted list of strings that begin so."""
    return np.searchsorted(order, _padded(begins, size, 0)), np.searchsorted(order, _padded(begins, size, LAST), "right")


def _pairs(size: int, indexed: np.ndarray, asking: np.ndarray, low: np.ndarray, high: np.ndarray, inserted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``asking``, row of ``indexed``) of the words one replaced, or one inserted, code point apart.

    ``indexed``: distinct words of ``size`` in order, as code points; ``asking``: words of that size, or of one less, each with
    the places from ``low`` to ``high`` that it asks for.
    """
    forward, back = _padded(indexed, size, 0), _padded(indexed[:, ::-1], size, 0)
    turned = np.argsort(back)
    backward = back[turned]
    rank = np.empty(len(turned), np.int64)
    rank[turned] = np.arange(len(turned))
    tree = WaveletTree(rank)
    waiting: list[np.ndarray] = []

    def ask() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        row, place, *bounds = np.concatenate(waiting, axis=1)
        waiting.clear()
        q, value = tree.report(*bounds)
        found, row, place = turned[value], row[q], place[q]
        # The word itself is no replacement of it; an insertion counts at the last place where it fits.
        ends = place == asking.shape[1]
        new = indexed[found, place] != asking[row, np.minimum(place, asking.shape[1] - 1)]
        new |= ends & inserted
        yield row[new], found[new]

    for k in range(int(low.min(initial=0)), int(high.max(initial=0))):
        rows = np.flatnonzero((low <= k) & (k < high))
        if not len(rows):
            continue
        chars = asking[rows]
        a, b = _interval(forward, chars[:, :k], size)
        # A replacement always finds the word itself.
        some = np.flatnonzero(b - a > (not inserted))
        rows, a, b = rows[some], a[some], b[some]
        c, d = _interval(backward, chars[some][:, k + (not inserted) :][:, ::-1], size)
        some = np.flatnonzero(d - c > (not inserted))
        if len(some):
            waiting.append(np.stack([rows[some], np.full(len(some), k), a[some], b[some], c[some], d[some]]))
        if sum(w.shape[1] for w in waiting) >= QUERIES:
            yield from ask()
    if waiting:
        yield from ask()


def _best(own: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``own``: how many others, and the other of largest n, of these the first by rank."""
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    mine, first, count = np.unique(own, return_index=True, return_counts=True)
    return mine, count, other[first]


OUT = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _near(table: pa.Table) -> pa.Table:
    """What the words of a group find: (word, n_near, best_n, best), a word once for each way it is met."""
    text, n = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    size, role = table.column("size").to_numpy(), table.column("role").to_numpy()
    low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
    rank = np.zeros(len(text), np.int64)  # in the order of words, among those of one length
    out = []

    def tell(own, other):
        mine, count, best = _best(own, other, n, rank)
        out.append(pa.table([pa.array(text[mine], pa.string()), pa.array(count), pa.array(n[best]), pa.array(text[best], pa.string())], schema=OUT))

    for length in np.unique(size):
        rows = np.flatnonzero((size == length) & (role == 0))
        if not len(rows):
            continue
        words, first = np.unique(text[rows].astype(f"U{length}"), return_index=True)
        held = rows[first]
        indexed = words.view(np.uint32).reshape(len(words), length)
        for kind in (0, 1):
            rows = np.flatnonzero((size == length) & (role == kind))
            if not len(rows):
                continue
            asking = text[rows].astype(f"U{length - kind}")
            rank[rows] = np.unique(asking, return_inverse=True)[1]
            asking = asking.view(np.uint32).reshape(len(rows), length - kind)
            for i, j in _pairs(int(length), indexed, asking, low[rows], high[rows], kind == 1):
                tell(rows[i], held[j])
                if kind:
                    tell(held[j], rows[i])
    return pa.concat_tables([OUT.empty_table(), *out])


def _key(low: Column, high: Column) -> Column:
    """What is left of a word of ``size`` without the places [low, high); a shorter word has one place less there."""
    rest = F.substr("word", high + 1 - F.col("role"), F.col("size"))
    return F.xxhash64("size", low, high, F.substr("word", F.lit(1), low), rest)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) from distinct (word, n): how many words are one edit away, and which of them has the largest n.

    An edit inserts, deletes or replaces one code point. Ties go to the word smaller by code points. Words
    with no other near are left out, as are null and empty ones. Exact at any size and for any family of words.
    """
    small_batches(words.sparkSession)
    size = F.length("word")
    rows = words.where(F.length("word") > 0).select("word", F.col("n").cast("long").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"))
    rows = rows.withColumn("size", size + F.col("role"))
    part = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    halves = lambda low, high: F.array(part(low, F.floor((low + high) / 2)), part(F.floor((low + high) / 2), high))
    rows = rows.withColumn("part", F.explode(F.filter(halves(F.lit(0), F.col("size")), lambda p: p["low"] < p["high"])))
    ready = None
    while True:
        keyed = rows.select("word", "n", "role", "size", "part.low", "part.high").withColumn("key", _key(F.col("low"), F.col("high")))
        counts = keyed.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("held"), F.count(F.lit(1)).alias("all"))
        met = cut(keyed.join(counts.where("held > 0 and all > 1").select("key", "held"), "key"))
        crowded = (F.col("held") > CROWD) & (F.col("high") - F.col("low") > 1)
        fine = met.where(~crowded)
        ready = fine if ready is None else ready.unionByName(fine)
        more = met.where(crowded)
        if more.isEmpty():
            break
        rows = more.select("word", "n", "role", "size", F.explode(halves(F.col("low"), F.col("high"))).alias("part"))
    chars = ready.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-chars // GROUP_CHARS))
    dealt = ready.select("word", "n", "role", "size", "low", "high", F.pmod("key", F.lit(groups)).alias("grp"))
    found = dealt.groupBy("grp").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain of forms, by doubling; counts rise along a chain, so it ends."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each of the distinct (word, n).

    A word's ``form`` is the near word of largest n (ties: the smaller by code points), if that n is at least ``ratio`` times its own;
    ``root`` is reached by following forms to the last, and the word itself without any. ``n_near`` counts the words within one edit, 0 if none.
    A null or empty word has no near words. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form occurs more often than its variant")
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    near = words.join(near_words(words), "word", "left").withColumn("is", F.col("best_n") >= ratio * F.col("n"))
    told = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is"), F.col("best")).alias("form"), F.when(F.col("is"), F.col("best_n")).alias("form_n")))
    roots = _roots(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
