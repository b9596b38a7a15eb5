"""Full-text search: tokens, postings, BM25, near-duplicate texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X
from recollect.operators.lineage import cut, local

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
segment = X.segment


def searchable() -> Column:
    return F.concat_ws(" ", "content", F.array_join("tags", " "))


def query_terms(query: str) -> list[str]:
    """Terms of a query, folded like the index, repeats kept; of CJK text its bigrams, or a character that stands alone."""
    low = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    out = []
    for run in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", low)):
        for part in re.findall(f"{X.CJK}+|(?:(?!{X.CJK}).)+", run):
            cjk = re.match(X.CJK, part) and len(part) > 1
            out += [part[i : i + 2] for i in range(len(part) - 1)] if cjk else [part]
    return out


@dataclass(frozen=True)
class Counts:
    """What one pass over the texts tells about some terms.

    ``rows``: (id, namespace, _dl, _tf0, ...), checkpointed; ``df``: documents with each term; ``n``, ``mean``: how many
    documents there are and their mean length.
    """

    rows: DataFrame
    terms: tuple[str, ...]
    df: dict[str, int]
    n: int
    mean: float

    def is_noise(self, term: str, t: S.Thresholds) -> bool:
        return self.n >= t.noise_min_docs and self.df[term] / self.n > t.noise_df_ratio

    def bm25(self, query: str, t: S.Thresholds = S.DEFAULTS) -> Column:
        """Terms in over 80 % of at least five documents are noise and dropped."""
        terms, parts = query_terms(query), [F.lit(0.0)]
        for term in dict.fromkeys(terms):
            if self.df[term] and not self.is_noise(term, t):
                tf = F.col(f"_tf{self.terms.index(term)}")
                gain = idf(F.lit(float(self.n)), F.lit(float(self.df[term]))) * tf * (K1 + 1) / (tf + (F.col("_dl") / F.lit(self.mean) * B + (1 - B)) * K1)
                parts.append(F.when(tf == 0, 0.0).otherwise(gain * terms.count(term)))
        return reduce(lambda a, b: a + b, parts)

    def best(self, query: str, limit: int, namespace: str | None = None, t: S.Thresholds = S.DEFAULTS) -> list[tuple[str, float]]:
        """(id, bm25) of the ``limit`` best matches of any term, best first, on the driver."""
        rows = self.rows if namespace is None else self.rows.where(F.col("namespace") == namespace)
        found = rows.select("id", self.bm25(query, t).alias("bm25")).where("bm25 > 0")
        return [(r.id, r.bm25) for r in found.orderBy(F.desc("bm25"), "id").limit(limit).collect()]


def count_terms(memories: DataFrame, queries: list[str]) -> Counts:
    """Tokenise all texts once and count the terms of all ``queries``; nothing is exploded or shuffled."""
    terms = tuple(dict.fromkeys(w for q in queries for w in query_terms(q)))
    folded = memories.select("id", "namespace", X.fold(searchable()).alias("_f"))
    texts = folded.select("id", "namespace", X.spaced(F.col("_f")).alias("_s"))
    tfs = [X.times_in(F.col("_s"), t).alias(f"_tf{i}") for i, t in enumerate(terms)]
    rows = cut(texts.select("id", "namespace", X.tokens_in(F.col("_s")).alias("_dl"), *tfs))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    return Counts(rows, terms, {t: one[f"df{i}"] for i, t in enumerate(terms)}, one.n, one.mean or 1.0)


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(LEAST_IDF), F.log((n - df + 0.5) / (df + 0.5)))


def search(memories: DataFrame, query: str, limit: int, namespace: str | None = None, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """The ``limit`` best matches of any term with a column bm25, best first.

    Statistics are of all rows given; only the ids of the matches are joined back.
    """
    found = count_terms(memories, [query]).best(query, limit, namespace, t)
    hits = local(memories.sparkSession, {"id": ([i for i, _ in found], pa.string()), "bm25": ([x for _, x in found], pa.float64())})
    return memories.join(F.broadcast(hits), "id").select(*memories.columns, "bm25").orderBy(F.desc("bm25"), "id")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each row has each of its tokens; a row's tokens are together."""
    for batch in batches:
        tokens = batch.column("_t")
        each = pa.table({"row": pc.list_parent_indices(tokens), "term": tokens.flatten()}).group_by(["row", "term"]).aggregate([([], "count_all")]).combine_chunks()
        row = each.column("row").combine_chunks() if len(each) else pa.array([], pa.int64())
        term = each.column("term").combine_chunks() if len(each) else pa.array([], pa.string())
        tf = each.column("count_all").combine_chunks() if len(each) else pa.array([], pa.int64())
        dl = pc.list_value_length(tokens).cast(pa.int32())
        yield pa.RecordBatch.from_arrays([term, batch.column("id").take(row), batch.column("namespace").take(row), dl.take(row), tf], ["term", "id", "namespace", "dl", "tf"])


def postings(memories: DataFrame) -> DataFrame:
    """(term, id, namespace, dl, tf): an index to keep when many queries are to come. Tokens are counted where their row is; nothing is shuffled."""
    toks = memories.select(F.col("id").cast("string").alias("id"), "namespace", X.tokens(searchable()).alias("_t")).where("_t is not null")
    return toks.mapInArrow(_counted, "term string, id string, namespace string, dl int, tf long")


def search_postings(index: DataFrame, n_docs: int, mean_length: float, query: str, limit: int, namespace: str | None = None, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """:func:`search` on an index; only the postings of the query's terms are read. (id, bm25)."""
    terms = query_terms(query)
    hits = index.where(F.col("term").isin(*set(terms)))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = df.where(~((F.lit(n_docs) >= t.noise_min_docs) & (F.col("df") / n_docs > t.noise_df_ratio)))
    times = F.element_at(F.create_map(*[F.lit(x) for w in set(terms) for x in (w, float(terms.count(w)))]), F.col("term"))
    gain = idf(F.lit(n_docs), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + (F.col("dl") / mean_length * B + (1 - B)) * K1)
    scored = hits.join(F.broadcast(df), "term").groupBy("id", "namespace").agg(F.sum(gain * times).alias("bm25"))
    if namespace is not None:
        scored = scored.where(F.col("namespace") == namespace)
    return scored.select("id", "bm25").orderBy(F.desc("bm25"), "id").limit(limit)


def term_document_frequency(memories: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df) of each term asked for; 0 if it occurs nowhere."""
    toks = X.tokens(searchable())
    counted = memories.select(toks.alias("_t")).agg(*[F.count_if(F.array_contains("_t", t)).alias(f"_{i}") for i, t in enumerate(terms)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_{i}").alias("df")) for i, t in enumerate(terms)])
    return counted.select(F.inline(pairs))


def noise_terms(memories: DataFrame, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """(term, df) of the terms that queries lose."""
    toks = memories.select(F.array_distinct(X.tokens(searchable())).alias("_t"))
    n = toks.agg(F.count(F.lit(1)).alias("_n"))
    df = toks.select(F.explode("_t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).where((F.col("_n") >= t.noise_min_docs) & (F.col("df") / F.col("_n") > t.noise_df_ratio)).select("term", "df")


def repair_index(index: DataFrame, memories: DataFrame) -> DataFrame:
    """The index without orphans and with what it missed."""
    ids = index.select("id").distinct()
    kept = index.join(memories.select("id"), "id", "left_semi")
    return kept.unionByName(postings(memories.join(ids, "id", "left_anti")))


#: At most so many words, the most frequent, have counts that order the prefix filter; a word of at most RARE sets has none.
FREQUENT, RARE = 1 << 17, 8
#: Words of which the prefixes are taken at once.
WORDS_AT_ONCE = 1 << 20
#: Parity bits of a set of words, by 64.
LONGS = 4
BITS = [f"b{k}" for k in range(LONGS)]


def word_sets(df: DataFrame, id_col: str = "id", text_col: str = "content", by: str | None = None) -> DataFrame:
    """(id, _by, w): hashes of the different words of each text with three or more, in ascending order."""
    words = F.sort_array(F.transform(X.dedup_words(F.col(text_col)), lambda x: F.xxhash64(x)))
    rows = df.select(F.col(id_col).alias("id"), (F.col(by) if by else F.lit("")).alias("_by"), words.alias("w"))
    return rows.where(F.size("w") >= 3)


def frequent_words(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words, ascending, and how many sets have each. They order the prefix filter and decide no result."""
    counted = sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RARE)
    counted = cut(counted.withColumn("level", F.floor(F.log2("n") * 8).cast("int")))
    least, held = None, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        held += r["count"]
        if held > FREQUENT:
            break
        least = r.level
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = counted.where(F.col("level") >= least).select("word", "n").toArrow()
    words, n = found.column("word").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def prefixes(sets: DataFrame, key: str, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(_by, ``key``, n, word, b0, ...): the words of each set of n, rare ones first, of which one is shared by any other set that overlaps by over ``threshold``.

    The bits b0, ... are the parities of all words of the set.
    """
    known, counts = frequent

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            upto = np.cumsum(pc.list_value_length(whole.column("w")).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, WORDS_AT_ONCE), "right"), whole.num_rows))
            for lo, hi in zip(np.append(0, cuts), cuts):
                batch = whole.slice(lo, hi - lo)
                n = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
                words = batch.column("w").flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                times = np.where(known[at] == words, counts[at], 0) if len(known) else np.zeros(len(words), np.int64)
                order = np.lexsort((words, times, row))
                place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
                taken = place < np.repeat(n - np.ceil(n * threshold).astype(np.int64) + 1, n)
                bit = np.int64(1) << (words & 63)
                bits = [np.bitwise_xor.reduceat(np.where((words >> 6) % LONGS == k, bit, 0), np.cumsum(n) - n) for k in range(LONGS)]
                own = row[taken]
                of = pa.array(own)
                columns = [batch.column("_by").take(of), batch.column(key).take(of), pa.array(n[own].astype(np.int32)), pa.array(words[order][taken]), *[pa.array(b[own]) for b in bits]]
                yield pa.RecordBatch.from_arrays(columns, ["_by", key, "n", "word", *BITS])

    kinds = dict(sets.dtypes)
    return sets.select("_by", key, "w").mapInArrow(first, f"_by {kinds['_by']}, `{key}` {kinds[key]}, n int, word long, {', '.join(f'{b} long' for b in BITS)}")


def _may_meet(a: str, b: str, threshold: float) -> Column:
    """Whether two rows of :func:`prefixes` may be of sets over the threshold: by their sizes, and as each word that only one of them has changes one parity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in BITS])
    return (F.least(n, m) >= F.greatest(n, m) * threshold) & (apart * (1 + threshold) <= (n + m) * (1 - threshold) + 1e-6)


def _enough(n: Column, m: Column, shared: Column, threshold: float) -> Column:
    """Whether sets of n and m with ``shared`` words in both prefixes may overlap by over ``threshold``.

    Of the set whose prefix ends first, all that the other has of this prefix is in the other's prefix, too; so beyond
    ``shared`` they have no more in common than is left of that set, ceil(n * threshold) - 1 words.
    """
    most = shared + F.greatest(F.ceil(n * threshold), F.ceil(m * threshold)) - 1
    return most * (1 + threshold) > (n + m) * threshold - 1e-6


def overlap(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of different values."""
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def jaccard_pairs(df: DataFrame, threshold: float, id_col: str = "id", text_col: str = "content", by: str | None = None) -> DataFrame:
    """(a, b, jaccard): pairs of texts whose different words overlap by over ``threshold``.

    Prefix filter: words are ordered from rare to common, and a pair over the threshold shares one
    among the first n - ceil(threshold * n) + 1 of each; only those meet. Parities of all words tell most others apart where they
    meet, and how many words two sets share there bounds their overlap, so few are left to be compared. Equal word sets meet once,
    as one; their copies are linked to the smallest id, with jaccard 1. Words are compared by 64-bit hashes.
    """
    base = cut(word_sets(df, id_col, text_col, by).withColumn("k", F.sha2(F.concat_ws(",", F.col("w").cast("array<string>")), 256)))
    classes = cut(base.groupBy("_by", "k").agg(F.min("id").alias("rep"), F.first("w").alias("w")))
    keys = prefixes(classes, "rep", frequent_words(classes), threshold)
    a, b = keys.alias("a"), keys.alias("b")
    near = (F.col("a._by") == F.col("b._by")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.rep") < F.col("b.rep")) & _may_meet("a", "b", threshold)
    shared = a.join(b, near).groupBy(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    pairs = cut(shared.where(_enough(F.col("n"), F.col("m"), F.col("c"), threshold)).select("a", "b"))
    sets = classes.select("rep", "w")
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("w").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("w").alias("y")), "b")
    found = both.select("a", "b", overlap(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") > threshold)
    copies = base.drop("w").join(classes.drop("w"), ["_by", "k"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return found.unionByName(copies)


def jaccard_join(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """(new_id, old_id, jaccard): texts of ``new`` and ``old`` (id, namespace, content) of one namespace that overlap by over ``threshold``."""
    x, y = cut(word_sets(new, by="namespace")), word_sets(old, by="namespace")
    frequent = frequent_words(x.select("w").unionAll(y.select("w")))
    a = prefixes(x.withColumnRenamed("id", "new_id"), "new_id", frequent, threshold)
    b = prefixes(y.withColumnRenamed("id", "old_id"), "old_id", frequent, threshold)
    near = (F.col("a._by") == F.col("b._by")) & (F.col("a.word") == F.col("b.word")) & _may_meet("a", "b", threshold)
    shared = a.alias("a").join(b.alias("b"), near).groupBy("new_id", "old_id", F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    met = cut(shared.where(_enough(F.col("n"), F.col("m"), F.col("c"), threshold)).select("new_id", "old_id"))
    some = word_sets(old.join(met.select(F.col("old_id").alias("id")).distinct(), "id", "left_semi"), by="namespace")
    both = met.join(x.select(F.col("id").alias("new_id"), F.col("w").alias("x")), "new_id").join(some.select(F.col("id").alias("old_id"), F.col("w").alias("y")), "old_id")
    return both.select("new_id", "old_id", overlap(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") > threshold)
