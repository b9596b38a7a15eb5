"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has n chunks of WIDTH symbols of SYMBOL_BITS bits, each the low bits of a
min-wise hash of its shingle set. If two signatures differ in at most 2 * n - 1 symbols, then
by pigeonhole some chunk differs in at most one; so each chunk is indexed once for each symbol
left out, and all pairs within that distance share a key. n follows from the threshold, so that a
pair at the threshold misses every key with a probability of at most MISS: 8 chunks at a Jaccard
similarity of 0.85 (6e-6), 12 at 0.80 (3e-6). Links are confirmed on full shingle sets.

Documents with one and the same shingle set are one class from the start. In a key's bucket each
class is first tested against the smallest only. Where a bucket then still holds several components,
the members outside the largest are tested against all, in blocks, as matrix products of shingle sets;
a block tells at most one link of a member to each component, so pairs are never laid out as rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._graph import components
from recollect.llm._session import cut, small_batches
from recollect.llm._words import U64, WordHasher, blocks, mix, windows

WIDTH, SYMBOL_BITS = 6, 16
#: A pair at the threshold shares no key with at most this probability.
MISS = 6.5e-6
#: Members of a block of the rest and of all; shingles multiplied at once.
REST, ALL, COLUMNS = 512, 2048, 4096


def chunks(percent: int) -> int:
    """How many chunks keep the miss rate: one alone has a key in common if at most one of its symbols differs."""
    j = percent / 100
    differs = 1 - j**WIDTH - WIDTH * j ** (WIDTH - 1) * (1 - j)
    return max(1, math.ceil(math.log(MISS) / math.log(differs))) if differs > 0 else 1


def _sets(block: bytes, starts_of: np.ndarray, hasher: WordHasher, width: int):
    """Distinct shingle hashes of each row of a block, one after the other, and how many each has."""
    starts, _, h = hasher.words(block.lower())
    row = np.searchsorted(starts_of, starts, "right") - 1
    n_rows = len(starts_of)
    first = np.searchsorted(row, np.arange(n_rows + 1))
    grams = windows(h, width)
    out, counts = [], np.zeros(n_rows, np.int64)
    for r in range(n_rows):
        lo, hi = first[r], first[r + 1]
        if hi - lo >= width:
            own = np.unique(grams[lo : hi - width + 1])
        elif hi > lo:
            own = windows(h[lo:hi], hi - lo) + U64(hi - lo)
        else:
            continue
        counts[r] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.empty(0, U64)), counts


def _sketcher(width: int, n_chunks: int):
    symbols = n_chunks * WIDTH

    def sketch(batches):
        hasher = WordHasher()
        rng = np.random.default_rng(85)
        xor = rng.integers(0, 1 << 63, symbols, dtype=np.uint64)
        mult = rng.integers(0, 1 << 63, symbols, dtype=np.uint64) * U64(2) + U64(1)
        for batch in batches:
            for lo, hi, block, begins in blocks(batch.column(1)):
                values, counts = _sets(block, begins, hasher, width)
                some = counts > 0
                at = np.concatenate(([0], np.cumsum(counts[some])[:-1])).astype(np.int64)
                sums = np.zeros((2, hi - lo), U64)
                signature = np.zeros((hi - lo, symbols), np.uint16)
                if len(values):
                    for k in range(2):
                        sums[k, some] = np.add.reduceat(mix(values + U64(k + 1)), at)
                    for k in range(symbols):
                        v = values ^ xor[k]
                        v *= mult[k]
                        v ^= v >> U64(32)
                        signature[some, k] = (mix(np.minimum.reduceat(v, at)) & U64((1 << SYMBOL_BITS) - 1)).astype(np.uint16)
                sets = pa.array([sums[:, r].tobytes() for r in range(hi - lo)], pa.binary())
                packed = pa.FixedSizeListArray.from_arrays(pa.array(signature.reshape(-1).astype(np.int32)), symbols).cast(pa.list_(pa.int32()))
                passed = [batch.column(k).slice(lo, hi - lo) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*passed, pa.array(counts), sets, packed], ["doc_id", "text_key", "n_shingles", "set_key", "signature"])

    return sketch


def _set_builder(width: int):
    def build(batches):
        hasher = WordHasher()
        for batch in batches:
            for lo, hi, block, begins in blocks(batch.column(1)):
                values, counts = _sets(block, begins, hasher, width)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], ["rep", "shingles"])

    return build


def _keys(signature: Column, n_chunks: int) -> Column:
    """A key for each chunk and each symbol left out of it."""
    made = []
    for c in range(n_chunks):
        part = [signature[c * WIDTH + j] for j in range(WIDTH)]
        made += [F.xxhash64(F.lit(c * WIDTH + out), *[p for j, p in enumerate(part) if j != out]) for out in range(WIDTH)]
    return F.array(*made)


def _alike(n: Column, m: Column, s: Column, t: Column, percent: int, n_chunks: int) -> Column:
    """Bounds that no pair over the threshold and within the signature distance breaks."""
    apart = F.size(F.filter(F.zip_with(s, t, lambda x, y: x != y), lambda d: d))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart <= 2 * n_chunks - 1)


def _links(percent: int):
    """For a block of the rest (side 0) and one of all (side 1): a link of each member to each other component."""

    def links(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        lists = table.column("shingles").combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.zeros(len(sizes), np.int64)
        place[one], place[two] = np.arange(len(one)), np.arange(len(two))
        values = values[offsets[0] : offsets[-1]]
        mine = side[owner] == 0
        both = np.intersect1d(values[mine], values[~mine])
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        known = both[at] == values if len(both) else np.zeros(len(values), bool)
        common = np.zeros((len(one), len(two)), np.float32)
        for lo in range(0, len(both), COLUMNS):
            own = known & (at >= lo) & (at < lo + COLUMNS)
            parts = []
            for own_side, n in ((mine, len(one)), (~mine, len(two))):
                m = np.zeros((n, min(COLUMNS, len(both) - lo)), np.float32)
                pick = own & own_side
                m[place[owner[pick]], at[pick] - lo] = 1
                parts.append(m)
            common += parts[0] @ parts[1].T
        ids, components = table.column("rep").to_numpy(), table.column("component").to_numpy()
        union = sizes[one][:, None] + sizes[two][None, :] - common
        hit = (common * 100 >= union * percent) & (components[one][:, None] != components[two][None, :])
        src, dst = [], []
        for i in np.flatnonzero(hit.any(1)):
            js = np.flatnonzero(hit[i])
            js = js[np.unique(components[two[js]], return_index=True)[1]]
            src += [int(ids[one[i]])] * len(js)
            dst += ids[two[js]].tolist()
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return links


def _rest_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): links across components inside each group of (grp, rep, component).

    All members but those of the group's largest component meet all members, in blocks.
    """
    of = groups.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    top = of.groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    top = top.select("grp", "largest", F.ceil((F.col("all") - F.col("most")) / REST).alias("rests"), F.ceil(F.col("all") / ALL).alias("alls"))
    m = groups.join(top, "grp").join(sets, "rep")
    draw = F.xxhash64("rep")
    every = m.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("r"), F.pmod(draw, F.col("alls")).alias("a"), F.lit(1).alias("side"), "rep", "component", "shingles")
    rest = m.where("component <> largest").select("grp", F.pmod(draw, F.col("rests")).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("alls") - 1)).alias("a"), F.lit(0).alias("side"), "rep", "component", "shingles")
    return every.unionByName(rest).groupBy("grp", "r", "a").applyInArrow(_links(percent), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set has the distinct ``width``-word shingles,
    or of fewer words the whole sequence as one. Documents are linked if 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable, and that document is kept.

    No words or null text: an empty set, linked with nothing. Rows with a null id are components of
    their own, with a null component, and kept. Ids are integers that name documents: rows that
    repeat an id and text are one document. Of an id with several texts each has its own links and component; in any order of
    the rows, a text that is linked with none has its id as component and is kept. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    n_chunks = chunks(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    drawn = rows.mapInArrow(_sketcher(width, n_chunks), "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, signature array<int>")
    drawn = cut(drawn.withColumn("row", F.monotonically_increasing_id()))
    some = drawn.where("n_shingles > 0 and doc_id is not null")
    # A class is named by its smallest id; where an id stands at several texts, by a number below all ids for each of them.
    first = F.min(F.struct("doc_id", "row", "text_key")).alias("f")
    classes = some.groupBy("set_key").agg(first, F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    classes = cut(classes.select("set_key", "f.doc_id", "f.row", "f.text_key", "signature", "n"))
    twice = classes.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("twice"))
    repeats = twice.limit(1).count() > 0
    if not repeats:
        classes = classes.withColumn("rep", F.col("doc_id"))
    else:
        lowest = min(0, classes.agg(F.min("doc_id")).first()[0])
        other = F.when(F.col("twice"), F.lit(lowest) - 1 - F.col("row")).otherwise(F.col("doc_id"))
        classes = cut(classes.join(twice, "doc_id", "left").withColumn("rep", other))

    # Sets of under percent / (100 - percent) shingles have no other set within the threshold.
    keyed = classes.where(f"n * {100 - percent} >= {percent}").select("rep", F.explode(_keys(F.col("signature"), n_chunks)).alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("src"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "src")
    shared = cut(keyed.join(leaders, "key"))
    near = shared.where("rep <> src").select("src", F.col("rep").alias("dst")).distinct()
    facts = classes.select("rep", "n", "signature")
    s = facts.select(F.col("rep").alias("src"), F.col("n").alias("n1"), F.col("signature").alias("s1"))
    t = facts.select(F.col("rep").alias("dst"), F.col("n").alias("n2"), F.col("signature").alias("s2"))
    stars = cut(near.join(s, "src").join(t, "dst").where(_alike(F.col("n1"), F.col("n2"), F.col("s1"), F.col("s2"), percent, n_chunks)).select("src", "dst"))

    # Shingle sets of those that share a bucket, from one more pass over the texts.
    wanted = classes.join(shared.select("rep").distinct(), "rep", "left_semi").select("doc_id", "text_key", "rep")
    own_text = rows.join(wanted, ["doc_id", "text_key"]).select("rep", "text").dropDuplicates(["rep"])
    sets = cut(own_text.mapInArrow(_set_builder(width), "rep bigint, shingles array<bigint>"))
    both = stars.join(sets.select(F.col("rep").alias("src"), F.col("shingles").alias("s")), "src").join(sets.select(F.col("rep").alias("dst"), F.col("shingles").alias("t")), "dst")
    common = F.size(F.array_intersect("s", "t"))
    links = cut(both.where(common * 100 >= (F.size("s") + F.size("t") - common) * percent).select("src", "dst"))
    known = components(links)

    # Buckets whose members are not one component yet, grouped where they share members.
    member = shared.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "src", "rep", F.coalesce("component", "rep").alias("component"))
    split = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    left = cut(member.join(split, "key").select("src", "rep", "component").distinct())
    group = components(left.where("rep <> src").select("src", F.col("rep").alias("dst")))
    groups = cut(left.select("rep", "component").distinct().join(group.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "rep"))
    more = cut(_rest_links(groups, sets, percent))
    if not more.isEmpty():
        known = components(known.select(F.col("node").alias("src"), F.col("component").alias("dst")).where("src <> dst").union(more))

    named = known.select(F.col("node").alias("rep"), F.col("component").alias("name"))
    if repeats:  # else the smallest node is the smallest id
        named = named.join(classes.select("rep", F.col("doc_id").alias("id")), "rep")
        least = cut(named.groupBy("name").agg(F.min("id").alias("id")))
        named = named.select("rep", "name").join(least, "name").select("rep", F.col("id").alias("name"))
    own = classes.select("set_key", "rep", "doc_id").join(named, "rep", "left").select("set_key", F.coalesce("name", "doc_id").alias("component"))
    joined = drawn.select("doc_id", "n_shingles", "set_key").join(own, "set_key", "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
