"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share all words by weight, none above ``max_epochs`` times its source (water filling).
A source gets the slots of equally many words that its target needs, the last one cut to what is left.
The i-th slot of the mix falls to the source whose interval of cumulative slots holds the i-th
golden-ratio point; on a lattice of Fibonacci numbers those points are a permutation, so each source has
exactly its slots. The r-th slot of a source takes the r-th block of its shuffled words, round and round.
Running sums and ranks go in two levels, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._session import cut

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source in a bucket of the shuffled order, and slots of a run, on average.
BUCKET_ROWS = 4096
RUN_SLOTS = 16384
#: Words of a slot; more where there would be over MOST_SLOTS, so that their products fit 64 bits.
SLOT_WORDS = 4096
MOST_SLOTS = 1 << 30
#: So many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    starts = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))
    return starts.cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Sources by code point, null last, weigh ``weights`` in turn. A source is held at
    ``max_epochs * source_size`` if the level that fills the rest is above it; ordered by
    cap / weight, the held ones come first, so prefix sums over this table of sources suffice.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    deal = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sources.select("source", "source_size", deal.alias("weight")).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select("*", F.row_number().over(rising).alias("nth"), F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("caps_before"), F.coalesce(F.sum("weight").over(upto), F.lit(0.0)).alias("weights_before"), F.sum("source_size").over(everything).cast("double").alias("total"), F.sum("weight").over(everything).alias("weights"))
    level = (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before"))
    # If all before a source are held; true up to the first that isn't, whose level counts.
    t = t.withColumn("free", F.when(F.col("cap") >= level * F.col("weight"), F.struct("nth", level.alias("level"))))
    t = t.withColumn("free", F.min("free").over(everything))
    target = F.when(F.col("free.nth").isNull() | (F.col("nth") < F.col("free.nth")), F.col("cap")).otherwise(F.col("free.level") * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def lattice(slots: int) -> tuple[int, int]:
    """(modulus, step): neighbouring Fibonacci numbers, the modulus at least ``slots``.

    ``i * step mod modulus`` runs through all places below the modulus; divided by it, these are
    points of the golden-ratio sequence up to the precision of the fraction.
    """
    step, modulus = 1, 2
    while modulus < slots:
        step, modulus = modulus, step + modulus
    return modulus, step


def schedule(shares: DataFrame, slot_words: int) -> DataFrame:
    """(source, slot, rank, block, words): the slots of the mix, numbered in its order with gaps.

    ``rank`` counts the slots of a source; ``block`` is the block of ``slot_words`` words of its
    shuffled order that the slot takes, and ``words`` how many of them. Full rounds take all blocks;
    what the target has beyond them is taken from the first blocks, the last of these cut.
    """
    w = F.lit(slot_words)
    need = shares.where("source_size > 0").select("source", "source_size", F.round("target").cast("long").alias("goal"))
    need = need.withColumns({"blocks": F.expr(f"(source_size + {slot_words - 1}) div {slot_words}"), "rest": F.expr("goal % source_size")})
    need = need.withColumn("slots", F.expr(f"(goal div source_size) * blocks + (rest + {slot_words - 1}) div {slot_words}"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    need = cut(need.withColumn("start", F.coalesce(F.sum("slots").over(order), F.lit(0).cast("long"))))
    modulus, step = lattice(need.agg(F.sum("slots")).first()[0] or 0)
    back = pow(step, -1, modulus)

    # Runs of a source's places are dealt out before they are laid out, so no task lays out a whole source.
    runs = need.where("slots > 0").withColumn("run", F.explode(F.expr(f"sequence(0, (slots - 1) div {RUN_SLOTS})"))).repartition("source", "run")
    inside = F.expr(f"sequence(run * {RUN_SLOTS}, least(run * {RUN_SLOTS} + {RUN_SLOTS - 1}, slots - 1))")
    dealt = runs.select("source", "source_size", "blocks", "rest", "slots", F.explode(inside).alias("nth"), "start")
    slot = F.expr(f"(start + nth) * {back}L % {modulus}L")
    dealt = dealt.select("source", "source_size", "blocks", "rest", "slots", slot.alias("slot")).withColumn("run", F.expr(f"slot div {RUN_SLOTS}"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source", "run").count()
    counts = counts.select("source", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")).alias("c")
    rank = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    ranked = dealt.withColumn("within", rank).alias("d").join(counts, F.expr("d.source <=> c.source and d.run = c.run"))
    ranked = ranked.select("d.source", "source_size", "blocks", "rest", "slots", "slot", (F.col("base") + F.col("within")).alias("rank"))
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks"))
    # A block has slot_words words, the last one of a source what is left; the last slot of a target what that lacks.
    whole = F.least(w, F.col("source_size") - F.col("block") * w)
    words = F.when((F.col("rest") > 0) & (F.col("rank") == F.col("slots") - 1), F.col("rest") - F.col("block") * w).otherwise(whole)
    return ranked.select("source", "slot", "rank", "block", words.alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first, spans, source), a row for each row of ``docs``.

    ``taken``: words of the document that the mix takes, repeats counted, at most ``max_epochs``
    times its size; those of a source add up to its target, rounded. ``first``: the place of its first word in its source's shuffled order.
    ``spans``: array of (low, high, repeats, slots), word ranges of the document by the blocks they fall in, each with the slots of the
    schedule that take it, first round first. Words in the order of their slots, then of ``first``, are the mix: each part of it has
    the sources in their shares.

    The order within a source is by a hash of the id, then the id, then size; it is the same in
    every run. Null text has size 0 and is taken 0 times; null sources are one source, the last.
    Rows that repeat are separate documents. An empty table gives no rows.
    """
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("draw")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    shares = cut(targets(sources, weights, max_epochs))
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    words = max(SLOT_WORDS, total // MOST_SLOTS)
    whole = F.least(F.lit(words), F.col("source_size") - F.col("block") * words)
    # Of each block: how often it is taken whole, and up to which word once more, with the slots; at most a slot an epoch and one.
    slots = schedule(shares, words).alias("q").join(shares.select(F.col("source").alias("s"), "source_size"), F.expr("q.source <=> s"))
    repeats = slots.groupBy("q.source", "block").agg(F.count_if(F.col("words") == whole).alias("repeats"), F.max(F.when(F.col("words") < whole, F.col("words"))).alias("part"),
        F.sort_array(F.collect_list(F.when(F.col("words") == whole, F.struct("rank", "slot")))).alias("slots"), F.max(F.when(F.col("words") < whole, F.col("slot"))).alias("last"))

    # Two-level running sums of words in the order of ``draw``: over buckets, then inside a bucket.
    buckets = max(1, sized.count() // BUCKET_ROWS)
    # Buckets are ranges of ``draw``, which has 60 bits.
    placed = sized.withColumn("bucket", F.expr(f"shiftright(shiftright(draw, 30) * {buckets}L, 30)"))
    key = [F.col("source"), F.col("bucket")]
    heads = placed.groupBy(*key).agg(F.sum("size").alias("words"))
    heads = heads.select("source", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key).orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    h = heads.alias("h")
    placed = placed.alias("p").join(h, F.expr("p.source <=> h.source and p.bucket = h.bucket")).select("p.*", (F.col("p.within") + F.col("h.base")).alias("first"))

    # Each document meets the blocks its words lie in.
    low, high = F.expr(f"first div {words}"), F.expr(f"(first + size - 1) div {words}")
    pieces = placed.where("size > 0").select("doc_id", "source", "draw", "size", "first", F.explode(F.sequence(low, high)).alias("block"))
    r = repeats.alias("r")
    pieces = pieces.alias("p").join(r, F.expr("p.source <=> r.source and p.block = r.block"))
    lo = F.greatest(F.col("p.block") * words - F.col("first"), F.lit(0))
    hi = F.least((F.col("p.block") + 1) * words - F.col("first"), F.col("size"))
    end = F.greatest(lo, F.least(hi, F.col("p.block") * words + F.coalesce("part", F.lit(0)) - F.col("first")))

    def span(low: Column, high: Column, times: Column, slots: Column) -> Column:
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), times.alias("repeats"), slots.alias("slots"))

    whole_slots = F.transform("slots", lambda x: x["slot"])
    both = F.array(span(lo, end, F.col("repeats") + 1, F.concat(whole_slots, F.array("last"))), span(end, hi, F.col("repeats"), whole_slots))
    pieces = pieces.select("p.doc_id", "p.source", "first", F.explode(F.filter(both, lambda x: (x["low"] < x["high"]) & (x["repeats"] > 0))).alias("span"))
    counted = F.sum((F.col("span.high") - F.col("span.low")) * F.col("span.repeats")).cast("long")
    taken = pieces.groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("first").alias("t_first"))
    taken = taken.agg(counted.alias("taken"), F.sort_array(F.collect_list("span")).alias("spans"))
    out = placed.join(taken, F.expr("doc_id <=> t_id and first = t_first and source <=> t_source and size > 0"), "left")
    s = shares.select(F.col("source").alias("s_source"), "source_size", "target")
    few = shares.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = out.join(F.broadcast(s) if few else s, F.expr("source <=> s_source"))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first", F.coalesce("spans", F.array().cast("array<struct<low:bigint,high:bigint,repeats:bigint,slots:array<bigint>>>")).alias("spans"), F.col("source"))
