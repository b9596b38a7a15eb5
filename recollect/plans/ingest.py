"""From texts and conversations to stored memories and facts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X
from recollect.operators import facts as G
from recollect.operators import mutations as M
from recollect.operators import topics, vector
from recollect.plans.consolidate import State
from recollect.streaming import capture

Extractor = Callable[[str], list[tuple[str, float]]]


def statements(text: str) -> list[tuple[str, float]]:
    """The default extractor: sentences of 20 to 200 characters, each of importance 0.5."""
    import re

    return [(s.strip(), 0.5) for s in re.split(r"[\n.!?]", text or "") if 20 <= len(s.strip()) <= 200]


def extract(texts: DataFrame, extractor: Extractor = statements, id_col: str = "id", text_col: str = "content", least_bytes: int = 100, most_chars: int = 12_000) -> DataFrame:
    """(id, content, importance) of what the extractor finds in each text of ``least_bytes`` and more."""
    rows = texts.where(F.octet_length(text_col) >= least_bytes).select(F.col(id_col).cast("string").alias("id"), F.substring(text_col, 1, most_chars).alias("content"))

    def run(batches):
        for pdf in batches:
            found = [(f"{i}-{n}", c, float(w)) for i, t in zip(pdf.id, pdf.content) for n, (c, w) in enumerate(extractor(t))]
            yield pd.DataFrame(found, columns=["id", "content", "importance"])

    return rows.mapInPandas(run, "id string, content string, importance double")


def semantic_hits(memories: DataFrame, new: DataFrame, threshold: float = S.DEFAULTS.insert_dedup_sim) -> DataFrame:
    """(new_id, old_id, similarity): the nearest memory of any namespace for each new row with a vector, over the threshold."""
    pairs = vector.similar_across(new, memories, threshold)
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("similarity"), "old_id"))).where("_r = 1")
    return ranked.drop("_r")


def remember(memories: DataFrame, inputs: DataFrame, now_ms: int, epoch: int, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """All memories after the inputs (id, content, embedding, ...) came in by way of both dedupes.

    An input near a memory by its vector reinforces it, and replaces its text unless their words agree by
    over ``insert_merge_jaccard``; the others are inserted, where textual duplicates merge.
    """
    from recollect.operators.cluster import cut

    hits = cut(semantic_hits(memories, inputs, t.insert_dedup_sim))
    last = hits.groupBy("old_id").agg(F.max("new_id").alias("new_id"))
    words = inputs.select(F.col("id").alias("new_id"), F.col("content").alias("_content"))
    m = M.reinforce(memories, hits.select(F.col("old_id").alias("id")), now_ms)
    m = m.join(last.join(words, "new_id").select(F.col("old_id").alias("id"), "_content"), "id", "left")
    same = X.words_jaccard(X.dedup_words(F.col("content")), X.dedup_words(F.col("_content"))) > t.insert_merge_jaccard
    m = m.withColumn("content", F.when(F.col("_content").isNotNull() & ~same, F.col("_content")).otherwise(F.col("content"))).select(*S.MEMORY_COLS)
    fresh = inputs.join(hits.select(F.col("new_id").alias("id")), "id", "left_anti")
    return M.insert(m, fresh, now_ms, epoch, t=t)


def import_texts(state: State, texts: DataFrame, now_ms: int, extractor: Extractor = statements) -> State:
    rows = extract(texts, extractor).withColumn("source", F.lit("import"))
    return replace(state, memories=M.insert(state.memories, rows, now_ms, state.epoch))


def import_numbered(state: State, texts: DataFrame, now_ms: int, id_col: str = "id", text_col: str = "text") -> State:
    """The ``N. fact`` lines of each text, at Working."""
    from recollect.sources.tables import numbered_facts

    rows = numbered_facts(texts, text_col).select(F.concat_ws("-", F.col(id_col).cast("string"), F.col("no").cast("string")).alias("id"), F.col("fact").alias("content"), F.lit(S.WORKING).alias("layer"), F.lit("import").alias("source"))
    return replace(state, memories=M.insert_batch(state.memories, rows, now_ms, state.epoch)[0])


def capture_batch(state: State, turns: DataFrame, now_ms: int, extractor: Extractor = statements, t: S.Thresholds = S.DEFAULTS) -> State:
    """What conversations say that is worth keeping: extracted, filtered, inserted with its source."""
    kept = capture.worth_keeping(extract(turns, extractor))
    rows = kept.select("id", "content", "importance", F.lit("proxy").alias("source"), F.array(F.lit("auto-extract")).alias("tags"))
    return replace(state, memories=M.insert(state.memories, rows, now_ms, state.epoch, t=t))


def add_facts(state: State, new: DataFrame, now_ms: int) -> State:
    """Facts superseding older ones; a fact without a memory gets one of its own."""
    made = G.placeholders(new, now_ms)
    rows = M.prepare(made, now_ms, state.epoch).drop("error")
    bare = F.col("memory_id").isNull() | (F.trim("memory_id") == "")
    linked = new.withColumn("memory_id", F.when(bare, F.concat(F.lit("fact-"), "id")).otherwise(F.col("memory_id")))
    return replace(state, facts=G.insert(state.facts, linked), memories=state.memories.unionByName(rows))


def distil_topics(state: State, nodes: DataFrame, members: DataFrame, summarise: Callable[[list[str]], str], now_ms: int, t: S.Thresholds = S.DEFAULTS) -> State:
    """The largest leaves become one memory each, in the highest layer of their members, which it supersedes."""
    big = topics.bloated(nodes, t).select("node_id")
    rows = members.join(F.broadcast(big), "node_id").join(state.memories, F.col("memory_id") == F.col("id"))
    grouped = rows.groupBy("node_id").agg(F.max("layer").alias("layer"), F.max("namespace").alias("namespace"), F.max("importance").alias("importance"), F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))).alias("notes")).where(F.size("notes") >= 2)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": [f"topic-{now_ms}-{n}" for n in pdf.node_id], "content": [summarise([x["content"] for x in n]) for n in pdf.notes], "layer": pdf.layer, "namespace": pdf.namespace, "importance": pdf.importance})

    made = grouped.mapInPandas(run, "id string, content string, layer int, namespace string, importance double").withColumn("tags", F.array(F.lit("distilled")))
    gone = grouped.select(F.explode(F.transform("notes", lambda n: n["id"])).alias("id"))
    m, facts, trash = M.soft_delete(state.memories, state.facts, state.trash, gone, now_ms)
    good = M.prepare(made, now_ms, state.epoch).where(F.col("error").isNull()).drop("error")
    return replace(state, memories=m.unionByName(good), facts=facts, trash=trash)


def report(memories: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: memories by layer and kind, vectors, namespaces, active and superseded facts."""
    layers = [F.count_if(F.col("layer") == k).alias(name) for k, name in S.LAYER_NAMES.items()]
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in S.KINDS]
    a = memories.agg(F.count(F.lit(1)).alias("memories"), *layers, *kinds, F.count("embedding").alias("vectors"), F.count_distinct("namespace").alias("namespaces"))
    b = facts.agg(F.count_if(F.col("valid_until").isNull()).alias("active_facts"), F.count("valid_until").alias("superseded_facts"))
    return a.crossJoin(b)
