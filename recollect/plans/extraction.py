"""Memories and facts out of conversation windows, with what is known as context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect import providers
from recollect import schema as S
from recollect.operators import facts as G
from recollect.operators import metric
from recollect.operators import mutations as M
from recollect.operators.lineage import cut
from recollect.operators.positions import newest_before
from recollect.plans.consolidate import State
from recollect.plans.ingest import statements
from recollect.streaming import capture

#: A window of fewer bytes is left out; one is cut to so many characters; context of so long, so many rows and characters a row.
LEAST_BYTES, WINDOW_CHARS, CONTEXT_MS, CONTEXT_ROWS, CONTEXT_CHARS = 100, 12_000, 6 * S.HOUR_MS, 30, 120
ENTRY = "id string, window_id string, content string, importance double, kind string, tags array<string>, facts array<struct<subject:string,predicate:string,object:string>>"


@dataclass(frozen=True)
class Entry:
    """What an extractor finds in a window."""

    content: str
    importance: float = 0.5
    kind: str = "semantic"
    tags: list[str] = field(default_factory=list)
    facts: list[tuple[str, str, str]] = field(default_factory=list)


#: The text of a window and the lines that are known already.
Extractor = Callable[[str, list[str]], list[Entry]]


def unknown_statements(text: str, known: list[str]) -> list[Entry]:
    """The default: statements that no known line begins with."""
    return [Entry(c, w) for c, w in statements(text) if not any(k.startswith(c[:CONTEXT_CHARS]) for k in known)]


def context(windows: DataFrame, memories: DataFrame) -> DataFrame:
    """(window_id, rank, id): the memories of any namespace that a window (window_id, at, content) is told about, newest first."""
    return newest_before(windows, memories.select("id", "created_at"), CONTEXT_MS, CONTEXT_ROWS)


def extract(windows: DataFrame, memories: DataFrame, extractor: Extractor = unknown_statements) -> DataFrame:
    """ENTRY rows of what the extractor finds in each window (window_id, at, content) of LEAST_BYTES and more."""
    large = windows.where(F.octet_length("content") >= LEAST_BYTES)
    lines = context(large, memories).join(memories.select("id", F.substring("content", 1, CONTEXT_CHARS).alias("line")), "id")
    known = lines.groupBy(F.col("window_id").alias("w")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("known"))
    asked = large.join(known, F.col("window_id").cast("string") == F.col("w"), "left")
    asked = asked.select(F.col("window_id").cast("string").alias("window_id"), F.substring("content", 1, WINDOW_CHARS).alias("content"), F.coalesce("known", F.array().cast("array<string>")).alias("known"))

    def run(batches):
        for pdf in batches:
            out = []
            for window, text, known in zip(pdf.window_id, pdf.content, pdf.known):
                for n, e in enumerate(extractor(text, list(known))):
                    out.append((f"{window}-{n}", window, e.content, e.importance, e.kind, e.tags, [{"subject": a, "predicate": b, "object": c} for a, b, c in e.facts]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return asked.mapInPandas(run, ENTRY)


def store(state: State, entries: DataFrame, now_ms: int, embed: Callable[[DataFrame], DataFrame] = providers.embed, t: S.Thresholds = S.DEFAULTS) -> State:
    """Entries that are worth keeping and new become memories with their facts; those that a memory already says reinforce it.

    Left out are empty, long, unimportant and code texts, and of entries of one window alike each but the first. An entry is known if its vector
    is over ``proxy_dedup_sim`` like a memory of any namespace; the most similar one is reinforced, once.
    """
    kept = cut(capture.worth_keeping(entries, by="window_id"))
    vectors = cut(embed(kept.select("id", "content")).select("id", "embedding"))
    rows = vectors.select(F.concat(F.lit("new "), "id").alias("id"), "embedding", F.lit(metric.PROBE).alias("mode"))
    old = state.memories.select(F.concat(F.lit("old "), "id").alias("id"), "embedding", F.lit(metric.OLD).alias("mode"))
    pairs = metric.near_pairs(rows.unionByName(old).withColumn("g", F.lit("")), t.proxy_dedup_sim)
    pairs = cut(pairs.select(F.substring("a", 5, 1 << 30).alias("new_id"), F.substring("b", 5, 1 << 30).alias("old_id"), "similarity"))
    known = pairs.groupBy("new_id").agg(F.max_by("old_id", F.struct("similarity", "old_id")).alias("old_id"))
    fresh = cut(kept.join(known.select(F.col("new_id").alias("id")), "id", "left_anti").join(vectors, "id"))
    inputs = fresh.select("id", "content", "importance", "kind", F.array_append("tags", F.lit("auto-extract")).alias("tags"), F.lit("proxy").alias("source"), "embedding")
    new = M.prepare(inputs, now_ms, state.epoch).where(F.col("error").isNull()).drop("error")
    memories = M.reinforce(state.memories, known.select(F.col("old_id").alias("id")), now_ms).unionByName(new.select(*S.MEMORY_COLS))
    none = F.lit(None).cast("long")
    each = fresh.join(new.select("id"), "id", "left_semi").select("id", F.posexplode("facts").alias("n", "f"))
    linked = each.select(
        F.concat_ws("-", "id", F.col("n").cast("string")).alias("id"), "f.subject", "f.predicate", "f.object", F.col("id").alias("memory_id"), F.lit(S.DEFAULT_NAMESPACE).alias("namespace"),
        F.lit(now_ms).cast("long").alias("created_at"), none.alias("valid_from"), none.alias("valid_until"), F.lit(None).cast("string").alias("superseded_by"),
    )
    return replace(state, memories=memories, facts=G.insert(state.facts, linked))
