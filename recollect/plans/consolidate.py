"""One maintenance cycle as a function from the old state to the new one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X
from recollect.operators import dedup, lifecycle as L
from recollect.operators import mutations as M


@dataclass(frozen=True)
class State:
    memories: DataFrame
    facts: DataFrame
    trash: DataFrame
    epoch: int = 0


def actions(memories: DataFrame, now_ms: int, epoch: int, level: str = "off", cap: int | None = None, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """(id, demote, promote, evict, drop, candidate): what a cycle decides, all from the snapshot at its start."""
    flags = memories.select(
        "id",
        ((F.col("layer") == S.CORE) & L.should_demote()).alias("demote"),
        ((F.col("layer") == S.BUFFER) & L.buffer_should_promote(epoch, t)).alias("promote"),
        ((F.col("layer") == S.BUFFER) & ~L.buffer_should_promote(epoch, t) & (L.decayed_importance(now_ms) < t.decay_drop)).alias("drop"),
        ((F.col("layer") == S.WORKING) & L.qualifies_for_core(now_ms, t) & L.gate_state(epoch, level, t).isin("open", "retry")).alias("candidate"),
    )
    out = L.evictions(memories, epoch, cap, t).select("id", F.lit(True).alias("evict"))
    return flags.join(out, "id", "left").withColumn("evict", F.coalesce("evict", F.lit(False)))


def consolidate(state: State, now_ms: int, level: str = "off", judge: Callable[[DataFrame], DataFrame] | None = None, cap: int | None = None, t: S.Thresholds = S.DEFAULTS) -> tuple[State, DataFrame]:
    """(new state, report). Order: stale tags at the old epoch, then demotions, promotions, evictions, decay.

    ``judge`` maps candidates the gate asks about to (id, approve); without one they are promoted.
    """
    from recollect.operators.cluster import cut

    epoch = state.epoch + 1
    snapshot = state.memories
    todo = cut(actions(snapshot, now_ms, epoch, level, cap, t))
    report = todo.agg(*[F.count_if(F.col(c)).alias(c) for c in ("demote", "promote", "evict", "drop", "candidate")])
    pick = lambda c: todo.where(F.col(c)).select("id")

    m = snapshot.withColumn("tags", L.clean_tags(state.epoch, t))
    special = (F.col("layer") == S.BUFFER) & ((F.col("kind") == "procedural") | L.has_tag("lesson")) & ~L.has_tag("distilled") & X.tag_number(F.col("tags"), "_birth_epoch:").isNull() & (F.size("tags") < S.MAX_TAGS)
    m = m.withColumn("tags", F.when(special, F.array_append("tags", F.lit(f"_birth_epoch:{epoch}"))).otherwise(F.col("tags")))
    m = M.demote(m, pick("demote"), S.WORKING, now_ms, epoch)
    m = M.promote(m, pick("promote"), S.WORKING, now_ms, epoch)

    asked = snapshot.join(pick("candidate"), "id", "left_semi").withColumn("decision", L.gate_decision(level, t))
    yes = asked.where("decision = 'promote'").select("id")
    open_ = asked.where("decision = 'ask'")
    no = asked.where("decision = 'reject'").select("id")
    if judge is None:
        yes = yes.union(open_.select("id"))
    else:
        verdict = judge(open_)
        yes, no = yes.union(verdict.where("approve").select("id")), no.union(verdict.where("not approve").select("id"))
    m = M.promote(m, yes, S.CORE, now_ms, epoch)
    if level != "off":
        marks = no.withColumn("_no", F.lit(True))
        m = m.join(marks, "id", "left").withColumn("tags", F.when(F.col("_no"), L.reject_tags(epoch)).otherwise(F.col("tags"))).drop("_no").select(*S.MEMORY_COLS)

    gone = todo.where("evict or drop").select("id")
    m, facts, trash = M.soft_delete(m, state.facts, state.trash, gone, now_ms)
    m = L.decay_importance(m, now_ms, t)
    return State(m, facts, trash, epoch), report


def dedup_and_triage(state: State, now_ms: int, t: S.Thresholds = S.DEFAULTS) -> State:
    """Buffer duplicates merged, then the heuristic triage of what is left."""
    change = dedup.dedup_buffer(state.memories, t.triage_dedup_sim)
    new = change.select("id", F.col("removed").alias("_r"), *[F.col(c).alias(f"_{c}") for c in ("access_count", "importance", "tags")])
    m = state.memories.join(new, "id", "left")
    m = m.withColumns({c: F.coalesce(f"_{c}", c) for c in ("access_count", "importance", "tags")})
    gone = change.where("removed").select("id")
    m = m.select(*S.MEMORY_COLS)
    m, facts, trash = M.soft_delete(m, state.facts, state.trash, gone, now_ms)
    up = L.triage(m, now_ms).where("verdict = 'promote'").select("id")
    return replace(state, memories=M.promote(m, up, S.WORKING, now_ms, state.epoch), facts=facts, trash=trash)


def distill_sessions(state: State, now_ms: int, summarise: Callable[[list[str]], str], limit_bytes: int = 500) -> State:
    """Each namespace's session notes become one episodic memory; the notes go."""
    notes = L.session_notes(state.memories)
    grouped = notes.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))).alias("notes"))

    def summary(batches):
        import pandas as pd

        for pdf in batches:
            text = [summarise([n["content"] for n in x]).encode()[:limit_bytes].decode("utf-8", "ignore") for x in pdf.notes]
            yield pd.DataFrame({"namespace": pdf.namespace, "content": text})

    made = grouped.mapInPandas(summary, "namespace string, content string")
    rows = M.prepare(made.select(F.concat(F.lit(f"distilled-{now_ms}-"), "namespace").alias("id"), "namespace", "content", F.lit(0.7).alias("importance"), F.lit("episodic").alias("kind"), F.lit("session").alias("source"), F.array(F.lit("auto-distilled")).alias("tags")), now_ms, state.epoch)
    good = rows.where(F.col("error").isNull()).drop("error")
    m, facts, trash = M.soft_delete(state.memories, state.facts, state.trash, notes.select("id"), now_ms)
    return replace(state, memories=m.unionByName(good), facts=facts, trash=trash)
