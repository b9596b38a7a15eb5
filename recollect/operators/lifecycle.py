"""Promotion, demotion, decay and eviction rules as columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X


def has_tag(*names: str) -> Column:
    return F.exists("tags", lambda t: t.isin(*names))


def is_session() -> Column:
    return (F.col("source") == "session") | has_tag("session")


def should_demote() -> Column:
    return is_session() | has_tag("ephemeral")


def skip_promotion() -> Column:
    return is_session() | has_tag("ephemeral", "auto-distilled", "distilled")


def strong_or_old(now_ms: int, t: S.Thresholds = S.DEFAULTS) -> Column:
    w, fit = X.weight(), F.col("importance") >= t.promote_min_importance
    old = (F.lit(now_ms) - F.col("created_at")) > t.promote_age_days * S.DAY_MS
    return fit & ((w >= t.core_promote) | (old & (w > 0)))


def qualifies_for_core(now_ms: int, t: S.Thresholds = S.DEFAULTS) -> Column:
    return ~skip_promotion() & ~has_tag("gate-rejected-final") & (F.col("kind") != "episodic") & strong_or_old(now_ms, t)


def core_candidates(memories: DataFrame, now_ms: int, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    return memories.where((F.col("layer") == S.WORKING) & qualifies_for_core(now_ms, t))


def gate_state(epoch: int, level: str = "off", t: S.Thresholds = S.DEFAULTS) -> Column:
    """'wait' while a cooldown runs, 'final' for the third strike, 'retry' when one ran out, else 'open'."""
    pending, rejected = X.tag_number(F.col("tags"), "_gate_pending_epoch:"), F.coalesce(X.tag_number(F.col("tags"), "_gate_epoch:"), F.lit(0))
    first, second = has_tag("gate-rejected"), has_tag("gate-rejected-2")
    state = F.when(pending.isNotNull() & (F.lit(epoch) - pending < t.gate_pending_epochs), "wait")
    if level == "auto":
        state = state.when(second, "final")
    state = state.when(second & (F.lit(epoch) - rejected < t.gate_retry2_epochs), "wait")
    state = state.when(~second & first & (F.lit(epoch) - rejected < t.gate_retry_epochs), "wait")
    return state.when(second | first, "retry").otherwise("open")


def gated_candidates(memories: DataFrame, now_ms: int, epoch: int, level: str = "off", t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    return core_candidates(memories, now_ms, t).withColumn("gate", gate_state(epoch, level, t)).where(F.col("gate").isin("open", "retry"))


def gate_decision(level: str = "off", t: S.Thresholds = S.DEFAULTS) -> Column:
    """'promote', 'reject' or 'ask': what the gate says without a judge."""
    fit = F.col("importance") >= t.promote_min_importance
    off = F.when((F.col("access_count") >= 3) & fit, "promote").otherwise("reject")
    auto = F.when((F.col("access_count") >= 5) & ((F.col("repetition_count") >= 2) | has_tag("lesson", "procedural")) & fit, "promote").otherwise("ask")
    return {"off": off, "auto": auto, "full": F.lit("ask")}[level]


def reject_tags(epoch: int) -> Column:
    """Tags after a rejection: first, second, final."""
    rest = F.filter("tags", lambda t: ~t.startswith("gate-rejected") & ~t.startswith("_gate_epoch:"))
    mark = F.when(has_tag("gate-rejected-2"), "gate-rejected-final").when(has_tag("gate-rejected"), "gate-rejected-2").otherwise("gate-rejected")
    return F.concat(rest, F.array(mark, F.lit(f"_gate_epoch:{epoch}")))


def buffer_should_promote(epoch: int, t: S.Thresholds = S.DEFAULTS) -> Column:
    born = F.coalesce(X.tag_number(F.col("tags"), "_birth_epoch:"), F.lit(epoch))
    special = (F.col("kind") == "procedural") | has_tag("lesson")
    return ~has_tag("distilled") & ((X.weight() >= t.buffer_promote) | (special & (F.lit(epoch) - born >= t.lesson_epochs)))


def buffer_promotions(memories: DataFrame, epoch: int, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    return memories.where((F.col("layer") == S.BUFFER) & buffer_should_promote(epoch, t))


def evictions(memories: DataFrame, epoch: int, cap: int | None = None, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """What goes from a Buffer over ``cap`` of those not promoted: least weight first, then oldest.

    The survivors are a top-k, so no task ranks the whole Buffer.
    """
    cap = t.buffer_cap if cap is None else cap
    held = memories.where((F.col("layer") == S.BUFFER) & ~buffer_should_promote(epoch, t)).withColumn("weight", X.weight())
    kept = held.orderBy(F.desc("weight"), F.desc("created_at"), F.desc("id")).limit(cap).select("id")
    return held.join(kept, "id", "left_anti")


def decayed_importance(now_ms: int) -> Column:
    hours = (F.lit(now_ms) - F.col("last_accessed")) / float(S.HOUR_MS)
    return F.col("importance") * F.exp(-F.col("decay_rate") * hours / S.WEEK_HOURS)


def decayed(memories: DataFrame, now_ms: int, threshold: float = S.DEFAULTS.decay_drop) -> DataFrame:
    return memories.where((F.col("layer") < S.CORE) & (decayed_importance(now_ms) < threshold))


def importance_after_decay(t: S.Thresholds = S.DEFAULTS) -> Column:
    ratio = F.when(F.col("kind") == "episodic", 1.0).when(F.col("kind") == "procedural", t.decay_procedural).otherwise(t.decay_semantic)
    return F.greatest(F.lit(t.importance_floor), F.col("importance") * (F.lit(1.0) - ratio * t.decay_factor))


def decays(cycle_start_ms: int, t: S.Thresholds = S.DEFAULTS) -> Column:
    return (F.col("last_accessed") < cycle_start_ms) & (F.col("importance") > t.importance_floor) & (F.col("layer") < S.CORE)


def decay_importance(memories: DataFrame, cycle_start_ms: int, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    return memories.withColumn("importance", F.when(decays(cycle_start_ms, t), importance_after_decay(t)).otherwise(F.col("importance")))


def clean_tags(epoch: int, t: S.Thresholds = S.DEFAULTS) -> Column:
    """Tags of Working and Core rows without stale gate marks and ``promotion``."""
    stale = (F.col("layer") == S.WORKING) & has_tag("gate-rejected") & (F.lit(epoch) - F.coalesce(X.tag_number(F.col("tags"), "_gate_epoch:"), F.lit(0)) >= t.gate_stale_epochs)
    fresh = F.when(stale, F.filter("tags", lambda x: (x != "gate-rejected") & ~x.startswith("_gate_epoch:"))).otherwise(F.col("tags"))
    return F.when(F.col("layer") >= S.WORKING, F.filter(fresh, lambda x: x != "promotion")).otherwise(F.col("tags"))


def stale_tags(memories: DataFrame, epoch: int, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """(id, tags, cleaned) of the rows that change."""
    return memories.select("id", "tags", clean_tags(epoch, t).alias("cleaned")).where(F.size("tags") != F.size("cleaned"))


SIGNAL_TAGS = ("lesson", "preference", "decision", "procedural", "identity", "constraint")


def heuristic_promote() -> Column:
    """Triage without a judge: used, repeated, tagged as a signal or important."""
    signal = F.exists("tags", lambda t: t.isin(*SIGNAL_TAGS) | t.startswith("trigger:"))
    return (F.col("access_count") > 3) | (F.col("repetition_count") > 1) | signal | (F.col("importance") >= 0.7)


def heuristic_keep() -> Column:
    """False for what was never read, has no signal and is under 20 bytes."""
    signal = F.exists("tags", lambda t: t.isin(*SIGNAL_TAGS) | t.startswith("trigger:"))
    return ~((F.col("access_count") == 0) & ~signal & (F.octet_length("content") < 20))


def triage_eligible(now_ms: int, with_judge: bool = False) -> Column:
    ok = (F.col("layer") == S.BUFFER) & ~has_tag("distilled", "ephemeral") & (F.lit(now_ms) - F.col("created_at") > 600_000)
    return ok & ~has_tag("_triaged") if with_judge else ok


def triage(memories: DataFrame, now_ms: int) -> DataFrame:
    """(id, verdict): promote, keep or drop."""
    verdict = F.when(heuristic_promote(), "promote").when(heuristic_keep(), "keep").otherwise("drop")
    return memories.where(triage_eligible(now_ms)).select("id", "namespace", verdict.alias("verdict"))


def triage_batches(memories: DataFrame, now_ms: int, size: int = 20) -> DataFrame:
    """Rows for a judge, the oldest ``size`` of each namespace."""
    n = F.row_number().over(Window.partitionBy("namespace").orderBy("created_at", "id"))
    return memories.where(triage_eligible(now_ms, True)).withColumn("_n", n).where(F.col("_n") <= size).drop("_n")


def dry_run(memories: DataFrame, now_ms: int, epoch: int, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """(action, id, preview): what a cycle would do; cooldowns aside, nothing is written."""
    preview = F.substring("content", 1, 100).alias("preview")
    act = lambda df, a: df.select(F.lit(a).alias("action"), "id", preview)
    decays_now = decayed(memories, now_ms, t.decay_drop).where(F.col("layer") == S.BUFFER).where(~buffer_should_promote(epoch, t))
    return (
        act(memories.where((F.col("layer") == S.CORE) & should_demote()), "demote")
        .unionByName(act(core_candidates(memories, now_ms, t), "candidate"))
        .unionByName(act(buffer_promotions(memories, epoch, t), "promote"))
        .unionByName(act(decays_now, "drop"))
    )


def session_notes(memories: DataFrame, least: int = 3, newest: int = 10) -> DataFrame:
    """Undistilled session notes of namespaces that have ``least`` of them, the newest ``newest`` each."""
    notes = memories.where(is_session() & ~has_tag("distilled"))
    w = Window.partitionBy("namespace")
    n = notes.groupBy("namespace").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    ranked = notes.withColumn("_r", F.row_number().over(w.orderBy(F.desc("created_at"), "id"))).where(F.col("_r") <= newest)
    return ranked.join(n, "namespace").drop("_r", "_n").select(*memories.columns)
