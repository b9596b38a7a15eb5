"""A full consolidation as one resumable run of steps: cycle, reconcile, distil, buffer dedupe, triage, merge.

Every step maps a state to the next one and is written to a folder of its own, its report last; a run that was stopped goes on
after the last step with a report, and a step that was cut off is written again from the state before it. Steps are
functions of their input and the clock given, so a run that was stopped ends as one that wasn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import providers
from recollect import schema as S
from recollect.functions import scalars as X
from recollect.operators import cluster, dedup
from recollect.operators import lifecycle as L
from recollect.operators import mutations as M
from recollect.operators.lineage import cut
from recollect.plans.consolidate import State, consolidate

#: Merged texts are cut to so many characters, notes before they are summed up; a summary of more bytes is dropped.
MERGED_CHARS, NOTE_CHARS, SUMMARY_BYTES = 600, 300, 500
TABLES = ("memories", "facts", "trash", "kept")


def similar_enough(pairs: DataFrame, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """(key, decision, content) for (key, similarity, ...): an update in the upper half of the window, else both are kept; without a merged text."""
    middle = (t.reconcile_min_sim + t.reconcile_max_sim) / 2
    return pairs.select("key", F.when(F.col("similarity") >= middle, "update").otherwise("keep_both").alias("decision"), F.lit(None).cast("string").alias("content"))


@dataclass(frozen=True)
class Hooks:
    """Models of a run; the defaults need none. ``relation`` sees (key, older, newer, similarity, older_text, newer_text)."""

    judge: Callable[[DataFrame], DataFrame] | None = None
    relation: Callable[[DataFrame], DataFrame] = similar_enough
    summarise: Callable[[list[str]], str] = providers.first_sentences
    merge: Callable[[list[str]], str] = providers.first_sentences
    embed: Callable[[DataFrame], DataFrame] = providers.embed


@dataclass(frozen=True)
class Run:
    """What a run goes by: the state, pairs judged to be kept (key), and when rows were last reconciled and merged."""

    state: State
    kept: DataFrame
    reconciled_ms: int = 0
    merged_ms: int = 0


Step = tuple[Run, dict[str, Column]]


def _again_embedded(memories: DataFrame, changed: DataFrame, hooks: Hooks) -> DataFrame:
    """Memories with new vectors of the rows (id) whose text is new."""
    texts = memories.join(changed.select("id").distinct(), "id", "left_semi").select("id", "content")
    return M.set_embedding(memories, hooks.embed(texts).select("id", "embedding"))


def _changed(memories: DataFrame, new: DataFrame, now_ms: int, epoch: int) -> DataFrame:
    """Memories with what ``new`` (id and any columns, null leaves one) says of them."""
    names = [c for c in new.columns if c != "id"]
    both = memories.join(new.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in names]), "id", "left")
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in names}
    values |= {"modified_at": F.when(F.col("_hit"), now_ms).otherwise(F.col("modified_at")).cast("long"), "modified_epoch": F.when(F.col("_hit"), epoch).otherwise(F.col("modified_epoch")).cast("long")}
    return both.withColumns(values).select(*S.MEMORY_COLS)


def reconcile(run: Run, now_ms: int, hooks: Hooks, t: S.Thresholds = S.DEFAULTS) -> Run:
    """Memories that a newer one of the same topic replaces go to the trash; pairs judged to be kept are not asked again.

    An older memory goes with its most similar newer one, a Buffer row replaces one memory at most. The newer one gets the merged text
    if the hook gives one, the tags and accesses of those it replaces, the larger importance, their layer if it is in the Buffer, and
    their namespace if that is ``default``. All from the values before the step; a memory that replaces one and is replaced goes, too.
    """
    m = run.state.memories
    pairs = cut(dedup.reconcile_pairs(m, run.kept, run.reconciled_ms, t.reconcile_min_sim, t.reconcile_max_sim))
    text = lambda side: m.select(F.col("id").alias(side), F.substring("content", 1, 400).alias(f"{side}_text"))
    said = cut(hooks.relation(pairs.join(text("older"), "older").join(text("newer"), "newer")).select("key", "decision", "content"))
    told = pairs.join(said, "key").join(m.select(F.col("id").alias("newer"), F.col("layer").alias("newer_layer")), "newer")
    yes = told.where(F.col("decision").isin("update", "absorb"))
    best = F.max(F.struct("similarity", "newer", "key", "newer_layer", "content")).alias("b")
    chosen = yes.groupBy("older").agg(best).select("older", "b.*")
    buffer = F.col("newer_layer") == S.BUFFER
    one = chosen.where(buffer).groupBy("newer").agg(F.max(F.struct("similarity", "older", "key", "newer_layer", "content")).alias("b")).select("b.older", "newer", "b.similarity", "b.key", "b.newer_layer", "b.content")
    chosen = cut(chosen.where(~buffer).select("older", "newer", "similarity", "key", "newer_layer", "content").union(one.select("older", "newer", "similarity", "key", "newer_layer", "content")))

    old = m.select(F.col("id").alias("older"), "tags", "importance", "access_count", "namespace", F.col("layer").alias("older_layer"))
    gained = chosen.join(old, "older").groupBy(F.col("newer").alias("id")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("older", "tags"))), lambda s: s["tags"])).alias("tags"),
        F.max("importance").alias("importance"), F.sum("access_count").alias("access_count"), F.max(F.col("namespace") == S.DEFAULT_NAMESPACE).alias("home"),
        F.max("older_layer").alias("older_layer"), F.max_by("content", F.when(F.trim("content") != "", F.struct("similarity", "older"))).alias("content"),
    )
    own = m.select("id", F.col("tags").alias("_tags"), F.col("importance").alias("_importance"), F.col("access_count").alias("_access"), "layer")
    up = cut(gained.join(own, "id"))
    new = up.select(
        "id", F.nullif(F.trim("content"), F.lit("")).alias("content"), X.merge_tags(F.col("_tags"), F.col("tags")).alias("tags"), F.greatest("importance", "_importance").alias("importance"),
        (F.col("access_count") + F.col("_access")).alias("access_count"), F.when(F.col("home"), S.DEFAULT_NAMESPACE).alias("namespace"),
    )
    epoch = run.state.epoch
    for layer in (S.WORKING, S.CORE):
        m = M.promote(m, up.where((F.col("layer") == S.BUFFER) & (F.col("older_layer") == layer)).select("id"), layer, now_ms, epoch)
    m = _changed(m, new, now_ms, epoch)
    m, facts, trash = M.soft_delete(m, run.state.facts, run.state.trash, chosen.select(F.col("older").alias("id")), now_ms)
    m = _again_embedded(m, new.where("content is not null"), hooks)
    kept = run.kept.select("key").union(told.where(~F.col("decision").isin("update", "absorb")).select("key")).distinct()
    return replace(run, state=replace(run.state, memories=m, facts=facts, trash=trash), kept=kept, reconciled_ms=now_ms)


def distil(run: Run, now_ms: int, hooks: Hooks, t: S.Thresholds = S.DEFAULTS) -> Run:
    """The session notes of a namespace that has three become one memory and go to the trash.

    If a memory already says what the summary does (word sets over ``triage_dedup_sim``, or vectors), the notes are tagged as distilled
    and stay. An empty summary, or one over SUMMARY_BYTES, leaves its notes for the next run.
    """
    state = run.state
    notes = cut(L.session_notes(state.memories.where(F.col("layer") <= S.WORKING)).select("id", "namespace", "content", "created_at"))
    grouped = notes.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", F.substring("content", 1, NOTE_CHARS).alias("content")))).alias("notes"))
    summarise = hooks.summarise

    def write(batches):
        for pdf in batches:
            yield pd.DataFrame({"namespace": pdf.namespace, "content": [summarise([n["content"] for n in own]).strip() for own in pdf.notes]})

    said = grouped.mapInPandas(write, "namespace string, content string").where((F.col("content") != "") & (F.octet_length("content") <= SUMMARY_BYTES))
    made = said.select(
        F.concat(F.lit(f"distilled-{now_ms}-"), "namespace").alias("id"), "namespace", "content", F.lit(0.7).alias("importance"), F.lit("episodic").alias("kind"),
        F.lit("consolidation").alias("source"), F.array(F.lit("project-status"), F.lit("auto-distilled")).alias("tags"),
    )
    rows = M.prepare(made, now_ms, state.epoch).where(F.col("error").isNull()).drop("error")
    rows = cut(M.set_embedding(rows, hooks.embed(rows.select("id", "content")).select("id", "embedding")))
    known = cut(M.duplicates_of(state.memories, rows, t.triage_dedup_sim, t).select(F.col("new_id").alias("id")).distinct())
    fresh = cut(rows.join(known, "id", "left_anti").select(*S.MEMORY_COLS))
    of = lambda some: notes.join(some.select("namespace"), "namespace", "left_semi").select("id")
    again = of(rows.join(known, "id", "left_semi"))
    m = _changed(state.memories, state.memories.join(again, "id", "left_semi").select("id", F.array_append("tags", F.lit("distilled")).alias("tags")), now_ms, state.epoch)
    m, facts, trash = M.soft_delete(m, state.facts, state.trash, of(fresh), now_ms)
    return replace(run, state=replace(state, memories=m.unionByName(fresh), facts=facts, trash=trash))


def dedupe_buffer(run: Run, now_ms: int, hooks: Hooks, t: S.Thresholds = S.DEFAULTS) -> Run:
    """Buffer rows that a newer one repeats go to the trash; the newer one gets accesses, importance and tags."""
    state = run.state
    change = cut(dedup.dedup_buffer(state.memories, t.triage_dedup_sim))
    m = _changed(state.memories, change.select("id", "access_count", "importance", "tags"), now_ms, state.epoch)
    m, facts, trash = M.soft_delete(m, state.facts, state.trash, change.where("removed").select("id"), now_ms)
    return replace(run, state=replace(state, memories=m, facts=facts, trash=trash))


def triage(run: Run, now_ms: int, hooks: Hooks, t: S.Thresholds = S.DEFAULTS) -> Run:
    """Buffer rows that the rules promote go to Working."""
    up = L.triage(run.state.memories, now_ms).where("verdict = 'promote'").select("id")
    return replace(run, state=replace(run.state, memories=M.promote(run.state.memories, up, S.WORKING, now_ms, run.state.epoch)))


def merge(run: Run, now_ms: int, hooks: Hooks, t: S.Thresholds = S.DEFAULTS) -> Run:
    """Near-duplicate memories of a layer become one: the newest, with the merged text, all tags and accesses, the largest importance.

    Stars of pairs over ``merge_sim``, of one namespace or with ``default``, where the result then stays. A merged text that
    is empty or not shorter than its parts leaves the star as it is; over MERGED_CHARS it is cut. The others go to the trash.
    """
    state, join = run.state, hooks.merge
    pairs = cut(dedup.merge_pairs(state.memories, t.merge_sim, run.merged_ms).select("a", "b"))
    members = cluster.stars(pairs)
    full = members.join(state.memories.select("id", "content", "created_at", "importance", "access_count", "tags", "namespace"), "id")
    order = F.array_sort(F.collect_list(F.struct((F.col("id") != F.col("seed")).alias("later"), "id", "content", "tags")))
    stars = full.groupBy("seed").agg(
        order.alias("rows"), F.max_by("id", F.struct("created_at", "id")).alias("winner"), F.max("importance").alias("importance"), F.sum("access_count").alias("access_count"),
        F.max(F.col("namespace") == S.DEFAULT_NAMESPACE).alias("home"), F.sum(F.length("content")).alias("chars"), F.count(F.lit(1)).alias("n"),
    )

    def write(batches):
        for pdf in batches:
            yield pd.DataFrame({"seed": pdf.seed, "text": [join([x["content"] for x in own]).strip() for own in pdf.rows]})

    stars = cut(stars.where("n > 1"))
    said = stars.select("seed", "rows").mapInPandas(write, "seed string, text string").withColumn("text", F.substring("text", 1, MERGED_CHARS))
    good = cut(stars.join(said, "seed").where((F.col("text") != "") & (F.length("text") < F.col("chars"))))
    tags = F.slice(F.array_distinct(F.flatten(F.transform("rows", lambda x: x["tags"]))), 1, S.MAX_TAGS)
    new = good.select(F.col("winner").alias("id"), F.col("text").alias("content"), "importance", "access_count", tags.alias("tags"), F.when(F.col("home"), S.DEFAULT_NAMESPACE).alias("namespace"))
    gone = good.select("winner", F.explode(F.transform("rows", lambda x: x["id"])).alias("id")).where("id <> winner").select("id")
    m = _again_embedded(_changed(state.memories, new, now_ms, state.epoch), new, hooks)
    m, facts, trash = M.soft_delete(m, state.facts, state.trash, gone, now_ms)
    return replace(run, state=replace(state, memories=m, facts=facts, trash=trash), merged_ms=now_ms)


def steps(level: str, merging: bool) -> list[tuple[str, Callable[..., Run]]]:
    """The steps of a run; those that compare or write texts are left out at level ``off``, as is merging if it isn't asked for."""

    def cycle(run: Run, now_ms: int, hooks: Hooks, t: S.Thresholds = S.DEFAULTS) -> Run:
        return replace(run, state=consolidate(run.state, now_ms, level, hooks.judge, t=t)[0])

    texts = [] if level == "off" else [("reconcile", reconcile), ("distil", distil)]
    last = [("merge", merge)] if merging and level != "off" else []
    return [("cycle", cycle), *texts, ("dedupe", dedupe_buffer), ("triage", triage), *last]


def _is_there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_steps(start: Run, folder: str, now_ms: int, level: str = "auto", merging: bool = False, hooks: Hooks = Hooks(), t: S.Thresholds = S.DEFAULTS, stop_after: str | None = None) -> tuple[Run, DataFrame]:
    """(run, reports): the state after all steps, read from ``folder``, and (step, memories, trash, kept, reconciled_ms, merged_ms, epoch) of each.

    Call it again with the same arguments to go on with a run that was stopped; ``stop_after`` stops it by itself.
    """
    spark, run, done = start.state.memories.sparkSession, start, []
    for k, (name, step) in enumerate(steps(level, merging)):
        path = f"{folder}/{k}-{name}"
        if not _is_there(spark, f"{path}/report/_SUCCESS"):
            new = step(run, now_ms, hooks, t)
            for table, df in zip(TABLES, (new.state.memories, new.state.facts, new.state.trash, new.kept)):
                df.write.mode("overwrite").parquet(f"{path}/{table}")
            counts = [spark.read.parquet(f"{path}/{table}").count() for table in ("memories", "trash", "kept")]
            row = [(k, name, *counts, new.reconciled_ms, new.merged_ms, new.state.epoch)]
            spark.createDataFrame(row, "n int, step string, memories long, trash long, kept long, reconciled_ms long, merged_ms long, epoch int").coalesce(1).write.mode("overwrite").parquet(f"{path}/report")
        report = spark.read.parquet(f"{path}/report")
        done.append(report)
        told, (memories, facts, trash, kept) = report.first(), (spark.read.parquet(f"{path}/{table}") for table in TABLES)
        run = Run(State(memories, facts, trash, told.epoch), kept, told.reconciled_ms, told.merged_ms)
        if name == stop_after:
            break
    reports = done[0]
    for more in done[1:]:
        reports = reports.unionByName(more)
    return run, reports
