"""Changes as functions from old tables to new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X
from recollect.operators import text
from recollect.operators.lineage import cut


def prepare(inputs: DataFrame, now_ms: int, epoch: int) -> DataFrame:
    """MEMORY_DDL rows of inputs (id, content and any of layer, importance, source, tags, namespace, kind, embedding), with a column error."""
    have = set(inputs.columns)

    def col(name: str, kind: str, default) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in have else F.lit(default).cast(kind)

    tags = X.sanitize_tags(F.coalesce(F.col("tags"), F.array().cast("array<string>"))) if "tags" in have else F.array().cast("array<string>")
    kind = col("kind", "string", "semantic")
    layer = col("layer", "int", S.BUFFER)
    special = (kind == "procedural") | F.exists(tags, lambda t: (t == "lesson") | t.startswith("trigger:"))
    given = F.col("importance").cast("double") if "importance" in have else F.lit(None).cast("double")
    importance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(given, F.when(special, 0.75).otherwise(0.5))))
    now = F.lit(now_ms).cast("long")
    zero = F.lit(0).cast("long")
    rows = inputs.select(
        F.col("id") if "id" in have else F.expr("uuid()").alias("id"), "content", layer.alias("layer"), importance.alias("importance"), now.alias("created_at"), now.alias("last_accessed"), zero.alias("access_count"), zero.alias("repetition_count"),
        X.layer_default_decay(layer).alias("decay_rate"), col("source", "string", "api").alias("source"), tags.alias("tags"), col("namespace", "string", S.DEFAULT_NAMESPACE).alias("namespace"),
        (F.col("embedding").cast("array<float>") if "embedding" in have else F.lit(None).cast("array<float>")).alias("embedding"), kind.alias("kind"), now.alias("modified_at"), F.lit(epoch).cast("long").alias("modified_epoch"),
    )
    return rows.withColumn("error", X.validation_error())


def insert_batch(memories: DataFrame, inputs: DataFrame, now_ms: int, epoch: int) -> tuple[DataFrame, DataFrame]:
    """(all memories, rejected inputs with their error); no dedupe."""
    rows = prepare(inputs, now_ms, epoch)
    good = rows.where(F.col("error").isNull()).drop("error")
    return memories.unionByName(good), rows.where(F.col("error").isNotNull())


def insert(memories: DataFrame, inputs: DataFrame, now_ms: int, epoch: int, pairs: DataFrame | None = None, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """All memories after the inputs came in; an input that repeats a memory of its namespace reinforces it.

    ``pairs`` (id of the input, of the memory): which inputs repeat which memory; by default those of
    :func:`duplicates_of` with ``insert_merge_jaccard``. The memory gets the new text, the tags of both,
    the higher layer, and max(given importance, its own + 0.05). Of several inputs the last by id counts.
    """
    rows = prepare(inputs, now_ms, epoch).where(F.col("error").isNull()).drop("error")
    if pairs is None:
        pairs = cut(duplicates_of(memories, rows, t.insert_merge_jaccard, t))
    best = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("jaccard"), "old_id"))).where("_r = 1")
    last = best.withColumn("_r", F.row_number().over(Window.partitionBy("old_id").orderBy(F.desc("new_id")))).where("_r = 1").select("new_id", "old_id")
    hits = best.groupBy(F.col("old_id").alias("_old")).agg(F.count(F.lit(1)).alias("_hits"))
    fresh = rows.join(best.select(F.col("new_id").alias("id")), "id", "left_anti")
    new = rows.select(F.col("id").alias("new_id"), F.col("content").alias("_content"), F.col("tags").alias("_tags"), F.col("importance").alias("_importance"), F.col("layer").alias("_layer"))
    old = memories.join(last.join(new, "new_id").withColumnRenamed("old_id", "id"), "id", "left").join(hits, F.col("id") == F.col("_old"), "left")
    hit = F.col("new_id").isNotNull()
    changed = old.withColumns({
        "content": F.coalesce("_content", "content"), "tags": F.when(hit, X.merge_tags(F.col("tags"), F.col("_tags"))).otherwise(F.col("tags")), "layer": F.greatest("layer", "_layer"),
        "importance": F.when(hit, F.least(F.lit(1.0), F.greatest(F.col("importance") + 0.05, F.col("_importance")))).otherwise(F.col("importance")),
        "repetition_count": F.col("repetition_count") + F.coalesce("_hits", F.lit(0)), "last_accessed": F.when(hit, now_ms).otherwise(F.col("last_accessed")).cast("long"),
        "modified_at": F.when(hit, now_ms).otherwise(F.col("modified_at")).cast("long"), "modified_epoch": F.when(hit, epoch).otherwise(F.col("modified_epoch")).cast("long"),
    })
    return changed.select(*S.MEMORY_COLS).unionByName(fresh.select(*S.MEMORY_COLS))


def duplicates_of(memories: DataFrame, rows: DataFrame, threshold: float, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """(new_id, old_id, jaccard) of one namespace: which memories the new rows repeat.

    Word sets overlap by over ``threshold``; where both have vectors they must overlap by over ``dedup_jaccard_prefilter``
    and the cosine be over ``dedup_cosine`` instead. All memories that share a rare word are compared, not a few text hits.
    """
    def compared(new: DataFrame, old: DataFrame, least: float) -> DataFrame:
        x = new.select(F.col("id").alias("new_id"), F.col("embedding").alias("x"))
        y = old.select(F.col("id").alias("old_id"), F.col("embedding").alias("y"))
        return text.jaccard_join(new, old, least).join(x, "new_id").join(y, "old_id").withColumn("cosine", X.cosine(F.col("x"), F.col("y")))

    # The low threshold is for rows with vectors only.
    has = F.col("embedding").isNotNull()
    near = compared(rows, memories, threshold).where("cosine is null")
    tested = compared(rows.where(has), memories.where(has), min(threshold, t.dedup_jaccard_prefilter)).where(F.col("cosine") > t.dedup_cosine)
    return near.unionByName(tested).select("new_id", "old_id", "jaccard")


def _update(memories: DataFrame, ids: DataFrame, columns: dict[str, Column]) -> DataFrame:
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    df = memories.join(mark, "id", "left")
    return df.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in columns.items()}).drop("_hit").select(*memories.columns)


def touch(memories: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    up = F.when(F.col("layer") < S.CORE, F.least(F.lit(1.0), F.col("importance") + 0.03)).otherwise(F.col("importance"))
    return _update(memories, ids, {"access_count": F.col("access_count") + 1, "last_accessed": F.lit(now_ms).cast("long"), "importance": up})


def reinforce(memories: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    return _update(memories, ids, {"repetition_count": F.col("repetition_count") + 1, "last_accessed": F.lit(now_ms).cast("long"), "importance": F.least(F.lit(1.0), F.col("importance") + 0.05)})


def promote(memories: DataFrame, ids: DataFrame, target: int, now_ms: int, epoch: int) -> DataFrame:
    """To a higher layer; episodic memories never become Core."""
    ok = (F.col("layer") < target) & ~((F.lit(target) == S.CORE) & (F.col("kind") == "episodic"))
    decay = X.layer_default_decay(F.lit(target)) if target != S.WORKING else X.kind_decay(F.col("kind"))
    pick = lambda c, v: F.when(ok, v).otherwise(F.col(c))
    return _update(memories, ids, {"decay_rate": pick("decay_rate", decay), "last_accessed": pick("last_accessed", F.lit(now_ms).cast("long")), "modified_at": pick("modified_at", F.lit(now_ms).cast("long")), "modified_epoch": pick("modified_epoch", F.lit(epoch).cast("long")), "layer": pick("layer", F.lit(target))})


def demote(memories: DataFrame, ids: DataFrame, target: int, now_ms: int, epoch: int) -> DataFrame:
    """To a lower layer; when it was last accessed stays."""
    ok = F.col("layer") > target
    decay = X.layer_default_decay(F.lit(target)) if target != S.WORKING else X.kind_decay(F.col("kind"))
    pick = lambda c, v: F.when(ok, v).otherwise(F.col(c))
    return _update(memories, ids, {"decay_rate": pick("decay_rate", decay), "modified_at": pick("modified_at", F.lit(now_ms).cast("long")), "modified_epoch": pick("modified_epoch", F.lit(epoch).cast("long")), "layer": pick("layer", F.lit(target))})


def update_fields(memories: DataFrame, changes: DataFrame, now_ms: int, epoch: int) -> tuple[DataFrame, DataFrame]:
    """(memories, rejected changes). ``changes``: id and any of content, layer, importance, tags; null leaves a field."""
    names = [c for c in ("content", "layer", "importance", "tags") if c in changes.columns]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in names])
    df = memories.join(new, "id", "left")
    values: dict[str, Column] = {}
    for c in names:
        v = F.col(f"_{c}")
        v = X.sanitize_tags(v) if c == "tags" else F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) if c == "importance" else v
        values[c] = F.coalesce(v, F.col(c))
    merged = memories.join(new, "id").withColumns(values)
    error = merged.withColumn("error", X.validation_error()).where(F.col("error").isNotNull()).select("id", "error")
    given = F.lit(False)
    for c in names:
        given = given | F.col(f"_{c}").isNotNull()
    bad = error.select("id", F.lit(True).alias("_bad"))
    df = df.join(bad, "id", "left")
    ok = given & F.col("_bad").isNull()
    done = df.withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in values.items()} | {"modified_at": F.when(ok, now_ms).otherwise(F.col("modified_at")).cast("long"), "modified_epoch": F.when(ok, epoch).otherwise(F.col("modified_epoch")).cast("long")})
    return done.select(*memories.columns), error


def set_column(memories: DataFrame, ids: DataFrame, column: str, value) -> DataFrame:
    """kind, decay_rate, access_count or namespace of some rows."""
    return _update(memories, ids, {column: F.lit(value).cast(dict(memories.dtypes)[column])})


def set_embedding(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    new = vectors.select("id", F.col("embedding").cast("array<float>").alias("_e"))
    return memories.join(new, "id", "left").withColumn("embedding", F.coalesce("_e", "embedding")).select(*memories.columns)


def soft_delete(memories: DataFrame, facts: DataFrame, trash: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, facts, trash) after the rows went to the trash, their facts with them."""
    gone = ids.select("id").distinct()
    thrown = memories.join(gone, "id", "left_semi").select("id", "content", "layer", "importance", "created_at", F.lit(now_ms).cast("long").alias("deleted_at"), "tags", "namespace", "source", "kind")
    kept = memories.join(gone, "id", "left_anti").select(*memories.columns)
    left = facts.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti").select(*facts.columns)
    return kept, left, trash.unionByName(thrown)


def delete_namespace(memories: DataFrame, facts: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """For good, past the trash."""
    return memories.where(F.col("namespace") != namespace), facts.where(F.col("namespace") != namespace)


def restore(memories: DataFrame, trash: DataFrame, ids: DataFrame, now_ms: int, namespace: str = S.DEFAULT_NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """(memories, trash): counters start anew, there is no vector, decay is 1."""
    back = trash.where(F.col("namespace") == namespace).join(ids.select("id").distinct(), "id", "left_semi")
    zero = F.lit(0).cast("long")
    rows = back.select("id", "content", "layer", "importance", "created_at", F.lit(now_ms).cast("long").alias("last_accessed"), zero.alias("access_count"), zero.alias("repetition_count"), F.lit(1.0).alias("decay_rate"), "source", "tags", "namespace", F.lit(None).cast("array<float>").alias("embedding"), "kind", zero.alias("modified_at"), zero.alias("modified_epoch"))
    return memories.unionByName(rows), trash.join(back.select("id"), "id", "left_anti").select(*trash.columns)


def purge(trash: DataFrame, namespace: str) -> DataFrame:
    return trash.where(F.col("namespace") != namespace)


def trash_count(trash: DataFrame, namespace: str = S.DEFAULT_NAMESPACE) -> DataFrame:
    return trash.where(F.col("namespace") == namespace).agg(F.count(F.lit(1)).alias("n"))


def checked_update(memories: DataFrame, changes: DataFrame, now_ms: int, epoch: int, needs_tag: str) -> tuple[DataFrame, DataFrame]:
    """:func:`update_fields` for the rows that still have ``needs_tag``; changes of other rows come to nothing."""
    held = memories.where(F.array_contains("tags", needs_tag)).select("id")
    return update_fields(memories, changes.join(held, "id", "left_semi"), now_ms, epoch)
