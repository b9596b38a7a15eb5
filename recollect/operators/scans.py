"""Filters, lists, counts and reports over memories, facts and trash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X


class AmbiguousPrefix(ValueError):
    """More than one id starts with the prefix."""


def get(memories: DataFrame, id_: str) -> DataFrame:
    return memories.where(F.col("id") == id_)


def resolve_prefix(memories: DataFrame, prefix: str) -> str | None:
    """The id that starts with ``prefix``; a full-length one is returned as it is."""
    if len(prefix) >= 36:
        return prefix
    found = memories.where(F.col("id").startswith(prefix)).select("id").limit(2).collect()
    if len(found) > 1:
        raise AmbiguousPrefix(prefix)
    return found[0].id if found else None


def conditions(namespace: str | None = None, layer: int | None = None, tag: str | None = None, kind: str | None = None, min_importance: float | None = None, source: str | None = None, since_ms: int | None = None) -> Column:
    """All given conditions; a tag must be an element, importance and time bounds are inclusive."""
    every = []
    if namespace is not None:
        every.append(F.col("namespace") == namespace)
    if layer is not None:
        every.append(F.col("layer") == layer)
    if tag is not None:
        every.append(F.array_contains("tags", tag))
    if kind is not None:
        every.append(F.col("kind") == kind)
    if min_importance is not None:
        every.append(F.col("importance") >= min_importance)
    if source is not None:
        every.append(F.col("source") == source)
    if since_ms is not None:
        every.append(F.col("created_at") >= since_ms)
    return reduce(lambda a, b: a & b, every, F.lit(True))


def meta(memories: DataFrame) -> DataFrame:
    return memories.select(*S.META_COLS)


def list_filtered(memories: DataFrame, limit: int | None = None, offset: int = 0, **where) -> DataFrame:
    """Newest first."""
    df = meta(memories).where(conditions(**where)).orderBy(F.desc("created_at"), "id")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def list_by_layer(memories: DataFrame, layer: int, limit: int, offset: int = 0, namespace: str | None = None) -> DataFrame:
    """Most important first, without vectors."""
    return meta(memories).where(conditions(namespace, layer)).orderBy(F.desc("importance"), "id").offset(offset).limit(limit)


def list_since(memories: DataFrame, since_ms: int, limit: int, **where) -> DataFrame:
    return list_filtered(memories, limit, since_ms=since_ms, **where)


def list_by_epoch(memories: DataFrame, min_epoch: int, limit: int, namespace: str | None = None) -> DataFrame:
    return meta(memories).where(conditions(namespace) & (F.col("modified_epoch") >= min_epoch)).orderBy(F.desc("modified_at"), "id").limit(limit)


def list_by_tag(memories: DataFrame, tag: str, namespace: str | None = None) -> DataFrame:
    return list_filtered(memories, tag=tag, namespace=namespace)


def missing_vectors(memories: DataFrame, limit: int) -> DataFrame:
    return memories.where(F.col("embedding").isNull()).orderBy("id").limit(limit)


def with_vectors(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("embedding").isNotNull())


def vectors_of(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, embedding) of the ids that have one."""
    return with_vectors(memories).select("id", "embedding").join(ids.select("id").distinct(), "id", "left_semi")


def topic_entries(memories: DataFrame, per_layer: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Entries with vectors: Core, then Working, then Buffer, each by importance, numbered from 0; with ``per_layer`` the first of each layer only.

    ``keep``: the columns wanted, all by default. Numbers come from running sums over ranges, so no task holds a layer.
    """
    from recollect.operators.positions import running

    rows = with_vectors(memories)
    if per_layer is not None:
        rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("importance"), "id"))
        rows = rows.withColumn("_r", rank).where(F.col("_r") <= per_layer).drop("_r")
    down = lambda c: F.coalesce(-F.col(c).cast("double"), F.lit(float("inf")))
    order = [down("layer").alias("_layer"), down("importance").alias("_importance"), F.col("id").alias("_id")]
    placed = running(rows.select(*(keep or memories.columns), *order), ["_layer", "_importance", "_id"], {"idx": F.lit(1)})
    return placed.withColumn("idx", (F.col("idx") - 1).cast("int")).drop("_layer", "_importance", "_id")


def namespaces(memories: DataFrame) -> DataFrame:
    return memories.select("namespace").distinct().orderBy("namespace")


def trash_list(trash: DataFrame, limit: int, offset: int = 0, namespace: str = S.DEFAULT_NAMESPACE) -> DataFrame:
    return trash.where(F.col("namespace") == namespace).orderBy(F.desc("deleted_at"), "id").offset(offset).limit(limit)


def active_facts(facts: DataFrame, namespace: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    df = facts.where((F.col("namespace") == namespace) & F.col("valid_until").isNull()).orderBy(F.desc("created_at"), "id").offset(offset)
    return df if limit is None else df.limit(limit)


def stats(memories: DataFrame, namespace: str | None = None) -> DataFrame:
    """Counts by layer and kind."""
    return memories.where(conditions(namespace)).groupBy("layer", "kind").agg(F.count(F.lit(1)).alias("n"))


def count_filtered(memories: DataFrame, **where) -> DataFrame:
    return memories.where(conditions(**where)).agg(F.count(F.lit(1)).alias("n"))


def integrity(memories: DataFrame, index_ids: DataFrame) -> DataFrame:
    """One row: total, ids in the text index, orphans there, rows it misses, rows without a vector."""
    ids = index_ids.select(F.col("id").alias("_i")).distinct()
    both = memories.select("id", F.col("embedding").isNull().alias("bare")).join(ids, F.col("id") == F.col("_i"), "full")
    return both.agg(F.count("id").alias("total"), F.count("_i").alias("indexed"), F.count_if(F.col("id").isNull()).alias("orphans"), F.count_if(F.col("_i").isNull()).alias("missing"), F.count_if(F.col("bare")).alias("no_vector"))


def recall_filter(min_importance: float = 0.0, since: int | None = None, until: int | None = None, layers: list[int] | None = None, source: str | None = None, tags: list[str] | None = None, namespace: str | None = None) -> Column:
    """Bounds are inclusive, all tags must be there whatever their case, and the default namespace is let in."""
    ok = F.col("importance") >= min_importance
    if since is not None:
        ok &= F.col("created_at") >= since
    if until is not None:
        ok &= F.col("created_at") <= until
    if layers:
        ok &= F.col("layer").isin(*layers)
    if source is not None:
        ok &= F.col("source") == source
    for t in tags or []:
        ok &= F.array_contains(F.transform("tags", F.lower), t.lower())
    if namespace is not None:
        ok &= F.col("namespace").isin(namespace, S.DEFAULT_NAMESPACE)
    return ok


def triggers(memories: DataFrame, action: str, namespace: str | None = None) -> DataFrame:
    """Memories tagged for the action, the weightiest first."""
    df = memories.where(conditions(namespace, tag=f"trigger:{action}"))
    return df.withColumn("weight", X.weight()).orderBy(F.desc("weight"), "id")


def trigger_frequency(memories: DataFrame, namespace: str | None = None) -> DataFrame:
    """How often each trigger was used; never used counts once."""
    tags = memories.where(conditions(namespace)).select(F.explode("tags").alias("tag"), "access_count").where(F.col("tag").startswith("trigger:"))
    return tags.groupBy(F.substring("tag", 9, 1 << 20).alias("action")).agg(F.sum(F.greatest("access_count", F.lit(1))).alias("uses"))


def most_common_tag(memories: DataFrame, by: str, generic: tuple[str, ...] = ("auto-extract", "auto-distilled", "distilled", "promotion")) -> DataFrame:
    """(by, tag, n): the commonest tag of each group, ties by code point."""
    from pyspark.sql import Window

    n = memories.select(by, F.explode("tags").alias("tag")).where(~F.col("tag").isin(*generic)).groupBy(by, "tag").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "tag"))).where("_r = 1").select(by, "tag", "n")


def memories_without_facts(memories: DataFrame, facts: DataFrame, limit: int | None = None, namespace: str | None = None) -> DataFrame:
    df = meta(memories).where(conditions(namespace) & (F.col("layer") >= S.WORKING)).join(facts.select(F.col("memory_id").alias("id")).distinct(), "id", "left_anti").orderBy(F.desc("layer"), F.desc("importance"), "id")
    return df if limit is None else df.limit(limit)
