"""The fact graph: lookup, history, supersession, multi-hop traversal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S


def lookup_terms(entity: str) -> list[str]:
    return [t for t in re.split(r"[\s的，,]+", entity) if t]


def lookup(facts: DataFrame, entity: str, namespace: str = S.DEFAULT_NAMESPACE, superseded: bool = False) -> DataFrame:
    """Facts whose subject or object holds any term of the entity, whatever its case; ``%`` and ``_`` are wildcards."""
    terms = lookup_terms(entity)
    hit: Column = F.lit(False)
    for t in terms:
        pattern = f"%{t.lower()}%"
        hit = hit | F.lower("subject").like(pattern) | F.lower("object").like(pattern)
    df = facts.where((F.col("namespace") == namespace) & hit)
    return df if superseded else df.where(F.col("valid_until").isNull())


def _same(subject: str, predicate: str, namespace: str) -> Column:
    return (F.col("namespace") == namespace) & (F.lower("subject") == subject.lower()) & (F.lower("predicate") == predicate.lower())


def conflicts(facts: DataFrame, subject: str, predicate: str, namespace: str = S.DEFAULT_NAMESPACE) -> DataFrame:
    """All facts of the subject and predicate, superseded ones too."""
    return facts.where(_same(subject, predicate, namespace))


def all_conflicts(facts: DataFrame) -> DataFrame:
    """(subject, predicate, namespace, objects, facts) with more than one object, lower-cased."""
    by = [F.lower("subject").alias("subject"), F.lower("predicate").alias("predicate"), F.col("namespace")]
    return facts.groupBy(*by).agg(F.count_distinct("object").alias("objects"), F.count(F.lit(1)).alias("facts")).where("objects > 1")


def history(facts: DataFrame, subject: str, predicate: str, namespace: str = S.DEFAULT_NAMESPACE) -> DataFrame:
    return conflicts(facts, subject, predicate, namespace).orderBy("created_at", "id")


def supersede(facts: DataFrame) -> DataFrame:
    """Facts with valid_until and superseded_by as if inserted one by one, oldest first.

    A fact ends with the first later one of the same subject, predicate and namespace (by lower case)
    that has another object; so runs of one object stay active side by side until the object changes.
    """
    key = [F.lower("subject"), F.lower("predicate"), F.col("namespace")]
    order = Window.partitionBy(*key).orderBy("created_at", "id")
    changed = F.coalesce((F.col("object") != F.lag("object").over(order)).cast("int"), F.lit(0))
    runs = facts.withColumn("_run", changed).withColumn("_run", F.sum("_run").over(order))
    head = F.struct(F.col("created_at").alias("at"), F.col("id").alias("by"))
    # The first row of the next run, seen from any row: the least head among the rows of runs after it.
    later = Window.partitionBy(*key).orderBy("_run").rangeBetween(1, 1)
    marked = runs.withColumn("_next", F.min(head).over(later))
    ends = F.coalesce("valid_until", "_next.at")
    return marked.withColumn("superseded_by", F.when(F.col("valid_until").isNull(), F.col("_next.by")).otherwise(F.col("superseded_by"))).withColumn("valid_until", ends).drop("_run", "_next")


def insert(facts: DataFrame, new: DataFrame) -> DataFrame:
    """All facts after the new ones came in; what was superseded stays so."""
    closed = facts.where(F.col("valid_until").isNotNull())
    return closed.unionByName(supersede(facts.where(F.col("valid_until").isNull()).unionByName(new)))


def placeholders(new: DataFrame, now_ms: int) -> DataFrame:
    """(memory_id, content) to create for facts that come without a memory."""
    bare = new.where(F.col("memory_id").isNull() | (F.trim("memory_id") == ""))
    return bare.select(F.concat(F.lit("fact-"), F.col("id")).alias("id"), F.concat_ws(" ", "subject", "predicate", "object").alias("content"), F.lit("fact").alias("source"), "namespace", F.lit(now_ms).alias("created_at"))


def delete(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids.select("id"), "id", "left_anti")


def delete_by_memory(facts: DataFrame, memory_ids: DataFrame) -> DataFrame:
    return facts.join(memory_ids.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")


def multihop(facts: DataFrame, entities: DataFrame, hops: int = 2, namespace: str = S.DEFAULT_NAMESPACE) -> DataFrame:
    """(entity, depth, path): chains of active facts from each of ``entities`` (entity), 1 to 3 hops.

    Breadth first: every fact of a reached entity gives a chain, but an entity is expanded from its
    first chain only, whatever its case; first by depth, then the path before it, then the fact's age and id.
    """
    hops = max(1, min(3, hops))
    live = facts.where((F.col("namespace") == namespace) & F.col("valid_until").isNull())
    edges = live.select(F.lower("subject").alias("_from"), F.lower("object").alias("_to"), F.struct("subject", "predicate", "object").alias("_step"), F.struct("created_at", "id").alias("_age"))
    start = entities.select(F.col("entity"), F.lower("entity").alias("_at")).distinct()
    seen = start.select("entity", F.col("_at").alias("_seen"))
    frontier = start.select("entity", "_at", F.array().cast("array<struct<subject:string,predicate:string,object:string>>").alias("path"), F.array().cast("array<struct<created_at:bigint,id:string>>").alias("_order"))
    levels = []
    for depth in range(1, hops + 1):
        chains = frontier.join(edges, F.col("_at") == F.col("_from")).select("entity", F.col("_to").alias("_at"), F.array_append("path", F.col("_step")).alias("path"), F.array_append("_order", F.col("_age")).alias("_order"))
        levels.append(chains.select("entity", F.lit(depth).alias("depth"), "path"))
        if depth < hops:
            first = F.row_number().over(Window.partitionBy("entity", "_at").orderBy("_order"))
            fresh = chains.join(seen, (chains["entity"] == seen["entity"]) & (F.col("_at") == F.col("_seen")), "left_anti")
            frontier = fresh.withColumn("_n", first).where("_n = 1").drop("_n")
            seen = seen.unionByName(frontier.select("entity", F.col("_at").alias("_seen")))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out
