"""Duplicate and related pairs of memories, and how they are resolved."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import metric, text
from recollect.operators.lineage import cut


def pair_key(a: str = "a", b: str = "b"):
    """The same key for a pair in either order."""
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def near_duplicates(memories: DataFrame, jaccard: float = 0.8, loose: float = S.DEFAULTS.dedup_jaccard_prefilter, cosine: float = S.DEFAULTS.dedup_cosine) -> DataFrame:
    """(a, b, jaccard, cosine): word sets overlap by over ``jaccard``; with vectors by over ``loose`` if the cosine is over ``cosine``."""
    from recollect.functions import scalars as X

    pairs = text.jaccard_pairs(memories, min(loose, jaccard))
    v = memories.select("id", "embedding")
    both = pairs.join(v.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(v.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
    both = both.select("a", "b", "jaccard", X.cosine(F.col("x"), F.col("y")).alias("cosine"))
    return both.where(F.when(F.col("cosine").isNull(), F.col("jaccard") > jaccard).otherwise((F.col("jaccard") > loose) & (F.col("cosine") > cosine)))


def _is_new(since_ms: int) -> Column:
    """Whether a row was written or changed after the watermark; all are new without one."""
    return F.greatest("created_at", "modified_at") > since_ms if since_ms > 0 else F.lit(True)


def _meeting(rows: DataFrame, groups: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows of :func:`metric.near_pairs`: for each group of ``groups`` (label, mode) those whose mode is not null."""
    made = [rows.select(F.concat(F.lit(f"{name}:"), label).alias("g"), "id", "embedding", mode.alias("mode")).where("mode is not null") for name, (label, mode) in groups.items()]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _mode(*cases: tuple[Column, int]) -> Column:
    """The mode of the first case that holds, else null."""
    return F.coalesce(*[F.when(when, F.lit(mode)) for when, mode in cases])


def reconcile_pairs(memories: DataFrame, kept: DataFrame | None = None, since_ms: int = 0, low: float = S.DEFAULTS.reconcile_min_sim, high: float = S.DEFAULTS.reconcile_max_sim, gap_ms: int = S.HOUR_MS) -> DataFrame:
    """(older, newer, similarity, key): one memory may restate another.

    Similar but not equal, at least ``gap_ms`` apart, the newer in no lower layer, of one namespace or one
    of them ``default``. Working and Core rows written or changed after ``since_ms`` meet all such rows, Buffer rows since then
    meet them as the newer one; rows from before the watermark don't meet each other, so the work grows with
    what is new. Pairs whose key is in ``kept`` are left out before anything else is read of them.
    """
    rows = memories.where((F.col("layer") >= S.BUFFER) & F.col("embedding").isNotNull())
    fresh, home = _is_new(since_ms), F.col("namespace") == S.DEFAULT_NAMESPACE
    buffer, lasting = F.col("layer") == S.BUFFER, F.col("layer") >= S.WORKING
    one, none = F.col("namespace"), F.lit("")
    groups = {
        "own": (one, _mode((buffer & fresh, metric.PROBE), (lasting & fresh, metric.NEW), (lasting, metric.OLD))),
        "from default": (none, _mode((home & fresh, metric.PROBE), (~home & lasting, metric.OLD))),
        "to default": (none, _mode((~home & lasting & fresh, metric.PROBE), (home & lasting & ~fresh, metric.OLD))),
        "buffer to default": (none, _mode((~home & buffer & fresh, metric.PROBE), (home & lasting, metric.OLD))),
    }
    near = metric.near_pairs(_meeting(rows, groups), low, high, True).withColumn("key", pair_key())
    if kept is not None:
        near = near.join(kept.select("key"), "key", "left_anti")
    facts = rows.select("id", "layer", "created_at")
    x, y = (facts.select(*[F.col(c).alias(f"{c}_{s}") for c in facts.columns]) for s in ("a", "b"))
    p = near.join(x, F.col("a") == F.col("id_a")).join(y, F.col("b") == F.col("id_b"))
    first = F.col("created_at_a") <= F.col("created_at_b")
    pick = lambda c, newer: F.when(first, F.col(f"{c}_{'b' if newer else 'a'}")).otherwise(F.col(f"{c}_{'a' if newer else 'b'}"))
    p = p.select(
        pick("id", False).alias("older"), pick("id", True).alias("newer"), "similarity", "key", pick("layer", False).alias("lo"), pick("layer", True).alias("ln"),
        pick("created_at", False).alias("to"), pick("created_at", True).alias("tn"),
    )
    p = p.where((F.col("tn") - F.col("to") >= gap_ms) & (F.col("lo") >= S.WORKING) & ((F.col("ln") >= F.col("lo")) | (F.col("ln") == S.BUFFER)))
    return p.select("older", "newer", "similarity", "key")


def core_overlaps(memories: DataFrame, threshold: float = S.DEFAULTS.core_overlap_sim, seen: DataFrame | None = None, since_ms: int = 0) -> DataFrame:
    """(a, b, similarity, key): Core memories that say the same, one of them new since ``since_ms``; keys in ``seen`` are left out."""
    core = memories.where(F.col("layer") == S.CORE)
    mode = _mode((_is_new(since_ms), metric.NEW), (F.lit(True), metric.OLD))
    p = metric.near_pairs(core.select(F.lit("").alias("g"), "id", "embedding", mode.alias("mode")), threshold)
    p = p.select("a", "b", "similarity", pair_key().alias("key"))
    return p if seen is None else p.join(seen.select("key"), "key", "left_anti")


def merge_pairs(memories: DataFrame, threshold: float = S.DEFAULTS.merge_sim, since_ms: int = 0) -> DataFrame:
    """(layer, namespace, a, b, similarity) of one layer, and of one namespace or with one row in ``default``; one row is new since ``since_ms``.

    A pair of ``default`` with another namespace is in ``default``, where its merged row stays.
    """
    rows = memories.where(F.col("layer").isin(*S.LAYER_NAMES))
    fresh, home, layer = _is_new(since_ms), F.col("namespace") == S.DEFAULT_NAMESPACE, F.col("layer").cast("string")
    groups = {
        "own": (F.concat_ws(":", layer, "namespace"), _mode((fresh, metric.NEW), (F.lit(True), metric.OLD))),
        "from default": (layer, _mode((home & fresh, metric.PROBE), (~home, metric.OLD))),
        "to default": (layer, _mode((~home & fresh, metric.PROBE), (home & ~fresh, metric.OLD))),
    }
    p = metric.near_pairs(_meeting(rows, groups), threshold)
    own = F.col("g").startswith("own:")
    layer_of = F.when(own, F.split_part("g", F.lit(":"), F.lit(2))).otherwise(F.element_at(F.split("g", ":"), -1)).cast("int")
    namespace = F.when(own, F.expr("substring(g, length(split_part(g, ':', 2)) + 6)")).otherwise(S.DEFAULT_NAMESPACE)
    return p.select(layer_of.alias("layer"), namespace.alias("namespace"), "a", "b", "similarity")


def dedup_buffer(memories: DataFrame, threshold: float = S.DEFAULTS.triage_dedup_sim, accumulate: bool = False) -> DataFrame:
    """(id, removed, access_count, importance, tags) of the Buffer rows that duplicates change or remove.

    Pairs are visited by id; the older goes, the newer gets the sum of both access counts, the larger importance
    and the tags of both, from the values at the start, so of several pairs the last counts; a row already gone
    still pairs as the first of a pair begun. ``accumulate`` adds up whole groups instead. Rows meet in their
    component of pairs only, which the exact pair join finds first.
    """
    buffer = memories.where((F.col("layer") == S.BUFFER) & F.col("embedding").isNotNull())
    pairs = cut(metric.near_pairs(buffer.select(F.col("namespace").alias("g"), "id", "embedding", F.lit(metric.NEW).alias("mode")), threshold, inclusive=True).select("a", "b"))
    from recollect.operators.cluster import connected

    comp = connected(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = buffer.join(comp.select(F.col("node").alias("id"), "component"), "id").select("component", "id", "created_at", "access_count", "importance", "tags")
    partners = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).groupBy("id").agg(F.collect_list("other").alias("others"))
    rows = rows.join(partners, "id", "left")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {r.id: r for r in pdf.itertuples()}
        near = {r.id: set(r.others) if r.others is not None else set() for r in pdf.itertuples()}
        ids, gone, out = sorted(row), set(), {}
        for i in ids:
            if i in gone:
                continue
            for j in sorted(near[i]):
                if j in gone:
                    continue
                keep, drop = (i, j) if row[i].created_at >= row[j].created_at else (j, i)
                base = out.get(keep) if accumulate else None
                access, importance, tags = base or (row[keep].access_count, row[keep].importance, list(row[keep].tags))
                more = (out.get(drop) if accumulate else None) or (row[drop].access_count, row[drop].importance, list(row[drop].tags))
                out[keep] = (access + more[0], max(importance, more[1]), list(dict.fromkeys([*tags, *more[2]]))[: S.MAX_TAGS])
                gone.add(drop)
                if accumulate and drop == i:
                    break
        return pd.DataFrame([(k, k in gone, *(out.get(k) or (row[k].access_count, row[k].importance, list(row[k].tags)))) for k in ids if k in gone or k in out], columns=["id", "removed", "access_count", "importance", "tags"])

    return rows.groupBy("component").applyInPandas(resolve, "id string, removed boolean, access_count long, importance double, tags array<string>")


def roll_up(members: DataFrame, by: str) -> DataFrame:
    """One row for each group: the newest row's id and text, the sum of accesses, the largest importance, all tags in order."""
    newest = F.max_by(F.struct("id", "content"), F.struct("created_at", "id"))
    tags = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "tags"))), lambda s: s["tags"])
    return members.groupBy(by).agg(newest.alias("_n"), F.sum("access_count").alias("access_count"), F.max("importance").alias("importance"), F.max("layer").alias("layer"), F.slice(F.array_distinct(F.flatten(tags)), 1, S.MAX_TAGS).alias("tags"), F.count(F.lit(1)).alias("members")).select(by, F.col("_n.id").alias("id"), F.col("_n.content").alias("content"), "access_count", "importance", "layer", "tags", "members")
