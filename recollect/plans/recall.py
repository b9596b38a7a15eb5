"""Hybrid recall: keyword, vector and fact candidates fused into one ranking under a token budget.

The texts are tokenised once, to a narrow checkpointed table of term counts, for all queries of a request. Keyword and
vector hits are bounded by the page, so they come to the driver as lists of a few hundred ids and scores; the number of
candidates decides how vectors are searched. The last step joins the memories with those lists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X
from recollect.operators import facts as G
from recollect.operators import scans, text, vector
from recollect.operators.lineage import cut, local


@dataclass(frozen=True)
class Request:
    query: str
    vector: list[float] | None = None
    extra_queries: list[str] = field(default_factory=list)
    budget: int = 2000
    limit: int = 20
    offset: int = 0
    layers: list[int] | None = None
    min_importance: float = 0.0
    since: int | None = None
    until: int | None = None
    sort_by: str = "score"
    source: str | None = None
    tags: list[str] | None = None
    namespace: str | None = None
    min_score: float = 0.0

    @property
    def page(self) -> int:
        return min(self.limit, 100)

    @property
    def fetch(self) -> int:
        return max(50, self.offset + self.page)

    @property
    def short_cjk(self) -> bool:
        import re

        return 0 < len(self.query) < 10 and re.search(X.CJK, self.query) is not None


CORE_CANDIDATES = 200
#: Memories that facts name, of which the hits are broadcast at most; with more, the memories are joined by a shuffle.
LINKED_BROADCAST = 1 << 16


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


@dataclass(frozen=True)
class Candidates:
    """Keyword hits by the first query and by the others, as bounded maps on the driver; ``linked`` and ``core`` are tables of ids."""

    fts: dict[str, float]
    extra: dict[str, float]
    linked: DataFrame
    core: DataFrame


def candidates(memories: DataFrame, facts: DataFrame, r: Request, counts: text.Counts, t: S.Thresholds = S.DEFAULTS) -> Candidates:
    def hits(query: str, limit: int) -> dict[str, float]:
        found = counts.best(query, limit, r.namespace, t)
        best = max([0.001, *(x for _, x in found)])
        return {i: x / best for i, x in found}

    extra: dict[str, float] = {}
    for q in r.extra_queries:
        extra = {i: x * 0.85 for i, x in hits(q, r.page).items()} | extra  # the first query that finds a row counts
    linked = G.lookup(facts, r.query, r.namespace or S.DEFAULT_NAMESPACE).select(F.col("memory_id").alias("id")).distinct()
    core = _ids(scans.list_filtered(memories, CORE_CANDIDATES, namespace=r.namespace, layer=S.CORE))
    return Candidates(hits(r.query, r.fetch * 3), extra, cut(linked), core)


def semantic(memories: DataFrame, c: Candidates, r: Request) -> dict[str, float]:
    """Similarities of the nearest 3 * fetch rows, among the candidates only if they are twice the page or more."""
    if r.vector is None:
        return {}
    spark = memories.sparkSession
    found = local(spark, {"id": ([*c.fts, *c.extra], pa.string())})
    found = cut(found.union(c.linked).union(c.core).distinct())
    rows = memories.where(F.col("embedding").isNotNull())
    if found.count() >= 2 * (r.offset + r.page):
        rows = rows.join(found, "id", "left_semi")
    elif r.namespace is not None:
        rows = rows.where(F.col("namespace") == r.namespace)
    near = vector.with_similarity(rows, r.vector, "sim").where("sim > 0").orderBy(F.desc("sim"), "id").limit(3 * r.fetch)
    return {x.id: x.sim for x in near.select("id", "sim").collect()}


def relevance(memories: DataFrame, facts: DataFrame, r: Request, t: S.Thresholds = S.DEFAULTS, counts: text.Counts | None = None) -> DataFrame:
    """The rows found, with sim, f and relevance; ``counts`` of all its terms can come from an index (``text_index.term_counts``)."""
    words = list(dict.fromkeys(text.query_terms(r.query)))
    counts = text.count_terms(memories, [r.query, *r.extra_queries]) if counts is None else counts
    c = candidates(memories, facts, r, counts, t)
    near = {i: x for i, x in semantic(memories, c, r).items() if x >= t.recall_sim_floor}
    ids = list(dict.fromkeys([*near, *c.fts, *c.extra]))
    found = {"sim": near, "f": c.fts, "x": c.extra}
    hits = local(memories.sparkSession, {"id": (ids, pa.string())} | {k: ([v.get(i) for i in ids], pa.float64()) for k, v in found.items()})
    hits = hits.join(c.linked.withColumn("linked", F.lit(True)), "id", "full")
    few = c.linked.count() <= LINKED_BROADCAST  # all others are bounded by the page
    boost, base, slope, alone = (0.6, 0.50, 0.35, 0.4) if r.short_cjk else (0.3, 0.35, 0.25, 0.25)
    sim, f = F.col("sim"), F.col("f")
    gate = F.least(F.lit(1.0), sim / 0.45)
    dual = F.least(F.lit(1.0), F.greatest(sim * (F.lit(1.0) + f * boost * gate), (f * slope + base) * gate))
    rel = F.when(sim.isNotNull() & f.isNotNull(), dual).when(sim.isNotNull(), sim).when(f.isNotNull(), f * alone).otherwise(F.col("x"))
    own = scans.recall_filter(r.min_importance, r.since, r.until, r.layers, r.source, r.tags, r.namespace)
    hits = hits.withColumn("relevance", rel)
    rows = memories.join(F.broadcast(hits) if few else hits, "id").where(own)

    terms = list(dict.fromkeys(w for w in r.query.lower().split() if w))
    content = F.lower("content")
    rel = F.col("relevance")
    if terms:
        said = F.exists(F.array(*map(F.lit, terms)), lambda w: F.contains(content, w))
        rel = F.when(F.col("f").isNull() & ~said, rel * t.no_keyword_penalty).otherwise(rel)
    if words:
        known = [(w, counts.df[w]) for w in words if not counts.is_noise(w, t)]
        idfs = [(w, math.log(counts.n / df)) for w, df in known if df > 0]
        total = sum(i for _, i in idfs)
        whole = F.lower(F.concat_ws(" ", "content", F.array_join("tags", " ")))
        if known and total > 0:
            share = reduce(lambda a, b: a + b, [F.when(F.contains(whole, F.lit(w)), i).otherwise(0.0) for w, i in idfs]) / total
            rel = rel * F.when(share > 0, share * t.idf_boost + 1).otherwise(t.idf_miss_penalty)
        elif known:
            rel = rel * t.orphan_penalty
    if r.tags:
        wanted = F.array(*[F.lit(x.lower()) for x in r.tags])
        rel = rel * (F.size(F.filter("tags", lambda x: F.array_contains(wanted, F.lower(x)))) * t.tag_boost + 1)
    # Rows found by facts alone are certain, past all penalties.
    return rows.withColumn("relevance", F.coalesce(rel, F.when(F.col("linked"), 1.0))).where(F.col("relevance").isNotNull())


def scored(memories: DataFrame, facts: DataFrame, r: Request, now_ms: int, t: S.Thresholds = S.DEFAULTS, counts: text.Counts | None = None) -> DataFrame:
    rows = relevance(memories, facts, r, t, counts)
    rows = rows.withColumns({"recency": X.recency(F.col("last_accessed"), F.col("decay_rate"), now_ms), "weight": X.weight()})
    return rows.withColumn("score", X.score(F.col("relevance"), F.col("weight"), F.col("recency"))).where(F.col("score") >= r.min_score)


def ordering(sort_by: str) -> list[Column]:
    key = {"recent": "created_at", "accessed": "last_accessed"}.get(sort_by, "score")
    return [F.desc(key), F.asc("id")]


def budget_prefix(df: DataFrame, order: list[Column], budget: int, limit: int, offset: int = 0, cost: Column | None = None) -> DataFrame:
    """Rows in order up to the first that overflows the budget; the first row always; 0: no budget. rank from 1.

    Costs are at least 1, so running sums rise and a prefix is a filter. Only offset + limit rows are ranked.
    """
    page = df.orderBy(*order).limit(offset + limit)
    w = Window.orderBy(*order)
    page = page.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > offset)
    cost = X.estimate_tokens(F.col("content")) if cost is None else cost
    page = page.withColumn("tokens", cost).withColumn("_sum", F.sum("tokens").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    if budget:
        page = page.where((F.col("_sum") <= budget) | (F.col("_r") == offset + 1))
    return page.withColumn("rank", (F.col("_r") - offset).cast("int")).drop("_r", "_sum")


def recall(memories: DataFrame, facts: DataFrame, r: Request, now_ms: int, t: S.Thresholds = S.DEFAULTS, counts: text.Counts | None = None) -> DataFrame:
    """The page: rank, id, score, relevance, recency, tokens and the memory's columns."""
    rows = scored(memories, facts, r, now_ms, t, counts)
    return budget_prefix(rows, ordering(r.sort_by), r.budget, r.page, r.offset).drop("sim", "f", "x", "linked", "embedding")


def touched(page: DataFrame, least: float = 0.5) -> DataFrame:
    """Ids whose counters a recall that is not dry would raise."""
    return page.where(F.col("relevance") > least).select("id")


def projection(page: DataFrame) -> DataFrame:
    """What a client gets of a page: short id, content, score, layer name, tags, kind."""
    return page.select(X.short_id(F.col("id")).alias("id"), "content", "score", X.layer_label(F.col("layer")).alias("layer"), "tags", "kind")


def breakdown(page: DataFrame) -> DataFrame:
    return page.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def fact_chains(facts: DataFrame, r: Request) -> DataFrame:
    """Chains of two facts from the subjects of the facts that the query names."""
    ns = r.namespace or S.DEFAULT_NAMESPACE
    subjects = G.lookup(facts, r.query, ns).select(F.col("subject").alias("entity")).distinct()
    return G.multihop(facts, subjects, 2, ns).where("depth > 1")


def recall_expanding(memories: DataFrame, facts: DataFrame, r: Request, now_ms: int, expander, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """Recall again with expanded queries if the best relevance is low; the second page counts only if it is better."""
    from dataclasses import replace

    best = lambda p: p.agg(F.max("relevance")).first()[0] or 0.0
    page = recall(memories, facts, r, now_ms, t)
    if (first := best(page)) >= t.auto_expand:
        return page
    again = recall(memories, facts, replace(r, extra_queries=expander(r.query)), now_ms, t)
    return again if best(again) > first else page
