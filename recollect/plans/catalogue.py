"""Registered queries and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import noise
from recollect.functions import scalars as X
from recollect.operators import cluster, dedup, lifecycle, mutations, scans, text, topics, usage, vector
from recollect.operators import facts as G
from recollect.plans import recall as R
from recollect.plans import resume
from recollect.sources import adapters as A
from recollect.sources import tables as T
from recollect.sources.adapters import BASE_MS, EPOCH, NOW_MS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The adapter of sources/adapters.py in SQL.
MEM = f"""
memories AS (SELECT *, created_at AS modified_at, n % {EPOCH} AS modified_epoch FROM (SELECT d.doc_id AS n, CAST(d.doc_id AS VARCHAR) AS id, d.text AS content, CAST(1 + d.doc_id % 3 AS INTEGER) AS layer, CAST(d.doc_id % 100 AS DOUBLE) / 100 AS importance,
  {NOW_MS} - (d.doc_id % 240) * {S.HOUR_MS} AS last_accessed, {NOW_MS} - (d.doc_id % 240) * {S.HOUR_MS} - (d.doc_id % 30) * {S.DAY_MS} AS created_at, d.doc_id % 50 AS access_count, d.doc_id % 7 AS repetition_count,
  CAST(CASE d.doc_id % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 1.0 ELSE 0.05 END AS DOUBLE) AS decay_rate, d.source, d.lang AS namespace, CASE d.doc_id % 5 WHEN 3 THEN 'episodic' WHEN 4 THEN 'procedural' ELSE 'semantic' END AS kind,
  list_filter([d.lang, d.source, CASE WHEN d.doc_id % 11 = 0 THEN 'lesson' END, CASE WHEN d.doc_id % 13 = 0 THEN 'trigger:deploy' END, CASE WHEN d.doc_id % 17 = 0 THEN '_birth_epoch:90' END,
    CASE WHEN d.doc_id % 19 = 0 THEN 'gate-rejected' END, CASE WHEN d.doc_id % 19 = 0 THEN '_gate_epoch:' || (30 + d.doc_id % 60) END, CASE WHEN d.doc_id % 23 = 0 THEN 'session' END, CASE WHEN d.doc_id % 29 = 0 THEN 'ephemeral' END], lambda t: t IS NOT NULL) AS tags,
  CAST(e.embedding AS DOUBLE[]) AS embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id))"""
WEIGHT = "(importance + least(0.7, 0.17 * ln(1 + repetition_count)) + least(0.55, 0.12 * ln(1 + access_count)) + CASE kind WHEN 'procedural' THEN 0.15 WHEN 'episodic' THEN -0.1 ELSE 0 END + CASE layer WHEN 3 THEN 0.1 WHEN 1 THEN -0.1 ELSE 0 END)"
RECENCY = f"exp(-decay_rate * greatest(0, ({NOW_MS} - last_accessed) / {float(S.HOUR_MS)}) / 168.0)"
DECAYED = f"importance * exp(-decay_rate * (({NOW_MS} - last_accessed) / {float(S.HOUR_MS)}) / 168.0)"
TOKENS = "greatest(1, CAST(ceil(strlen(content) / 4.0) AS BIGINT))"
FACTS = f"""
facts AS (SELECT 'c' || c_custkey AS id, c_name AS subject, 'in_nation' AS predicate, n_name AS object, CAST(c_custkey * 2 AS VARCHAR) AS memory_id, {BASE_MS} + c_custkey AS created_at FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'in_region', r_name, '0', {BASE_MS} + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"""
ORDER_FACTS = "ofacts AS (SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, c_name AS subject, o_orderpriority AS object, epoch_us(o_orderdate) // 1000 AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)"
USAGE = "usage AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ts, event_type AS component, 'm' || (user_id % 5) AS model, CAST(floor(value) AS BIGINT) AS input_tokens, CAST(props->>'$.k' AS BIGINT) AS output_tokens, CAST(floor(value * 10) AS BIGINT) AS duration_ms FROM events)"
TURNS = f"turns AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_key, role || ': ' || text AS content, {BASE_MS} + conv_id * 60000 + turn * 1000 AS created_at FROM conversations)"
TOKENISED = "tok AS (SELECT *, regexp_extract_all(strip_accents(lower(content || ' ' || array_to_string(tags, ' '))), '[\\p{L}\\p{N}]+') AS w FROM memories)"
SKIP = "(source = 'session' OR len(list_intersect(tags, ['session', 'ephemeral', 'auto-distilled', 'distilled'])) > 0)"
STRONG = f"(importance >= 0.6 AND ({WEIGHT} >= 0.8 OR ({NOW_MS} - created_at > {7 * S.DAY_MS} AND {WEIGHT} > 0)))"
CORE_OK = f"(layer = 2 AND NOT {SKIP} AND NOT list_contains(tags, 'gate-rejected-final') AND kind <> 'episodic' AND {STRONG})"
BORN = f"coalesce(CAST(regexp_extract(list_filter(tags, lambda t: starts_with(t, '_birth_epoch:'))[1], '(\\d+)$', 1) AS BIGINT), {EPOCH})"
BUFFER_OK = f"(NOT list_contains(tags, 'distilled') AND ({WEIGHT} >= 0.4 OR ((kind = 'procedural' OR list_contains(tags, 'lesson')) AND {EPOCH} - {BORN} >= 4)))"
GATE = "coalesce(CAST(nullif(regexp_extract(list_filter(tags, lambda t: starts_with(t, '_gate_epoch:'))[1], '(\\d+)$', 1), '') AS BIGINT), 0)"
QUERY = "the thonre whation"
TERMS = text.query_terms(QUERY)
META = ["id", "layer", "importance", "created_at", "namespace", "kind"]
META_SQL = ", ".join(META)


def register(name: str, sql: str | None = None, *ctes: str):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return keep


def mem(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    return A.memories(spark, d, vectors)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Scans and counts


@register("list_filtered", f"SELECT {META_SQL} FROM memories WHERE namespace = 'en' AND layer = 2 AND kind = 'semantic' ORDER BY created_at DESC, id LIMIT 50 OFFSET 5", MEM)
def _(s, d):
    return scans.list_filtered(mem(s, d), 50, 5, namespace="en", layer=2, kind="semantic").select(*META)


@register("list_by_layer", f"SELECT {META_SQL} FROM memories WHERE layer = 3 ORDER BY importance DESC, id LIMIT 40", MEM)
def _(s, d):
    return scans.list_by_layer(mem(s, d), 3, 40).select(*META)


@register("list_by_tag", f"SELECT {META_SQL} FROM memories WHERE list_contains(tags, 'lesson')", MEM)
def _(s, d):
    return scans.list_by_tag(mem(s, d), "lesson").select(*META)


@register("list_since", f"SELECT {META_SQL} FROM memories WHERE created_at >= {NOW_MS - 10 * S.DAY_MS} AND importance >= 0.5 AND source = 'src3' ORDER BY created_at DESC, id LIMIT 100", MEM)
def _(s, d):
    return scans.list_since(mem(s, d), NOW_MS - 10 * S.DAY_MS, 100, min_importance=0.5, source="src3").select(*META)


@register("list_by_epoch", f"SELECT {META_SQL} FROM memories WHERE modified_epoch >= 76 ORDER BY modified_at DESC, id LIMIT 200", MEM)
def _(s, d):
    return scans.list_by_epoch(mem(s, d), 76, 200).select(*META)


@register("namespaces", "SELECT DISTINCT namespace FROM memories", MEM)
def _(s, d):
    return scans.namespaces(mem(s, d))


@register("stats_by_layer_kind", "SELECT layer, kind, count(*) AS n FROM memories GROUP BY ALL", MEM)
def _(s, d):
    return scans.stats(mem(s, d))


@register("count_filtered", "SELECT count(*) AS n FROM memories WHERE namespace = 'fr' AND importance >= 0.25", MEM)
def _(s, d):
    return scans.count_filtered(mem(s, d), namespace="fr", min_importance=0.25)


@register("integrity", "SELECT count(*) AS total, count(*) FILTER (layer > 1) AS indexed, 0::BIGINT AS orphans, count(*) FILTER (layer = 1) AS missing, count(*) FILTER (embedding IS NULL) AS no_vector FROM memories", MEM)
def _(s, d):
    m = mem(s, d, True)
    return scans.integrity(m, m.where("layer > 1").select("id"))


@register("missing_vectors", "SELECT id FROM memories WHERE embedding IS NULL ORDER BY id LIMIT 500", MEM)
def _(s, d):
    return scans.missing_vectors(mem(s, d, True), 500).select("id")


@register("recall_filter", f"SELECT {META_SQL} FROM memories WHERE importance >= 0.3 AND created_at >= {NOW_MS - 20 * S.DAY_MS} AND created_at <= {NOW_MS - S.DAY_MS} AND layer IN (2, 3) AND namespace IN ('en', 'default') AND list_contains(tags, 'lesson')", MEM)
def _(s, d):
    return mem(s, d).where(scans.recall_filter(0.3, NOW_MS - 20 * S.DAY_MS, NOW_MS - S.DAY_MS, [2, 3], None, ["Lesson"], "en")).select(*META)


@register("topic_entries", "SELECT id, CAST(row_number() OVER (ORDER BY layer DESC, importance DESC, id) - 1 AS INTEGER) AS idx FROM memories WHERE embedding IS NOT NULL", MEM)
def _(s, d):
    return scans.topic_entries(mem(s, d, True), keep=["id"])


@register("triggers", f"SELECT id, round({WEIGHT}, 6) AS weight FROM memories WHERE list_contains(tags, 'trigger:deploy')", MEM)
def _(s, d):
    return scans.triggers(mem(s, d), "deploy").select("id", r6(F.col("weight"), "weight"))


@register("trigger_freq", "SELECT t[9:] AS action, CAST(sum(greatest(access_count, 1)) AS BIGINT) AS uses FROM (SELECT unnest(tags) AS t, access_count FROM memories) WHERE starts_with(t, 'trigger:') GROUP BY 1", MEM)
def _(s, d):
    return scans.trigger_frequency(mem(s, d))


@register("most_common_tag", "SELECT namespace, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY n DESC, tag) AS r FROM (SELECT namespace, unnest(tags) AS tag, count(*) AS n FROM memories GROUP BY 1, 2)) WHERE r = 1", MEM)
def _(s, d):
    return scans.most_common_tag(mem(s, d), "namespace")


@register("memories_without_facts", f"SELECT {META_SQL} FROM memories m WHERE layer >= 2 AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.memory_id = m.id)", MEM, FACTS)
def _(s, d):
    return scans.memories_without_facts(mem(s, d), A.facts(s, d)).select(*META)


# Scalars


@register("scalar_weight", f"SELECT id, round({WEIGHT}, 6) AS weight FROM memories", MEM)
def _(s, d):
    return mem(s, d).select("id", r6(X.weight(), "weight"))


@register("scalar_score", f"SELECT id, round({RECENCY}, 6) AS recency, round(2 / (1 + exp(-2 * (0.5 * (1 + 0.4 * {WEIGHT} + 0.2 * {RECENCY})))) - 1, 6) AS score FROM memories WHERE {WEIGHT} > -2", MEM)
def _(s, d):
    rec = X.recency(F.col("last_accessed"), F.col("decay_rate"), NOW_MS)
    return mem(s, d).select("id", r6(rec, "recency"), r6(X.score(F.lit(0.5), X.weight(), rec), "score"))


@register("estimate_tokens", f"SELECT id, {TOKENS} AS tokens FROM memories", MEM)
def _(s, d):
    return mem(s, d).select("id", X.estimate_tokens(F.col("content")).alias("tokens"))


@register("validate_inputs", "SELECT id, CASE WHEN content IS NULL OR trim(content) = '' THEN 'empty content' WHEN length(trim(content)) > 8192 THEN 'content too long' END AS error FROM memories", MEM)
def _(s, d):
    return mem(s, d).select("id", X.validation_error().alias("error"))


@register("short_ids", "SELECT id, substr(id, 1, 8) AS short, CASE WHEN length(content) > 40 THEN substr(content, 1, 40) || '…' ELSE content END AS preview, CASE layer WHEN 1 THEN 'buffer' WHEN 2 THEN 'working' ELSE 'core' END AS layer_name FROM memories", MEM)
def _(s, d):
    return mem(s, d).select("id", X.short_id(F.col("id")).alias("short"), X.truncate_chars(F.col("content"), 40).alias("preview"), X.layer_label(F.col("layer")).alias("layer_name"))


@register("format_age", f"SELECT id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age FROM (SELECT id, ({NOW_MS} - created_at) // 60000 AS m FROM memories)", MEM)
def _(s, d):
    return mem(s, d).select("id", X.format_age(F.col("created_at"), NOW_MS).alias("age"))


def _count_sql(words: list[str]) -> str:
    return " + ".join("CAST(contains(lower(content), '" + w.replace("'", "''") + "') AS INTEGER)" for w in words)


@register("code_noise", f"SELECT id, (({_count_sql(noise.STRONG)}) >= 1 OR ({_count_sql(noise.WEAK)}) >= 2) AND ({_count_sql(noise.VALUE)}) = 0 AS noise FROM (SELECT id, content || CASE n % 4 WHEN 0 THEN ' cargo build' WHEN 1 THEN ' refactor and rename' WHEN 2 THEN ' decision: cargo test' ELSE ' refactor' END AS content FROM memories)", MEM)
def _(s, d):
    tail = F.element_at(F.array(*map(F.lit, (" cargo build", " refactor and rename", " decision: cargo test", " refactor"))), (F.col("id").cast("int") % 4 + 1))
    return mem(s, d).select("id", noise.is_code_noise(F.concat("content", tail)).alias("noise"))


@register("numbered_facts", "SELECT conv_id, turn, CAST(i AS INTEGER) AS no, l[i] AS fact FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE trim(l[i]) <> ''")
def _(s, d):
    # Every line of every message, numbered; lines without a fact are no facts.
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    c = A.table(s, d, "conversations").select("conv_id", "turn", F.array_join(lines, "\n").alias("text"))
    return T.numbered_facts(c).select("conv_id", "turn", "no", "fact")


# Full text

_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_DF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
_BM = " + ".join(f"CASE WHEN tf{i} = 0 OR (n >= 5 AND df{i} / n > 0.8) THEN 0 ELSE greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) END" for i in range(len(TERMS)))
BM25 = ["tf AS (SELECT * EXCLUDE (n), len(w) AS dl, " + _TF + " FROM tok)", f"st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {_DF} FROM tf)", f"bm AS (SELECT tf.*, {_BM} AS bm25 FROM tf, st)"]


@register("bm25_search", "SELECT id, round(bm25, 6) AS bm25 FROM bm WHERE bm25 > 0 ORDER BY bm.bm25 DESC, id LIMIT 50", MEM, TOKENISED, *BM25)
def _(s, d):
    return text.search(mem(s, d), QUERY, 50).select("id", r6(F.col("bm25"), "bm25"))


@register("bm25_postings", ORACLE["bm25_search"])
def _(s, d):
    m = mem(s, d)
    n, mean = m.select(F.size(X.tokens(text.searchable())).alias("dl")).agg(F.count(F.lit(1)), F.avg("dl")).first()
    return text.search_postings(text.postings(m), n, mean, QUERY, 50).select("id", r6(F.col("bm25"), "bm25"))


@register("term_df", "SELECT term, count(*) FILTER (list_contains(w, term)) AS df FROM tok, (SELECT unnest(['the', 'lesson', 'deploy', 'nosuchterm']) AS term) GROUP BY term", MEM, TOKENISED)
def _(s, d):
    return text.term_document_frequency(mem(s, d), ["the", "lesson", "deploy", "nosuchterm"])


@register("noise_terms", "SELECT term, df FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM tok) GROUP BY term) WHERE df / (SELECT count(*) FROM tok) > 0.5", MEM, TOKENISED)
def _(s, d):
    return text.noise_terms(mem(s, d), S.Thresholds(noise_df_ratio=0.5))


@register("recall_keyword", f"SELECT id, round(2 / (1 + exp(-2 * raw)) - 1, 6) AS score FROM (SELECT id, 0.25 * bm25 / greatest(0.001, max(bm25) OVER ()) * (1 + 0.4 * {WEIGHT} + 0.2 * {RECENCY}) AS raw FROM (SELECT * FROM bm WHERE bm25 > 0 ORDER BY bm25 DESC, id LIMIT 150)) ORDER BY raw DESC, id LIMIT 20", MEM, TOKENISED, *BM25)
def _(s, d):
    c = text.search(mem(s, d), QUERY, 150)
    top = c.agg(F.greatest(F.lit(0.001), F.max("bm25")).alias("m"))
    rel = F.col("bm25") / F.col("m") * 0.25
    return c.crossJoin(F.broadcast(top)).select("id", X.score(rel, X.weight(), X.recency(F.col("last_accessed"), F.col("decay_rate"), NOW_MS)).alias("score")).orderBy(F.desc("score"), "id").limit(20).select("id", r6(F.col("score"), "score"))


# Vectors

QUERY_VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7)"
COS = "(list_dot_product(embedding, q) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(q, q))))"


def query_vector(s: SparkSession, d: str) -> list[float]:
    return list(A.table(s, d, "embeddings").where("vec_id = 7").select("embedding").first()[0])


@register("cosine_topk", f"SELECT id, round({COS}, 6) AS similarity FROM memories, {QUERY_VECTOR} WHERE embedding IS NOT NULL AND {COS} > 0 ORDER BY {COS} DESC, id LIMIT 25", MEM)
def _(s, d):
    return vector.search(mem(s, d, True), query_vector(s, d), 25).select("id", r6(F.col("similarity"), "similarity"))


@register("cosine_topk_ns", f"SELECT id, round({COS}, 6) AS similarity FROM memories, {QUERY_VECTOR} WHERE namespace = 'fr' AND embedding IS NOT NULL AND {COS} > 0 ORDER BY {COS} DESC, id LIMIT 25", MEM)
def _(s, d):
    return vector.search(mem(s, d, True), query_vector(s, d), 25, "fr").select("id", r6(F.col("similarity"), "similarity"))


@register("candidate_cosine", f"SELECT id, round({COS}, 6) AS similarity FROM memories, {QUERY_VECTOR} WHERE list_contains(tags, 'lesson') AND embedding IS NOT NULL AND {COS} > 0 ORDER BY {COS} DESC, id LIMIT 10", MEM)
def _(s, d):
    m = mem(s, d, True)
    return vector.search_among(m, m.where(F.array_contains("tags", "lesson")), query_vector(s, d), 10).select("id", r6(F.col("similarity"), "similarity"))


PAIRS = "pairs AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, list_dot_product(x.embedding, y.embedding) / (sqrt(list_dot_product(x.embedding, x.embedding)) * sqrt(list_dot_product(y.embedding, y.embedding))) AS sim, x.namespace AS nx, y.namespace AS ny, x.n AS xn, y.n AS yn, x.layer AS lx, y.layer AS ly, x.created_at AS cx, y.created_at AS cy, x.tags AS tx, y.tags AS ty FROM memories x JOIN memories y ON x.n < y.n WHERE x.embedding IS NOT NULL AND y.embedding IS NOT NULL)"


@register("vector_dup_pairs", "SELECT nx AS g, a, b, round(sim, 6) AS similarity FROM pairs WHERE nx = ny AND sim > 0.35", MEM, PAIRS)
def _(s, d):
    return vector.similar_pairs(mem(s, d, True), 0.35, by="namespace").select("g", "a", "b", r6(F.col("similarity"), "similarity"))


@register("core_overlap_pairs", "SELECT a, b, round(sim, 6) AS similarity, a || ':' || b AS key FROM pairs WHERE lx = 3 AND ly = 3 AND sim > 0.35", MEM, PAIRS)
def _(s, d):
    return dedup.core_overlaps(mem(s, d, True), 0.35).select("a", "b", r6(F.col("similarity"), "similarity"), "key")


@register(
    "reconcile_pairs",
    f"""SELECT CAST(CASE WHEN f THEN xn ELSE yn END AS VARCHAR) AS older, CAST(CASE WHEN f THEN yn ELSE xn END AS VARCHAR) AS newer, round(sim, 6) AS similarity, a || ':' || b AS key
FROM (SELECT *, CASE WHEN a = CAST(xn AS VARCHAR) THEN cx <= cy ELSE NOT (cy <= cx) END AS f FROM pairs)
WHERE (nx = ny OR nx = 'default' OR ny = 'default') AND sim >= 0.35 AND sim <= 0.5 AND abs(cx - cy) >= {S.HOUR_MS} AND CASE WHEN f THEN lx ELSE ly END >= 2 AND (CASE WHEN f THEN ly ELSE lx END >= CASE WHEN f THEN lx ELSE ly END OR CASE WHEN f THEN ly ELSE lx END = 1)""",
    MEM,
    PAIRS,
)
def _(s, d):
    return dedup.reconcile_pairs(mem(s, d, True), low=0.35, high=0.5).select("older", "newer", r6(F.col("similarity"), "similarity"), "key")


#: Rows written or changed later are new to the reconciliation.
SINCE_MS = A.NOW_MS - 20 * S.DAY_MS
_NEWER = "CASE WHEN f THEN {0}y ELSE {0}x END"


@register(
    "reconcile_new_pairs",
    f"""SELECT CAST(CASE WHEN f THEN xn ELSE yn END AS VARCHAR) AS older, CAST(CASE WHEN f THEN yn ELSE xn END AS VARCHAR) AS newer, round(sim, 6) AS similarity, a || ':' || b AS key
FROM (SELECT *, CASE WHEN a = CAST(xn AS VARCHAR) THEN cx <= cy ELSE NOT (cy <= cx) END AS f FROM pairs)
WHERE (nx = ny OR nx = 'default' OR ny = 'default') AND sim >= 0.35 AND sim <= 0.5 AND abs(cx - cy) >= {S.HOUR_MS} AND {_NEWER.format("c")} > {SINCE_MS} AND (xn + yn) % 7 <> 0
  AND CASE WHEN f THEN lx ELSE ly END >= 2 AND ({_NEWER.format("l")} >= CASE WHEN f THEN lx ELSE ly END OR {_NEWER.format("l")} = 1)""",
    MEM,
    PAIRS,
)
def _(s, d):
    """The pairs of one run after another: new rows since the watermark, without pairs that were judged before."""
    m = mem(s, d, True)
    judged = dedup.reconcile_pairs(m, low=0.35, high=0.5).where((F.col("older").cast("long") + F.col("newer").cast("long")) % 7 == 0)
    return dedup.reconcile_pairs(m, judged, SINCE_MS, 0.35, 0.5).select("older", "newer", r6(F.col("similarity"), "similarity"), "key")


@register("merge_pairs", "SELECT lx AS layer, nx AS namespace, a, b, round(sim, 6) AS similarity FROM pairs WHERE lx = ly AND nx = ny AND sim > 0.3", MEM, PAIRS)
def _(s, d):
    return dedup.merge_pairs(mem(s, d, True), 0.3).select("layer", "namespace", "a", "b", r6(F.col("similarity"), "similarity"))


JAC = "(CASE WHEN len(list_distinct(list_concat(tx, ty))) = 0 THEN 0 ELSE len(list_intersect(tx, ty)) / len(list_distinct(list_concat(tx, ty))) END)"


@register("single_linkage_components", f"SELECT id, min(b) AS component FROM r GROUP BY id", "", MEM, PAIRS)
def _(s, d):
    return cluster.connected(cluster.combined_links(mem(s, d, True), 0.45)).select(F.col("node").alias("id"), "component")


ORACLE["single_linkage_components"] = f"WITH RECURSIVE {MEM}, {PAIRS}, e AS (SELECT a, b FROM pairs WHERE 0.7 * sim + 0.3 * {JAC} > 0.45), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS b FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.b = u.a) SELECT id, min(b) AS component FROM r GROUP BY id"


@register("tag_jaccard_pairs", None)
def _(s, d):
    return cluster.tag_jaccard_pairs(mem(s, d), 0.6, "namespace").select("a", "b", r6(F.col("jaccard"), "jaccard"))


_TJ = "sets AS (SELECT namespace, list_sort(list_distinct(tags)) AS t, min(id) AS rep, list(id) AS ids FROM memories GROUP BY 1, 2)"
ORACLE["tag_jaccard_pairs"] = f"WITH {MEM}, {_TJ} SELECT x.rep AS a, y.rep AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM sets x JOIN sets y ON x.namespace = y.namespace AND x.rep < y.rep WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) > 0.6 UNION ALL SELECT rep, i, 1.0 FROM (SELECT rep, unnest(ids) AS i FROM sets) WHERE i <> rep"

_WS = "ws AS (SELECT id, namespace, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> ''))) AS w FROM memories), cl AS (SELECT w, min(id) AS rep, list(id) AS ids FROM ws WHERE len(w) >= 3 GROUP BY w), ex AS (SELECT rep, len(w) AS n, unnest(w) AS t FROM cl), cm AS (SELECT x.rep AS a, y.rep AS b, x.n AS n, y.n AS m, count(*) AS c FROM ex x JOIN ex y ON x.t = y.t AND x.rep < y.rep GROUP BY ALL)"


@register("jaccard_dups", f"SELECT a, b, round(c / (n + m - c), 6) AS jaccard FROM cm WHERE c / (n + m - c) > 0.8 UNION ALL SELECT rep, i, 1.0 FROM (SELECT rep, unnest(ids) AS i FROM cl) WHERE i <> rep", MEM, _WS)
def _(s, d):
    return text.jaccard_pairs(mem(s, d), 0.8).select("a", "b", r6(F.col("jaccard"), "jaccard"))


# Facts


@register("facts_lookup", "SELECT id, subject, object FROM facts WHERE lower(subject) LIKE '%#00000001%' OR lower(object) LIKE '%#00000001%' OR lower(subject) LIKE '%asia%' OR lower(object) LIKE '%asia%'", FACTS)
def _(s, d):
    return G.lookup(A.facts(s, d), "#00000001，ASIA").select("id", "subject", "object")


@register("facts_conflicts", "SELECT lower(subject) AS subject, 'order_priority' AS predicate, 'default' AS namespace, count(DISTINCT object) AS objects, count(*) AS facts FROM ofacts GROUP BY 1 HAVING count(DISTINCT object) > 1", ORDER_FACTS)
def _(s, d):
    return G.all_conflicts(A.order_facts(s, d))


@register("facts_history", "SELECT id, object, created_at FROM ofacts WHERE subject = (SELECT min(c_name) FROM customer JOIN orders ON o_custkey = c_custkey)", ORDER_FACTS)
def _(s, d):
    f = A.order_facts(s, d)
    name = f.agg(F.min("subject")).first()[0]
    return G.history(f, name.upper(), "ORDER_PRIORITY").select("id", "object", "created_at")


@register(
    "facts_supersede",
    "SELECT id, subject, object, created_at, (SELECT min(created_at) FROM runs n WHERE n.subject = r.subject AND n.run = r.run + 1) AS valid_until, (SELECT arg_min(id, (created_at, id)) FROM runs n WHERE n.subject = r.subject AND n.run = r.run + 1) AS superseded_by FROM runs r",
    ORDER_FACTS,
    "ch AS (SELECT *, CAST(coalesce(object <> lag(object) OVER (PARTITION BY subject ORDER BY created_at, id), false) AS INTEGER) AS c FROM ofacts)",
    "runs AS (SELECT *, sum(c) OVER (PARTITION BY subject ORDER BY created_at, id) AS run FROM ch)",
)
def _(s, d):
    return G.supersede(A.order_facts(s, d)).select("id", "subject", "object", "created_at", "valid_until", "superseded_by")


@register(
    "facts_multihop",
    "SELECT subject AS entity, 1 AS depth, object AS last FROM facts UNION ALL SELECT f.subject, 2, g.object FROM facts f JOIN facts g ON lower(g.subject) = lower(f.object)",
    FACTS,
)
def _(s, d):
    f = A.facts(s, d)
    start = f.select(F.col("subject").alias("entity")).distinct()
    return G.multihop(f, start, 2).select("entity", "depth", F.element_at("path", -1)["object"].alias("last"))


# Recall

_AFF = " OR ".join(f"contains(lower(content), '{w}')" for w in QUERY.split())
_IDF = ", ".join(f"CASE WHEN df{i} > 0 AND NOT (n >= 5 AND df{i} / n > 0.8) THEN ln(n / df{i}) ELSE 0 END AS i{i}" for i in range(len(TERMS)))
_GOT = " + ".join(f"CASE WHEN contains(whole, '{t}') THEN i{i} ELSE 0 END" for i, t in enumerate(TERMS))
_TOT = " + ".join(f"i{i}" for i in range(len(TERMS)))
_NTERMS = " + ".join(f"CAST(NOT (n >= 5 AND df{i} / n > 0.8) AS INTEGER)" for i in range(len(TERMS)))


def _hybrid(limit: int, offset: int, min_score: float) -> str:
    fetch = max(50, offset + limit)
    return f"""WITH {MEM}, {TOKENISED}, {", ".join(BM25)}, {FACTS},
q AS {QUERY_VECTOR},
fts AS (SELECT id, bm25 / greatest(0.001, max(bm25) OVER ()) AS f FROM (SELECT id, bm25 FROM bm WHERE bm25 > 0 AND namespace = 'en' ORDER BY bm25 DESC, id LIMIT {3 * fetch})),
core AS (SELECT id FROM memories WHERE namespace = 'en' AND layer = 3 ORDER BY created_at DESC, id LIMIT 200),
cand AS (SELECT id FROM fts UNION SELECT id FROM core),
sem AS (SELECT id, sim FROM (SELECT id, namespace, {COS} AS sim FROM memories, q WHERE embedding IS NOT NULL) WHERE sim > 0 AND CASE WHEN (SELECT count(*) FROM cand) >= {2 * (offset + limit)} THEN id IN (SELECT id FROM cand) ELSE namespace = 'en' END ORDER BY sim DESC, id LIMIT {3 * fetch}),
hits AS (SELECT coalesce(s.id, t.id) AS id, s.sim, t.f FROM (SELECT * FROM sem WHERE sim >= 0.3) s FULL JOIN fts t ON s.id = t.id),
rel AS (SELECT *, CASE WHEN sim IS NOT NULL AND f IS NOT NULL THEN least(1, greatest(sim * (1 + f * 0.3 * least(1, sim / 0.45)), (0.35 + 0.25 * f) * least(1, sim / 0.45))) WHEN sim IS NOT NULL THEN sim ELSE 0.25 * f END AS r0 FROM hits),
i AS (SELECT {_IDF}, {_NTERMS} AS nt FROM st),
fin AS (SELECT m.*, r0 * CASE WHEN f IS NULL AND NOT ({_AFF}) THEN 0.85 ELSE 1 END * CASE WHEN nt = 0 THEN 1 WHEN ({_TOT}) <= 0 THEN 0.5 WHEN ({_GOT}) / ({_TOT}) > 0 THEN 1 + 0.5 * ({_GOT}) / ({_TOT}) ELSE 0.85 END AS relevance FROM rel JOIN (SELECT *, lower(content || ' ' || array_to_string(tags, ' ')) AS whole FROM memories) m ON m.id = rel.id, i WHERE m.namespace IN ('en', 'default')),
sc AS (SELECT *, {TOKENS} AS tokens, CASE WHEN relevance * (1 + 0.4 * {WEIGHT} + 0.2 * {RECENCY}) <= 0 THEN 0 ELSE 2 / (1 + exp(-2 * relevance * (1 + 0.4 * {WEIGHT} + 0.2 * {RECENCY}))) - 1 END AS score FROM fin),
pg AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - {offset} AS rank FROM sc WHERE score >= {min_score}),
bud AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS upto FROM pg WHERE rank > 0 AND rank <= {limit})
SELECT CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, round(relevance, 6) AS relevance, tokens FROM bud WHERE """


@register("recall_hybrid", None)
def recall_hybrid(s, d):
    r = R.Request(QUERY, query_vector(s, d), namespace="en", min_score=0.30, budget=4000)
    return R.recall(mem(s, d, True), A.facts(s, d), r, NOW_MS).select("rank", "id", r6(F.col("score"), "score"), r6(F.col("relevance"), "relevance"), "tokens")


ORACLE["recall_hybrid"] = _hybrid(20, 0, 0.30) + "upto <= 4000 OR rank = 1"


@register("recall_page_two", None)
def _(s, d):
    r = R.Request(QUERY, query_vector(s, d), namespace="en", limit=15, offset=15, budget=0)
    return R.recall(mem(s, d, True), A.facts(s, d), r, NOW_MS).select("rank", "id", r6(F.col("score"), "score"), r6(F.col("relevance"), "relevance"), "tokens")


ORACLE["recall_page_two"] = _hybrid(15, 15, 0.0) + "true"


@register("recall_budget_prefix", f"SELECT id, tokens, CAST(rank AS INTEGER) AS rank FROM (SELECT id, {TOKENS} AS tokens, row_number() OVER (ORDER BY importance DESC, id) AS rank, sum({TOKENS}) OVER (ORDER BY importance DESC, id) AS upto FROM memories) WHERE rank <= 100 AND (upto <= 20000 OR rank = 1)", MEM)
def _(s, d):
    return R.budget_prefix(mem(s, d), [F.desc("importance"), F.asc("id")], 20000, 100).select("id", "tokens", "rank")


@register("recall_recent", f"SELECT {META_SQL} FROM memories WHERE created_at >= {NOW_MS - 48 * S.HOUR_MS} AND importance >= 0.2 ORDER BY created_at DESC, id LIMIT 20", MEM)
def _(s, d):
    return scans.list_since(mem(s, d), NOW_MS - 48 * S.HOUR_MS, 20, min_importance=0.2).select(*META)


@register("resume_core", f"SELECT id, CAST(rank AS INTEGER) AS rank FROM (SELECT id, row_number() OVER (ORDER BY w DESC, id) AS rank, sum(length(content) + 2) OVER (ORDER BY w DESC, id) AS upto FROM (SELECT *, {WEIGHT} AS w FROM (SELECT * FROM memories WHERE layer = 3 ORDER BY importance DESC, id LIMIT 100))) WHERE upto <= 8000 OR rank = 1", MEM)
def _(s, d):
    return resume.resume(mem(s, d), EPOCH)["core"].select("id", "rank")


# Lifecycle


@register("decayed_rows", f"SELECT id, round({DECAYED}, 6) AS left_over FROM memories WHERE layer < 3 AND {DECAYED} < 0.01", MEM)
def _(s, d):
    return lifecycle.decayed(mem(s, d), NOW_MS).select("id", r6(lifecycle.decayed_importance(NOW_MS), "left_over"))


@register("importance_decay", f"SELECT id, round(CASE WHEN last_accessed < {NOW_MS} AND importance > 0.01 AND layer < 3 THEN greatest(0.01, importance * CASE kind WHEN 'episodic' THEN 0.98 WHEN 'procedural' THEN 0.996 ELSE 0.988 END) ELSE importance END, 6) AS importance FROM memories", MEM)
def _(s, d):
    return lifecycle.decay_importance(mem(s, d), NOW_MS).select("id", r6(F.col("importance"), "importance"))


@register("promote_candidates", f"SELECT id FROM memories WHERE {CORE_OK}", MEM)
def _(s, d):
    return lifecycle.core_candidates(mem(s, d), NOW_MS).select("id")


@register("gated_candidates", f"SELECT id, CASE WHEN list_contains(tags, 'gate-rejected') THEN 'retry' ELSE 'open' END AS gate FROM memories WHERE {CORE_OK} AND NOT (list_contains(tags, 'gate-rejected') AND {EPOCH} - {GATE} < 48)", MEM)
def _(s, d):
    return lifecycle.gated_candidates(mem(s, d), NOW_MS, EPOCH).select("id", "gate")


@register("gate_off_rule", f"SELECT id, CASE WHEN access_count >= 3 AND importance >= 0.6 THEN 'promote' ELSE 'reject' END AS decision FROM memories WHERE {CORE_OK}", MEM)
def _(s, d):
    return lifecycle.core_candidates(mem(s, d), NOW_MS).select("id", lifecycle.gate_decision("off").alias("decision"))


@register("core_demotions", "SELECT id FROM memories WHERE layer = 3 AND (source = 'session' OR len(list_intersect(tags, ['session', 'ephemeral'])) > 0)", MEM)
def _(s, d):
    return mem(s, d).where((F.col("layer") == 3) & lifecycle.should_demote()).select("id")


@register("buffer_promote", f"SELECT id FROM memories WHERE layer = 1 AND {BUFFER_OK}", MEM)
def _(s, d):
    return lifecycle.buffer_promotions(mem(s, d), EPOCH).select("id")


@register("buffer_evict", f"SELECT id, round(w, 6) AS weight FROM (SELECT id, {WEIGHT} AS w, row_number() OVER (ORDER BY {WEIGHT} DESC, created_at DESC, id DESC) AS r FROM memories WHERE layer = 1 AND NOT {BUFFER_OK}) WHERE r > 10", MEM)
def _(s, d):
    return lifecycle.evictions(mem(s, d), EPOCH, 10).select("id", r6(F.col("weight"), "weight"))


SIGNAL = "len(list_filter(tags, lambda t: t IN ('lesson', 'preference', 'decision', 'procedural', 'identity', 'constraint') OR starts_with(t, 'trigger:'))) > 0"


@register("triage_heuristic", f"SELECT id, namespace, CASE WHEN access_count > 3 OR repetition_count > 1 OR {SIGNAL} OR importance >= 0.7 THEN 'promote' WHEN NOT (access_count = 0 AND NOT ({SIGNAL}) AND strlen(content) < 20) THEN 'keep' ELSE 'drop' END AS verdict FROM memories WHERE layer = 1 AND NOT (list_contains(tags, 'distilled') OR list_contains(tags, 'ephemeral')) AND {NOW_MS} - created_at > 600000", MEM)
def _(s, d):
    return lifecycle.triage(mem(s, d), NOW_MS)


@register("stale_tags", f"SELECT id, list_filter(tags, lambda t: t <> 'gate-rejected' AND NOT starts_with(t, '_gate_epoch:')) AS cleaned FROM memories WHERE layer = 2 AND list_contains(tags, 'gate-rejected') AND {EPOCH} - {GATE} >= 48", MEM)
def _(s, d):
    return lifecycle.stale_tags(mem(s, d), EPOCH).select("id", "cleaned")


@register(
    "epoch_dry_run",
    f"""SELECT 'demote' AS action, id, substr(content, 1, 100) AS preview FROM memories WHERE layer = 3 AND (source = 'session' OR len(list_intersect(tags, ['session', 'ephemeral'])) > 0)
UNION ALL SELECT 'candidate', id, substr(content, 1, 100) FROM memories WHERE {CORE_OK}
UNION ALL SELECT 'promote', id, substr(content, 1, 100) FROM memories WHERE layer = 1 AND {BUFFER_OK}
UNION ALL SELECT 'drop', id, substr(content, 1, 100) FROM memories WHERE layer = 1 AND NOT {BUFFER_OK} AND {DECAYED} < 0.01""",
    MEM,
)
def _(s, d):
    return lifecycle.dry_run(mem(s, d), NOW_MS, EPOCH)


def empty(s: SparkSession, ddl: str) -> DataFrame:
    return s.createDataFrame([], ddl)


@register(
    "consolidation_cycle",
    f"""SELECT id, CASE WHEN layer = 3 AND (source = 'session' OR len(list_intersect(tags, ['session', 'ephemeral'])) > 0) THEN 2 WHEN layer = 1 AND {BUFFER_OK.replace(str(EPOCH), str(EPOCH + 1))} THEN 2
 WHEN {CORE_OK} AND NOT (list_contains(tags, 'gate-rejected') AND {EPOCH + 1} - {GATE} < 48) AND access_count >= 3 THEN 3 ELSE layer END AS layer
FROM memories WHERE NOT (layer = 1 AND NOT {BUFFER_OK.replace(str(EPOCH), str(EPOCH + 1))} AND ({DECAYED} < 0.01 OR id IN (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {WEIGHT} DESC, created_at DESC, id DESC) AS r FROM memories WHERE layer = 1 AND NOT {BUFFER_OK.replace(str(EPOCH), str(EPOCH + 1))}) WHERE r > 10)))""",
    MEM,
)
def _(s, d):
    from recollect.plans.consolidate import State, consolidate

    new, _ = consolidate(State(mem(s, d), empty(s, S.FACT_DDL), empty(s, S.TRASH_DDL), EPOCH), NOW_MS, cap=10)
    return new.memories.select("id", "layer")


# Mutations


@register("touch_rows", f"SELECT id, access_count + 1 AS access_count, round(CASE WHEN layer < 3 THEN least(1.0, importance + 0.03) ELSE importance END, 6) AS importance FROM memories WHERE list_contains(tags, 'lesson')", MEM)
def _(s, d):
    m = mem(s, d)
    done = mutations.touch(m, m.where(F.array_contains("tags", "lesson")).select("id"), NOW_MS)
    return done.where(F.array_contains("tags", "lesson")).select("id", "access_count", r6(F.col("importance"), "importance"))


@register("promote_rows", f"SELECT id, CASE WHEN {CORE_OK} THEN 3 ELSE layer END AS layer, CAST(CASE WHEN {CORE_OK} THEN 0.05 ELSE decay_rate END AS DOUBLE) AS decay_rate FROM memories", MEM)
def _(s, d):
    m = mem(s, d)
    return mutations.promote(m, lifecycle.core_candidates(m, NOW_MS).select("id"), 3, NOW_MS, EPOCH).select("id", "layer", "decay_rate")


GONE = f"(layer < 3 AND {DECAYED} < 0.01)"


@register("soft_delete_cascade", f"SELECT 'memory' AS kind, id FROM memories WHERE NOT {GONE} UNION ALL SELECT 'trash', id FROM memories WHERE {GONE} UNION ALL SELECT 'fact', id FROM facts WHERE memory_id NOT IN (SELECT id FROM memories WHERE {GONE})", MEM, FACTS)
def _(s, d):
    m = mem(s, d)
    kept, left, trash = mutations.soft_delete(m, A.facts(s, d), empty(s, S.TRASH_DDL), lifecycle.decayed(m, NOW_MS).select("id"), NOW_MS)
    named = lambda df, k: df.select(F.lit(k).alias("kind"), "id")
    return named(kept, "memory").unionByName(named(trash, "trash")).unionByName(named(left, "fact"))


def thrown(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(memories, trash) after all decayed memories went."""
    m = mem(s, d)
    kept, _, trash = mutations.soft_delete(m, A.facts(s, d), empty(s, S.TRASH_DDL), lifecycle.decayed(m, NOW_MS).select("id"), NOW_MS)
    return kept, trash


@register("trash_restore", f"SELECT id, layer, 0::BIGINT AS access_count, 1.0::DOUBLE AS decay_rate FROM memories WHERE {GONE} AND namespace = 'en'", MEM)
def _(s, d):
    kept, trash = thrown(s, d)
    back, _ = mutations.restore(kept.where("false"), trash, trash.select("id"), NOW_MS, "en")
    return back.select("id", "layer", "access_count", "decay_rate")


@register("export_rows", "SELECT id, content, created_at FROM memories", MEM)
def _(s, d):
    return T.export_rows(mem(s, d)).select("id", "content", "created_at")


@register("import_conflicts", "SELECT ns AS namespace, count(*) AS n, count(*) FILTER (layer >= 2) AS new_ids FROM (SELECT *, CASE WHEN kind = 'procedural' THEN 'other' ELSE namespace END AS ns FROM memories) WHERE NOT (layer >= 2 AND ns = namespace) GROUP BY 1", MEM)
def _(s, d):
    # Working and Core are there; everything comes in, procedural rows to another namespace.
    m = mem(s, d)
    incoming = m.withColumn("old", F.col("id")).withColumn("namespace", F.when(F.col("kind") == "procedural", "other").otherwise(F.col("namespace")))
    return T.import_rows(m.where("layer >= 2"), incoming).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") != F.col("old")).alias("new_ids"))


# Usage and conversations


@register("usage_daily", f"SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, component, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, 0::BIGINT AS cached_tokens, CAST(floor(avg(duration_ms)) AS BIGINT) AS avg_duration_ms FROM usage WHERE ts >= {BASE_MS + 20 * S.DAY_MS} GROUP BY 1, 2, 3", USAGE)
def _(s, d):
    return usage.daily(A.usage(s, d), BASE_MS + 30 * S.DAY_MS, 10)


@register(
    "usage_summary",
    "SELECT * FROM (SELECT 'total' AS scope, '' AS name, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage UNION ALL SELECT 'today', '', count(*), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT) FROM usage WHERE strftime(make_timestamp(ts * 1000), '%Y-%m-%d') = '2024-01-15' UNION ALL SELECT 'component', component, count(*), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT) FROM usage GROUP BY component UNION ALL SELECT 'model', model, count(*), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT) FROM usage GROUP BY model)",
    USAGE,
)
def _(s, d):
    return usage.summary(A.usage(s, d), "2024-01-15")


@register("turns_concat", "SELECT session_key, string_agg(content, chr(10) || '---' || chr(10) ORDER BY id) AS content, count(*) AS turns FROM turns GROUP BY 1", TURNS)
def _(s, d):
    return usage.drain_sessions(A.turns(s, d))


@register("session_size", f"SELECT session_key, count(*) AS turns, CAST(sum(length(content)) AS BIGINT) AS chars, max(created_at) AS last_at, max(created_at) <= {NOW_MS - 30_000} AS quiet FROM turns GROUP BY 1", TURNS)
def _(s, d):
    return usage.session_sizes(A.turns(s, d), NOW_MS)


@register("sessions_peek", "SELECT session_key, turns, CAST(strlen(content) AS INTEGER) AS chars, substr(content, 1, 200) AS preview FROM (SELECT session_key, string_agg(content, chr(10) || '---' || chr(10) ORDER BY id) AS content, count(*) AS turns FROM turns GROUP BY 1)", TURNS)
def _(s, d):
    return usage.peek(A.turns(s, d))


# Clusters, topics and streams, without SQL


@register("star_clusters")
def _(s, d):
    return cluster.star_clusters(mem(s, d, True), 0.35)


@register("linkage_clusters")
def _(s, d):
    return cluster.clusters(mem(s, d, True), 0.45)


@register("buffer_dedupe")
def _(s, d):
    return dedup.dedup_buffer(mem(s, d, True), 0.35)


@register("topic_tree_nodes")
def _(s, d):
    return topics.topic_tree(topics.entries(mem(s, d, True)))[0].drop("centroid")


@register("topic_members")
def _(s, d):
    return topics.topic_tree(topics.entries(mem(s, d, True)))[1]


@register("topic_names")
def _(s, d):
    m = mem(s, d, True)
    nodes, members = topics.topic_tree(topics.entries(m))
    names = topics.leaf_names(members, m)
    return names.unionByName(topics.inner_names(nodes, names))


@register("session_flush_stream")
def _(s, d):
    return streamed(s, d, "flush")


@register("usage_minute_stream")
def _(s, d):
    return streamed(s, d, "usage")


@register("proxy_watermark_stream")
def _(s, d):
    return streamed(s, d, "watermark")


def streamed(s: SparkSession, d: str, what: str) -> DataFrame:
    """Run a streaming query over the folder's rows to its end; the result as a table in the shared checkpoint folder."""
    import uuid

    from recollect.operators.cluster import cut
    from recollect.streaming import capture

    cut(s.range(1))
    folder = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"
    if what == "usage":
        rows, ddl = A.usage(s, d), S.USAGE_DDL
    elif what == "flush":
        rows, ddl = A.turns(s, d), S.TURN_DDL
    else:
        c = A.table(s, d, "conversations")
        said = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
        each = said.select(F.col("conv_id").cast("string").alias("session_key"), F.explode(F.sequence(F.lit(1), F.size("m"))).alias("n"), "m")
        rows = each.select("session_key", F.col("n").cast("long").alias("seq"), F.transform(F.slice("m", 1, F.col("n")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
        ddl = capture.REQUEST
    rows.write.parquet(f"{folder}/in")
    stream = s.readStream.schema(ddl).parquet(f"{folder}/in")
    out = {"usage": capture.usage_by_minute, "flush": capture.session_flush, "watermark": capture.new_turns}[what](stream)
    capture.start(out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/n={n}"), f"{folder}/check").awaitTermination()
    spec = {"usage": "start timestamp, component string, calls long, input_tokens long", "flush": "session_key string, start timestamp, end timestamp, content string, turns long", "watermark": "session_key string, seq long, text string"}[what]
    return s.read.schema(spec).parquet(f"{folder}/out/*") if not rows.isEmpty() else s.createDataFrame([], spec)
