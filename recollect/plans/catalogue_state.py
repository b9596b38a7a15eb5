"""More registered queries and their SQL: state changes, parsers, recall variants, resume, streams."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import noise
from recollect.functions import scalars as X
from recollect.operators import cluster, dedup, lifecycle, meta, mutations, scans, text, usage, vector
from recollect.operators import facts as G
from recollect.operators.lineage import shared_folder
from recollect.plans import ingest, resume
from recollect.plans import recall as R
from recollect.plans.catalogue import CORE_OK, COS, FACTS, GONE, MEM, META, META_SQL, NOW_MS, ORACLE, ORDER_FACTS, QUERIES, QUERY_VECTOR, RECENCY, TOKENISED, TOKENS, TURNS, USAGE, WEIGHT, empty, mem, query_vector, r6, register, thrown
from recollect.plans.catalogue import _count_sql as count_sql
from recollect.sources import adapters as A
from recollect.sources import tables as T
from recollect.sources.adapters import BASE_MS, EPOCH
from recollect.streaming import capture

LESSON = "list_contains(tags, 'lesson')"
BAD = "(content IS NULL OR trim(content) = '' OR length(trim(content)) > 8192)"


def lessons(m: DataFrame) -> DataFrame:
    return m.where(F.array_contains("tags", "lesson")).select("id")


# Lookups and lists


@register("get_by_id", f"SELECT {META_SQL} FROM memories WHERE id = '42'", MEM)
def _(s, d):
    return scans.get(mem(s, d), "42").select(*META)


@register("resolve_prefix", f"SELECT sha256(id) AS id FROM memories WHERE starts_with(sha256(id), '{hashlib.sha256(b'42').hexdigest()[:12]}')", MEM)
def _(s, d):
    m = mem(s, d).withColumn("id", F.sha2(F.col("id").cast("binary"), 256))
    return s.range(1).select(F.lit(scans.resolve_prefix(m, hashlib.sha256(b"42").hexdigest()[:12])).alias("id"))


@register("vectors_by_ids", f"SELECT id, len(embedding) AS dims, round(sqrt(list_dot_product(embedding, embedding)), 4) AS length FROM memories WHERE {LESSON} AND embedding IS NOT NULL", MEM)
def _(s, d):
    m = mem(s, d, True)
    return scans.vectors_of(m, lessons(m)).select("id", F.size("embedding").alias("dims"), F.round(X.norm(F.col("embedding")), 4).alias("length"))


@register("trash_list", f"SELECT id, layer FROM memories WHERE {GONE} AND namespace = 'en' ORDER BY id LIMIT 50 OFFSET 3", MEM)
def _(s, d):
    return scans.trash_list(thrown(s, d)[1], 50, 3, "en").select("id", "layer")


@register("trash_purge", f"SELECT namespace, count(*) AS n FROM memories WHERE {GONE} AND namespace <> 'en' GROUP BY 1 UNION ALL SELECT 'counted en', count(*) FROM memories WHERE {GONE} AND namespace = 'en'", MEM)
def _(s, d):
    trash = thrown(s, d)[1]
    left = mutations.purge(trash, "en").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    return left.unionByName(mutations.trash_count(trash, "en").select(F.lit("counted en").alias("namespace"), "n"))


@register("facts_page", "SELECT id, subject, object FROM facts ORDER BY created_at DESC, id LIMIT 100 OFFSET 10", FACTS)
def _(s, d):
    return scans.active_facts(A.facts(s, d), S.DEFAULT_NAMESPACE, 100, 10).select("id", "subject", "object")


@register("workspace_rows", "SELECT id FROM memories WHERE len(tags) = 0 OR len(list_filter(tags, lambda t: lower(t) = 'lesson' OR starts_with(lower(t), 'lesson:') OR lower(t) = 'trigger' OR starts_with(lower(t), 'trigger:'))) > 0", MEM)
def _(s, d):
    return mem(s, d).where(resume.workspace_match(["Lesson", " trigger "])).select("id")


@register("health_report", "SELECT (SELECT count(*) FROM memories) AS memories, count(*) FILTER (layer = 1) AS buffer, count(*) FILTER (layer = 2) AS working, count(*) FILTER (layer = 3) AS core, count(*) FILTER (kind = 'semantic') AS semantic, count(*) FILTER (kind = 'episodic') AS episodic, count(*) FILTER (kind = 'procedural') AS procedural, count(embedding) AS vectors, count(DISTINCT namespace) AS namespaces, (SELECT count(*) FROM facts) AS active_facts, 0::BIGINT AS superseded_facts FROM memories", MEM, FACTS)
def _(s, d):
    return ingest.report(mem(s, d, True), A.facts(s, d))


@register("result_projection", f"SELECT substr(id, 1, 8) AS id, content, round({WEIGHT}, 6) AS score, CASE layer WHEN 1 THEN 'buffer' WHEN 2 THEN 'working' ELSE 'core' END AS layer, array_to_string(tags, '|') AS tags, kind FROM memories", MEM)
def _(s, d):
    return R.projection(mem(s, d).withColumn("score", r6(X.weight(), "score"))).withColumn("tags", F.array_join("tags", "|"))


# State changes


@register("insert_batch_rows", f"SELECT id, 1 AS layer, CAST(CASE WHEN kind = 'procedural' THEN 0.75 ELSE 0.5 END AS DOUBLE) AS importance, CASE WHEN content IS NULL OR trim(content) = '' THEN 'empty content' WHEN length(trim(content)) > 8192 THEN 'content too long' END AS error FROM memories", MEM)
def _(s, d):
    inputs = mem(s, d).select("id", "content", "kind", "namespace")
    new, rejected = mutations.insert_batch(empty(s, S.MEMORY_DDL), inputs, NOW_MS, EPOCH)
    columns = ["id", "layer", "importance"]
    return new.select(*columns, F.lit(None).cast("string").alias("error")).unionByName(rejected.select(*columns, "error"))


WORDS = r"ws AS (SELECT id, namespace, layer, embedding, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')) AS w FROM memories), ex AS (SELECT id, namespace, layer, len(w) AS n, unnest(w) AS t FROM ws WHERE len(w) >= 3)"


@register(
    "insert_duplicates",
    f"SELECT new_id, old_id, round(j, 6) AS jaccard FROM (SELECT c.*, CASE WHEN x.embedding IS NOT NULL AND y.embedding IS NOT NULL THEN list_dot_product(x.embedding, y.embedding) / (sqrt(list_dot_product(x.embedding, x.embedding)) * sqrt(list_dot_product(y.embedding, y.embedding))) END AS cos FROM (SELECT a.id AS new_id, b.id AS old_id, count(*) / (a.n + b.n - count(*)) AS j FROM ex a JOIN ex b ON a.namespace = b.namespace AND a.t = b.t WHERE a.layer = 1 AND b.layer > 1 GROUP BY a.id, b.id, a.n, b.n) c JOIN memories x ON x.id = new_id JOIN memories y ON y.id = old_id) WHERE j > 0.5 AND CASE WHEN cos IS NULL THEN j > 0.8 ELSE cos > 0.2 END",
    MEM,
    WORDS,
)
def _(s, d):
    # The vectors of the test tables have little to do with the texts, so the second tier takes a low cosine.
    m = mem(s, d, True)
    found = mutations.duplicates_of(m.where("layer > 1"), m.where("layer = 1"), 0.8, S.Thresholds(dedup_cosine=0.2))
    return found.select("new_id", "old_id", r6(F.col("jaccard"), "jaccard"))


@register("update_fields", f"SELECT id, CASE WHEN {LESSON} AND NOT {BAD} THEN 3 ELSE layer END AS layer, round(CASE WHEN {LESSON} AND NOT {BAD} THEN 1.0 ELSE importance END, 6) AS importance, CASE WHEN {LESSON} AND NOT {BAD} THEN {EPOCH} ELSE modified_epoch END AS modified_epoch FROM memories", MEM)
def _(s, d):
    m = mem(s, d)
    changes = lessons(m).select("id", F.lit(2.0).alias("importance"), F.lit(3).alias("layer"), F.lit(None).cast("string").alias("content"))
    return mutations.update_fields(m, changes, NOW_MS, EPOCH)[0].select("id", "layer", r6(F.col("importance"), "importance"), "modified_epoch")


@register("checked_update", f"SELECT id, round(CASE WHEN {LESSON} AND layer = 2 AND NOT {BAD} THEN 0.9 ELSE importance END, 6) AS importance FROM memories", MEM)
def _(s, d):
    m = mem(s, d)
    changes = m.where("layer = 2").select("id", F.lit(0.9).alias("importance"))
    return mutations.checked_update(m, changes, NOW_MS, EPOCH, "lesson")[0].select("id", r6(F.col("importance"), "importance"))


@register("set_fields", f"SELECT id, CASE WHEN {LESSON} THEN 'procedural' ELSE kind END AS kind, CASE WHEN {LESSON} THEN 0.5 ELSE decay_rate END AS decay_rate, CASE WHEN {LESSON} THEN 7 ELSE access_count END AS access_count, CASE WHEN {LESSON} THEN 'moved' ELSE namespace END AS namespace FROM memories", MEM)
def _(s, d):
    m = mem(s, d)
    ids = lessons(m)
    for column, value in (("kind", "procedural"), ("decay_rate", 0.5), ("access_count", 7), ("namespace", "moved")):
        m = mutations.set_column(m, ids, column, value)
    return m.select("id", "kind", "decay_rate", "access_count", "namespace")


@register("reinforce_rows", f"SELECT id, repetition_count + CAST({LESSON} AS INTEGER) AS repetition_count, round(CASE WHEN {LESSON} THEN least(1.0, importance + 0.05) ELSE importance END, 6) AS importance FROM memories", MEM)
def _(s, d):
    m = mem(s, d)
    return mutations.reinforce(m, lessons(m), NOW_MS).select("id", "repetition_count", r6(F.col("importance"), "importance"))


@register("demote_rows", "SELECT id, CASE WHEN x THEN 2 ELSE layer END AS layer, CAST(CASE WHEN x THEN CASE kind WHEN 'episodic' THEN 1.0 WHEN 'procedural' THEN 0.1 ELSE 0.3 END ELSE decay_rate END AS DOUBLE) AS decay_rate, last_accessed FROM (SELECT *, layer = 3 AND (source = 'session' OR len(list_intersect(tags, ['session', 'ephemeral'])) > 0) AS x FROM memories)", MEM)
def _(s, d):
    m = mem(s, d)
    ids = m.where((F.col("layer") == S.CORE) & lifecycle.should_demote()).select("id")
    return mutations.demote(m, ids, S.WORKING, NOW_MS, EPOCH).select("id", "layer", "decay_rate", "last_accessed")


@register("delete_namespace", "SELECT 'memory' AS what, id FROM memories WHERE namespace <> 'fr' UNION ALL SELECT 'fact', id FROM facts", MEM, FACTS)
def _(s, d):
    m, f = mutations.delete_namespace(mem(s, d), A.facts(s, d), "fr")
    return m.select(F.lit("memory").alias("what"), "id").unionByName(f.select(F.lit("fact").alias("what"), "id"))


@register("set_embedding", f"SELECT id, CASE WHEN {LESSON} THEN 2 ELSE coalesce(len(embedding), -1) END AS dims FROM memories", MEM)
def _(s, d):
    m = mem(s, d, True)
    done = mutations.set_embedding(m, lessons(m).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")))
    return done.select("id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims")).withColumn("dims", F.when(F.col("dims") < 0, -1).otherwise(F.col("dims")))


RUNS = (ORDER_FACTS, "ch AS (SELECT *, CAST(coalesce(object <> lag(object) OVER (PARTITION BY subject ORDER BY created_at, id), false) AS INTEGER) AS c FROM ofacts)", "runs AS (SELECT *, sum(c) OVER (PARTITION BY subject ORDER BY created_at, id) AS run FROM ch)")


@register("insert_facts", "SELECT id, valid_until FROM (SELECT id, CAST(NULL AS BIGINT) AS valid_until FROM facts UNION ALL SELECT id, (SELECT min(created_at) FROM runs n WHERE n.subject = r.subject AND n.run = r.run + 1) FROM runs r)", FACTS, *RUNS)
def _(s, d):
    return G.insert(A.facts(s, d), A.order_facts(s, d)).select("id", "valid_until")


@register("delete_facts", f"SELECT id FROM facts WHERE predicate <> 'in_region' AND memory_id NOT IN (SELECT id FROM memories WHERE {LESSON})", MEM, FACTS)
def _(s, d):
    f = A.facts(s, d)
    return G.delete_by_memory(G.delete(f, f.where("predicate = 'in_region'")), lessons(mem(s, d))).select("id")


@register("fact_chains", "SELECT f.subject AS entity, 2 AS depth, g.object AS last FROM (SELECT DISTINCT subject FROM facts WHERE lower(subject) LIKE '%nation_7%' OR lower(object) LIKE '%nation_7%') e JOIN facts f ON lower(f.subject) = lower(e.subject) JOIN facts g ON lower(g.subject) = lower(f.object)", FACTS)
def _(s, d):
    return R.fact_chains(A.facts(s, d), R.Request("NATION_7")).select("entity", "depth", F.element_at("path", -1)["object"].alias("last"))


@register("settings", "SELECT 'ns:' || namespace || ':' || kind AS key, CASE WHEN kind = 'episodic' THEN 'changed' ELSE CAST(count(*) AS VARCHAR) END AS value FROM memories WHERE namespace = 'en' AND kind <> 'procedural' GROUP BY namespace, kind", MEM)
def _(s, d):
    rows = mem(s, d).groupBy("namespace", "kind").agg(F.count(F.lit(1)).cast("string").alias("value"))
    table = rows.select(F.concat_ws(":", F.lit("ns"), "namespace", "kind").alias("key"), "value")
    table = meta.put(table, table.where(F.col("key").endswith(":episodic")).select("key", F.lit("changed").alias("value")))
    return meta.with_prefix(meta.clear_prefix(table, "ns:en:procedural"), "ns:en:")


@register("table_versions", "SELECT id, layer, 3 AS version FROM memories WHERE layer > 1", MEM)
def _(s, d):
    table = T.VersionedTable(s, f"{shared_folder(s)}/memories-{uuid.uuid4().hex}", S.MEMORY_DDL)
    table.write(mem(s, d))
    table.write(table.read().where("layer > 1"))
    version = table.compact()
    return table.read().select("id", "layer", F.lit(version).alias("version"))


# Dedupe, clusters, text


@register("roll_up_by_source", "SELECT source, arg_max(id, (created_at, id)) AS id, CAST(sum(access_count) AS BIGINT) AS access_count, round(max(importance), 6) AS importance, max(layer) AS layer, count(*) AS members FROM memories GROUP BY 1", MEM)
def _(s, d):
    return dedup.roll_up(mem(s, d), "source").select("source", "id", "access_count", r6(F.col("importance"), "importance"), "layer", "members")


PACK = "o AS (SELECT id, length(content) AS size, row_number() OVER (ORDER BY id) AS k FROM memories)"
ORACLE["packed_batches"] = f"WITH RECURSIVE {MEM}, {PACK}, r AS (SELECT k, id, 0 AS batch, size AS used FROM o WHERE k = 1 UNION ALL SELECT o.k, o.id, CASE WHEN used > 0 AND used + size > 20000 THEN batch + 1 ELSE batch END, CASE WHEN used > 0 AND used + size > 20000 THEN size ELSE used + size END FROM r JOIN o ON o.k = r.k + 1) SELECT id, batch FROM r"


@register("packed_batches")
def _(s, d):
    return cluster.packed(mem(s, d).select("id", F.length("content").alias("size")), "size", 20_000)


@register("index_repair", "SELECT id, count(DISTINCT t) AS terms, CAST(max(len(w)) AS BIGINT) AS dl FROM (SELECT id, w, unnest(w) AS t FROM tok) GROUP BY 1", MEM, TOKENISED)
def _(s, d):
    m = mem(s, d)
    orphans = m.where("layer = 1").withColumn("id", F.concat(F.lit("gone-"), "id"))
    index = text.repair_index(text.postings(m.where("layer > 1").unionByName(orphans)), m)
    return index.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.max("dl").cast("long").alias("dl"))


# Every third memory has a run of CJK text; its tokens are the run and its bigrams.
CJK_SQL = "cjk AS (SELECT * REPLACE (content || CASE WHEN layer = 1 THEN ' 部署服务' WHEN layer = 2 THEN ' 服务器v2' ELSE '' END AS content) FROM memories), tok AS (SELECT *, list_concat(regexp_extract_all(strip_accents(lower(replace(content, '器v', '器 v') || ' ' || array_to_string(tags, ' '))), '[\\p{L}\\p{N}]+'), CASE WHEN layer = 1 THEN ['部署', '服务', '署服'] WHEN layer = 2 THEN ['服务', '务器'] ELSE [] END) AS w FROM cjk)"
CJK_BM = "tf AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = '部署')) AS tf0, len(list_filter(w, lambda x: x = '署服')) AS tf1, len(list_filter(w, lambda x: x = '务器')) AS tf2 FROM tok), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1, count(*) FILTER (tf2 > 0) AS df2 FROM tf)"


@register("cjk_search", "SELECT id, round(bm25, 6) AS bm25 FROM (SELECT id, " + " + ".join(f"CASE WHEN tf{i} = 0 OR df{i} / n > 0.8 THEN 0 ELSE greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) END" for i in range(3)) + " AS bm25 FROM tf, st) q WHERE bm25 > 0 ORDER BY q.bm25 DESC, id LIMIT 60", MEM, CJK_SQL, CJK_BM)
def _(s, d):
    tail = F.when(F.col("layer") == 1, " 部署服务").when(F.col("layer") == 2, " 服务器v2").otherwise("")
    m = mem(s, d).withColumn("content", F.concat("content", tail))
    return text.search(m, "部署服 务器", 60).select("id", r6(F.col("bm25"), "bm25"))


@register("mean_vectors", "SELECT namespace, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY namespace)), 5) AS x FROM (SELECT namespace, i - 1 AS i, avg(embedding[i]) AS x FROM (SELECT namespace, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM memories WHERE embedding IS NOT NULL) GROUP BY 1, 2)", MEM)
def _(s, d):
    return vector.mean_vector(mem(s, d, True), "namespace").select("namespace", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 5))


@register("nearest_duplicate", f"SELECT id, round({COS}, 6) AS similarity FROM memories, {QUERY_VECTOR} WHERE embedding IS NOT NULL AND {COS} > 0.5 ORDER BY {COS} DESC, id LIMIT 1", MEM)
def _(s, d):
    return vector.duplicate_of(mem(s, d, True), query_vector(s, d), 0.5).select("id", r6(F.col("similarity"), "similarity"))


ENTRIES = "en AS (SELECT 'c' || conv_id || '-' || turn AS id, text AS content FROM conversations)"
CODE = f"(({count_sql(noise.STRONG)}) >= 1 OR ({count_sql(noise.WEAK)}) >= 2) AND ({count_sql(noise.VALUE)}) = 0"
KEPT = r"fine AS (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> ''))) AS w FROM en WHERE trim(content) <> '' AND length(content) <= 200 AND NOT (" + CODE + ")), cl AS (SELECT w, min(id) AS rep, list(id) AS ids FROM fine WHERE len(w) >= 3 GROUP BY w), ex AS (SELECT rep, len(w) AS n, unnest(w) AS t FROM cl), again AS (SELECT y.rep AS id FROM ex x JOIN ex y ON x.t = y.t AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) > 0.5 UNION SELECT i FROM (SELECT rep, unnest(ids) AS i FROM cl) WHERE i <> rep)"


@register("capture_filter", "SELECT id FROM fine WHERE id NOT IN (SELECT id FROM again)", ENTRIES, KEPT)
def _(s, d):
    c = A.table(s, d, "conversations")
    entries = c.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("content"), F.lit(0.5).alias("importance"))
    return capture.worth_keeping(entries).select("id")


@register("capture_known", f"SELECT x.id FROM memories x WHERE layer = 1 AND NOT EXISTS (SELECT 1 FROM memories y WHERE y.layer > 1 AND y.embedding IS NOT NULL AND x.embedding IS NOT NULL AND list_dot_product(x.embedding, y.embedding) / (sqrt(list_dot_product(x.embedding, x.embedding)) * sqrt(list_dot_product(y.embedding, y.embedding))) > 0.4)", MEM)
def _(s, d):
    m = mem(s, d, True)
    return capture.not_known(m.where("layer = 1"), m.where("layer > 1"), 0.4).select("id")


# Lifecycle


@register("gate_levels", f"SELECT 'auto' AS level, id, CASE WHEN access_count >= 5 AND (repetition_count >= 2 OR len(list_intersect(tags, ['lesson', 'procedural'])) > 0) AND importance >= 0.6 THEN 'promote' ELSE 'ask' END AS decision FROM memories WHERE {CORE_OK} UNION ALL SELECT 'full', id, 'ask' FROM memories WHERE {CORE_OK}", MEM)
def _(s, d):
    c = lifecycle.core_candidates(mem(s, d), NOW_MS)
    auto, full = (c.select(F.lit(level).alias("level"), "id", lifecycle.gate_decision(level).alias("decision")) for level in ("auto", "full"))
    return auto.unionByName(full)


@register("triage_batches", f"SELECT id, namespace FROM (SELECT id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY created_at, id) AS r FROM memories WHERE layer = 1 AND len(list_intersect(tags, ['distilled', 'ephemeral', '_triaged'])) = 0 AND {NOW_MS} - created_at > 600000) WHERE r <= 20", MEM)
def _(s, d):
    return lifecycle.triage_batches(mem(s, d), NOW_MS).select("id", "namespace")


@register("session_notes", "SELECT id, namespace FROM (SELECT id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id) AS r, count(*) OVER (PARTITION BY namespace) AS n FROM memories WHERE source = 'session' OR list_contains(tags, 'session')) WHERE n >= 3 AND r <= 10", MEM)
def _(s, d):
    return lifecycle.session_notes(mem(s, d)).select("id", "namespace")


@register("reject_tags", f"SELECT id, array_to_string(list_concat(list_filter(tags, lambda t: NOT starts_with(t, 'gate-rejected') AND NOT starts_with(t, '_gate_epoch:')), [CASE WHEN list_contains(tags, 'gate-rejected') THEN 'gate-rejected-2' ELSE 'gate-rejected' END, '_gate_epoch:{EPOCH}']), '|') AS tags FROM memories", MEM)
def _(s, d):
    return mem(s, d).select("id", F.array_join(lifecycle.reject_tags(EPOCH), "|").alias("tags"))


# Usage, sessions, parsers


@register("usage_clear", f"SELECT id FROM usage WHERE ts >= {BASE_MS + 15 * S.DAY_MS}", USAGE)
def _(s, d):
    log = A.usage(s, d)
    return usage.clear(usage.log_call(usage.clear(log), log), BASE_MS + 15 * S.DAY_MS).select("id")


READY = "rd AS (SELECT session_key FROM turns GROUP BY 1 HAVING (count(*) >= 4 OR sum(length(content)) >= 400) AND max(created_at) <= %d)" % (NOW_MS - 30_000)


@register("sessions_drain", "SELECT 'drained' AS what, session_key, count(*) AS turns FROM turns WHERE session_key IN (SELECT session_key FROM rd) GROUP BY 2 UNION ALL SELECT 'left', session_key, count(*) FROM turns WHERE session_key NOT IN (SELECT session_key FROM rd) GROUP BY 2", TURNS, READY)
def _(s, d):
    turns = A.turns(s, d)
    stored = usage.save_turns(turns.where("false"), turns)
    gone, left = usage.drain(stored, usage.should_flush(stored, NOW_MS, 4, 400))
    left = left.groupBy("session_key").agg(F.count(F.lit(1)).alias("turns"))
    return gone.select(F.lit("drained").alias("what"), "session_key", "turns").unionByName(left.select(F.lit("left").alias("what"), "session_key", "turns"))


@register("embed_cache", "SELECT least(128, count(*)) AS size, least(128, count(*)) AS hits, (SELECT count(*) FROM memories) - least(128, count(*)) AS misses FROM memories", MEM)
def _(s, d):
    m = mem(s, d).select(F.col("id").alias("key"), "created_at")
    return usage.cache_counters(usage.cache_put(m.where("false"), m), m).select("size", "hits", "misses")


@register("message_texts", "SELECT conv_id, turn, text AS user_text, text || ' ' || role AS blocks, substr(text, 1, 6000) AS answer FROM conversations")
def _(s, d):
    c = A.table(s, d, "conversations")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("c"))), r"(?s)^\{\"c\":(.*)\}$", 1)
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    blocks = F.to_json(F.array(block(F.col("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), block(F.col("role"))))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    return c.select("conv_id", "turn", T.user_text(quoted).alias("user_text"), T.user_text(blocks).alias("blocks"), T.assistant_text(body).alias("answer"))


@register("scalar_labels", "SELECT id, CAST(CASE kind WHEN 'semantic' THEN 0.9 WHEN 'episodic' THEN 0.3 ELSE 0.5 END AS DOUBLE) AS importance, '[' || n || ']' AS inner_json, array_to_string(list_slice(list_concat(tags, list_filter(['lesson', 'new tag'], lambda t: NOT list_contains(tags, t))), 1, 20), '|') AS tags FROM memories", MEM)
def _(s, d):
    label = F.when(F.col("kind") == "semantic", "Critical").when(F.col("kind") == "episodic", "LOW").otherwise("?")
    raw = F.concat(F.lit("```json\n["), "id", F.lit("]\n```"))
    more = X.sanitize_tags(F.array(F.lit(" lesson"), F.lit(""), F.lit("new tag "), F.lit("lesson")))
    return mem(s, d).select("id", X.importance_from_label(label).alias("importance"), X.unwrap_json(raw).alias("inner_json"), F.array_join(X.merge_tags(F.col("tags"), more), "|").alias("tags"))


# Resume

RESUME = f"core AS (SELECT id, rank, chars FROM (SELECT id, length(content) + 2 AS chars, row_number() OVER (ORDER BY w DESC, id) AS rank, sum(length(content) + 2) OVER (ORDER BY w DESC, id) AS upto FROM (SELECT *, {WEIGHT} AS w FROM (SELECT * FROM memories WHERE layer = 3 ORDER BY importance DESC, id LIMIT 100))) WHERE upto <= 8000 OR rank = 1), left_over AS (SELECT greatest(1, least(4000, 16000 - coalesce(sum(chars), 0))) AS b FROM core)"
RECENT = f"recent AS (SELECT id, row_number() OVER (ORDER BY modified_at DESC, id) AS rank, sum(length(content) + 2) OVER (ORDER BY modified_at DESC, id) AS upto FROM (SELECT * FROM memories WHERE modified_epoch >= {EPOCH - 24} ORDER BY modified_at DESC, id LIMIT 200) WHERE layer <> 3)"


@register("resume_sections", "SELECT 'core' AS section, CAST(rank AS INTEGER) AS rank, id AS item FROM core UNION ALL SELECT 'recent', CAST(rank AS INTEGER), id FROM recent, left_over WHERE upto <= b OR rank = 1 UNION ALL SELECT 'triggers', CAST(row_number() OVER (ORDER BY uses DESC, action) AS INTEGER), action FROM (SELECT t[9:] AS action, sum(greatest(access_count, 1)) AS uses FROM (SELECT unnest(tags) AS t, access_count FROM memories) WHERE starts_with(t, 'trigger:') GROUP BY 1)", MEM, RESUME, RECENT)
def _(s, d):
    from pyspark.sql import Window

    parts = resume.resume(mem(s, d), EPOCH)
    named = lambda k: parts[k].select(F.lit(k).alias("section"), "rank", F.col("id").alias("item"))
    place = F.row_number().over(Window.orderBy(F.desc("uses"), "action"))  # a row for each action
    return named("core").unionByName(named("recent")).unionByName(parts["triggers"].select(F.lit("triggers").alias("section"), place.alias("rank"), F.col("action").alias("item")))


@register("page_breakdown", f"SELECT layer, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT layer, {TOKENS} AS tokens, row_number() OVER (ORDER BY importance DESC, id) AS rank, sum({TOKENS}) OVER (ORDER BY importance DESC, id) AS upto FROM memories) WHERE rank <= 100 AND (upto <= 20000 OR rank = 1) GROUP BY 1", MEM)
def _(s, d):
    return R.breakdown(R.budget_prefix(mem(s, d), [F.desc("importance"), F.asc("id")], 20_000, 100))


# Recall with its branches


def recall_sql(r: R.Request, linked: str = "SELECT NULL AS id WHERE false") -> str:
    """The whole ranking of a request in SQL; ``linked``: ids of memories that the facts name."""
    queries = [r.query, *r.extra_queries]
    terms = list(dict.fromkeys(w for q in queries for w in text.query_terms(q)))
    at = {t: i for i, t in enumerate(terms)}
    noise_of = lambda t: f"(n >= 5 AND df{at[t]} / n > 0.8)"

    def bm(q: str) -> str:
        gain = lambda t: f"CASE WHEN tf{at[t]} = 0 OR {noise_of(t)} THEN 0 ELSE greatest(1e-6, ln((n - df{at[t]} + 0.5) / (df{at[t]} + 0.5))) * tf{at[t]} * 2.2 / (tf{at[t]} + 1.2 * (0.25 + 0.75 * dl / avgdl)) END"
        return " + ".join(map(gain, text.query_terms(q)))

    inside = "true" if r.namespace is None else f"namespace = '{r.namespace}'"
    let_in = "true" if r.namespace is None else f"namespace IN ('{r.namespace}', 'default')"
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    top = lambda q, k: f"(SELECT id, s / greatest(0.001, max(s) OVER ()) AS f FROM (SELECT id, {bm(q)} AS s FROM tf, st WHERE {inside}) WHERE s > 0 ORDER BY s DESC, id LIMIT {k})"
    extra = " UNION ALL ".join(f"SELECT {k} AS k, id, f * 0.85 AS x FROM {top(q, r.page).replace('max(s) OVER ()', 'max(s) OVER ()')}" for k, q in enumerate(r.extra_queries)) or "SELECT 0 AS k, NULL AS id, NULL::DOUBLE AS x WHERE false"
    sem = f"SELECT id, sim FROM (SELECT id, namespace, {COS} AS sim FROM memories, q WHERE embedding IS NOT NULL) WHERE sim > 0 AND CASE WHEN (SELECT count(*) FROM cand) >= {2 * (r.offset + r.page)} THEN id IN (SELECT id FROM cand) ELSE {inside} END ORDER BY sim DESC, id LIMIT {3 * r.fetch}" if r.vector else "SELECT NULL AS id, NULL::DOUBLE AS sim WHERE false"
    first = list(dict.fromkeys(text.query_terms(r.query)))
    idfs = ", ".join(f"CASE WHEN df{at[t]} > 0 AND NOT {noise_of(t)} THEN ln(n / df{at[t]}) ELSE 0 END AS i{k}" for k, t in enumerate(first))
    known = " + ".join(f"CAST(NOT {noise_of(t)} AS INTEGER)" for t in first)
    total = "(" + " + ".join(f"i{k}" for k in range(len(first))) + ")"
    got = "(" + " + ".join(f"CASE WHEN contains(whole, '{t}') THEN i{k} ELSE 0 END" for k, t in enumerate(first)) + ")"
    said = " OR ".join(f"contains(lower(content), '{w}')" for w in dict.fromkeys(r.query.lower().split()))
    tags = [t.lower() for t in r.tags or []]
    tag_ok = " AND ".join(f"list_contains(list_transform(tags, lambda x: lower(x)), '{t}')" for t in tags) or "true"
    boost = f"* (1 + 0.2 * len(list_filter(tags, lambda x: list_contains({tags}, lower(x)))))" if tags else ""
    order = {"recent": "created_at", "accessed": "last_accessed"}.get(r.sort_by, "score") + " DESC, id"
    raw = f"relevance * (1 + 0.4 * {WEIGHT} + 0.2 * {RECENCY})"
    budget = f"upto <= {r.budget} OR rank = 1" if r.budget else "true"
    return f"""WITH {MEM}, {TOKENISED}, {FACTS}, q AS {QUERY_VECTOR},
tf AS (SELECT id, namespace, len(w) AS dl, {tf} FROM tok), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM tf),
fts AS {top(r.query, 3 * r.fetch)},
ext AS (SELECT id, arg_min(x, k) AS x FROM ({extra}) GROUP BY id),
linked AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id FROM ({linked})),
core AS (SELECT id FROM memories WHERE {inside} AND layer = 3 ORDER BY created_at DESC, id LIMIT 200),
cand AS (SELECT id FROM fts UNION SELECT id FROM ext UNION SELECT id FROM linked UNION SELECT id FROM core),
sem AS ({sem}),
ids AS (SELECT id FROM sem WHERE sim >= 0.3 UNION SELECT id FROM fts UNION SELECT id FROM ext UNION SELECT id FROM linked),
hits AS (SELECT i.id, s.sim, t.f, e.x, l.id IS NOT NULL AS link FROM ids i LEFT JOIN (SELECT * FROM sem WHERE sim >= 0.3) s ON s.id = i.id LEFT JOIN fts t ON t.id = i.id LEFT JOIN ext e ON e.id = i.id LEFT JOIN linked l ON l.id = i.id),
rel AS (SELECT *, CASE WHEN sim IS NOT NULL AND f IS NOT NULL THEN least(1, greatest(sim * (1 + f * 0.3 * least(1, sim / 0.45)), (0.35 + 0.25 * f) * least(1, sim / 0.45))) WHEN sim IS NOT NULL THEN sim WHEN f IS NOT NULL THEN 0.25 * f ELSE x END AS r0 FROM hits),
i AS (SELECT {idfs}, {known} AS nt FROM st),
fin AS (SELECT m.*, coalesce(r0 * CASE WHEN f IS NULL AND NOT ({said}) THEN 0.85 ELSE 1 END * CASE WHEN nt = 0 THEN 1 WHEN {total} <= 0 THEN 0.5 WHEN {got} / {total} > 0 THEN 1 + 0.5 * {got} / {total} ELSE 0.85 END {boost}, CASE WHEN link THEN 1.0 END) AS relevance
  FROM rel JOIN (SELECT *, lower(content || ' ' || array_to_string(tags, ' ')) AS whole FROM memories) m ON m.id = rel.id, i WHERE {let_in} AND {tag_ok}),
sc AS (SELECT *, {TOKENS} AS tokens, CASE WHEN {raw} <= 0 THEN 0 ELSE 2 / (1 + exp(-2 * {raw})) - 1 END AS score FROM fin),
pg AS (SELECT *, row_number() OVER (ORDER BY {order}) - {r.offset} AS rank FROM sc WHERE score >= {r.min_score}),
bud AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS upto FROM pg WHERE rank > 0 AND rank <= {r.page})
SELECT CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, round(relevance, 6) AS relevance FROM bud WHERE {budget}"""


LINKED = "SELECT memory_id AS id FROM facts WHERE lower(subject) LIKE '%nation_7%' OR lower(object) LIKE '%nation_7%' OR lower(subject) LIKE '%whation%' OR lower(object) LIKE '%whation%'"
RECALLS = {
    "recall_by_facts": (R.Request("nation_7 whation", [0.0], budget=0, limit=100), LINKED),
    "recall_expanded": (R.Request("whation", [0.0], ["thonre lesson", "src3 whation deploy"], namespace="en", budget=6000), None),
    "recall_sorted_recent": (R.Request("the thonre whation", [0.0], namespace="en", sort_by="recent", budget=0), None),
    "recall_sorted_accessed": (R.Request("the thonre whation", [0.0], namespace="en", sort_by="accessed", budget=9000), None),
    "recall_tagged": (R.Request("whation lesson", [0.0], tags=["Lesson"], budget=0, limit=50), None),
    "recall_unrestricted": (R.Request("zzznothing whation", [0.0], namespace="fr", limit=100, budget=0), None),
    "recall_without_vector": (R.Request("the thonre whation", None, namespace="en", budget=0, min_score=0.1), None),
}


def _recall(r: R.Request):
    from dataclasses import replace

    def run(s, d):
        asked = replace(r, vector=query_vector(s, d) if r.vector else None)
        return R.recall(mem(s, d, True), A.facts(s, d), asked, NOW_MS).select("rank", "id", r6(F.col("score"), "score"), r6(F.col("relevance"), "relevance"))

    return run


for _name, (_request, _linked) in RECALLS.items():
    register(_name, recall_sql(_request, *([_linked] if _linked else [])))(_recall(_request))


@register("recall_touched", ORACLE["recall_without_vector"].replace("SELECT CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, round(relevance, 6) AS relevance FROM bud", "SELECT id FROM bud").replace("WHERE true", "WHERE relevance > 0.1"))
def _(s, d):
    page = R.recall(mem(s, d, True), A.facts(s, d), RECALLS["recall_without_vector"][0], NOW_MS)
    return R.touched(page, 0.1)


# Streams

ORACLE["usage_minute_stream"] = f"WITH {USAGE} SELECT make_timestamp(m * 60000000) AS start, component, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM (SELECT *, ts // 60000 AS m FROM usage) GROUP BY m, component HAVING (m + 1) * 60000 <= (SELECT max(ts) FROM usage) - 600000"
ORACLE["session_flush_stream"] = f"WITH {TURNS} SELECT session_key, make_timestamp(min(created_at) * 1000) AS start, make_timestamp((max(created_at) + 30000) * 1000) AS end, string_agg(content, chr(10) || '---' || chr(10) ORDER BY id) AS content, count(*) AS turns FROM turns GROUP BY 1 HAVING max(created_at) + 30000 <= (SELECT max(created_at) FROM turns) - 60000"
ORACLE["proxy_watermark_stream"] = "SELECT CAST(conv_id AS VARCHAR) AS session_key, n AS seq, substr(text, 1, 6000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 1 AND role = 'user' AND text <> ''"
