"""Registered queries of indexes, windows and whole consolidation runs, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from recollect import schema as S
from recollect.operators import text_index, vector_index
from recollect.operators.lineage import shared_folder
from recollect.plans import extraction, maintenance
from recollect.plans import recall as R
from recollect.plans.catalogue import (
    BM25, BUFFER_OK, CORE_OK, COS, DECAYED, EPOCH, FACTS, GATE, JAC, MEM, NOW_MS, PAIRS, QUERY, QUERY_VECTOR, TOKENISED, TURNS, USAGE, WEIGHT, query_vector, r6,
)
from recollect.plans.catalogue_state import ORACLE, QUERIES, mem, recall_sql, register
from recollect.plans.consolidate import State, consolidate
from recollect.sources import adapters as A
from recollect.streaming import capture, windows

__all__ = ["ORACLE", "QUERIES"]


def number():
    return F.col("id").cast("long")


def changed_index(s, m):
    """An index of three quarters of the memories, to which the rest was added and from which a third was taken, which makes it rebuild."""
    index = vector_index.build(m.where(number() % 4 != 0))
    index = vector_index.insert(index, m.where(number() % 4 == 0))
    index = vector_index.remove(index, m.where(number() % 3 == 0))
    return vector_index.rebuild(index, s)


@register(
    "vector_index_search",
    f"SELECT id, round({COS}, 6) AS similarity FROM memories, {QUERY_VECTOR} WHERE n % 3 <> 0 AND embedding IS NOT NULL AND {COS} > 0 ORDER BY {COS} DESC, id LIMIT 25",
    MEM,
)
def _(s, d):
    """All lists are probed, so the changed index gives the exact answer."""
    index = changed_index(s, mem(s, d, True))
    return vector_index.search(index, s, query_vector(s, d), 25, len(index.centroids)).select("id", r6(F.col("similarity"), "similarity"))


@register(
    "vector_index_recall",
    """SELECT count(*) AS queries, CAST(10 * count(*) AS BIGINT) AS neighbours, true AS recall_is_over_90_percent FROM memories WHERE n % 100 = 0 AND embedding IS NOT NULL""",
    MEM,
)
def _(s, d):
    """Every row whose id is divisible by 100 asks so many lists as other rows need; its ten neighbours are counted against those of an exact search."""
    m = mem(s, d, True)
    index = changed_index(s, m)
    asked = m.where(number() % 100 == 0).select(F.col("id").alias("query_id"), "embedding")
    others = m.where(number() % 10 == 5).orderBy(F.xxhash64("id")).limit(500).select(F.col("id").alias("query_id"), "embedding")
    found = vector_index.search_all(index, asked, 10, vector_index.probes_for(index, others, 10, 0.98))
    exact = vector_index.search_all(index, asked, 10, len(index.centroids))
    return exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.sum("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_is_over_90_percent")
    )


# The full-text index


def changed_text_index(s, m):
    """An index of three quarters of the memories, to which the rest was added, from which a third was taken and a part of that put back."""
    index = text_index.build(m.where(number() % 4 != 0))
    index = text_index.insert(index, m.where(number() % 4 == 0))
    index = text_index.remove(index, m.where(number() % 3 == 0))
    return text_index.insert(index, m.where(number() % 9 == 0))


LEFT = MEM.replace("memories AS (", "every AS (", 1) + ", memories AS (SELECT * FROM every WHERE n % 3 <> 0 OR n % 9 = 0)"


@register("text_index_search", "SELECT id, round(bm25, 6) AS bm25 FROM bm WHERE bm25 > 0 ORDER BY bm.bm25 DESC, id LIMIT 50", LEFT, TOKENISED, *BM25)
def _(s, d):
    return text_index.search(changed_text_index(s, mem(s, d)), s, QUERY, 50).select("id", r6(F.col("bm25"), "bm25"))


@register(
    "text_index_df",
    "SELECT term, count(*) FILTER (list_contains(w, term)) AS df FROM tok, (SELECT unnest(['the', 'lesson', 'deploy', 'nosuchterm']) AS term) GROUP BY term",
    LEFT,
    TOKENISED,
)
def _(s, d):
    """After merging, which drops what is dead."""
    index = text_index.merge(changed_text_index(s, mem(s, d)), s)
    return text_index.document_frequency(index, s, ["the", "lesson", "deploy", "nosuchterm"])


@register("recall_indexed", ORACLE["recall_hybrid"])
def _(s, d):
    """Hybrid recall that reads the postings of its terms in place of all texts."""
    m = mem(s, d, True)
    r = R.Request(QUERY, query_vector(s, d), namespace="en", min_score=0.30, budget=4000)
    counts = text_index.term_counts(text_index.build(m), s, [r.query])
    return R.recall(m, A.facts(s, d), r, NOW_MS, counts=counts).select("rank", "id", r6(F.col("score"), "score"), r6(F.col("relevance"), "relevance"), "tokens")


UNKNOWN = R.Request("zzznothing", None, namespace="en", budget=0)
EXPANSIONS = ["thonre lesson", "whation deploy"]


@register("recall_auto_expanded", recall_sql(replace(UNKNOWN, extra_queries=EXPANSIONS)))
def _(s, d):
    """A query without any match is asked again with its expansions. It has no vector, so none are joined to the texts."""
    page = R.recall_expanding(mem(s, d), A.facts(s, d), UNKNOWN, NOW_MS, lambda query: EXPANSIONS)
    return page.select("rank", "id", r6(F.col("score"), "score"), r6(F.col("relevance"), "relevance"))


# Clusters

# Rows in the order of ids, each with those it is near; a row is a seed unless a seed before it is near.
_STARS = """nd AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k, near FROM (SELECT id, list(other) AS near FROM (SELECT a AS id, b AS other FROM pairs WHERE sim > 0.35 UNION ALL SELECT b, a FROM pairs WHERE sim > 0.35) GROUP BY id)),
sd AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seeds UNION ALL SELECT nd.k, CASE WHEN list_has_any(near, seeds) THEN seeds ELSE list_append(seeds, id) END FROM sd JOIN nd ON nd.k = sd.k + 1),
al AS (SELECT seeds FROM sd ORDER BY k DESC LIMIT 1)"""
ORACLE["star_clusters"] = f"""WITH RECURSIVE {MEM}, {PAIRS}, {_STARS}
SELECT CASE WHEN list_contains(seeds, id) THEN id ELSE list_min(list_intersect(near, seeds)) END AS seed, id FROM nd, al"""

# A group of over ten rows is split by its two farthest rows, every round all such groups at once.
_LINKED = """cs AS MATERIALIZED (SELECT a, b, 0.7 * sim + 0.3 * {jac} AS sim FROM pairs),
u AS (SELECT a, b FROM cs WHERE sim > 0.45 UNION SELECT b, a FROM cs WHERE sim > 0.45), w AS (SELECT a AS id, a AS b FROM u UNION SELECT w.id, u.b FROM w JOIN u ON w.b = u.a),
g0 AS MATERIALIZED (SELECT id, min(b) AS grp FROM w GROUP BY id),
bw AS MATERIALIZED (SELECT a, b, sim FROM cs UNION ALL SELECT b, a, sim FROM cs),
g AS (SELECT 0 AS step, id, grp FROM g0 UNION ALL
  SELECT step, id, min(id) OVER (PARTITION BY grp, side) AS grp FROM (
    SELECT s.step + 1 AS step, s.id, s.grp, CASE WHEN f.a IS NULL OR s.id = f.a THEN 0 WHEN s.id = f.b THEN 1 WHEN x.sim >= y.sim THEN 0 ELSE 1 END AS side
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM g) s
    LEFT JOIN (SELECT p.grp, first(cs.a ORDER BY cs.sim, cs.a, cs.b) AS a, first(cs.b ORDER BY cs.sim, cs.a, cs.b) AS b FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM g) p JOIN g q ON q.grp = p.grp AND p.id < q.id AND p.n > 10
      JOIN cs ON cs.a = p.id AND cs.b = q.id GROUP BY p.grp) f ON f.grp = s.grp
    LEFT JOIN bw x ON x.a = s.id AND x.b = f.a LEFT JOIN bw y ON y.a = s.id AND y.b = f.b
    WHERE (SELECT max(c) FROM (SELECT count(*) AS c FROM g GROUP BY grp)) > 10))"""
ORACLE["linkage_clusters"] = f"WITH RECURSIVE {MEM}, {PAIRS}, {_LINKED.format(jac=JAC)} SELECT grp AS cluster, id FROM g WHERE step = (SELECT max(step) FROM g)"


# Consolidation

_NEXT = EPOCH + 1
_BUFFER_OK = BUFFER_OK.replace(str(EPOCH), str(_NEXT))
_CYCLE = f"""cy AS (SELECT *, layer = 3 AND (source = 'session' OR len(list_intersect(tags, ['session', 'ephemeral'])) > 0) AS down, layer = 1 AND {_BUFFER_OK} AS up,
  {CORE_OK} AND NOT (list_contains(tags, 'gate-rejected') AND {_NEXT} - {GATE} < 48) AND access_count >= 3 AS core,
  layer = 1 AND NOT {_BUFFER_OK} AND ({DECAYED} < 0.01 OR id IN (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {WEIGHT} DESC, created_at DESC, id DESC) AS r FROM memories WHERE layer = 1 AND NOT {_BUFFER_OK}) WHERE r > 10)) AS gone,
  CASE WHEN layer = 2 AND list_contains(tags, 'gate-rejected') AND {EPOCH} - {GATE} >= 48 THEN list_filter(tags, lambda t: t <> 'gate-rejected' AND NOT starts_with(t, '_gate_epoch:')) ELSE tags END AS clean FROM memories),
ag AS (SELECT * EXCLUDE (tags), CASE WHEN layer = 1 AND (kind = 'procedural' OR list_contains(tags, 'lesson')) AND NOT list_contains(tags, 'distilled') AND len(list_filter(tags, lambda t: starts_with(t, '_birth_epoch:'))) = 0
  THEN list_append(clean, '_birth_epoch:{_NEXT}') ELSE clean END AS tags, CASE WHEN down OR up THEN 2 WHEN core THEN 3 ELSE layer END AS now_layer, CASE WHEN up OR core THEN {NOW_MS} ELSE last_accessed END AS used FROM cy)"""


@register(
    "consolidation_state",
    f"""SELECT 'memories' AS tbl, id, CAST(now_layer AS INTEGER) AS layer, round(CASE WHEN used < {NOW_MS} AND importance > 0.01 AND now_layer < 3 THEN greatest(0.01, importance * CASE kind WHEN 'episodic' THEN 0.98 WHEN 'procedural' THEN 0.996 ELSE 0.988 END) ELSE importance END, 6) AS importance,
  CASE WHEN down OR up THEN CASE kind WHEN 'episodic' THEN 1.0 WHEN 'procedural' THEN 0.1 ELSE 0.3 END WHEN core THEN 0.05 ELSE decay_rate END::DOUBLE AS decay_rate, used AS last_accessed,
  CASE WHEN down OR up OR core THEN {NOW_MS} ELSE modified_at END AS modified_at, CAST(CASE WHEN down OR up OR core THEN {_NEXT} ELSE modified_epoch END AS BIGINT) AS modified_epoch, access_count, array_to_string(tags, ',') AS tags FROM ag WHERE NOT gone
UNION ALL SELECT 'trash', id, layer, round(importance, 6), NULL, NULL, NULL, NULL, NULL, array_to_string(tags, ',') FROM ag WHERE gone
UNION ALL SELECT 'facts', id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM facts WHERE memory_id NOT IN (SELECT id FROM ag WHERE gone)""",
    MEM,
    FACTS,
    _CYCLE,
)
def _(s, d):
    """What a cycle makes of memories, trash and facts, on all columns that it changes."""
    start = State(mem(s, d), A.facts(s, d), s.createDataFrame([], S.TRASH_DDL), EPOCH)
    new, _ = consolidate(start, NOW_MS, cap=10)
    columns = [F.lit("memories").alias("tbl"), "id", "layer", r6(F.col("importance"), "importance"), "decay_rate", "last_accessed", "modified_at", "modified_epoch", "access_count", F.array_join("tags", ",").alias("tags")]
    out = new.memories.select(*columns)
    kinds = dict(out.dtypes)
    rest = lambda df, **have: df.select(*[have.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in out.columns])
    trash = rest(new.trash, tbl=F.lit("trash"), id=F.col("id"), layer=F.col("layer"), importance=F.round("importance", 6), tags=F.array_join("tags", ","))
    return out.unionByName(trash).unionByName(rest(new.facts, tbl=F.lit("facts"), id=F.col("id")))


@register("consolidation_run")
def _(s, d):
    """A whole run with all steps, each written and read again: what becomes of every memory. Its texts are written by hooks, so it has no SQL."""
    start = maintenance.Run(State(mem(s, d, True), A.facts(s, d), s.createDataFrame([], S.TRASH_DDL), EPOCH), s.createDataFrame([], "key string"))
    run, _ = maintenance.run_steps(start, f"{shared_folder(s)}/run-{uuid.uuid4().hex}", NOW_MS, merging=True)
    kept = run.state.memories.select("id", "layer", r6(F.col("importance"), "importance"), "access_count", "namespace", F.lit(False).alias("gone"))
    gone = run.state.trash.select("id", "layer", r6(F.col("importance"), "importance"), F.lit(None).cast("long").alias("access_count"), "namespace", F.lit(True).alias("gone"))
    return kept.unionByName(gone)


# Extraction

#: Brings the conversations of the test tables to the time of its memories.
LATER_MS = 75 * S.DAY_MS


@register(
    "extraction_context",
    f"""SELECT window_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT window_id, row_number() OVER (PARTITION BY window_id ORDER BY created_at DESC, id DESC) AS rank, id
FROM (SELECT session_key AS window_id, max(created_at) + {LATER_MS} AS asked_at FROM turns GROUP BY 1) JOIN memories ON created_at <= asked_at AND created_at >= asked_at - {6 * S.HOUR_MS}) WHERE rank <= 30""",
    MEM,
    TURNS,
)
def _(s, d):
    """The memories that the extraction of each session is told about."""
    windows_of = A.turns(s, d).groupBy(F.col("session_key").alias("window_id")).agg((F.max("created_at") + LATER_MS).alias("at"))
    return extraction.context(windows_of, mem(s, d))


# Stateful windows


def played(rows, last, build, spec, parts=3):
    """Run a stream over rows that come in some micro-batches, the ``last`` after all others, to its end; what it emits as a table in the shared folder."""
    s, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/windows-{uuid.uuid4().hex}"
    for each in (rows.repartition(parts), last.coalesce(1)):
        each.write.mode("append").parquet(f"{folder}/in")  # files are read in the order of their times
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    capture.start(build(stream), lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/n={n}"), f"{folder}/check").awaitTermination()
    s.createDataFrame([], spec).write.parquet(f"{folder}/out/n=-1")
    return s.read.schema(spec).parquet(f"{folder}/out/*")


#: Rows may be late by more than all of a test table's time, as its rows come in no order.
LATE_MS = 2 * 366 * 86_400_000
LATE = f"{LATE_MS} milliseconds"
BATCH_MS, BATCH_MOST = 12 * 3_600_000, 3

_ITEMS = f"""items AS (SELECT component AS queue, CAST(id AS VARCHAR) AS id, ts FROM usage UNION ALL SELECT 'end', 'end', max(ts) + {LATE_MS} + 1 + {BATCH_MS} FROM usage HAVING count(*) > 0),
m AS (SELECT max(ts) - {LATE_MS} AS mark FROM items), i AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, id) AS i FROM items, m WHERE ts < mark)"""


def _windows_sql(most: int, select: str) -> str:
    """From each item the first of the next batch, then batches by following these from the first item on."""
    return f"""WITH RECURSIVE {USAGE}, {_ITEMS},
n AS (SELECT *, least(i + {most}, 1 + max(i) OVER (PARTITION BY queue ORDER BY ts RANGE BETWEEN CURRENT ROW AND {BATCH_MS - 1} FOLLOWING)) AS next FROM i),
b AS (SELECT queue, CAST(0 AS BIGINT) AS batch, i, next, ts, mark FROM n WHERE i = 1 UNION ALL SELECT n.queue, batch + 1, n.i, n.next, n.ts, n.mark FROM b JOIN n ON n.queue = b.queue AND n.i = b.next),
c AS (SELECT b.queue, batch, b.ts AS opened, CASE WHEN b.next - b.i = {most} THEN max(i.ts) ELSE b.ts + {BATCH_MS} END AS closed, string_agg(i.id, ',' ORDER BY i.i) AS ids, count(*) AS n
  FROM b JOIN i ON i.queue = b.queue AND i.i >= b.i AND i.i < b.next WHERE b.next - b.i = {most} OR b.ts + {BATCH_MS} < b.mark GROUP BY b.queue, batch, b.ts, b.next, b.i)
SELECT {select} FROM c"""


def _queued(s, d):
    """Usage rows by component, and one long after, which brings the watermark past them all."""
    rows = A.usage(s, d).select(F.col("component").alias("queue"), F.col("id").cast("string").alias("id"), "ts")
    last = rows.agg(F.max("ts").alias("ts")).where("ts is not null").select(F.lit("end").alias("queue"), F.lit("end").alias("id"), (F.col("ts") + LATE_MS + 1 + BATCH_MS).alias("ts"))
    return rows, last


@register("embed_batches_stream")
def _(s, d):
    made = played(*_queued(s, d), lambda x: windows.micro_batches(x, LATE, BATCH_MS, BATCH_MOST), "queue string, batch long, opened long, closed long, ids array<string>")
    return made.withColumn("ids", F.array_join("ids", ","))


@register("topic_debounce_stream")
def _(s, d):
    return played(*_queued(s, d), lambda x: windows.debounced(x, LATE, BATCH_MS), "queue string, run long, opened long, fires long, signals int").withColumn("signals", F.col("signals").cast("long"))


ORACLE["embed_batches_stream"] = _windows_sql(BATCH_MOST, "queue, batch, opened, closed, ids")
ORACLE["topic_debounce_stream"] = _windows_sql(1 << 40, "queue, batch AS run, opened, closed AS fires, n AS signals")


@register(
    "consolidation_ticks_stream",
    f"SELECT (ts // 1800000 + 1) * 1800000 AS fires, count(*) AS writes FROM items WHERE (ts // 1800000 + 1) * 1800000 <= (SELECT max(ts) - {LATE_MS} FROM items) GROUP BY 1",
    USAGE,
    _ITEMS,
)
def _(s, d):
    return played(*[x.select("ts") for x in _queued(s, d)], lambda x: windows.ticks(x, LATE), "fires long, writes long")


@register(
    "silence_flush_stream",
    f"""SELECT session_key, max(ends) + 30000 AS flushed_at, string_agg(content, chr(10) || '---' || chr(10) ORDER BY id) AS content, count(*) AS turns
FROM (SELECT *, max(created_at) OVER (PARTITION BY burst) AS ends FROM (SELECT *, sum(quiet) OVER (ORDER BY created_at RANGE UNBOUNDED PRECEDING) AS burst
  FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (ORDER BY created_at) >= 30000 THEN 1 ELSE 0 END AS quiet FROM turns)))
GROUP BY session_key, burst""",
    TURNS,
)
def _(s, d):
    """Turns come in no order, so they may be late by all of the table's time; a last turn long after lets the watermark pass them."""
    rows = A.turns(s, d).select("session_key", "id", "content", "created_at")
    last = rows.agg(F.max("created_at").alias("c"), F.max("id").alias("id")).where("c is not null")
    last = last.select(F.lit("end").alias("session_key"), (F.col("id") + 1).alias("id"), F.lit("end").alias("content"), (F.col("c") + LATE_MS + 60_000).alias("created_at"))
    return played(rows, last, lambda x: windows.silence_flush(x, LATE), "session_key string, flushed_at long, content string, turns long")
