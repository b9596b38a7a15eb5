"""Usage logs and conversation sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X

SEPARATOR = "\n---\n"


def daily(usage: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Calls and tokens by UTC day, component and model over the last ``days``; newest day first, then most calls."""
    recent = usage.where(F.col("ts") >= now_ms - days * S.DAY_MS)
    g = recent.groupBy(X.day(F.col("ts")).alias("day"), "component", "model")
    out = g.agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.floor(F.avg("duration_ms")).cast("long").alias("avg_duration_ms"))
    return out.orderBy(F.desc("day"), F.desc("calls"), "component", "model")


def summary(usage: DataFrame, today: str) -> DataFrame:
    """(scope, name, calls, input_tokens, output_tokens): all, today, by component and by model, in one pass."""
    rows = usage.select("*", (X.day(F.col("ts")) == today).alias("_today"))
    scopes = F.array(F.struct(F.lit("total").alias("scope"), F.lit("").alias("name")), F.struct(F.lit("component").alias("scope"), F.col("component").alias("name")), F.struct(F.lit("model").alias("scope"), F.col("model").alias("name")), F.when(F.col("_today"), F.struct(F.lit("today").alias("scope"), F.lit("").alias("name"))))
    each = rows.select(F.explode(F.filter(scopes, lambda s: s.isNotNull())).alias("s"), "input_tokens", "output_tokens")
    return each.groupBy("s.scope", "s.name").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def log_call(usage: DataFrame, new: DataFrame) -> DataFrame:
    return usage.unionByName(new)


def clear(usage: DataFrame, before_ms: int | None = None) -> DataFrame:
    """The log without rows older than ``before_ms``, or without any."""
    return usage.where(F.lit(False) if before_ms is None else F.col("ts") >= before_ms)


def save_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    return turns.unionByName(new.select(*turns.columns))


def drain(turns: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(drained sessions, turns that stay): ``sessions`` (session_key), or all of them."""
    if sessions is None:
        return drain_sessions(turns), turns.where(F.lit(False))
    keys = sessions.select("session_key").distinct()
    return drain_sessions(turns.join(keys, "session_key", "left_semi")), turns.join(keys, "session_key", "left_anti").select(*turns.columns)


MOST_TURNS, MOST_CHARS = 8, 16_000


def should_flush(turns: DataFrame, now_ms: int, most_turns: int = MOST_TURNS, most_chars: int = MOST_CHARS, quiet_ms: int = 30_000) -> DataFrame:
    """(session_key) of sessions with enough turns or characters that have been quiet; right after a turn none is."""
    sizes = session_sizes(turns, now_ms, quiet_ms)
    return sizes.where(((F.col("turns") >= most_turns) | (F.col("chars") >= most_chars)) & F.col("quiet")).select("session_key")


def drain_sessions(turns: DataFrame) -> DataFrame:
    """(session_key, content, turns): each session's turns in order, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda s: s["content"])
    return turns.groupBy("session_key").agg(F.array_join(ordered, SEPARATOR).alias("content"), F.count(F.lit(1)).alias("turns"))


def session_sizes(turns: DataFrame, now_ms: int, quiet_ms: int = 30_000) -> DataFrame:
    return turns.groupBy("session_key").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("content")).alias("chars"), F.max("created_at").alias("last_at")).withColumn("quiet", F.col("last_at") <= now_ms - quiet_ms)


def peek(turns: DataFrame, chars: int = 200) -> DataFrame:
    """Sessions with their newest text cut short, for a look at what waits."""
    return drain_sessions(turns).select("session_key", "turns", F.octet_length("content").alias("chars"), F.substring("content", 1, chars).alias("preview"))


def cache_load(cache: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache for ``keys`` (key), keys it misses)."""
    wanted = keys.select("key").distinct()
    return cache.join(wanted, "key", "left_semi"), wanted.join(cache.select("key"), "key", "left_anti")


def cache_put(cache: DataFrame, new: DataFrame, keep: int = 128) -> DataFrame:
    """The ``keep`` newest rows of a cache after the new ones replaced those of their key."""
    old = cache.join(new.select("key"), "key", "left_anti").select(*new.columns)
    return newest_entries(old.unionByName(new), keep)


def cache_counters(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: entries, hits and misses of ``asked`` (key), repeats counted."""
    own = cache.select(F.col("key").alias("_k")).distinct()
    hits = asked.join(own, F.col("key") == F.col("_k"), "left").agg(F.count("_k").alias("hits"), F.count_if(F.col("_k").isNull()).alias("misses"))
    return hits.crossJoin(own.agg(F.count(F.lit(1)).alias("size")))


def newest_entries(cache: DataFrame, keep: int = 128) -> DataFrame:
    """The ``keep`` newest rows of a cache; TakeOrdered keeps that many per task."""
    return cache.orderBy(F.desc("created_at"), "key").limit(keep)
