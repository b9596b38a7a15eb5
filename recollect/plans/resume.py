"""The opening summary: core, recent, topics and triggers under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X
from recollect.operators import scans
from recollect.plans.recall import budget_prefix

CORE_CHARS, RECENT_CHARS, RECENT_ROWS = 8000, 4000, 200


def _starts(prefix: str):
    return lambda x: x.startswith(prefix)


def workspace_match(tags: list[str]) -> Column:
    """No workspace and no tags let a row in; a tag matches as a whole or up to a colon, whatever its case."""
    ok = F.size("tags") == 0
    for w in (t.strip().lower() for t in tags):
        low = F.transform("tags", F.lower)
        ok = ok | F.array_contains(low, w) | F.exists(low, _starts(f"{w}:"))
    return ok if tags else F.lit(True)


def core_section(memories: DataFrame, namespace: str | None = None, workspace: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Core rows of the namespace, then of ``default``, by importance; ``limit`` of them, the weightiest first."""
    own = scans.list_by_layer(memories, S.CORE, limit * 2, 0, namespace).withColumn("_o", F.lit(0))
    if namespace not in (None, S.DEFAULT_NAMESPACE):
        own = own.unionByName(scans.list_by_layer(memories, S.CORE, limit, 0, S.DEFAULT_NAMESPACE).withColumn("_o", F.lit(1)))
    few = own.where(workspace_match(workspace or [])).orderBy("_o", F.desc("importance"), "id").limit(limit)
    return few.drop("_o").withColumn("weight", X.weight()).orderBy(F.desc("weight"), "id")


def recent_section(memories: DataFrame, epoch: int, namespace: str | None = None, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    rows = scans.list_by_epoch(memories, max(0, epoch - t.recent_epochs), RECENT_ROWS, namespace)
    return rows.where(F.col("layer") != S.CORE)


def char_prefix(rows: DataFrame, order: list[Column], budget: int, limit: int) -> DataFrame:
    """Whole texts up to the budget, two characters each for the line; the first always."""
    return budget_prefix(rows, order, budget, limit, cost=(F.length("content") + 2).cast("long"))


def resume(memories: DataFrame, epoch: int, namespace: str | None = None, workspace: list[str] | None = None, budget: int = 16_000, limit: int = 100) -> dict[str, DataFrame]:
    core = char_prefix(core_section(memories, namespace, workspace, limit), [F.desc("weight"), F.asc("id")], min(CORE_CHARS, budget), limit)
    spent = core.agg(F.sum("tokens")).first()[0] or 0  # one row over at most ``limit`` rows
    recent = char_prefix(recent_section(memories, epoch, namespace), [F.desc("modified_at"), F.asc("id")], max(1, min(RECENT_CHARS, budget - spent)), RECENT_ROWS)
    return {"core": core, "recent": recent, "triggers": scans.trigger_frequency(memories, namespace).orderBy(F.desc("uses"), "action")}
