"""Table schemas and tuning constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)  # type: ignore[return-value]


MEMORY_DDL = (
    "id string, content string, layer int, importance double, created_at long, last_accessed long, access_count long, "
    "repetition_count long, decay_rate double, source string, tags array<string>, namespace string, embedding array<float>, "
    "kind string, modified_at long, modified_epoch long"
)
FACT_DDL = "id string, subject string, predicate string, object string, memory_id string, namespace string, created_at long, valid_from long, valid_until long, superseded_by string"
TRASH_DDL = "id string, content string, layer int, importance double, created_at long, deleted_at long, tags array<string>, namespace string, source string, kind string"
USAGE_DDL = "id long, ts long, component string, model string, input_tokens long, output_tokens long, cached_tokens long, duration_ms long"
TURN_DDL = "id long, session_key string, content string, created_at long"

MEMORY_COLS = [f.split()[0] for f in MEMORY_DDL.split(", ")]
META_COLS = [c for c in MEMORY_COLS if c != "embedding"]

BUFFER, WORKING, CORE = 1, 2, 3
LAYER_NAMES = {1: "buffer", 2: "working", 3: "core"}
KINDS = ("semantic", "episodic", "procedural")
DEFAULT_NAMESPACE = "default"
HOUR_MS, DAY_MS, WEEK_HOURS = 3_600_000, 86_400_000, 168.0


@dataclass(frozen=True)
class Thresholds:
    """Every tuning constant; the defaults are fixed values that results depend on."""

    proxy_dedup_sim: float = 0.60
    insert_dedup_sim: float = 0.65
    triage_dedup_sim: float = 0.75
    merge_sim: float = 0.78
    reconcile_min_sim: float = 0.55
    reconcile_max_sim: float = 0.78
    core_overlap_sim: float = 0.70
    insert_merge_jaccard: float = 0.80
    dedup_cosine: float = 0.85
    dedup_jaccard_prefilter: float = 0.5
    recall_sim_floor: float = 0.30
    auto_expand: float = 0.25
    idf_boost: float = 0.5
    idf_miss_penalty: float = 0.85
    orphan_penalty: float = 0.5
    tag_boost: float = 0.2
    no_keyword_penalty: float = 0.85
    buffer_cap: int = 200
    buffer_promote: float = 0.4
    core_promote: float = 0.8
    promote_min_importance: float = 0.6
    promote_age_days: int = 7
    decay_drop: float = 0.01
    gate_retry_epochs: int = 48
    gate_retry2_epochs: int = 144
    gate_pending_epochs: int = 4
    lesson_epochs: int = 4
    gate_stale_epochs: int = 48
    decay_factor: float = 0.02
    decay_semantic: float = 0.6
    decay_procedural: float = 0.2
    importance_floor: float = 0.01
    cosine_weight: float = 0.7
    tag_weight: float = 0.3
    max_cluster: int = 10
    distill_min: int = 10
    distill_max: int = 2
    topic_assign: float = 0.30
    topic_merge: float = 0.55
    topic_leaf_budget: int = 256
    topic_absorb: float = 0.30
    topic_absorb_size: int = 3
    topic_split_large: float = 0.50
    topic_split_medium: float = 0.40
    topic_split_small: float = 0.35
    topic_inherit: float = 0.20
    noise_df_ratio: float = 0.8
    noise_min_docs: int = 5
    recent_epochs: int = 24


MAX_CONTENT, MAX_SOURCE, MAX_TAGS, MAX_TAG, MAX_FACT_FIELD = 8192, 64, 20, 32, 512
DEFAULTS = Thresholds()
