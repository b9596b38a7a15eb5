"""The tables of a data folder as memories, facts, usage rows and conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X

BASE_MS = 1_704_067_200_000
NOW_MS = BASE_MS + 90 * S.DAY_MS
EPOCH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """MEMORY_DDL rows from documents, with the vector of the same number. Without ``vectors`` nothing is joined."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")

    def every(k: int, *tags):
        return [F.when(n % k == 0, t if not isinstance(t, str) else F.lit(t)) for t in tags]

    tags = F.array(F.col("lang"), F.col("source"), *every(11, "lesson"), *every(13, "trigger:deploy"), *every(17, "_birth_epoch:90"), *every(19, "gate-rejected", F.concat(F.lit("_gate_epoch:"), (n % 60 + 30).cast("string"))), *every(23, "session"), *every(29, "ephemeral"))
    layer = (n % 3 + 1).cast("int")
    last = F.lit(NOW_MS) - (n % 240) * S.HOUR_MS
    created = last - (n % 30) * S.DAY_MS
    kind = F.when(n % 5 == 3, "episodic").when(n % 5 == 4, "procedural").otherwise("semantic")
    rows = d.select(
        n.cast("string").alias("id"), F.col("text").alias("content"), layer.alias("layer"), ((n % 100) / F.lit(100.0)).alias("importance"),
        created.alias("created_at"), last.alias("last_accessed"), (n % 50).alias("access_count"), (n % 7).alias("repetition_count"),
        X.layer_default_decay(layer).alias("decay_rate"), "source", F.filter(tags, lambda t: t.isNotNull()).alias("tags"), F.col("lang").alias("namespace"),
        kind.alias("kind"), created.alias("modified_at"), (n % EPOCH).alias("modified_epoch"), n.alias("_n"),
    )
    if vectors:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_n"), "embedding")
        rows = rows.join(e, "_n", "left")
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    return rows.select(*S.MEMORY_COLS)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACT_DDL rows: where customers and nations lie. memory_id: the memory with twice the customer's number, so some memories have no fact."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    # Nations and regions are fixed lists of 25 and 5 rows.
    at = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    one = at.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("subject"), F.lit("in_nation").alias("predicate"), F.col("n_name").alias("object"), (F.col("c_custkey") * 2).cast("string").alias("memory_id"), (F.lit(BASE_MS) + F.col("c_custkey")).alias("created_at"))
    two = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("subject"), F.lit("in_region").alias("predicate"), F.col("r_name").alias("object"), F.lit("0").alias("memory_id"), (F.lit(BASE_MS) + F.col("n_nationkey")).cast("long").alias("created_at"))
    every = one.unionByName(two)
    return every.select("id", "subject", "predicate", "object", "memory_id", F.lit("default").alias("namespace"), "created_at", F.lit(None).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_until"), F.lit(None).cast("string").alias("superseded_by"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACT_DDL rows to be superseded: each order restates its customer's priority."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.join(c, "o_custkey").select(F.format_string("o%012d", "o_orderkey").alias("id"), F.col("c_name").alias("subject"), F.lit("order_priority").alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_custkey").cast("string").alias("memory_id"), F.lit("default").alias("namespace"), at.alias("created_at"), F.lit(None).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_until"), F.lit(None).cast("string").alias("superseded_by"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("component"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), F.floor("value").cast("long").alias("input_tokens"), k.alias("output_tokens"), F.lit(0).cast("long").alias("cached_tokens"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_key"), F.concat("role", F.lit(": "), "text").alias("content"), (F.lit(BASE_MS) + F.col("conv_id") * 60000 + F.col("turn") * 1000).alias("created_at"))
