"""From raw documents to token ids: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir), works on all documents the one before kept, and but for the
last returns the columns of documents. ``run`` writes each result and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm import line_dedup, mixing, near_dedup, pieces, quality
from recollect.llm._session import checkpoint_folder, cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels of the documents.

    Rows with a null id go by their own text; rows that repeat an id all stay if one of them is accepted.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string"), "quality")
    text_key = F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    keyed = docs.withColumn("_key", F.when(F.col("doc_id").isNull(), text_key).otherwise(F.col("doc_id").cast("string")))
    accepted = quality.classify(keyed, labels, "_key").where("predicted = 1").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(accepted, "_key", "left_semi").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-duplicate lines of at least MIN_CHARS characters and exact repeats of shorter ones.

    n_chars follows the text. Rows with a null id keep all.
    """
    done = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows with a null id are kept; rows that repeat an id all stay if one of them is kept.
    """
    gone = near_dedup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def _own_keys(size: Column) -> list[Column]:
    """Two hashes by which rows of one id and source meet their shares; rows without an id meet by size, too."""
    by = ["doc_id", "source", F.when(F.col("doc_id").isNull(), size)]
    return [F.xxhash64(*by).alias("_a"), F.xxhash64(F.lit("mix"), *by).alias("_b")]


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken, cut to the words the mix takes of it.

    Rows come in the order of the schedule's slots, by the first slot of each: any part of the output has the sources
    in their shares. Rows with a null id and rows that repeat an id are documents of their own; of those of one id and source the
    shares go by size, then by text.
    """
    size = mixing.word_count(F.col("text"))
    shares = mixing.mix(docs).select(*_own_keys(F.col("size")), F.struct("size", "first", "spans").alias("share"))
    shares = cut(shares.groupBy("_a", "_b").agg(F.sort_array(F.collect_list("share")).alias("_shares")))
    slots = F.flatten(F.transform(F.flatten(F.transform("_shares", lambda s: s["spans"])), lambda s: s["slots"]))
    last = shares.agg(F.max(F.array_max(slots))).first()[0] or 0

    group = Window.partitionBy("_a", "_b")
    placed = docs.select("*", *_own_keys(size)).withColumn("_many", F.count(F.lit(1)).over(group) > 1)
    nth = F.row_number().over(group.orderBy(F.when(F.col("_many"), size), F.when(F.col("_many"), F.col("text"))))
    joined = placed.withColumn("_nth", nth).join(shares, ["_a", "_b"])
    joined = joined.withColumn("_share", F.element_at("_shares", F.col("_nth"))).where(F.size("_share.spans") > 0)
    rounds = F.array_max(F.transform("_share.spans", lambda s: s["repeats"])).cast("int")
    joined = joined.withColumn("_round", F.explode(F.sequence(F.lit(1), rounds)))
    joined = joined.withColumn("_spans", F.filter("_share.spans", lambda s: s["repeats"] >= F.col("_round")))
    joined = joined.withColumn("_slot", F.array_min(F.transform("_spans", lambda s: F.element_at(s["slots"], F.col("_round")))))

    taken = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    joined = joined.withColumn("_part", F.when(taken < F.col("_share.size"), F.col("_spans")))
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    some = F.transform("_part", lambda s: F.slice(words, (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))
    text = F.when(F.col("_part").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(some), " "))
    n_chars = F.when(F.col("_part").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    mixed = joined.withColumn("text", text).withColumn("n_chars", n_chars).select(*docs.columns, "_slot", F.col("_share.first").alias("_first"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = mixed.repartitionById(parts, F.expr(f"cast(_slot * {parts} div {last + 1} as int)"))
    return in_order.sortWithinPartitions("_slot", "_first").select(docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of every document of the mix, null ids included."""
    coded = pieces.decode(pieces.encode(docs))
    return coded.select("doc_id", "token_ids", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Learnt scores and byte-pair merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
