"""A full-text index that is kept: postings in buckets of their terms, with deltas, tombstones and merging.

A search reads the buckets of its terms and the tombstones in them, nothing else: buckets are partitions of the table, and
terms are pushed to the scan. A row without any token has a posting of the empty term, by which it is known. Inserting appends the postings of the new rows with a version; removing appends a tombstone to
every bucket that has postings of the row; both append what they change about the number and the length of documents.
Merging writes what is live anew, once over a fifth of the postings are dead or there are many deltas. An index is the value of a
folder and a version: each change returns the next one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X
from recollect.operators import text
from recollect.operators.lineage import cut, shared_folder

#: Buckets of a new index; the share of dead postings and the number of changes above which it is merged.
BUCKETS, DEAD, DELTAS = 64, 0.2, 32
POSTING = "term string, id string, namespace string, tf long, dl long, version int, bucket int"
GHOST = "id string, version int, bucket int"
TOTAL = "n long, length long, version int"


@dataclass(frozen=True)
class TextIndex:
    folder: str
    buckets: int = BUCKETS
    version: int = 0

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTING).parquet(f"{self.folder}/postings")

    def ghosts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(GHOST).parquet(f"{self.folder}/ghosts")

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def _write_totals(index: TextIndex, changed: DataFrame) -> None:
    changed.select(F.col("n").cast("long").alias("n"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.lit(index.version).alias("version")).write.mode("append").parquet(f"{index.folder}/totals")


def _append(index: TextIndex, postings: DataFrame) -> None:
    """Sorted by term inside a bucket, so that the scan skips row groups without the terms; a full bucket is dealt to several files."""
    narrow = postings.select("term", "id", "namespace", *[F.col(c).cast("int").alias(c) for c in ("tf", "dl")])
    dealt = narrow.repartition(index.bucket(F.col("term")), F.pmod(F.xxhash64("id"), F.lit(4)))
    filed = dealt.withColumns({"bucket": index.bucket(F.col("term")), "version": F.lit(index.version), "tf": F.col("tf").cast("long"), "dl": F.col("dl").cast("long")})
    filed.sortWithinPartitions("bucket", "term", "id").select("term", "id", "namespace", "tf", "dl", "version", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{index.folder}/postings")


def build(memories: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> TextIndex:
    """An index of the content and tags of all rows."""
    spark = memories.sparkSession
    index = TextIndex(folder or f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}", buckets)
    for name, ddl in (("postings", POSTING), ("ghosts", GHOST)):
        spark.createDataFrame([], ddl).write.mode("append").partitionBy("bucket").parquet(f"{index.folder}/{name}")
    return _added(index, memories)


def _added(index: TextIndex, memories: DataFrame) -> TextIndex:
    none = memories.where(F.size(X.tokens(text.searchable())) == 0).select(F.lit("").alias("term"), "id", "namespace", F.lit(0).alias("tf"), F.lit(0).alias("dl"))
    found = text.postings(memories).select("term", "id", "namespace", "tf", "dl").unionByName(none)
    _append(index, found.withColumns({c: F.col(c).cast("long") for c in ("tf", "dl")}))
    _write_totals(index, memories.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(X.tokens(text.searchable()))).alias("length")))
    return index


def insert(index: TextIndex, memories: DataFrame) -> TextIndex:
    """The index with more rows; a row whose id it has takes the place of the old one."""
    return _added(remove(index, memories), memories)


def remove(index: TextIndex, ids: DataFrame) -> TextIndex:
    """The index without some ids; those that it doesn't have change nothing."""
    spark = ids.sparkSession
    index = replace(index, version=index.version + 1)
    gone = ids.select(F.col("id").cast("string").alias("id")).distinct()
    there = cut(_held(index, spark).join(gone, "id", "left_semi"))
    there.select("id", F.lit(index.version).alias("version"), "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{index.folder}/ghosts")
    each = there.groupBy("id").agg(F.first("dl").alias("dl"))
    _write_totals(index, each.agg((-F.count(F.lit(1))).alias("n"), (-F.sum("dl")).alias("length")))
    return index


def _held(index: TextIndex, spark: SparkSession) -> DataFrame:
    """(bucket, id, dl) of the live rows: versions are compared by row and bucket, so single postings are not shuffled."""
    last = index.postings(spark).groupBy("bucket", "id").agg(F.max(F.struct("version", "dl")).alias("last"))
    gone = index.ghosts(spark).groupBy("bucket", "id").agg(F.max("version").alias("gone"))
    held = last.join(gone, ["bucket", "id"], "left").where(F.col("gone").isNull() | (F.col("gone") <= F.col("last.version")))
    return held.select("bucket", "id", F.col("last.dl").alias("dl"))


def live(index: TextIndex, spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
    """Postings that no later tombstone covers: all, or of some terms, read from their buckets alone."""
    rows, gone = index.postings(spark), index.ghosts(spark)
    if terms is not None:
        buckets = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms] or [("",)], "t string").select(index.bucket(F.col("t"))).collect()})
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        gone = gone.where(F.col("bucket").isin(buckets))
    gone = gone.groupBy("bucket", "id").agg(F.max("version").alias("gone"))
    return rows.join(gone, ["bucket", "id"], "left").where(F.col("gone").isNull() | (F.col("gone") <= F.col("version"))).drop("gone")


def totals(index: TextIndex, spark: SparkSession) -> tuple[int, float]:
    """How many documents there are and their mean length, from a row for each change."""
    one = spark.read.schema(TOTAL).parquet(f"{index.folder}/totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    return one.n or 0, (one.length / one.n) if one.n else 1.0


def search(index: TextIndex, spark: SparkSession, query: str, limit: int, namespace: str | None = None, t: S.Thresholds = S.DEFAULTS) -> DataFrame:
    """(id, bm25) of the best matches, as :func:`text.search` has them of the live rows."""
    n, mean = totals(index, spark)
    terms = sorted(set(text.query_terms(query)))
    if not terms or not n:
        return spark.createDataFrame([], "id string, bm25 double")
    return text.search_postings(live(index, spark, terms), n, mean, query, limit, namespace, t)


def document_frequency(index: TextIndex, spark: SparkSession, terms: list[str]) -> DataFrame:
    """(term, df) of each term asked for, 0 if it is nowhere."""
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    df = live(index, spark, list(dict.fromkeys(terms))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return asked.join(F.broadcast(df), "term", "left").select("term", F.coalesce("df", F.lit(0).cast("long")).alias("df"))


def term_counts(index: TextIndex, spark: SparkSession, queries: list[str]) -> text.Counts:
    """What :func:`text.count_terms` tells about the terms of all queries, from their postings; rows with none of the terms are left out."""
    terms = tuple(dict.fromkeys(w for q in queries for w in text.query_terms(q)))
    n, mean = totals(index, spark)
    found = live(index, spark, list(terms))
    tfs = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
    rows = cut(found.groupBy("id", "namespace").agg(F.first("dl").alias("_dl"), *tfs))
    one = rows.agg(F.lit(0), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    return text.Counts(rows, terms, {t: one[f"df{i}"] for i, t in enumerate(terms)}, n, mean)


def dead_share(index: TextIndex, spark: SparkSession) -> float:
    every, alive = index.postings(spark).count(), live(index, spark).select("id").count()
    return 1 - alive / every if every else 0.0


def merge(index: TextIndex, spark: SparkSession, most_dead: float = DEAD, most_deltas: int = DELTAS, folder: str | None = None) -> TextIndex:
    """The same index, or its live postings alone in a new folder if too many are dead or there were too many changes."""
    if index.version <= most_deltas and dead_share(index, spark) <= most_dead:
        return index
    new = TextIndex(folder or f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}", index.buckets)
    _append(new, live(index, spark).select("term", "id", "namespace", "tf", "dl"))
    spark.createDataFrame([], GHOST).write.mode("append").partitionBy("bucket").parquet(f"{new.folder}/ghosts")
    n, mean = totals(index, spark)
    _write_totals(new, spark.createDataFrame([(n, round(n * mean))], "n long, length long"))
    return new


def repair(index: TextIndex, memories: DataFrame) -> tuple[TextIndex, int, int]:
    """(index, orphans, missing): without postings of rows that are gone, and with those of rows it lacks."""
    spark = memories.sparkSession
    known = cut(live(index, spark).select("id").distinct())
    orphans = cut(known.join(memories.select("id"), "id", "left_anti"))
    missing = memories.join(known, "id", "left_anti")
    lost, lacked = orphans.count(), missing.count()
    index = remove(index, orphans) if lost else index
    return (_added(replace(index, version=index.version + 1), missing) if lacked else index), lost, lacked
