"""An approximate vector index: inverted lists under k-means centroids, as a table partitioned by list.

Rows are appended to the list of their nearest centroid with a version; a removed row gets a tombstone in the same list
with the version of the removal, so a search reads the few lists that it probes and their tombstones only. Once over a
fifth of the rows are ghosts the lists are written anew under new centroids. An index is the value of a few paths and
numbers: inserting, removing and rebuilding return the next one, and the one before stays readable until its folder is dropped.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import scalars as X
from recollect.operators import metric
from recollect.operators.lineage import shared_folder

#: Lists at most, vectors the centroids are fitted on, rounds of k-means, share of ghosts above which to rebuild.
LISTS, SAMPLE, ROUNDS, GHOSTS = 1024, 8192, 8, 0.2
#: Rows of a list, and queries, of a block; queries of a block that are multiplied at once.
BLOCK, TILE = 8192, 512
ROW = "id string, namespace string, embedding array<float>, version int, list int"


@dataclass(frozen=True)
class Index:
    """Where the lists and tombstones are, the unit centroids (list, component), and the last version."""

    folder: str
    centroids: np.ndarray = field(repr=False)
    version: int = 0

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(ROW).parquet(f"{self.folder}/lists")

    def tombstones(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id string, version int, list int").parquet(f"{self.folder}/ghosts")


def _vectors(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("embedding").isNotNull() & (X.norm(F.col("embedding")) > 0)).select("id", "namespace", F.col("embedding").cast("array<float>").alias("embedding"))


def fit_centroids(rows: DataFrame, lists: int | None = None) -> np.ndarray:
    """Unit centroids by k-means on directions, from a sample by hash of about SAMPLE rows."""
    total = rows.count()
    share = max(1, total // SAMPLE)
    draw = F.xxhash64("id", F.lit("centroids"))
    drawn = rows.where(F.pmod(draw, F.lit(share)) == 0).select("embedding", draw.alias("draw")).orderBy("draw").limit(SAMPLE).collect()
    if not drawn:
        return np.zeros((1, 1))
    x = np.array([r.embedding for r in drawn], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = min(lists or max(1, min(LISTS, math.isqrt(total))), len(x))
    c = x[:k].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            mine = x[own == j].sum(0)
            size = np.linalg.norm(mine)
            c[j] = mine / size if size > 0 else c[j]
    return c


def _filed(rows: DataFrame, centroids: np.ndarray, version: int) -> DataFrame:
    """Rows with the list of their nearest centroid."""

    def file(batches):
        for batch in batches:
            v = batch.column(2)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
            own = (x @ centroids.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.full(len(v), version, np.int32)), pa.array(own)], ["id", "namespace", "embedding", "version", "list"])

    return rows.mapInArrow(file, ROW)


def _write(rows: DataFrame, path: str) -> None:
    """One file a list and task of the shuffle; a long list is dealt to several, so no task writes all of it."""
    salted = rows.repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.lit(4)))
    salted.write.mode("append").partitionBy("list").parquet(path)


def build(memories: DataFrame, folder: str | None = None, lists: int | None = None) -> Index:
    """An index of all rows with a vector; vectors have one length."""
    rows = _vectors(memories)
    spark = memories.sparkSession
    index = Index(folder or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", fit_centroids(rows, lists))
    _write(_filed(rows, index.centroids, 0), f"{index.folder}/lists")
    none = spark.createDataFrame([], "id string, version int, list int")
    none.write.mode("append").partitionBy("list").parquet(f"{index.folder}/ghosts")
    return index


def insert(index: Index, memories: DataFrame) -> Index:
    """The index with more rows; those with an id that it has replace them."""
    index = remove(index, memories)
    _write(_filed(_vectors(memories), index.centroids, index.version), f"{index.folder}/lists")
    return index


def remove(index: Index, ids: DataFrame) -> Index:
    """The index without some ids: a tombstone in the list of each row that they have there."""
    version = index.version + 1
    there = live(index, ids.sparkSession).select("id", "list").join(ids.select("id").distinct(), "id", "left_semi")
    there.select("id", F.lit(version).alias("version"), "list").write.mode("append").partitionBy("list").parquet(f"{index.folder}/ghosts")
    return replace(index, version=version)


def live(index: Index, spark: SparkSession, lists: Column | None = None) -> DataFrame:
    """Rows that no later tombstone covers, of all lists or of some; tombstones are read of the same lists."""
    rows, gone = index.rows(spark), index.tombstones(spark)
    if lists is not None:
        rows, gone = rows.where(lists), gone.where(lists)
    gone = gone.groupBy("list", "id").agg(F.max("version").alias("gone"))
    return rows.join(gone, ["list", "id"], "left").where(F.col("gone").isNull() | (F.col("gone") <= F.col("version"))).drop("gone")


def ghost_share(index: Index, spark: SparkSession) -> float:
    """Rows covered by a tombstone, of all rows in the lists; only ids and versions are read."""
    every, alive = index.rows(spark).count(), live(index, spark).select("id").count()
    return 1 - alive / every if every else 0.0


def rebuild(index: Index, spark: SparkSession, most: float = GHOSTS, folder: str | None = None) -> Index:
    """The same index, or one of the live rows alone under new centroids if over ``most`` of the rows are ghosts."""
    if ghost_share(index, spark) <= most:
        return index
    return build(live(index, spark).select("id", "namespace", "embedding"), folder, len(index.centroids))


def search(index: Index, spark: SparkSession, query: list[float], k: int, probes: int = 8, namespace: str | None = None) -> DataFrame:
    """(id, similarity): the ``k`` best of the ``probes`` lists nearest to the query; other lists are pruned from the scan."""
    q = np.asarray(query, float)
    order = np.argsort(-(index.centroids @ q), kind="stable")[:probes]
    rows = live(index, spark, F.col("list").isin([int(x) for x in order]))
    if namespace is not None:
        rows = rows.where(F.col("namespace") == namespace)
    near = rows.select("id", X.cosine(F.col("embedding"), F.array(*[F.lit(float(np.float32(x))) for x in query])).alias("similarity"))
    return near.where("similarity > 0").orderBy(F.desc("similarity"), "id").limit(k)


def search_all(index: Index, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """(query_id, rank, id, similarity, probe) for a table of queries (query_id, embedding): each meets the rows of its own lists.

    ``probe``: the how manieth of the query's lists, from 1, the row was in.

    Blocks of at most about BLOCK rows of a list meet blocks of the queries that probe it as matrix products, and each tells the ``k`` best of a
    query alone. Where every list is probed the blocks are of all lists together. Null and zero queries have no rows.
    """
    spark, centroids = queries.sparkSession, index.centroids
    every = probes >= len(centroids)

    def probe(batches):
        for batch in batches:
            v = batch.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
            order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            width = order.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * width), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, lists], ["query_id", "q", "lists"])

    kind = dict(queries.dtypes)["query_id"]
    fine = queries.where(F.col("embedding").isNotNull() & (X.norm(F.col("embedding")) > 0)).select("query_id", F.col("embedding").cast("array<float>").alias("q"))
    if every:
        asked = fine.withColumn("cell", F.lit(0))
    else:
        asked = fine.mapInArrow(probe, f"query_id {kind}, q array<float>, lists array<int>").select("query_id", "q", F.explode("lists").alias("cell"))
    shares = max(1, math.ceil(fine.count() / BLOCK))
    rows = live(index, spark).select("id", "embedding", "list", (F.lit(0) if every else F.col("list")).alias("cell"))
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    some = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rows = rows.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), some(F.lit(shares).cast("long")).alias("share"), "id", "embedding", "list")
    asked = asked.join(parts, "cell").select("cell", some(F.col("parts")).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(shares).cast("long")).alias("share"), "query_id", "q")
    keys = ["cell", "part", "share"]
    met = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_best(centroids, k), f"query_id {kind}, id string, similarity double, probe int")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity", "probe")


def _best(centroids: np.ndarray, k: int) -> Callable:
    """For a block of rows and one of queries: the ``k`` rows of the largest positive cosine of each query, equal ones by id."""

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asked):
            v, q = metric.matrix(rows.column("embedding")), metric.matrix(asked.column("q"))
            lengths, norms = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
            units = (v / lengths[:, None]).astype(np.float32)
            lists, place = rows.column("list").to_numpy(), np.empty(len(v), np.int64)
            place[pc.sort_indices(rows.column("id")).to_numpy()] = np.arange(len(v))
            slack = max(1, v.shape[1]) * 2.0**-21
            for lo in range(0, len(q), TILE):
                x = q[lo : lo + TILE]
                s = (x / norms[lo : lo + TILE, None]).astype(np.float32) @ units.T
                least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k] if k < len(v) else np.full(len(x), -1.0)
                i, j = np.nonzero((s >= least[:, None] - slack) & (s > -slack))
                product = norms[lo + i] * lengths[j]
                exact = np.where(product >= 1e-12, np.einsum("ij,ij->i", x[i], v[j]) / np.maximum(product, 1e-12), 0.0)
                order = np.lexsort((place[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (exact > 0)
                i, j, exact = i[first], j[first], exact[first]
                probe = np.argsort(np.argsort(-(x @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")[i, lists[j]] + 1
                out.append(pa.table({"query_id": asked.column("query_id").take(pa.array(lo + i)), "id": rows.column("id").take(pa.array(j)), "similarity": exact, "probe": pa.array(probe, pa.int32())}))
        if out:
            return pa.concat_tables(out)
        return pa.table({"query_id": asked.column("query_id").slice(0, 0), "id": rows.column("id").slice(0, 0), "similarity": pa.array([], pa.float64()), "probe": pa.array([], pa.int32())})

    return best


def probes_for(index: Index, queries: DataFrame, k: int, target: float = 0.95) -> int:
    """How many lists to probe so that the share ``target`` of the ``k`` true neighbours of these queries is found.

    One exact search tells in which of a query's lists its neighbours are. Vectors without clusters need most lists, which pruning can't help.
    """
    at = search_all(index, queries, k, len(index.centroids)).groupBy("probe").count().orderBy("probe").collect()
    total, found = sum(r["count"] for r in at), 0
    for r in at:
        found += r["count"]
        if found >= target * total:
            return r.probe
    return 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, id) that were found."""
    total, hit = exact.count(), exact.join(found, ["query_id", "id"], "left_semi").count()
    return hit / total if total else 1.0
