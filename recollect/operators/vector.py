"""Cosine search, vector joins, centroids, codecs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import scalars as X
from recollect.operators import metric


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(np.float32(x))) for x in vector])


def with_similarity(memories: DataFrame, query: list[float], column: str = "similarity") -> DataFrame:
    """The query's own norm is folded into the plan; each row costs two dot products."""
    return memories.withColumn(column, X.cosine(F.col("embedding"), literal(query)))


def top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by), "id").limit(k)


def search(memories: DataFrame, query: list[float], k: int, namespace: str | None = None) -> DataFrame:
    """Exact: the ``k`` rows of the namespace with the largest positive cosine."""
    df = memories.where(F.col("embedding").isNotNull())
    if namespace is not None:
        df = df.where(F.col("namespace") == namespace)
    return top_k(with_similarity(df, query).where("similarity > 0"), "similarity", k)


def search_among(memories: DataFrame, ids: DataFrame, query: list[float], k: int) -> DataFrame:
    return search(memories.join(ids.select("id").distinct(), "id", "left_semi"), query, k)


def duplicate_of(memories: DataFrame, query: list[float], threshold: float) -> DataFrame:
    """The nearest row of any namespace if it is over the threshold; else none."""
    return search(memories, query, 10).where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "id").limit(1)


def mean_vector(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, centroid): the unit mean; a mean of no length stays as it is. Map-side sums, element by element."""
    each = df.where(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    length = X.norm(F.col("m"))
    return mean.select(by, F.when(length > 1e-12, F.transform("m", lambda x: x / length)).otherwise(F.col("m")).alias("centroid"))


def encode_vector(vector: list[float]) -> bytes:
    return struct.pack(f"<{len(vector)}f", *vector)


def decode_vectors(df: DataFrame, column: str, legacy_bytes: int = 12288) -> DataFrame:
    """Binary little-endian floats to arrays; blobs of ``legacy_bytes`` are doubles. The column is replaced."""
    at = df.columns.index(column)
    kinds = ", ".join(f"`{n}` {'array<float>' if n == column else t}" for n, t in df.dtypes)

    def decode(batches):
        for batch in batches:
            out = []
            for x in batch.column(at):
                raw = x.as_buffer().to_pybytes() if x.is_valid else None
                out.append(None if raw is None else np.frombuffer(raw, "<f8" if len(raw) == legacy_bytes else "<f4").astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float32())) if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    return df.mapInArrow(decode, kinds)


BLOCK_ROWS = metric.BLOCK_ROWS


def similar_pairs(df: DataFrame, threshold: float, by: str | None = None, upto: float = 2.0, inclusive: bool = False) -> DataFrame:
    """(a, b, similarity), a < b as strings: pairs of one ``by`` group with threshold < cosine <= upto.

    Exact. Each group is cut into blocks of at most BLOCK_ROWS vectors; pairs of blocks meet as matrix products,
    so a task holds two blocks whatever the size of the group.
    """
    key = F.col(by) if by else F.lit("")
    rows = df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(key.alias("g"), F.col("id").cast("string").alias("id"), "embedding", F.size("embedding").alias("n"))
    sizes = rows.groupBy("g", "n").agg(F.ceil(F.count(F.lit(1)) / metric.block_rows(F.col("n"), BLOCK_ROWS)).alias("blocks"))
    rows = rows.join(sizes, ["g", "n"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.select("g", "n", "id", "embedding", "block", other.alias("other")).select("g", "n", "id", "embedding", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("alone"))
    return dealt.groupBy("g", "n", "lo", "hi").applyInArrow(metric.block_products(threshold, upto, inclusive), "g string, a string, b string, similarity double")


def similar_across(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """(new_id, old_id, similarity): cosine over ``threshold`` between rows (id, embedding) of two tables.

    Blocks of new rows meet blocks of old ones as matrix products; rows of one table are never compared with each other.
    """
    sides = []
    for side, df in enumerate((new, old)):
        rows = df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("v"), F.size("embedding").alias("n"), F.lit(side).alias("side"))
        sides.append((rows, rows.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / metric.block_rows(F.col("n"), BLOCK_ROWS)).alias(f"b{side}"))))
    (x, bx), (y, by) = sides
    grid = bx.join(by, "n")
    other = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    p = x.join(grid, "n").select("n", F.pmod(F.xxhash64("id"), F.col("b0")).alias("p"), other("b1").alias("q"), "side", "id", "v")
    q = y.join(grid, "n").select("n", other("b0").alias("p"), F.pmod(F.xxhash64("id"), F.col("b1")).alias("q"), "side", "id", "v")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, v, ids = table.column("side").to_numpy(), metric.matrix(table.column("v")), table.column("id").combine_chunks()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        del table
        for i, j, s in metric.hits(v[one], v[two], threshold):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(one[i])), ids.take(pa.array(two[j])), pa.array(s)], ["new_id", "old_id", "similarity"])

    return p.unionByName(q).groupBy("n", "p", "q").applyInArrow(products, "new_id string, old_id string, similarity double")


def lsh_neighbours(memories: DataFrame, query: list[float], k: int, tables: int = 8, length: float = 0.5, seed: int = 7) -> DataFrame:
    """Approximate: candidates by bucketed random projections of unit vectors, then the exact cosine."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    df = memories.where(F.col("embedding").isNotNull())
    size = X.norm(F.col("embedding"))
    unit = df.where(size > 0).withColumn("_v", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / size)))
    q = np.asarray(query, float)
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", numHashTables=tables, bucketLength=length, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense(q / np.linalg.norm(q)), k * 4)
    return top_k(with_similarity(near.drop("_v", "_h", "distCol"), query), "similarity", k)
