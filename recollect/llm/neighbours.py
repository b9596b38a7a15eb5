"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt to tiles of bounded size, and each tile of queries meets each tile of
candidates by a key of both, so neither the plan nor what a task or the driver holds grows with the rows.
Products of int8 codes give each inner product within an error bound; pairs that the bound cannot rule
out are computed again in double precision on the original vectors and merged by heaps, first inside a
pair of tiles, then over the tiles of a query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._session import cut

#: Components of a tile of queries and of candidates, 4096 and 16384 rows of 64 dimensions; candidates multiplied at once.
QUERY_NUMBERS, CANDIDATE_NUMBERS = 1 << 18, 1 << 20
TILE = 2048
#: int8 products of so many dimensions are exact in float32.
DIMS = 1024


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _codes(x: np.ndarray):
    """int8 codes as float32, scale, norm of the decoded vector, norm of what is lost."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None])
    back = code * scale[:, None]
    return code.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], DIMS):
        total += a[:, at : at + DIMS] @ b[:, at : at + DIMS].T
    return total


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _thin(ids: np.ndarray, x: np.ndarray, most: int):
    """Of equal vectors the ``most`` smallest ids: no more of them can be among the nearest."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    seen: dict[bytes, int] = {}
    keep = []
    for i, row in enumerate(x):
        n = seen.get(k := row.tobytes(), 0)
        seen[k] = n + 1
        keep.append(n < most)
    return ids[keep], x[keep]


def _side(table: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
    own = table.filter(pa.compute.equal(table.column("side"), side)).combine_chunks()
    ids = own.column("id").to_numpy()
    x = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    return ids[order], x[order]


def _searcher(k: int):
    """The nearest of a tile of candidates for each query of a tile."""

    def search(group: pa.Table) -> pa.Table:
        q_ids, q = _side(group, 0)
        all_ids, every = _side(group, 1)
        heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
        least = np.full(len(q_ids), -np.inf)
        if len(q_ids) and len(all_ids):
            code, scale, norm, lost = _codes(q)
            all_ids, every = _thin(all_ids, every, k + 1)
            for lo in range(0, len(all_ids), TILE):
                ids, x = all_ids[lo : lo + TILE], every[lo : lo + TILE]
                c_code, c_scale, c_norm, c_lost = _codes(x)
                near = _products(code, c_code) * scale[:, None] * c_scale[None, :]
                true_norm = np.linalg.norm(x, axis=1)
                slack = lost[:, None] * true_norm[None, :] + norm[:, None] * c_lost[None, :] + 1e-9 * (norm + lost)[:, None] * true_norm[None, :]
                near[q_ids[:, None] == ids[None, :]] = -np.inf
                floor = least
                if len(ids) > k:
                    floor = np.maximum(least, np.partition(near - slack, len(ids) - k, axis=1)[:, len(ids) - k])
                qs, cs = np.nonzero((near + slack >= floor[:, None]) & np.isfinite(near))
                for at in range(0, len(qs), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    for i, j, s in zip(qs[some].tolist(), cs[some].tolist(), _exact(q[qs[some]], x[cs[some]]).tolist()):
                        item = (s, -int(ids[j]))
                        if len(heaps[i]) < k:
                            heapq.heappush(heaps[i], item)
                        elif item > heaps[i][0]:
                            heapq.heapreplace(heaps[i], item)
                for i in set(qs.tolist()):
                    if len(heaps[i]) == k:
                        least[i] = heaps[i][0][0]
        found = [(int(q_ids[i]), -n, s) for i, h in enumerate(heaps) for s, n in h]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    return search


def _tiles(rows: DataFrame, name: str, numbers: int) -> DataFrame:
    """(n, name): how many tiles the vectors of each length have; a tile has ``numbers`` components, about."""
    return rows.groupBy("n").agg(F.ceil(F.count(F.lit(1)) * F.col("n") / numbers).cast("long").alias(name))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner products.

    Rows with the query's own id don't count; ties go to the smaller id; fewer candidates give fewer
    rows. Vectors that are not :func:`usable` and null ids take no part, and a query meets vectors of
    its own length only. A repeated query id is searched once, with its smallest vector; repeated
    candidate ids are candidates each. Empty tables give no rows, further columns are ignored.
    """
    plain = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("n")]
    fit = usable(F.col(vector_col)) & F.col(id_col).isNotNull()
    asked = cut(queries.where(fit).select(*plain).groupBy("id").agg(F.min("v").alias("v")).withColumn("n", F.size("v")))
    candidates = vectors.where(fit).select(*plain)
    # Tiles of queries and of candidates by the length of their vectors: a row a length, so Spark may broadcast it.
    grid = cut(_tiles(asked, "q_tiles", QUERY_NUMBERS).join(_tiles(candidates, "c_tiles", CANDIDATE_NUMBERS), "n"))
    # Rows are dealt by a hash of their place, so that a repeated id or vector doesn't fill a tile.
    draw = F.xxhash64(F.monotonically_increasing_id())
    q = asked.withColumn("draw", draw).join(grid, "n").select("n", F.pmod("draw", F.col("q_tiles")).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_tiles") - 1)).alias("c"), F.lit(0).alias("side"), "id", "v")
    c = candidates.withColumn("draw", draw).join(grid, "n").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_tiles") - 1)).alias("q"), F.pmod("draw", F.col("c_tiles")).alias("c"), F.lit(1).alias("side"), "id", "v")
    found = q.unionByName(c).groupBy("n", "q", "c").applyInArrow(_searcher(k), "query_id long, vec_id long, score double")
    # Each task ranks what its tiles found before the queries' rows meet.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
