"""Exact cosine joins with pruning: pivots, rings and the triangle inequality of angles.

Angles between unit vectors are a metric. A bounded number of pivots is chosen; every vector is at home in the cell of
its nearest pivot. For each cell and pivot the smallest and largest angle of its vectors is known, so a vector whose own angle
to some pivot is further from that range than the threshold's angle has no partner in the cell and isn't sent there. In
a cell, rows lie in rings by their angle to its pivot, and rings further apart than the threshold's angle don't meet.
What is left meets in blocks of at most about BLOCK_ROWS rows, as matrix products. Nothing is lost: the bounds only leave out what can't match.
Where there are few rows, or the vectors lie so that rows would be sent to over one other cell on average, cells cost more than they save, and the blocks of each group
meet without pivots. Groups in which no two rows may meet are left out first.

Rows say how they take part in their group ``g`` by ``mode``: OLD rows meet no other OLD row, NEW rows meet all OLD and NEW ones,
PROBE rows meet all OLD and NEW ones but not each other. So the work grows with what is new, not with the square of all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scalars as X
from recollect.operators.lineage import cut

OLD, NEW, PROBE = 0, 1, 2
#: Rows of a block, on average, if its vectors have no more components than BLOCK_FLOATS; pivots at most; vectors they are chosen from; rings of a cell.
BLOCK_ROWS, BLOCK_FLOATS, PIVOTS, SAMPLE, RINGS = 8192, 1 << 19, 128, 1024, 512
#: Tables of up to so many blocks' rows meet without pivots, as choosing them costs more than it saves.
FEW_BLOCKS = 4
#: Rows of a block that are multiplied with another block at once; pairs that are looked at and told at once.
TILE, TOLD = 512, 1 << 18
#: Numbers of each side that are copied at once to compute pairs in double precision, whatever their vectors' length.
GATHERED = 1 << 20
#: Added to angles before they are compared, for rounding.
SLACK = 1e-5
#: How a row stands in a cell: at home, or sent there. A row sent from a cell after it meets only what is old.
HOME_OLD, HOME_NEW, SENT, SENT_BACK = 0, 1, 2, 3
BLOCK = ["role", "block", "part"]


def _rows(rows: DataFrame) -> DataFrame:
    """(g, id, embedding, mode, n) of the rows that can have a cosine."""
    fine = rows.where(F.col("embedding").isNotNull() & (X.norm(F.col("embedding")) > 0))
    return fine.select(F.col("g").cast("string").alias("g"), F.col("id").cast("string").alias("id"), "embedding", F.col("mode").cast("int").alias("mode"), F.size("embedding").alias("n"))


def block_rows(n: Column, most: int | None = None) -> Column:
    """How many rows with ``n`` components are a block."""
    return F.least(F.lit(most or BLOCK_ROWS), F.greatest(F.lit(1), F.floor(BLOCK_FLOATS / n))).cast("long")


def _partnered(rows: DataFrame) -> DataFrame:
    """Rows of the groups in which some two rows may meet."""
    of = lambda mode: F.count_if(F.col("mode") == mode)
    groups = rows.groupBy("g", "n").agg(of(NEW).alias("new"), of(PROBE).alias("probe"), of(OLD).alias("old"))
    some = groups.where("new > 1 or (new > 0 and old + probe > 0) or (probe > 0 and old > 0)").select("g", "n")
    return rows.join(some, ["g", "n"], "left_semi")


def choose_pivots(rows: DataFrame, most: int | None = None) -> dict[int, np.ndarray]:
    """Unit pivots by number of components: of a sample by hash, each the one farthest from those before.

    The driver gets about SAMPLE vectors, whatever the number of rows.
    """
    total = rows.count()
    most = most or min(PIVOTS, max(2, math.isqrt(total) // 2))
    share = max(1, total // SAMPLE)
    draw = F.xxhash64("id", F.lit("pivots"))
    drawn = rows.where(F.pmod(draw, F.lit(share)) == 0).select("n", "embedding", draw.alias("draw")).orderBy("draw").limit(SAMPLE).collect()
    found: dict[int, np.ndarray] = {}
    for n in sorted({r.n for r in drawn}):
        x = np.array([r.embedding for r in drawn if r.n == n], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        picked, nearest = [0], np.arccos(np.clip(x @ x[0], -1, 1))
        for _ in range(min(max(1, most * len(x) // len(drawn)), len(x)) - 1):
            far = int(nearest.argmax())
            if nearest[far] < SLACK:
                break
            picked.append(far)
            nearest = np.minimum(nearest, np.arccos(np.clip(x @ x[far], -1, 1)))
        found[n] = x[picked]
    return found


def _angles(batch: pa.RecordBatch, pivots: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, rows of the batch, their angles to the pivots) for each number of components; without pivots, one angle of 0."""
    sizes = batch.column("n").to_numpy()
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        x = batch.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
        if n in pivots:
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield n, at, np.arccos(np.clip(unit @ pivots[n].T, -1, 1))
        else:
            yield n, at, np.zeros((len(at), 1))


Bounds = dict[int, tuple[np.ndarray, np.ndarray]]


def cell_bounds(rows: DataFrame, pivots: dict[int, np.ndarray]) -> Bounds:
    """By number of components, the smallest and largest angle of the rows at home in each cell to each pivot: (cell, pivot)."""

    def measure(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n, _, angles in _angles(batch, pivots):
                k = angles.shape[1]
                low, high = seen.setdefault(n, (np.full((k, k), np.inf), np.full((k, k), -np.inf)))
                np.minimum.at(low, angles.argmin(1), angles)
                np.maximum.at(high, angles.argmin(1), angles)
        out = [(n, int(c), low[c].tolist(), high[c].tolist()) for n, (low, high) in seen.items() for c in np.flatnonzero(np.isfinite(low[:, 0]))]
        names = ["n", "cell", "low", "high"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())])], names)

    each = rows.where(F.col("mode") != PROBE).select("n", "embedding").mapInArrow(measure, "n int, cell int, low array<double>, high array<double>")
    flat = each.select("n", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "x"))
    found: Bounds = {}
    for r in flat.groupBy("n", "cell", "pivot").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).collect():
        k = len(pivots[r.n]) if r.n in pivots else 1
        low, high = found.setdefault(r.n, (np.full((k, k), np.inf), np.full((k, k), -np.inf)))
        low[r.cell, r.pivot], high[r.cell, r.pivot] = r.low, r.high
    return found


PLACED = "g string, id string, embedding array<float>, n int, cell int, role int, angle double"


def _stays(modes: np.ndarray, own: np.ndarray, angles: np.ndarray, bounds: tuple, theta: float, any_old: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, rows, roles): rows at home in their cell, and sent to each other cell that can hold a partner."""
    home = np.flatnonzero(modes != PROBE)
    for c in np.unique(own[home]).tolist():
        at = home[own[home] == c]
        yield c, at, np.where(modes[at] == NEW, HOME_NEW, HOME_OLD)
    low, high = bounds
    for c in range(len(low)):
        # No partner in the cell, by the range of any pivot.
        near = ((angles >= low[c] - theta) & (angles <= high[c] + theta)).all(1)
        sent = np.flatnonzero(near & ((modes == PROBE) | ((modes == NEW) & ((own < c) | any_old & (own > c)))))
        yield c, sent, np.where((modes[sent] == NEW) & (own[sent] > c), SENT_BACK, SENT)


#: Bounds of no cell, and of the one cell that vectors without pivots are in.
NONE, ONE = (np.empty((0, 0)), np.empty((0, 0))), (np.zeros((1, 1)), np.zeros((1, 1)))


def _placer(pivots: dict[int, np.ndarray], bounds: Bounds, theta: float, any_old: bool) -> Callable:
    def place(batches):
        for batch in batches:
            modes = batch.column("mode").to_numpy()
            for n, at, angles in _angles(batch, pivots):
                for cell, row, role in _stays(modes[at], angles.argmin(1), angles, bounds.get(n, NONE if n in pivots else ONE), theta, any_old):
                    if len(row):
                        picked = [batch.column(k).take(pa.array(at[row])) for k in ("g", "id", "embedding", "n")]
                        made = [pa.array(np.full(len(row), cell, np.int32)), pa.array(role.astype(np.int32)), pa.array(angles[row, cell])]
                        yield pa.RecordBatch.from_arrays([*picked, *made], ["g", "id", "embedding", "n", "cell", "role", "angle"])

    return place


def _places(rows: DataFrame, pivots: dict[int, np.ndarray], bounds: Bounds, theta: float, any_old: bool) -> int:
    """How many rows the placer would make."""

    def count(batches):
        for batch in batches:
            modes = batch.column("mode").to_numpy()
            made = sum(len(row) for n, at, angles in _angles(batch, pivots) for _, row, _ in _stays(modes[at], angles.argmin(1), angles, bounds.get(n, NONE if n in pivots else ONE), theta, any_old))
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["made"])

    return rows.select("mode", "n", "embedding").mapInArrow(count, "made long").agg(F.sum("made")).first()[0] or 0


def _blocks(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their block, and the blocks (g, n, cell, role, block, part, low, high, size): rings filled up to BLOCK_ROWS; a fuller ring is dealt by hash."""
    ring = F.least(F.floor(F.col("angle") / math.pi * RINGS), F.lit(RINGS - 1)).cast("int")
    rows, key = placed.withColumn("ring", ring), ["g", "n", "cell", "role"]
    before = Window.partitionBy(*key).orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    rings = rows.groupBy(*key, "ring").agg(F.count(F.lit(1)).alias("size"))
    rings = rings.withColumn("block", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / block_rows(F.col("n"))))
    rings = cut(rings.withColumn("parts", F.ceil(F.col("size") / block_rows(F.col("n")))))
    at = rows.join(rings.select(*key, "ring", "block", "parts"), [*key, "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    each = rings.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = each.groupBy(*key, "block", "part").agg(F.min("ring").alias("low"), F.max("ring").alias("high"), F.sum(F.col("size") / F.col("parts")).alias("size"))
    return at.drop("ring", "parts", "angle"), blocks


def _block_pairs(blocks: DataFrame, theta: float) -> DataFrame:
    """Which blocks of a cell meet: (g, n, cell, role, block, part) as x and y, and the cells of their product."""
    x, y = (blocks.select("g", "n", "cell", *[F.col(c).alias(f"{c}_{s}") for c in [*BLOCK, "low", "high", "size"]]) for s in "xy")
    pairs = x.join(y, ["g", "n", "cell"])
    home_first = F.struct("block_x", "part_x") <= F.struct("block_y", "part_y")
    meets = (F.col("role_y") == HOME_OLD) & (F.col("role_x") != HOME_OLD)
    meets |= (F.col("role_y") == HOME_NEW) & ((F.col("role_x") == SENT) | ((F.col("role_x") == HOME_NEW) & home_first))
    wide = math.ceil(theta / math.pi * RINGS) + 1
    close = (F.col("low_x") - F.col("high_y") <= wide) & (F.col("low_y") - F.col("high_x") <= wide)
    return pairs.where(meets & close).select("g", "n", "cell", *[f"{c}_{s}" for s in "xy" for c in BLOCK], (F.col("size_x") * F.col("size_y")).alias("products"))


def hits(x: np.ndarray, y: np.ndarray | None, low: float, high: float = 2.0, inclusive: bool = False, wanted: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of rows of ``x`` and of ``y``, or i < j of ``x`` alone, with low < cosine <= high, some at a time.

    ``wanted`` tells of pairs (i, j) whether they are still looked for.

    Tiles of unit vectors are multiplied in single precision; what comes near the bounds is computed in double precision.
    """
    norms = [np.linalg.norm(v, axis=1) for v in (x, x if y is None else y)]
    with np.errstate(all="ignore"):
        units = [(v / np.maximum(n, 1e-300)[:, None]).astype(np.float32) for v, n in zip((x, x if y is None else y), norms)]
    other, slack = x if y is None else y, max(1, x.shape[1]) * 2.0**-22
    for lo in range(0, len(x), TILE):
        from_ = lo if y is None else 0
        with np.errstate(all="ignore"):
            s = units[0][lo : lo + TILE] @ units[1][from_:].T
        near = s >= low - slack
        if high < 1:
            near &= s <= high + slack
        if low <= 0:  # a product of lengths near 0 counts as a cosine of 0
            near |= norms[0][lo : lo + TILE, None] * norms[1][None, from_:] < 1e-12
        if y is None:
            near = np.triu(near, 1)
        rows, columns = np.nonzero(near)
        for k in range(0, len(rows), TOLD):
            i, j = rows[k : k + TOLD] + lo, columns[k : k + TOLD] + from_
            if wanted is not None:
                still = wanted(i, j)
                i, j = i[still], j[still]
            product, dot, step = norms[0][i] * norms[1][j], np.empty(len(i)), max(1, GATHERED // max(1, x.shape[1]))
            with np.errstate(all="ignore"):
                for m in range(0, len(i), step):
                    dot[m : m + step] = np.einsum("ij,ij->i", x[i[m : m + step]], other[j[m : m + step]])
                exact = np.where(product >= 1e-12, dot / np.maximum(product, 1e-12), 0.0)
                fine = ((exact >= low) if inclusive else (exact > low)) & (exact <= high)
            if fine.any():
                yield i[fine], j[fine], exact[fine]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def in_order(a: pa.Array, b: pa.Array, *more: pa.Array) -> list[pa.Array]:
    """Ids of pairs, the smaller first, and what else they have; pairs of one id are left out."""
    keep = pc.not_equal(a, b)
    a, b, *more = (c.filter(keep) for c in (a, b, *more))
    swap = pc.greater(a, b)
    return [pc.if_else(swap, b, a), pc.if_else(swap, a, b), *more]


def block_products(low: float, high: float, inclusive: bool) -> Callable:
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, ids = table.column("side").to_numpy(), table.column("id").combine_chunks()
        g, v = table.column("g")[0].as_py(), matrix(table.column("embedding"))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = table.column("alone")[0].as_py()  # a block with itself
        del table
        for i, j, s in hits(v[one], None if alone else v[two], low, high, inclusive):
            a, b, s = in_order(ids.take(pa.array(one[i])), ids.take(pa.array((one if alone else two)[j])), pa.array(s))
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(a), pa.string()), a, b, s], ["g", "a", "b", "similarity"])

    return products


def plan(rows: DataFrame, low: float, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their blocks, pairs of blocks that meet); the sum of ``products`` is how many vectors are multiplied."""
    if low <= 0:
        raise ValueError("pruning needs a cosine above 0")
    whole = cut(_rows(rows))
    rows, theta = _partnered(whole), math.acos(min(1.0, low)) + SLACK
    chosen, bounds, any_old = {}, {}, False
    if pivots is not None or whole.count() > FEW_BLOCKS * BLOCK_ROWS:
        chosen = choose_pivots(rows, pivots)
        any_old = not rows.where(F.col("mode") == OLD).isEmpty()
        bounds = cell_bounds(rows, chosen)
        if pivots is None and _places(rows, chosen, bounds, theta, any_old) > 2 * rows.count():
            chosen, bounds = {}, {}
    place = _placer(chosen, bounds, theta, any_old)
    placed = cut(rows.select("g", "id", F.col("embedding").cast("array<float>").alias("embedding"), "mode", "n").mapInArrow(place, PLACED))
    at, blocks = _blocks(placed)
    return at, cut(_block_pairs(blocks, theta))


def near_pairs(rows: DataFrame, low: float, high: float = 2.0, inclusive: bool = False, pivots: int | None = None) -> DataFrame:
    """(g, a, b, similarity), a < b as strings: pairs of one group with low < cosine <= high that ``mode`` lets meet. Exact.

    ``rows``: (g, id, embedding, mode), an id at most once in a group as OLD or NEW. Null and zero vectors have no pairs;
    vectors of different length don't meet. An empty table gives no rows.
    """
    at, pairs = plan(rows, low, pivots)
    names = [f"{c}_{s}" for s in "xy" for c in BLOCK]
    own = F.lit(True)
    for c in BLOCK:
        own = own & (F.col(f"{c}_x") == F.col(f"{c}_y"))
    sides = []
    for k, s in enumerate("xy"):
        # A block that meets itself is sent once.
        met = (pairs if s == "x" else pairs.where(~own)).drop("products")
        one = at.select("g", "n", "cell", *[F.col(c).alias(f"{c}_{s}") for c in BLOCK], "id", "embedding", F.lit(k).alias("side"))
        sides.append(met.join(one, ["g", "n", "cell", *[f"{c}_{s}" for c in BLOCK]]).select("g", "n", "cell", *names, "side", own.alias("alone"), "id", "embedding"))
    dealt = sides[0].unionByName(sides[1]).groupBy("g", "n", "cell", *names)
    return dealt.applyInArrow(block_products(low, high, inclusive), "g string, a string, b string, similarity double")
