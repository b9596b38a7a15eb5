"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each document becomes a short vector of statistics of its whole text. Cosines of random projections
approximate a Gaussian kernel on them; each task adds up its part of the normal equations over all
labelled rows, and the sums of the parts are solved on the driver, as many numbers as features squared.
Raw scores of the labelled rows, counted in fixed bins, are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._session import cut, small_batches
from recollect.llm._words import WordHasher, blocks

FEATURES = 192
GAMMA = 0.08
RIDGE = 1e-3
SEED = 8
#: Standardised statistics are held within this many deviations.
REACH = 5.0
#: Bins of the raw score between -0.5 and 1.5.
BINS = 2000
PARTS = 16

CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()-", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~", b"\n", bytes(range(128, 256)))
#: log bytes, log words, mean word bytes, its deviation, one share for each class of bytes, upper among letters,
#: share of different words, of the most common word, of words that repeat the one before.
N_STATS = 4 + len(CLASSES) + 4


def _statistics(block: bytes, begins: np.ndarray, hasher: WordHasher) -> np.ndarray:
    n = len(begins)
    data = np.frombuffer(block, np.uint8)
    ends = np.append(begins[1:] - 1, len(data))
    size = (ends - begins).astype(np.float64)
    kind = np.full(256, len(CLASSES), np.uint8)
    for i, c in enumerate(CLASSES):
        kind[list(c)] = i
    row_of = np.repeat(np.arange(n), np.diff(np.append(begins, len(data))))
    counts = np.bincount(row_of * (len(CLASSES) + 1) + kind[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)[:, : len(CLASSES)].astype(np.float64)
    starts, stops, h = hasher.words(block)
    row = np.searchsorted(begins, starts, "right") - 1
    first = np.searchsorted(row, np.arange(n + 1))
    words = np.diff(first).astype(np.float64)
    some, w = np.maximum(size, 1), np.maximum(words, 1)
    length = (stops - starts).astype(np.float64)
    mean = np.bincount(row, length, n) / w
    spread = np.sqrt(np.maximum(np.bincount(row, length * length, n) / w - mean * mean, 0))
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[1:][again], minlength=n) / w
    distinct, common = np.zeros(n), np.zeros(n)
    for r in range(n):
        own = h[first[r] : first[r + 1]]
        if len(own):
            times = np.unique(own, return_counts=True)[1]
            distinct[r], common[r] = len(times) / len(own), times.max() / len(own)
    upper = counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    columns = [np.log1p(size), np.log1p(words), mean, spread, *(counts / some[:, None]).T, upper, distinct, common, repeats]
    return np.stack(columns, 1)


def _describe(batches):
    hasher = WordHasher()
    for batch in batches:
        for lo, hi, block, begins in blocks(batch.column(1)):
            stats = _statistics(block, begins, hasher)
            packed = pa.FixedSizeListArray.from_arrays(pa.array(stats.reshape(-1)), N_STATS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed], ["doc_id", "stats"])


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), N_STATS)


class _Map:
    """Standardise, hold within reach, project, take cosines; a constant comes last."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -REACH, REACH)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], 1)


def _adder(mapping):
    def add(batches):
        total = None
        for batch in batches:
            phi, y = mapping.value(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
            part = np.concatenate([phi.T @ phi, (phi.T @ y)[None, :]])
            total = part if total is None else total + part
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task % PARTS], pa.int32()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "task", "sums"])

    return add


def _sum(group: pa.Table) -> pa.Table:
    """The sums of a part, added in the order of tasks, so that reruns agree."""
    group = group.sort_by("task")
    total = None
    for x in group.column("sums"):
        own = np.frombuffer(x.as_buffer(), np.float64)
        total = own.copy() if total is None else total + own
    return pa.table({"part": group.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _scorer(model):
    def score(batches):
        mapping, beta = model.value
        for batch in batches:
            raw = mapping(_matrix(batch.column(1))) @ beta
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw)], ["key", "raw"])

    return score


def isotonic(position: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve fitted by pooling adjacent violators: (positions, values)."""
    pools: list[list[float]] = []
    for p, g, c in zip(position.tolist(), good.tolist(), count.tolist()):
        pools.append([p * c, g, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p / c for p, _, c in pools]), np.array([g / c for _, g, c in pools])


def classify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted), a row for each row of ``docs``, from its whole text alone.

    ``labelled``: (id, label 0 or 1); all its rows with a match in ``docs`` and a non-null label are
    learnt from; of an id with several labels the largest counts. ``score`` is the calibrated chance of label 1; ``predicted`` is 1 from ``threshold`` on.

    Null text counts as empty, and empty texts are scored like others. Without labels every score is
    1.0 and predicted 1, so that nothing is rejected unlearnt; with labels of one kind, all scores are that kind.
    Repeated rows are scored alike, null ids too; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    stats = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_describe, f"doc_id {kind}, stats array<double>"))
    answers = labelled.toDF("doc_id", "label").where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    train = cut(stats.join(answers, "doc_id").select("stats", "label"))
    moments = train.agg(F.count(F.lit(1)), *[f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return stats.select("doc_id", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    mapping = _Map(np.array(moments[1::2], float), np.array(moments[2::2], float))
    sums = train.mapInArrow(_adder(spark.sparkContext.broadcast(mapping)), "part int, task int, sums binary")
    parts = sums.groupBy("part").applyInArrow(_sum, "part int, sums binary").orderBy("part").collect()
    total = sum(np.frombuffer(p.sums, np.float64) for p in parts).reshape(FEATURES + 2, FEATURES + 1)
    beta = np.linalg.solve(total[:-1] + RIDGE * np.eye(FEATURES + 1), total[-1])
    model = spark.sparkContext.broadcast((mapping, beta))

    seen = train.select("label", "stats").mapInArrow(_scorer(model), "key double, raw double")
    bin_of = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(BINS - 1.0), (F.col("raw") + 0.5) * (BINS / 2))))
    curve = seen.groupBy(bin_of.alias("bin")).agg(F.sum("key").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    at, value = isotonic(*(np.array([float(r[i]) for r in curve]) for i in range(3)))
    knots = spark.sparkContext.broadcast(((at + 0.5) * 2 / BINS - 0.5, value))

    def calibrate(batches):
        for batch in batches:
            score = np.interp(batch.column(1).to_numpy(), *knots.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    raw = stats.mapInArrow(_scorer(model), f"key {kind}, raw double")
    scored = raw.mapInArrow(calibrate, f"doc_id {kind}, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
