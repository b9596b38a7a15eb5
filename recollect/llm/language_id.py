"""Language identification with a string kernel.

Kernel: for n = 1, 2, 3 the share of byte n-grams that two texts both have, |A and B| / sqrt(|A| |B|),
added up (a blended spectrum of presence, on the n-grams themselves). A bounded sample of labelled
texts gives Nystroem landmarks and one-versus-rest kernel ridge regression. As landmarks are fixed,
scores of a batch are one product: presence matrix times (landmark matrix transposed times coefficients).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._session import cut, small_batches
from recollect.llm._words import blocks

LENGTHS = (1, 2, 3)
#: Rows learnt from: so many a language, fewer where all languages together would have over SAMPLE_ROWS, but one at least.
TRAIN_PER_LANGUAGE = 400
SAMPLE_ROWS = 1 << 14
#: Landmarks a language, fewer where all together would be over LANDMARKS, but one at least.
LANDMARKS_PER_LANGUAGE = 32
LANDMARKS = 1 << 10
#: Rows in excess drawn to the sample before it is cut to size, so that no task ranks a whole language.
EXCESS = 4
#: Counts of languages, by the sizes of their rows, that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
RIDGE = 1e-3
SHARPNESS = 4.0
#: Numbers of the presence matrix of a batch.
CELLS = 1 << 22


def grams(block: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and codes of the different n-grams of each row, sorted by both, and how many of each length a row has.

    A code is n * 2**24 plus the n bytes read as a number.
    """
    data = np.frombuffer(block, np.uint8).astype(np.uint64)
    row = np.searchsorted(begins, np.arange(len(data)), "right") - 1
    row[begins[1:] - 1] = -1  # the joining spaces
    keys, counts, code = [], np.zeros((len(LENGTHS), len(begins))), data
    for i, n in enumerate(LENGTHS):
        if i:
            code = (code[:-1] << np.uint64(8)) | data[n - 1 :]
        first, last = row[: len(code)], row[n - 1 :]
        own = (first == last) & (first >= 0)
        key = np.unique((first[own].astype(np.uint64) << np.uint64(32)) | np.uint64(n << 24) | code[own])
        counts[i] = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(begins))
        keys.append(key)
    key = np.sort(np.concatenate(keys))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts


def _features(known: np.ndarray, block: bytes, begins: np.ndarray):
    """(lo, hi, presence of the ``known`` codes in rows [lo, hi)), each length scaled to norm 1 over all n-grams of the row."""
    rows, codes, counts = grams(block, begins)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    hit = known[at] == codes
    rows, at, length = rows[hit], at[hit], (codes[hit] >> np.uint32(24)).astype(np.int64) - LENGTHS[0]
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    step = max(1, CELLS // len(known))
    for lo in range(0, len(begins), step):
        hi = min(lo + step, len(begins))
        a, b = np.searchsorted(rows, (lo, hi))
        x = np.zeros((hi - lo, len(known)), np.float32)
        x[rows[a:b] - lo, at[a:b]] = scale[length[a:b], rows[a:b]]
        yield lo, hi, x


def _landmarks(batches):
    for batch in batches:
        for lo, hi, block, begins in blocks(batch.column(0)):
            rows, codes, _ = grams(block, begins)
            ends = np.searchsorted(rows, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([pa.array([codes[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["codes"])


def _kernel(marks):
    def kernel(batches):
        known, landmark = marks.value
        for batch in batches:
            for lo, hi, block, begins in blocks(batch.column(1)):
                rows = [row.tobytes() for _, _, x in _features(known, block, begins) for row in (x @ landmark.T).astype(np.float64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["lang", "kernel"])

    return kernel


def landmark_matrix(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All codes of the landmarks, sorted, and a scaled presence row for each landmark."""
    own = [np.frombuffer(c, np.uint32) for c in codes]
    known = np.unique(np.concatenate(own))
    x = np.zeros((len(own), len(known)), np.float32)
    for i, c in enumerate(own):
        length = (c >> np.uint32(24)).astype(np.int64)
        x[i, np.searchsorted(known, c)] = 1 / np.sqrt(np.bincount(length, minlength=max(LENGTHS) + 1)[length])
    return known, x


def fit(labels: list[str], k: np.ndarray, landmark: np.ndarray):
    """(languages, landmarks x languages coefficients, offsets): ridge regression in the Nystroem space, one against the rest.

    ``k``: kernel of each training row with each landmark.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    wide = landmark.astype(np.float64)
    values, vectors = np.linalg.eigh(wide @ wide.T)
    good = values > values[-1] * 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([k @ root, np.ones((len(k), 1))], 1)
    weight = (1 / np.bincount(y))[y] * len(y) / len(languages)  # languages count alike
    aim = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    beta = np.linalg.solve(z.T @ (z * weight[:, None]) + RIDGE * len(y) * np.eye(z.shape[1]), z.T @ (aim * weight[:, None]))
    return languages, root @ beta[:-1], beta[-1]


def _predictor(model):
    def predict(batches):
        languages, known, matrix, offset = model.value
        names = np.array(languages, object)
        for batch in batches:
            for lo, hi, block, begins in blocks(batch.column(1), 1 << 19):
                lang, score = [], []
                for _, _, x in _features(known, block, begins):
                    raw = x @ matrix + offset
                    e = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
                    lang += names[raw.argmax(1)].tolist()
                    score += (e.max(1) / e.sum(1)).astype(float).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "letter", "lang", "score"])

    return predict


def training_sample(train: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(id, lang, text, n): at most ``per_language`` rows of each language by the hash of the id, numbered from 1 in that order.

    Only hashes under a threshold, which leaves EXCESS times as many as are wanted, are ranked; the
    threshold comes to the texts, so that no others move.
    """
    known = train.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    every = F.count(F.lit(1)).over(Window.partitionBy())
    counts = cut(counts.withColumn("most", F.greatest(F.lit(1), F.least(F.lit(per_language), F.lit(float(SAMPLE_ROWS)) / every)).cast("long")))
    chance = F.shiftrightunsigned(F.xxhash64("id"), 12) / F.lit(float(1 << 52))
    few = (counts.agg(F.sum(F.octet_length("lang") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    drawn = known.join(F.broadcast(counts) if few else counts, "lang").where((chance * F.col("rows") < EXCESS * F.col("most")) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    return drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.col("most")).select("id", "lang", "text", "n")


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of ``docs``, from its whole text alone.

    Learns from ``per_language`` rows of ``train`` for each non-null language, drawn by the hash of the
    id (SAMPLE_ROWS bounds them all); that bound makes the model small. Text is lower-cased first.

    Null text and text without a letter: ``und`` with score 0; so for all rows if there is nothing to
    learn from. Null ids, ties and repeated rows are judged row by row; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    sample = cut(training_sample(train, id_col, text_col, lang_col, per_language))
    languages = sample.select("lang").distinct().count()
    if not languages:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    marks = sample.where(F.col("n") <= max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // languages))).orderBy("lang", "n")
    known, landmark = landmark_matrix(marks.select("text").mapInArrow(_landmarks, "codes binary").toArrow().column("codes").to_pylist())
    shared = spark.sparkContext.broadcast((known, landmark))
    rows = sample.select("lang", "text").mapInArrow(_kernel(shared), "lang string, kernel binary").orderBy("lang", "kernel").toArrow()
    k = np.frombuffer(b"".join(rows.column("kernel").to_pylist()), np.float64).reshape(rows.num_rows, -1)
    names, beta, offset = fit(rows.column("lang").to_pylist(), k, landmark)
    matrix = (landmark.T.astype(np.float64) @ beta).astype(np.float32)
    model = spark.sparkContext.broadcast((names, known, matrix, offset.astype(np.float32)))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"), lettered.alias("letter"))
    out = rows.mapInArrow(_predictor(model), f"doc_id {kind}, letter boolean, lang string, score double")
    return out.select("doc_id", F.when(F.col("letter"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"))
