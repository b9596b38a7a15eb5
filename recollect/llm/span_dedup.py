"""Substring dedup: words covered by a window of words that also starts in a smaller document.

With every document both reference and probe, broadcast automata would hold the whole corpus and
be streamed once for each shard, so work would grow as the square of the input (see the README).
For a fixed length a window's hash tells what a matching statistic over the length tells, and
hashes can be dealt out: each task sends each window once, for its smallest document; what recurs
inside the task is already known to be covered. A bucket of hashes then finds the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._session import small_batches
from recollect.llm._words import SPAN, U64, WordHasher, blocks, windows

WIDTH = 13
#: Bytes of text for each bucket of window hashes. The number of buckets is a power of two within these bounds.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 8 << 20, 8, 24
LOW = U64((1 << 56) - 1)


def _runs(keys: np.ndarray, owners: np.ndarray):
    """For sorted (key, owner): the first of each key, and those that have a smaller owner before them."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    least = owners[first][np.cumsum(new) - 1]
    return first, np.flatnonzero(owners > least)


def _pack(keys: np.ndarray, owners: np.ndarray) -> bytes:
    """The low 56 bits of sorted keys as gaps of 48 bits, the few wider gaps aside, and owners by their place in a list."""
    ids, place = np.unique(owners, return_inverse=True)
    kind = np.uint16 if len(ids) <= 1 << 16 else np.uint32
    low = keys & LOW
    gaps = np.diff(low, prepend=U64(0))
    wide = np.flatnonzero(gaps >> U64(48))
    head = np.array([len(keys), len(ids), len(wide)], np.int64)
    short = gaps.view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join((head.tobytes(), ids.tobytes(), wide.tobytes(), gaps[wide].tobytes(), place.astype(kind).tobytes(), short.tobytes()))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, w = (int(x) for x in np.frombuffer(data, np.int64, 3))
    ids = np.frombuffer(data, np.int64, m, 24)
    at = 24 + 8 * m
    wide, full = np.frombuffer(data, np.int64, w, at), np.frombuffer(data, np.uint64, w, at + 8 * w)
    kind = np.dtype(np.uint16 if m <= 1 << 16 else np.uint32)
    at += 16 * w
    place = np.frombuffer(data, kind, n, at)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at + kind.itemsize * n).reshape(n, 6)
    gaps = raw.reshape(-1).view(np.uint64)
    gaps[wide] = full
    return np.cumsum(gaps), ids[place]


def _short(keys: np.ndarray) -> np.ndarray:
    """48 bits of a key: enough inside one document."""
    return (keys & LOW) >> U64(8)


def _covers(keys: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """(doc_id, short keys) of covered windows, a row for each document."""
    order = np.argsort(owners, kind="stable")
    owners, keys = owners[order], _short(keys[order])
    at = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1]))) if len(owners) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(owners))
    raw = keys.view(np.uint8).reshape(-1, 8)[:, :6]
    return pa.RecordBatch.from_arrays([pa.array(owners[at] if len(at) else np.empty(0, np.int64)), pa.array([raw[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], ["doc_id", "short"])


def _indexer(width: int, bits: int):
    shift = U64(64 - bits)

    def index(batches):
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0)
            batch = batch.filter(ids.is_valid())
            owner = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(owner, kind="stable")
            owner, batch = owner[order], batch.take(pa.array(order))
            for lo, hi, block, begins in blocks(batch.column(1), 4 * SPAN):
                starts, _, h = hasher.words(block)
                row = np.searchsorted(begins, starts, "right") - 1
                keys = windows(h, width)
                if not len(keys):
                    continue
                own = np.flatnonzero(row[: len(keys)] == row[width - 1 :])
                keys, docs = keys[own], owner[lo:hi][row[own]]
                order = np.argsort(keys, kind="stable")  # documents ascend already
                keys, docs = keys[order], docs[order]
                first, again = _runs(keys, docs)
                buckets, data = [], []
                if len(again):
                    buckets.append(-1 - int(docs[again[0]]) % (1 << bits))
                    data.append(_pack(keys[again], docs[again]))
                keys, docs = keys[first], docs[first]
                at = np.searchsorted(keys >> shift, np.arange((1 << bits) + 1, dtype=U64)) if len(keys) else np.zeros((1 << bits) + 1, np.int64)
                for b in np.flatnonzero(at[1:] > at[:-1]):
                    buckets.append(int(b))
                    data.append(_pack(keys[at[b] : at[b + 1]], docs[at[b] : at[b + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])

    return index


def _resolve(group: pa.Table) -> pa.Table:
    """The covered windows of a bucket; those of a negative bucket are known already."""
    parts = [_unpack(x.as_buffer().to_pybytes()) for x in group.column("data")]
    keys, owners = np.concatenate([k for k, _ in parts]), np.concatenate([o for _, o in parts])
    if group.column("bucket")[0].as_py() >= 0:
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        _, again = _runs(keys, owners)
        keys, owners = keys[again], owners[again]
    return pa.Table.from_batches([_covers(keys, owners)])


def _remover(width: int):
    def remove(batches):
        hasher = WordHasher()
        for batch in batches:
            for lo, hi, block, begins in blocks(batch.column(1)):
                starts, ends, h = hasher.words(block)
                row = np.searchsorted(begins, starts, "right") - 1
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                keys = _short(windows(h, width))
                counts, removed, texts = np.diff(first), np.zeros(hi - lo, np.int64), []
                for r in range(hi - lo):
                    a, b = first[r], first[r + 1]
                    words = block[starts[a] : ends[b - 1]].split() if b > a else []
                    found = batch.column(2)[lo + r].as_py()
                    if found and b - a >= width:
                        raw = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 6)
                        known = np.zeros((len(raw), 8), np.uint8)
                        known[:, :6] = raw
                        hit = np.isin(keys[a : b - width + 1], known.reshape(-1).view(np.uint64))
                        edge = np.zeros(b - a + 1, np.int64)
                        at = np.flatnonzero(hit)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + width, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed[r] = int(gone.sum())
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), a row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed if a window of ``width`` consecutive
    words covers it whose words also start in a document with a smaller id, in the input as it is.
    The kept words are joined by one space. Windows are compared by a 64-bit hash.

    Null text and text without words: 0 words and an empty text. A null id neither loses words nor
    takes them from others. Rows that repeat an id are not smaller than each other. Further columns
    are ignored; ids are integers.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, (size // BUCKET_BYTES).bit_length()))
    sent = rows.mapInArrow(_indexer(width, bits), "bucket long, data binary")
    covered = sent.groupBy("bucket").applyInArrow(_resolve, "doc_id long, short binary")
    covered = covered.groupBy("doc_id").agg(F.collect_list("short").alias("short"))
    return rows.join(covered, "doc_id", "left").mapInArrow(_remover(width), "doc_id long, n_words long, n_removed long, kept_text string")
