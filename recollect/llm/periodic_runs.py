"""Periodic runs of words, found by Karp-Miller-Rosenberg naming.

Equal stretches of 2**k words have equal names: a level's names are the ranks of pairs of names of the
level below, so names are exact and nothing is hashed into fingerprints or sorted as suffixes. How far two places agree is read
off in one descent through the levels, forwards and backwards.

A run of period p and at least ``powers * p`` words holds a place of the grid 0, s, 2s, ... with
s = (powers - 1) * p together with the place p words on. So for each p only these pairs are candidates: those
whose words are equal are extended to the whole run. Places of all periods add up to n * log(n).

Rows are worked off in blocks of about 1 MB inside Arrow batches, without a shuffle; a document longer than that is
a block of its own, and a task holds about 100 bytes a word of it for each level it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._session import small_batches
from recollect.llm._words import blocks, edges

#: Candidate pairs looked at together.
CANDIDATES = 1 << 18
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def name_levels(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... words, as far as a stretch of that length occurs twice.

    ``words`` are names below len(words). Places whose halves are not both repeated get names of their own.
    """
    levels, width = [words], 1
    while 2 * width <= longest:
        last = levels[-1]
        n = len(last) - width
        if n <= 0:
            break
        often = np.bincount(last) > 1
        live = np.flatnonzero(often[last[:n]] & often[last[width:]])
        found, ranks = np.unique(last[live] * len(words) + last[live + width], return_inverse=True)
        if len(found) == len(live):
            break
        names = np.arange(len(found), len(found) + n)
        names[live] = ranks
        dead = np.ones(n, bool)
        dead[live] = False
        names[dead] = len(found) + np.arange(n - len(live))
        levels.append(names)
        width *= 2
    return levels


def agreement(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from places i and j (i < j) on, and how many before them."""
    ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        names = levels[k]
        y = j + ahead
        inside = np.flatnonzero(y < len(names))
        same = inside[names[(i + ahead)[inside]] == names[y[inside]]]
        ahead[same] += 1 << k
        x = i - behind - (1 << k)
        inside = np.flatnonzero(x >= 0)
        same = inside[names[x[inside]] == names[(j - behind - (1 << k))[inside]]]
        behind[same] += 1 << k
    return ahead, behind


def _candidates(words: np.ndarray, most: int, powers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid of each period up to ``most`` where the word p places on is the same."""
    n, low = len(words), 1
    most = min(most, n - 1)
    while low <= most:
        # As many periods as fill the bound, by n / ((powers - 1) * p) places each.
        high = min(most, max(low, int(low * (1 + CANDIDATES * (powers - 1) / n))))
        p = np.arange(low, high + 1)
        places = -(-(n - p) // ((powers - 1) * p))
        period = np.repeat(p, places)
        nth = np.arange(len(period)) - np.repeat(np.cumsum(places) - places, places)
        at = nth * period * (powers - 1)
        same = words[at] == words[at + period]
        yield at[same], period[same]
        low = high + 1


def find_runs(words: np.ndarray, longest: int, least: int, powers: int) -> np.ndarray:
    """Rows (start, length, period) by start, then period: the maximal runs of a sequence of names below its length.

    Length is at least ``max(least, powers * period)``, the period the smallest one. Runs have at most ``longest`` words.
    """
    levels = name_levels(words, longest)
    found = [np.empty((0, 3), np.int64)]
    for at, period in _candidates(words, longest // powers, powers):
        for lo in range(0, len(at), CANDIDATES):
            i, p = at[lo : lo + CANDIDATES], period[lo : lo + CANDIDATES]
            ahead, behind = agreement(levels, i, i + p)
            length = behind + ahead + p
            good = length >= np.maximum(least, powers * p)
            found.append(np.unique(np.stack([i - behind, length, p], 1)[good], axis=0))
    runs = np.concatenate(found)
    # One stretch is found again for multiples of its period, and with its own.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _block_runs(block: bytes, begins: np.ndarray, least: int, powers: int):
    """For the rows of a block: number of words, runs with their row, and the texts without repeats (offsets, bytes)."""
    data, n_rows = np.frombuffer(block, np.uint8), len(begins)
    starts, ends, solid = edges(data)
    row = np.searchsorted(begins, starts, "right") - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    sizes, letters = ends - starts, data[solid]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    coded = column.dictionary_encode()
    # A name of its own after each row, so that no run goes on into the next.
    words = np.empty(len(sizes) + n_rows, np.int64)
    place = np.arange(len(sizes)) + row
    words[place] = coded.indices.to_numpy()
    words[first[1:] + np.arange(n_rows)] = len(coded.dictionary) + np.arange(n_rows)
    runs = find_runs(words, int(np.diff(first).max(initial=0)), least, powers)
    runs[:, 0] -= np.searchsorted(first[1:] + np.arange(n_rows), runs[:, 0])
    of_row = row[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    turn = np.zeros(len(sizes) + 1, np.int64)
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(turn)[:-1] == 0
    # Words with a space after each but the last of a row; of these the kept ones.
    kept, kept_row = sizes[keep], row[keep]
    last = np.ones(len(kept), bool)
    last[:-1] = kept_row[1:] != kept_row[:-1]
    widths = kept + ~last
    text = np.full(widths.sum(), 32, np.uint8)
    begin = np.cumsum(widths) - widths
    text[np.repeat(begin - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())] = letters[np.repeat(keep, sizes)]
    at = np.zeros(n_rows + 1, np.int64)
    np.add.at(at, kept_row + 1, widths)
    runs[:, 0] -= first[of_row]
    return np.diff(first), of_row, runs, np.cumsum(at), text


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, powers: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` has (start, length, period) of each run, by start, then period: a
    stretch with that smallest period (words ``period`` apart are identical), of at least ``max(least, powers * period)`` words,
    that no neighbouring word extends. ``collapsed``: the words joined by one space, without those that some run
    contains after its first ``period`` words.

    Null and empty texts, and texts without words, have 0 words, no runs and an empty ``collapsed``. Ids are passed
    through, null and repeated ones too, each row by itself. An empty table gives no rows; further columns are ignored.
    """
    if powers < 2:
        raise ValueError("a run repeats its period at least twice")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        for batch in batches:
            for lo, hi, block, begins in blocks(batch.column(1)):
                n_words, of_row, runs, offsets, text = _block_runs(block, begins, least, powers)
                fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
                per_row = np.searchsorted(of_row, np.arange(hi - lo + 1)).astype(np.int32)
                texts = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(text)])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.ListArray.from_arrays(pa.array(per_row), fields), texts.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(find, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
