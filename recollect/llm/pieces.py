"""SentencePiece encoding and decoding with a relational lattice.

The frequent units (words with the spaces before them) are laid out as a lattice: their bounded
substrings, exploded, are equi-joined to the piece table, the edges grouped by unit, and a
higher-order ``aggregate`` folds them. The public model is a byte-pair model, for which a Viterbi
path gives other pieces than its merges; so the fold applies the merges, best piece first, on the
same edges (see the README). The folded units, at most FREQUENT_UNITS of them, are broadcast;
rarer ones are merged by the same rule where they occur.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm._session import cut, small_batches

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units in the broadcast table, and their greatest length in characters: under 16 MB.
FREQUENT_UNITS = 1 << 16
UNIT_CHARS = 32
#: Bytes of rare units and their ids that a worker remembers; then it forgets them all. An entry has so many more, about.
REMEMBERED_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Above so many characters a heap finds the best pair; below, a scan is faster.
SCAN_CHARS = 48
#: A merge never joins a character other than a space to a space after it, nor anything to a newline.
UNIT = " +[^ \n]*|[^ \n]+|\n"


@dataclass(frozen=True)
class Pieces:
    """The table of a byte-pair model with byte fallback."""

    rank: dict[str, tuple[float, int]]  # piece -> score, id
    byte: tuple[int, ...]  # id of each byte
    text: tuple[bytes, ...]  # bytes of each id

    @staticmethod
    def load(path: str = DEFAULT_MODEL) -> Pieces:
        """Read on the driver only."""
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        rank, byte, text = {}, [0] * 256, []
        for i in range(p.vocab_size()):
            piece = p.id_to_piece(i)
            text.append(piece.replace(SPACE, " ").encode())
            if p.is_byte(i):
                byte[int(piece[3:5], 16)] = i
                text[-1] = bytes([int(piece[3:5], 16)])
            elif p.is_control(i) or p.is_unknown(i):
                text[-1] = b""
            else:
                rank[piece.replace(SPACE, " ")] = (p.get_score(i), i)
        if any(re.search("[^ ] |\n", piece) for piece in rank):
            raise ValueError("pieces of this model cross the bounds of units")
        return Pieces(rank, tuple(byte), tuple(text))

    @property
    def longest(self) -> int:
        return max(map(len, self.rank))

    def ids(self, spans: list[str]) -> list[int]:
        """Ids of merged spans; a character that is no piece falls back to its bytes."""
        out = []
        for s in spans:
            known = self.rank.get(s)
            out += [known[1]] if known else [self.byte[b] for b in s.encode()]
        return out

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit of any length: the best pair first, of equal ones the leftmost."""
        n = len(unit)
        if n <= SCAN_CHARS:
            get, none = self.rank.get, (-math.inf, 0)
            parts = list(unit)
            scores = [get(a + b, none)[0] for a, b in zip(parts, parts[1:])]
            while scores and (best := max(scores)) > -math.inf:
                i = scores.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                if i < len(scores):
                    scores[i] = get(parts[i] + parts[i + 1], none)[0]
                if i:
                    scores[i - 1] = get(parts[i - 1] + parts[i], none)[0]
            return self.ids(parts)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (known := self.rank.get(unit[i : end[j]])):
                heapq.heappush(heap, (-known[0], i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if alive[i] and alive[j] and end[i] == j and end[j] == stop:
                alive[j] = False
                end[i] = stop
                if stop < n:
                    before[stop] = i
                    offer(i)
                if before[i] >= 0:
                    offer(before[i])
        spans, i = [], 0
        while i < n:
            spans.append(unit[i : end[i]])
            i = end[i]
        return self.ids(spans)


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, cuts): where the merges leave bounds, from (unit). Edges come from a join with the piece table."""
    spark = units.sparkSession
    long = [p for p in pieces.rank if len(p) > 1]
    table = spark.createDataFrame(pa.table({"piece": long, "score": [pieces.rank[p][0] for p in long]}))
    # The piece table is a fixed vocabulary; it doesn't grow with the input.
    n = F.length("unit")
    start = units.select("unit", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    edges = start.where("n - start >= 2").select("unit", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(pieces.longest), F.col("n") - F.col("start")))).alias("size"))
    edges = edges.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("size"))).join(F.broadcast(table), "piece")
    grouped = edges.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct((F.col("start") * 4096 + F.col("start") + F.col("size")).alias("edge"), "score"))).alias("edges"))
    grouped = units.join(grouped, "unit", "left").withColumn("n", n)

    # State: the bounds between spans. A step drops the bound inside the best edge over two spans.
    best = "array_max(transform(sequence(1, size(b) - 2), i -> struct(coalesce(edges[b[i - 1] * 4096 + b[i + 1]], double('-inf')) as score, -i as at)))"
    step = f"if(size(b) < 3, b, transform(array({best}), m -> if(m.score = double('-inf'), b, filter(b, (x, i) -> i <> -m.at)))[0])"
    cuts = f"if(edges is null, sequence(0, n), aggregate(sequence(1, n), sequence(0, n), (b, _) -> {step}))"
    return grouped.select("unit", F.expr(cuts).alias("cuts"))


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def frequent_units(docs: DataFrame, text_col: str, pieces: Pieces) -> pa.Table:
    """(unit, cuts) of the FREQUENT_UNITS units that occur most, counted over all texts, by the lattice."""
    units = docs.select(F.explode(F.regexp_extract_all(F.concat(F.lit(" "), F.col(text_col)), F.lit(UNIT), F.lit(0))).alias("unit"))
    top = units.groupBy("unit").count().where(F.length("unit") <= UNIT_CHARS).orderBy(F.desc("count"), "unit").limit(FREQUENT_UNITS)
    return lattice(cut(top.select("unit")), pieces).toArrow()


def _table(frequent: pa.Table, pieces: Pieces) -> dict[str, bytes]:
    """Ids of the frequent units as int32 bytes; made by each worker, once."""
    cut_units = zip(frequent.column("unit").to_pylist(), frequent.column("cuts").to_pylist())
    return {unit: _packed(pieces.ids([unit[a:b] for a, b in zip(cuts, cuts[1:])])) for unit, cuts in cut_units}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate(([0], np.cumsum(sizes))), np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))


def _gather(offsets: np.ndarray, values: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that ``picks`` name, end to end, and their sizes."""
    sizes = offsets[picks + 1] - offsets[picks]
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[picks] - ends + sizes, sizes)
    return values[place], sizes


def _encoder(shared):
    def encode(batches):
        # A worker keeps the broadcast value, and with it the rare units, from task to task.
        pieces, frequent, rare = shared.value
        find = re.compile(UNIT).findall
        if not rare:
            rare.update(_table(frequent, pieces))
        for batch in batches:
            out, ends = [], [0]
            for text in batch.column(1).to_pylist():
                units = find(" " + text) if text else []
                try:
                    ids = b"".join([rare[u] for u in units])
                except KeyError:
                    new = {u: _packed(pieces.merge(u)) for u in set(units) if u not in rare}
                    size = sum(4 * len(u) + len(x) + ENTRY_BYTES for u, x in new.items())
                    if rare.get(None, 0) + size > REMEMBERED_BYTES:
                        rare.clear()
                        rare.update(_table(frequent, pieces))
                    if size > REMEMBERED_BYTES:  # a text too long to be remembered
                        ids = b"".join([new[u] if u in new else rare[u] if u in rare else _packed(pieces.merge(u)) for u in units])
                    else:
                        # What was forgotten just now is merged again.
                        new |= {u: _packed(pieces.merge(u)) for u in set(units) if u not in rare and u not in new}
                        rare.update(new)
                        rare[None] = rare.get(None, 0) + size
                        ids = b"".join([rare[u] for u in units])
                out.append(ids)
                ends.append(ends[-1] + len(ids) // 4)
            flat = np.frombuffer(b"".join(out), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], [*batch.schema.names, "token_ids"])

    return encode


def _decoder(shared, column: int):
    def decode(batches):
        text = shared.value
        offsets, values = _flat([list(t) for t in text])
        values = values.astype(np.uint8)
        for batch in batches:
            lists = batch.column(column)
            out = []
            for ids in lists:
                if not ids.is_valid:
                    out.append(None)
                    continue
                raw, _ = _gather(offsets, values, np.asarray(ids.values, np.int64))
                raw = raw.tobytes().decode("utf-8", "replace")
                out.append(raw[1:] if raw[:1] == " " else raw)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return decode


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text, token_ids), a row for each row of ``docs``: what the model's own encoder gives.

    Null and empty texts have no tokens. Repeated rows are encoded alike; an empty table gives no rows.
    Further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = Pieces.load(model)
    shared = spark.sparkContext.broadcast((pieces, frequent_units(docs, text_col, pieces), {}))
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoder(shared), f"doc_id {kind}, text string, token_ids array<int>")


def decode(encoded: DataFrame, column: str = "token_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with a column decoded: the text of ``column``. Null ids give null, no ids an empty text.

    Bytes that are not UTF-8 become U+FFFD. A column named decoded is replaced.
    """
    spark: SparkSession = encoded.sparkSession
    encoded = encoded.drop("decoded")
    shared = spark.sparkContext.broadcast(Pieces.load(model).text)
    kinds = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(_decoder(shared, encoded.columns.index(column)), f"{kinds}, decoded string")
