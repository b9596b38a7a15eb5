"""Personal data: patterns with checks, and a character-level bidirectional LSTM with CRF transitions beside them.

The patterns (:func:`base_spans`) label the corpus. From the labels a bounded sample of windows is drawn, and a tagger is
trained on them and on rewritten copies, in which the labelled span is spaced, bracketed or grouped as writers do to hide it
or as extraction breaks it ("name (at) host [dot] net", "10[.]0[.]0[.]1", digits in groups by dots, numbers without a plus).
Whole texts are then cut into windows that overlap by half, every window is decoded, and the spans of all windows of a
text are reconciled: a span cut by a window's edge is whole in the next one, what fails the check of its kind or
overlaps a pattern's span goes, and of the others the disjoint set of the largest sum of scores stays.

A span that passes the checks has a digit, an at sign or a bracket, so windows without any of them are not run.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._session import cut, small_batches
from recollect.llm._tagger import SYMBOLS, Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

#: Windows of each kind, and of none, that the tagger learns from, before rewriting. The bound of the sample.
SAMPLE = 160
#: Rewritten copies of a sampled window with a span.
COPIES = 3
#: Characters around a sampled span; a window, and how far the next one is. Added spans have at most WINDOW - STRIDE characters.
AROUND, WINDOW, STRIDE = 32, 128, 64
#: Windows decoded at once.
DECODED = 1024

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Written so that no text makes them try again: digits and labels are taken whole, as what follows is never one of them.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

TRIGGERS = np.zeros(SYMBOLS, bool)
TRIGGERS[[ord(c) for c in "0123456789@(["]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str, checksum: bool = True) -> list[Span]:
    """(start, kind, end) by code points, leftmost and non-overlapping for each kind; without ``checksum`` cards need not pass Luhn."""
    found: list[Span] = []
    edge = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > edge and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            edge = m.end()
            found.append((start, 0, edge))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and (not checksum or luhn(d)):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


AT = re.compile(r"\s*(?:[\[(]\s*(?:at|@)\s*[\])]|@)\s*", re.I)
DOT = re.compile(r"\s*(?:[\[(]\s*(?:dot|\.)\s*[\])]|\.)\s*", re.I)
SPACED_IP = re.compile(r"[0-9]+(?:\s*(?:[\[(]\s*)?\.(?:\s*[\])])?\s*[0-9]+){3}")
SPACED_CARD = re.compile(r"[0-9](?:[\s._/-]{0,3}[0-9])+")
SPACED_PHONE = re.compile(r"[+(]?[0-9](?:[\s().+/-]{0,3}[0-9])+")


def acceptable(kind: int, text: str) -> bool:
    """Whether a span that the tagger reports is a well-formed one, however it is spaced."""
    digits = _digits(text)
    if kind == 0:
        return bool(EMAIL.fullmatch(DOT.sub(".", AT.sub("@", text)))) and bool(AT.search(text)) and any(c in "@([" for c in text)
    if kind == 1:
        return bool(SPACED_IP.fullmatch(text)) and _octets(re.findall("[0-9]+", text))
    if kind == 2:
        return bool(SPACED_CARD.fullmatch(text)) and 12 <= len(digits) <= 19 and luhn(digits)
    return bool(SPACED_PHONE.fullmatch(text)) and 9 <= len(digits) <= 15 and len(digits) < len(text)


def rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """The span as a writer hides it or as extraction breaks it, with other digits."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    if kind == 0:
        name, _, host = text.partition("@")
        return name + pick(" @ ", "(at)", " (at) ", "[at]", " [at] ", "@ ") + host.replace(".", pick(".", ".", "[dot]", " [dot] ", "(dot)", "[.]"))
    if kind == 1:
        parts = [str(rng.integers(256)) for _ in range(4)]
        return pick("[.]", " . ", "(.)", ". ", " .").join(parts)
    digits = "".join(str(rng.integers(10)) for _ in _digits(text))
    if kind == 2:
        return pick(".", "/", "  ", "_", " - ", ". ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    a, b, c, d = digits[:-10] or "1", digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({b}) {c}-{d}", f"{a}-{b}-{c}-{d}", f"{b}.{c}.{d}", f"+{a}/{b}/{c}/{d}", f"00{a} {b} {c} {d}", f"{b}-{c}-{d}")


def _touches(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether one of the spans, which are in order, has a character in [low, high)."""
    starts, ends = [s[0] for s in spans], list(accumulate((s[2] for s in spans), max))

    def touches(low: int, high: int) -> bool:
        n = bisect.bisect_left(starts, high)
        return n > 0 and ends[n - 1] > low

    return touches


def _redrawn(text: str, spans: list[Span], rng: np.random.Generator) -> str:
    """The window with other letters outside of its spans, so that the tagger does not learn the words around them."""
    out = list(text)
    inside = {i for start, _, end in spans for i in range(start, end)}
    for i, c in enumerate(out):
        if c.isalpha() and i not in inside:
            new = chr(97 + int(rng.integers(26)))
            out[i] = new.upper() if c.isupper() else new
    return "".join(out)


def _windows_of(text: str) -> Iterator[tuple[int, str, list[Span]]]:
    """(stratum, window, its spans): one around each span, and around each other trigger that is in none of those."""
    spans, edge = base_spans(text, checksum=False), 0
    starts, touches = [s[0] for s in spans], _touches(spans)
    for start, kind, end in spans:
        lo, hi = max(0, start - AROUND), min(len(text), end + AROUND)
        if end - start <= WINDOW:
            near = spans[bisect.bisect_left(starts, lo) : bisect.bisect_left(starts, hi)]
            yield kind, text[lo:hi], [(a - lo, k, b - lo) for a, k, b in near if b <= hi]
    for at in np.flatnonzero(TRIGGERS[symbols(text)]).tolist():
        lo, hi = max(0, at - AROUND), min(len(text), at + AROUND)
        if at >= edge and not touches(lo, hi):
            edge = hi
            yield len(KINDS), text[lo:hi], []


def sample(docs: DataFrame, text_col: str, most: int) -> list[tuple[int, str, list[Span]]]:
    """Of each stratum the ``most`` windows of smallest hash, equal windows once, by stratum and hash.

    Tasks keep so many each, packs of tasks then, and the driver gets (len(KINDS) + 1) * most windows of at most 192 characters.
    """

    def draw(batches):
        kept: list[dict[tuple[int, str], list[Span]]] = [{} for _ in range(len(KINDS) + 1)]
        heaps: list[list] = [[] for _ in kept]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for stratum, window, spans in _windows_of(text or ""):
                    key = (zlib.crc32(window.encode("utf-8", "replace")), window)
                    heap, own = heaps[stratum], kept[stratum]
                    if key in own or len(heap) >= most and (-key[0]) <= heap[0][0]:
                        continue
                    own[key] = spans
                    heapq.heappush(heap, (-key[0], window))
                    if len(heap) > most:
                        gone = heapq.heappop(heap)
                        del own[-gone[0], gone[1]]
        rows = [(s, h, w, [{"start": a, "kind": k, "end": b} for a, k, b in v]) for s, own in enumerate(kept) for (h, w), v in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(SAMPLED.types)], SAMPLED.names)

    kind = "stratum int, hash long, window string, spans array<struct<start:int,kind:int,end:int>>"
    rows = cut(docs.select(F.col(text_col).cast("string")).mapInArrow(draw, kind).withColumn("pack", F.spark_partition_id() % 256))
    for by in (["stratum", "pack"], ["stratum"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("hash", "window"))
        rows = rows.dropDuplicates([*by, "window"]).withColumn("rank", rank).where(F.col("rank") <= most)
    drawn = rows.orderBy("stratum", "hash", "window").collect()
    return [(r.stratum, r.window, [(s.start, s.kind, s.end) for s in r.spans]) for r in drawn]


SAMPLED = pa.schema([("stratum", pa.int32()), ("hash", pa.int64()), ("window", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))])


def train(windows: list[tuple[int, str, list[Span]]], epochs: int = 10, hidden: int = 20, seed: int = 12) -> Tagger | None:
    """A tagger for the windows and COPIES rewritten copies of each with a span; none without windows that have one.

    Half of each have other letters around the spans.
    """
    if not any(spans for _, _, spans in windows):
        return None
    rng, rows = np.random.default_rng(seed), []
    for stratum, text, spans in windows:
        rows.append((text, spans))
        own = [s for s in spans if s[1] == stratum]
        for _ in range(COPIES if own else 0):
            start, kind, end = own[int(rng.integers(len(own)))]
            new = rewritten(kind, text[start:end], rng)
            by = len(new) - (end - start)
            moved = [(a + by, k, b + by) if a >= end else (a, k, b) for a, k, b in spans if a >= end or b <= start]
            rows.append((text[:start] + new + text[end:], [*moved, (start, kind, start + len(new))]))
    rows = [(_redrawn(text, spans, rng) if rng.random() < 0.5 else text, spans) for text, spans in rows]
    width = max(len(text) for text, _ in rows)
    x, y = np.zeros((2, len(rows), width), np.int64)
    for r, (text, spans) in enumerate(rows):
        x[r, : len(text)] = symbols(text)
        for start, kind, end in spans:
            y[r, start:end] = 2 + 2 * kind
            y[r, start] = 1 + 2 * kind
    model = Tagger.new(1 + 2 * len(KINDS), hidden, seed)
    model.fit(x, y, epochs=epochs, seed=seed)
    return model


def _tagged(model: Tagger, windows: list[tuple[int, int, np.ndarray, int]]) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, start, kind, end, score) of whole spans of windows (row, offset, symbols, length of the text)."""
    x = np.zeros((len(windows), max(len(w[2]) for w in windows)), np.int64)
    for r, w in enumerate(windows):
        x[r, : len(w[2])] = w[2]
    tags, margin = model.decode(x)
    kinds = (tags + 1) // 2
    begins = (tags > 0) & ((tags % 2 == 1) | (kinds != np.pad(kinds, ((0, 0), (1, 0)))[:, :-1]))
    for r, t in zip(*np.nonzero(begins)):
        row, offset, chars, size = windows[r]
        end = t + 1
        while end < len(chars) and tags[r, end] == 2 * kinds[r, t]:
            end += 1
        if (t > 0 or offset == 0) and (end < len(chars) or offset + end == size):
            yield row, offset + int(t), int(kinds[r, t]) - 1, offset + end, float(margin[r, t:end].mean())


def reconciled(text: str, base: list[Span], found: list[tuple[int, int, int, float]]) -> list[Span]:
    """The spans (start, kind, end, score) of all windows of a text that stay beside those of the patterns."""
    best: dict[Span, float] = {}
    touches = _touches(base)
    for start, kind, end, score in found:
        while end > start and (text[end - 1].isspace() or text[end - 1] in ".,;:!?"):
            end -= 1
        while end > start and (text[start].isspace() or text[start] in ".,;:!?"):
            start += 1
        if end - start <= WINDOW - STRIDE and score > 0 and acceptable(kind, text[start:end]) and not touches(start, end):
            best[start, kind, end] = max(score, best.get((start, kind, end), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s))
    # The best sum up to each end; a span adds its score to the best that ends before it begins.
    sums, chosen, ends = [0.0], [], [s[2] for s in spans]
    for k, (start, _, _) in enumerate(spans):
        before = bisect.bisect_right(ends, start, 0, k)
        with_it = sums[before] + best[spans[k]]
        chosen.append(before if with_it > sums[-1] else None)
        sums.append(max(sums[-1], with_it))
    out, k = [], len(spans)
    while k:
        before = chosen[k - 1]
        if before is None:
            k -= 1
        else:
            out.append(spans[k - 1])
            k = before
    return sorted(out)


def _finder(model: Tagger | None) -> Callable:
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def find(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            found: dict[int, list] = {}
            waiting: list = []

            def decode():
                for row, *span in _tagged(model, waiting):
                    found.setdefault(row, []).append(span)
                waiting.clear()

            for r, text in enumerate(texts):
                if model is None or not text:
                    continue
                chars = symbols(text)
                # Each trigger is in the window of its stride and in the one before.
                at = np.unique(np.flatnonzero(TRIGGERS[chars]) // STRIDE)
                for j in np.union1d(at, at[at > 0] - 1).tolist():
                    waiting.append((r, j * STRIDE, chars[j * STRIDE : j * STRIDE + WINDOW], len(chars)))
                    if len(waiting) == DECODED:
                        decode()
            if waiting:
                decode()
            out = []
            for r, text in enumerate(texts):
                more = reconciled(text, base[r], found.get(r, []))
                spans = sorted([*((s, True) for s in base[r]), *((s, False) for s in more)])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for (a, k, b), own in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(fields))], ["doc_id", "spans"])

    return find


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, epochs: int = 10) -> DataFrame:
    """(doc_id, spans), a row for each row of ``docs``; spans (kind, start, end, base) by start, then kind as in KINDS.

    Starts and ends are code points, the end exclusive. ``base`` spans are those of the patterns and always there; the
    others were added by the tagger, overlap none of them and none of each other, and have at most WINDOW - STRIDE characters.
    The tagger learns from at most ``most`` windows of each kind and of none; if no text has a span, there is none.

    Null and empty texts have no spans. Ids are passed through, null and repeated ones too, each row by itself. An empty
    table gives no rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = train(sample(docs, text_col, most), epochs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(_finder(model), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
