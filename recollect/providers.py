"""Hooks for models, with defaults that need no network and give the same answer every time."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 64
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Signed hashed word counts, scaled to length 1; an empty text gives zeros."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, text in enumerate(texts):
        for w in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dims] += 1 if h & (1 << 20) else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(n, 1e-12)


def embed(df: DataFrame, text_col: str = "content", out_col: str = "embedding", embedder: Embedder = hashing_embedder, batch: int = 50, tries: int = 3) -> DataFrame:
    """``df`` with vectors, in batches of ``batch`` texts; a batch that fails is tried again, a wrong count is an error."""
    kept = [c for c in df.columns if c != out_col]
    at = kept.index(text_col)
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.select(*kept).dtypes)

    def run(batches):
        for b in batches:
            texts, rows = b.column(at).to_pylist(), []
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                for n in range(tries):
                    try:
                        got = embedder(part)
                        break
                    except Exception:
                        if n + 1 == tries:
                            raise
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                rows += [np.asarray(v, np.float32) for v in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float32()))], [*b.schema.names, out_col])

    return df.select(*kept).mapInArrow(run, f"{kinds}, `{out_col}` array<float>")


def approve_all(candidates: DataFrame) -> DataFrame:
    return candidates.select("id", F.lit(True).alias("approve"))


def rule_judge(candidates: DataFrame) -> DataFrame:
    """Approves what was used five times."""
    return candidates.select("id", (F.col("access_count") >= 5).alias("approve"))


def first_sentences(texts: list[str], limit: int = 500) -> str:
    """The first sentence of each text, joined while they fit."""
    out = ""
    for t in texts:
        s = re.split(r"(?<=[.!?])\s", t.strip())[0]
        if len(out) + len(s) + 1 > limit:
            break
        out = f"{out} {s}".strip()
    return out or "".join(texts)[:limit]


def expand_words(query: str) -> list[str]:
    """The longest words of a query, each a query of its own."""
    return sorted(set(re.findall(r"\w{4,}", query.lower())), key=lambda w: (-len(w), w))[:3]
