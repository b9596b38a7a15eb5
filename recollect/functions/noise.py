"""Predicates and labels from fixed word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-operation phrases that count alone, those that count in pairs, and words that veto both.
STRONG = [
    "pub(crate)", "pub fn", "#[cfg(test)]", "#[test]",
    "impl ", "struct ", "enum ", "trait ",
    "cargo test", "cargo build", "cargo check",
    "clippy", "doc-test", "inline test",
    ".rs:", ".rs`", "mod.rs", "lib.rs", "main.rs",
    "dead code", "unused import",
    "the mutex", "the rwlock", "the pool",
]
WEAK = [
    "compile", "compilation",
    "commit ", "merge conflict",
    "test pass", "tests pass", "test fail",
    "refactor", "visibility", "accessibility",
    "replace", "rename", "moved to", "split into",
    "magic number",
    "parse_", "extract_", "resolve_",
    "codebase", "source code", "implementation",
]
VALUE = ["lesson", "decision", "never ", "always ", "don't ", "chose", "decided", "strategy", "architecture", "trade-off", "tradeoff", "不要", "必须", "禁止", "选择了", "决定"]

# Words that a shortened name should not end with.
TRAILING = ["and", "or", "for", "the", "of", "in", "on", "to", "with", "by", "a", "an", "&"]


def _hits(text: Column, words: list[str]) -> Column:
    return F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda n, w: n + F.contains(text, w).cast("int"))


def is_code_noise(text: Column) -> Column:
    low = F.lower(text)
    loud = (_hits(low, STRONG) >= 1) | (_hits(low, WEAK) >= 2)
    return F.coalesce(loud & (_hits(low, VALUE) == 0), F.lit(False))


def strip_trailing_stopwords(text: Column) -> Column:
    words = "|".join(w.replace("&", r"\&") for w in TRAILING)
    return F.regexp_replace(F.regexp_replace(text, rf"(?<=.)( ({words}))+$", ""), r"[,\s]+$", "")
