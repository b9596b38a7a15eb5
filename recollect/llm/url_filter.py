"""URL filters: rules indexed by their rarest literal token.

Each rule is filed under one token that any URL it fits must contain; of its tokens, the one
that fewest rules have. The tokens of a URL fetch candidate rules, and only those are tested
by their regular expression. Only DataFrame functions. A short index is a literal of the plan and no
URL is shuffled; a long one is a table, joined with the tokens of the different URLs.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is a literal of the plan; more are a table that is joined by token.
PLAN_RULES = 4096


@dataclass(frozen=True)
class Rule:
    """A rule for a host, its subdomains and the start of a path, or a bare pattern.

    ``pattern`` is tested against ``host + path`` (lower-cased host). ``words`` are literals that
    a fitting URL has as whole tokens. ``rank`` decides between rules that fit: highest first.
    """

    name: str
    verdict: str
    pattern: str
    words: tuple[str, ...]
    rank: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; longer rules rank higher."""
    words = tuple(re.findall(r"[a-z0-9]+", host))
    return Rule(host + path, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), words, 1000 + len(host + path))


def word_rule(word: str, pattern: str, verdict: str = "block") -> Rule:
    """A pattern for hosts that no host rule decides; it must imply that ``word`` is a token of the URL."""
    return Rule("", verdict, pattern, (word,), 0)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal token (ties: the longest, then the first by code point)."""
    often = Counter(w for r in rules for w in set(r.words))
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        filed.setdefault(min(rule.words, key=lambda w: (often[w], -len(w), w)), []).append(rule)
    return filed


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``.

    Of the rules that fit, the highest rank decides, then the name first by code point. If none
    fits, ``rule`` is null and ``verdict`` the default; so for null URLs and URLs without ``://``.
    Rows that repeat are judged alike, further columns of ``pages`` are ignored.
    """
    filed = index(rules)
    base = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not filed:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = _literal(base, filed) if len(rules) <= PLAN_RULES else _joined(base, filed)
    rule = F.when(F.col("best.name") != "", F.col("best.name"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.lower(target), "[^a-z0-9]+"))


def _literal(base: DataFrame, filed: dict[str, list[Rule]]) -> DataFrame:
    """``base`` and best, the first of the rules that fit; the index stands in the plan."""

    def entry(rule: Rule) -> Column:
        return F.struct(F.lit(-rule.rank).alias("order"), F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"))

    target = F.concat("host", "path")
    base = base.select("*", target.alias("target"), _tokens(target).alias("tokens"))
    table = F.create_map(*[x for token, of in filed.items() for x in (F.lit(token), F.array(*map(entry, of)))])
    known = F.array(*map(F.lit, filed))
    found = F.flatten(F.transform(F.array_intersect(F.col("tokens"), known), lambda t: F.element_at(table, t)))
    fits = F.filter(found, lambda r: F.regexp_like(F.col("target"), r["pattern"]))
    return base.select("page_id", "host", "path", F.array_min(fits).alias("best"))


def _joined(base: DataFrame, filed: dict[str, list[Rule]]) -> DataFrame:
    """The same by joins: the tokens of each different URL meet the table of rules; a URL is judged once."""
    rows = [(token, -r.rank, r.name, r.verdict, r.pattern) for token, of in filed.items() for r in of]
    table = base.sparkSession.createDataFrame(rows, "token string, order long, name string, verdict string, pattern string")
    target = F.concat("host", "path")
    urls = base.select("host", "path").distinct().select("host", "path", F.explode(_tokens(target)).alias("token"))
    fits = urls.join(table, "token").where(F.regexp_like(target, F.col("pattern")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct("order", "name", "verdict")).alias("best"))
    return base.join(best, ["host", "path"], "left")
