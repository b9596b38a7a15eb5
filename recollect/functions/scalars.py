"""Scalar column expressions: scoring, similarity, text measures, validation. No Python runs per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect import schema as S

CJK = "[一-鿿㐀-䶿぀-ゟ゠-ヿ가-힯]"
TOKEN = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Latin-1 and Latin Extended-A letters that decompose, and their base letters, lower case."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x180))]
    pairs = [(c, b) for c, b in pairs if b != c and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents; ASCII texts, which have none, skip the slower translation."""
    low = F.lower(text)
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, *_accents()))


def segment(text: Column) -> Column:
    """Text with a space at each bound between CJK and other letters, then its CJK bigrams."""
    split = F.regexp_replace(F.regexp_replace(text, f"({CJK})([A-Za-z0-9])", "$1 $2"), f"([A-Za-z0-9])({CJK})", "$1 $2")
    even = F.regexp_extract_all(text, F.lit(CJK + "{2}"), F.lit(0))
    odd = F.regexp_extract_all(F.regexp_replace(text, f"(?<!{CJK}){CJK}(?={CJK})", ""), F.lit(CJK + "{2}"), F.lit(0))
    return F.when(has_cjk(text), F.concat_ws(" ", split, F.array_join(F.array_distinct(F.concat(even, odd)), " "))).otherwise(text)


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, CJK text segmented."""
    low = fold(text)
    return F.regexp_extract_all(F.when(_is_ascii(low), low).otherwise(segment(low)), F.lit(TOKEN), F.lit(0))


def spaced(folded: Column) -> Column:
    """:func:`tokens` of a folded text in one string, each with a space of its own before and after it; no arrays are made."""
    runs = F.when(_is_ascii(folded), F.regexp_replace(folded, "[^a-z0-9]+", "  ")).otherwise(F.regexp_replace(segment(folded), r"[^\p{L}\p{N}]+", "  "))
    return F.concat(F.lit(" "), F.trim(runs), F.lit(" "))


def times_in(spaced_: Column, term: str) -> Column:
    """How often a term is a token of a :func:`spaced` text."""
    left = F.octet_length(F.replace(spaced_, F.lit(f" {term} "), F.lit("")))
    return ((F.octet_length(spaced_) - left) / float(len(term.encode()) + 2)).cast("int")


def tokens_in(spaced_: Column) -> Column:
    """How many tokens a :func:`spaced` text has."""
    spaces = F.octet_length(spaced_) - F.octet_length(F.replace(spaced_, F.lit(" "), F.lit("")))
    return F.when(F.octet_length(spaced_) == 2, 0).otherwise((spaces / 2.0).cast("int"))


def layer_default_decay(layer: Column) -> Column:
    return F.when(layer == S.BUFFER, 5.0).when(layer == S.WORKING, 1.0).otherwise(0.05)


def kind_decay(kind: Column) -> Column:
    """Decay rate after a promotion or demotion to Working."""
    return F.when(kind == "episodic", 1.0).when(kind == "procedural", 0.1).otherwise(0.3)


def layer_label(layer: Column) -> Column:
    return F.when(layer == S.BUFFER, "buffer").when(layer == S.WORKING, "working").when(layer == S.CORE, "core")


def is_valid_kind(kind: Column) -> Column:
    return kind.isin(*S.KINDS)


def weight(importance="importance", repetition="repetition_count", access="access_count", kind="kind", layer="layer") -> Column:
    rep = F.least(F.lit(0.7), F.log1p(F.col(repetition)) * 0.17)
    acc = F.least(F.lit(0.55), F.log1p(F.col(access)) * 0.12)
    bias = F.when(F.col(kind) == "procedural", 0.15).when(F.col(kind) == "episodic", -0.1).otherwise(0.0)
    place = F.when(F.col(layer) == S.CORE, 0.1).when(F.col(layer) == S.BUFFER, -0.1).otherwise(0.0)
    return F.col(importance) + rep + acc + bias + place


def recency(last_accessed: Column, decay_rate: Column, now_ms: int) -> Column:
    hours = F.greatest(F.lit(0.0), (F.lit(now_ms) - last_accessed) / float(S.HOUR_MS))
    bad = decay_rate.isNull() | F.isnan(decay_rate) | (F.abs(decay_rate) == float("inf"))
    rate = F.when(bad, 0.1).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.0), decay_rate)))
    return F.exp(-rate * hours / S.WEEK_HOURS)


def score(relevance: Column, weight_: Column, recency_: Column) -> Column:
    raw = relevance * (F.lit(1.0) + weight_ * 0.4 + recency_ * 0.2)
    return F.when(raw <= 0, 0.0).otherwise(F.lit(2.0) / (F.exp(raw * -2.0) + 1.0) - 1.0)


def estimate_tokens(text: Column) -> Column:
    """A CJK character is two thirds of a token, four other bytes are one; at least one token."""
    cjk = F.regexp_count(text, F.lit(CJK))
    other = F.octet_length(F.regexp_replace(text, CJK, ""))
    return F.greatest(F.lit(1), F.ceil(cjk / 1.5 + other / 4.0)).cast("long")


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def is_short_cjk_query(text: Column) -> Column:
    n = F.length(text)
    return (n > 0) & (n < 10) & has_cjk(text)


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors that are empty, of different lengths or as good as zero; null stays null."""
    product = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (product >= 1e-12)
    return F.when(a.isNull() | b.isNull(), None).when(usable, dot(a, b) / product).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def combined_similarity(cos: Column, tags: Column, t: S.Thresholds = S.DEFAULTS) -> Column:
    return cos * t.cosine_weight + tags * t.tag_weight


def dedup_words(text: Column) -> Column:
    """Different lower-case words between white space, punctuation kept, and bigrams of CJK characters."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    cjk = F.regexp_extract_all(low, F.lit(CJK + "{2}"), F.lit(0))
    shifted = F.regexp_extract_all(F.regexp_replace(low, f"(^|[^一-鿿])({CJK})", "$1"), F.lit(CJK + "{2}"), F.lit(0))
    return F.array_distinct(F.when(has_cjk(text), F.concat(words, cjk, shifted)).otherwise(words))


def words_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of :func:`dedup_words` arrays; 0 if either has fewer than three."""
    return F.when((F.size(a) < 3) | (F.size(b) < 3), 0.0).otherwise(jaccard(a, b))


def short_id(id_: Column) -> Column:
    return F.substring(id_, 1, 8)


def truncate_chars(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def sanitize_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))


def merge_tags(a: Column, b: Column, cap: int = S.MAX_TAGS) -> Column:
    return F.slice(F.array_distinct(F.concat(a, b)), 1, cap)


def format_age(ts: Column, now_ms: int) -> Column:
    minutes = F.floor((F.lit(now_ms) - ts) / 60_000)
    return F.when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440), F.lit("d ago")))


def importance_from_label(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low == "critical", 0.9).when(low == "high", 0.7).when(low == "medium", 0.5).when(low == "low", 0.3).otherwise(0.5)


def unwrap_json(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found == "", text).otherwise(found)


def title_case(tag: Column) -> Column:
    return F.initcap(F.regexp_replace(tag, "[-_]", " "))


def tag_number(tags: Column, prefix: str) -> Column:
    """N of the first tag ``prefix`` + N, else null."""
    own = F.filter(tags, lambda t: t.startswith(prefix))
    return F.when(F.size(own) > 0, F.try_to_number(F.regexp_extract(F.get(own, F.lit(0)), r"(-?\d+)$", 1), F.lit("999999999999")).cast("long"))


def day(ts_ms: Column) -> Column:
    """UTC day of epoch milliseconds; the session time zone must be UTC."""
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd")


def validation_error(content="content", layer="layer", source="source", tags="tags", kind="kind") -> Column:
    """Null if a memory is fit to store, else what is wrong first."""
    trimmed = F.trim(F.col(content))
    clean = sanitize_tags(F.coalesce(F.col(tags), F.array().cast("array<string>")))
    return (
        F.when(F.col(content).isNull() | (trimmed == ""), "empty content")
        .when(F.length(trimmed) > S.MAX_CONTENT, "content too long")
        .when(~F.col(layer).between(1, 3), "bad layer")
        .when(F.octet_length(F.col(source)) > S.MAX_SOURCE, "source too long")
        .when(F.size(clean) > S.MAX_TAGS, "too many tags")
        .when(F.exists(clean, lambda t: F.length(t) > S.MAX_TAG), "tag too long")
        .when(~is_valid_kind(F.col(kind)), "bad kind")
    )


def fact_error(*fields: str) -> Column:
    fields = fields or ("subject", "predicate", "object")
    e = F.lit(None).cast("string")
    for f in reversed(fields):
        e = F.when(F.col(f).isNull() | (F.trim(F.col(f)) == ""), f"empty {f}").when(F.length(F.col(f)) > S.MAX_FACT_FIELD, f"{f} too long").otherwise(e)
    return e


def numbered(text: Column) -> Column:
    """array<struct<no, fact>> of the lines ``N. fact``."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+\. .+$"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)\. ", 1).cast("int").alias("no"), F.regexp_extract(x, r"^\d+\. (.+)$", 1).alias("fact")))
