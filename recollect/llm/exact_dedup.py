"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions. Each step groups only what the step before left in groups
of two or more, and the groupings move fixed-size rows, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._session import cut

#: Runs of white space other than one lone space; a lone space is already what they become.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: At most so many surviving lengths or (length, prefix) groups are broadcast: 24 bytes each, under 8 MB; of groups
#: with a whole hash an eighth of it. More are joined by a shuffle.
BROADCAST_GROUPS = 300_000


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal if identical after :func:`normalised`. Of equal texts the row with the
    smallest id stays. ``text_sha256`` is null where refinement ended before the full hash,
    unless ``digest_all`` asks for it on every row.

    Null text equals empty text. A null id never stays if its group has another id; in a group of null ids only, ``keep_id``
    is null and one row stays, which of these equal ones is left open. Rows that repeat an id and text all have kept = true for the
    id that stays, for nothing tells them apart. An empty table gives no rows; further columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    head, full = F.xxhash64(F.substring("body", 1, prefix_chars)).alias("head"), F.sha2(F.col("body").cast("binary"), 256)
    size = F.octet_length("body").alias("size")
    # Null ids are told apart by a number of the row, which a checkpoint fixes.
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row")
    if digest_all:
        # Every row is to have its hash, so one pass makes all three; the refinement works on them alone.
        rows = cut(rows.select("doc_id", size, head, full.alias("full"), row))
    else:
        rows = rows.select("doc_id", "body", size, head)

    sizes = _bounded(cut(rows.groupBy("size").count().where("count > 1").select("size")))
    heads = rows.select("size", "head").join(sizes, "size", "left_semi").groupBy("size", "head").count()
    heads = _bounded(cut(heads.where("count > 1").select("size", "head", F.lit(True).alias("more"))))
    marked = rows.join(heads, ["size", "head"], "left")
    if not digest_all:
        marked = cut(marked.select("doc_id", "more", F.when(F.col("more"), full).alias("full"), row))

    groups = marked.where("more").groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.min("row").alias("keep_row"), F.count(F.lit(1)).alias("group_size"))
    groups = _bounded(cut(groups.where("group_size > 1").withColumnRenamed("full", "key")), 8)
    joined = marked.join(groups, F.col("more") & (F.col("full") == F.col("key")), "left")
    keep = F.coalesce("keep_id", "doc_id")
    only_null = F.col("keep_id").isNull() & (F.col("row") == F.col("keep_row"))
    kept = F.coalesce(F.col("doc_id") == keep, F.col("group_size").isNull() | only_null)
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), F.col("full").alias("text_sha256"))


def _bounded(groups: DataFrame, width: int = 1) -> DataFrame:
    """Broadcast the groups if they are few; else they are joined by a shuffle, in which Spark can split a large group."""
    most = BROADCAST_GROUPS // width
    return F.broadcast(groups) if groups.limit(most + 1).count() <= most else groups
