"""Versioned Parquet tables, JSON import and export, chat payload parsers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import scalars as X

#: Size of a file of a compacted table, about.
FILE_BYTES = 128 << 20


class VersionedTable:
    """A table whose every write is a new folder ``v=N``; a pointer file names the current one.

    Readers keep what they opened, and a failed write leaves the pointer as it was.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path, self.ddl = spark, path.rstrip("/"), ddl

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        p, fs = self._file("_current")
        if not fs.exists(p):
            return 0
        stream = fs.open(p)
        try:
            return int(stream.readUTF())
        finally:
            stream.close()

    def read(self) -> DataFrame:
        n = self.version()
        if not n:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(f"{self.path}/v={n}")

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        n = self.version() + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/v={n}")
        p, fs = self._file("_current")
        stream = fs.create(p, True)
        try:
            stream.writeUTF(str(n))
        finally:
            stream.close()
        return n

    def compact(self, files: int | None = None, file_bytes: int = FILE_BYTES) -> int:
        """Rewrite as fewer files: as many as asked for, or so many that each, and what one task reads, is about ``file_bytes``."""
        if files is None:
            p, fs = self._file(f"v={self.version()}")
            held = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
            files = max(1, math.ceil(held / file_bytes))
        return self.write(self.read().coalesce(files))


def decode_rows(raw: DataFrame) -> DataFrame:
    """MEMORY_DDL rows from loosely typed ones: bad layers become Buffer, bad tags none, missing names defaults."""
    have = set(raw.columns)

    def col(name: str, kind: str, default=None) -> Column:
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return c if default is None else F.coalesce(c, F.lit(default).cast(kind))

    tags = F.col("tags") if "tags" in have else F.lit("[]")
    if "tags" in have and dict(raw.dtypes)["tags"] == "string":
        tags = F.from_json("tags", "array<string>")
    elif "tags" not in have:
        tags = F.array().cast("array<string>")
    layer = F.when(col("layer", "int").between(1, 3), col("layer", "int")).otherwise(S.BUFFER)
    created = col("created_at", "long", 0)
    return raw.select(
        col("id", "string").alias("id"), col("content", "string", "").alias("content"), layer.alias("layer"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), col("importance", "double", 0.5))).alias("importance"),
        created.alias("created_at"), col("last_accessed", "long", 0).alias("last_accessed"), col("access_count", "long", 0).alias("access_count"), col("repetition_count", "long", 0).alias("repetition_count"),
        F.coalesce(col("decay_rate", "double"), X.layer_default_decay(layer)).alias("decay_rate"), col("source", "string", "api").alias("source"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), col("namespace", "string", "default").alias("namespace"),
        col("embedding", "array<float>").alias("embedding"), col("kind", "string", "semantic").alias("kind"), F.greatest(col("modified_at", "long", 0), created).alias("modified_at"), col("modified_epoch", "long", 0).alias("modified_epoch"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Memories from JSON: an array of objects, or one object a line."""
    raw = spark.read.option("multiLine", True).json(path)
    return decode_rows(raw)


def import_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` to add: one with an id of the same namespace is skipped, of another gets a new id."""
    known = existing.select(F.col("id").alias("_id"), F.col("namespace").alias("_ns"))
    here = incoming.join(known, (F.col("id") == F.col("_id")) & (F.col("namespace") == F.col("_ns")), "left_anti")
    ids = existing.select(F.col("id").alias("_id")).distinct()
    clash = here.join(ids, F.col("id") == F.col("_id"), "left")
    return clash.withColumn("id", F.when(F.col("_id").isNull(), F.col("id")).otherwise(F.expr("uuid()"))).withColumn("modified_at", F.greatest("modified_at", "created_at")).drop("_id")


def export_rows(memories: DataFrame, vectors: bool = False) -> DataFrame:
    """All memories, oldest first."""
    df = memories if vectors else memories.drop("embedding")
    return df.orderBy("created_at", "id")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def user_text(content: Column) -> Column:
    """Text of a message's ``content`` JSON: a string, or blocks of type text joined by a space."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    plain = F.from_json(F.concat(F.lit('{"c":'), content, F.lit("}")), "struct<c:string>")["c"]
    return F.when(F.ltrim(content).startswith("["), F.array_join(texts, " ")).otherwise(plain)


ASSISTANT_CHARS = 6000


def assistant_text(body: Column) -> Column:
    """Text of a response: server-sent ``data:`` lines of either delta shape, else one JSON object."""
    lines = F.filter(F.split(body, "\r?\n"), lambda x: x.startswith("data: ") & (F.trim(F.substring(x, 7, 1 << 30)) != "[DONE]"))
    piece = lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.get_json_object(x, "$.delta.text"), F.lit(""))
    streamed = F.array_join(F.transform(lines, lambda x: piece(F.substring(x, 7, 1 << 30))), "")
    whole = F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.get_json_object(body, "$.content[0].text"), F.lit(""))
    return F.substring(F.when(F.size(lines) > 0, streamed).otherwise(whole), 1, ASSISTANT_CHARS)


def numbered_facts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each ``N. fact`` line of each text, with the line's number as no and the fact."""
    return df.select("*", F.explode(X.numbered(F.col(text_col))).alias("_f")).select(*df.columns, "_f.no", "_f.fact")


def parse_messages(request: str) -> list[tuple[str, str]]:
    """(role, text) of a chat request, on the driver; for tests and small tools."""
    out = []
    for m in json.loads(request).get("messages", []):
        c = m.get("content")
        text = c if isinstance(c, str) else " ".join(b.get("text", "") for b in c or [] if b.get("type") == "text")
        out.append((m.get("role", ""), text))
    return out
