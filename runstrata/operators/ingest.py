"""What one append adds: rows that changed, contents not stored yet, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: A content is cut into parts of so many bytes, so no row is unbounded.
PART = 1 << 20


def attrs_key(attrs: Column) -> Column:
    """Maps cannot be compared; their sorted entries can."""
    return F.coalesce(F.array_sort(F.map_entries(attrs)), F.array().cast("array<struct<key:string,value:string>>"))


def as_rows(entries: DataFrame, attrs, batch: int) -> DataFrame:
    """Kept entries with their hash -> file rows."""
    return entries.select(
        "path",
        P.parent(F.col("path")).alias("dir"),
        P.basename(F.col("path")).alias("name"),
        F.col("kind").cast("short").alias("kind"),
        F.col("mode").cast("int").alias("mode"),
        F.col("size").cast("long").alias("size"),
        "sha",
        F.col("mtime_ns").cast("long").alias("mtime_ns"),
        F.lit(batch).cast("long").alias("batch"),
        attrs.alias("attrs"),
    )


SAME = ("sha", "kind", "mode", "size", "mtime_ns")


def changed(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose path is not visible, or is with another content, kind, mode, size, time or attributes."""
    new = rows.withColumn("_attrs", attrs_key(F.col("attrs")))
    old = seen.select("path", *SAME, attrs_key(F.col("attrs")).alias("_attrs"))
    return new.join(old, ["path", *SAME, "_attrs"], "left_anti").select(*rows.columns)


def new_blobs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``sha, content`` of contents that are not empty and not known, each once."""
    return rows.where("size > 0 and content is not null").select("sha", "content").dropDuplicates(["sha"]).join(known.select("sha").distinct(), "sha", "left_anti")


def wanted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``sha, size`` of contents that rows name, that are not empty and not known, each once."""
    return rows.where("size > 0").groupBy("sha").agg(F.max("size").alias("size")).join(known.distinct(), "sha", "left_anti")


def new_contents(entries: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """``sha, content`` of the entries that have one with them (``_here``), each once; ``some``: only of these hashes. Copies within a task go before the one shuffle of contents."""
    once = entries.where("size > 0 and _here").select("sha", "content").dropDuplicates(["sha"])
    return once if some is None else once.join(some.select("sha"), "sha", "left_semi")


def as_parts(blobs: DataFrame, part: int = PART) -> DataFrame:
    """``sha, part, n_parts, size, content``."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / part)).cast("int")
    cut = blobs.withColumn("n_parts", n).withColumn("part", F.explode(F.expr("sequence(0, n_parts - 1)")))
    content = F.expr(f"substring(content, part * {part} + 1, {part})")
    return cut.select("sha", F.col("part").cast("int").alias("part"), "n_parts", F.octet_length(content).cast("long").alias("size"), content.alias("content"))


def pieces_as_parts(pieces: DataFrame, rows: DataFrame, known: DataFrame, piece: int, part: int = PART) -> DataFrame:
    """Pieces of ``piece`` bytes (``sha, piece, content``) of large contents that ``rows`` name and that are not known -> their parts, each once."""
    new = rows.where("size > 0").groupBy("sha").agg(F.max("size").alias("_whole")).join(known.select("sha").distinct(), "sha", "left_anti")
    once = pieces.groupBy("sha", "piece").agg(F.first("content").alias("content")).join(new, "sha")
    cut = once.withColumn("k", F.explode(F.expr(f"sequence(0, cast(ceil(octet_length(content) / {part}) as int) - 1)")))
    content = F.expr(f"substring(content, k * {part} + 1, {part})")
    return cut.select("sha", (F.col("piece") * (piece // part) + F.col("k")).cast("int").alias("part"), F.ceil(F.col("_whole") / part).cast("int").alias("n_parts"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


def summary(rows: DataFrame, blobs: DataFrame, excluded: DataFrame) -> dict:
    """Counts of one batch."""
    r = rows.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    b = blobs.agg(F.count_distinct("sha").alias("new_blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("new_blob_bytes")).first()
    return r.asDict() | b.asDict() | {"excluded": excluded.count()}
