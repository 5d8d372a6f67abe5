"""Integrity checks, storage reports, deletion plans and greedy packing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import paths as P
from . import namespace
from .content import EMPTY_SHA


def _problem(df: DataFrame, check: str, what) -> DataFrame:
    return df.select(F.lit(check).alias("check"), what.cast("string").alias("subject"))


def file_problems(files: DataFrame) -> DataFrame:
    """Rows of ``check, subject`` for each broken rule of the files table."""
    path, size, kind = F.col("path"), F.col("size"), F.col("kind")
    rules = {
        "null": F.reduce(F.array(*[F.col(c).isNull() for c in ("path", "dir", "name", "kind", "mode", "size", "sha", "mtime_ns", "batch", "attrs")]), F.lit(False), lambda a, b: a | b),
        "path": ~P.valid(path),
        "dir": (F.col("dir") != P.parent(path)) | (F.col("name") != P.basename(path)),
        "kind": ~kind.isin(0, 1, 2),
        "size": size < 0,
        "mode": F.col("mode").bitwiseAND(F.lit(~0o777)) != 0,
        "empty": (kind == 2) & ((size != 0) | (F.lower(F.hex("sha")) != EMPTY_SHA)),
        "attrs": F.exists(F.map_values("attrs"), lambda v: v.isNull()),
    }
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    rows = files.select("path", F.explode(found).alias("check"))
    return _problem(rows, "", F.col("path")).withColumn("check", F.lit("")).limit(0).unionByName(rows.select("check", F.col("path").alias("subject")))


def duplicate_paths(files: DataFrame) -> DataFrame:
    """A path twice in a batch."""
    return _problem(files.groupBy("batch", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate", F.concat_ws(":", "batch", "path"))


def order_problems(files: DataFrame) -> DataFrame:
    """Files of a segment whose paths do not rise strictly: (batch, path) after a greater or equal one. ``files`` as they were written, with Spark's file name and row position."""
    at = files.select("batch", "path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.row_index").alias("row"))
    before = F.lag("path").over(Window.partitionBy("file").orderBy("start", "row"))
    return _problem(at.withColumn("before", before).where("before >= path"), "order", F.concat_ws(":", "batch", "path"))


def loose_contents(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """What compaction would take away: contents no row names, and parts that are stored twice."""
    unused = blobs.select("sha").distinct().join(files.select("sha").distinct(), "sha", "left_anti")
    twice = blobs.groupBy("sha", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha").distinct()
    return _problem(unused, "unreferenced", F.lower(F.hex("sha"))).unionByName(_problem(twice, "stored-twice", F.lower(F.hex("sha"))))


def verify_counts(files: DataFrame, blobs: DataFrame, batches: int | None = None) -> DataFrame:
    """One row beside the violations: rows, contents, and rows that newer batches hide."""
    rows = files.agg(F.count(F.lit(1)).alias("files"))
    contents = blobs.agg(F.count_distinct("sha").alias("blobs"))
    hidden = namespace.visible(files, batches).agg(F.count(F.lit(1)).alias("visible"))
    return rows.crossJoin(contents).crossJoin(hidden).select("files", "blobs", (F.col("files") - F.col("visible")).alias("shadowed"))  # one row each


def frame_members(parts: DataFrame) -> DataFrame:
    """``pack, offset, length`` of physical frames with the contents in each: how many, their bytes, and the sorted (sha, part) list."""
    member = F.struct(F.lower(F.hex("sha")).alias("sha"), F.col("part").cast("int").alias("part"))
    return parts.groupBy("pack", "offset", "length").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"), F.sort_array(F.collect_list(member)).alias("contents"))


def file_and_directory(files: DataFrame) -> DataFrame:
    """A path that is both a file and a directory in one batch."""
    dirs = files.select("batch", F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    return _problem(files.select("batch", "path").join(dirs, ["batch", "path"], "left_semi"), "file-and-directory", F.concat_ws(":", "batch", "path"))


def part_problems(blobs: DataFrame) -> DataFrame:
    """Contents whose parts are not exactly 0..n-1."""
    by = blobs.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("d"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("n_parts").alias("said"))
    return _problem(by.where("d <> n or lo <> 0 or hi <> n - 1 or said <> n"), "parts", F.lower(F.hex("sha")))


def blob_problems(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files without content, or of another size than their content."""
    have = blobs.groupBy("sha").agg(F.sum("size").alias("_stored"))
    asked = files.where("size > 0").select("path", "sha", "size").join(have, "sha", "left")
    return _problem(asked.where("_stored is null"), "missing-blob", F.col("path")).unionByName(_problem(asked.where("_stored <> size"), "size-mismatch", F.col("path")))


def dirs_diff(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Stored directory rows that the files do not give, and the other way round."""
    cols = ["dir", "parent", "name", "depth", "n_files", "n_dirs", "bytes", "batch"]
    typed = lambda df: df.select(*[F.col(c).cast("string" if c in ("dir", "parent", "name") else "long") for c in cols])
    want, have = typed(namespace.rollup(files, per_batch=True)), typed(dirs)
    text = F.concat_ws(":", "batch", "dir")
    return _problem(have.exceptAll(want), "dirs-extra", text).unionByName(_problem(want.exceptAll(have), "dirs-missing", text))


def hash_problems(blobs: DataFrame) -> DataFrame:
    """Contents whose bytes have another hash: the deep check. Contents of several parts are hashed part by part, never joined."""
    single = blobs.where((F.col("n_parts") == 1) & (F.sha2("content", 256) != F.lower(F.hex("sha")))).select("sha")
    several = blobs.where("n_parts > 1").select("sha", "part", "content").repartition("sha").sortWithinPartitions("sha", "part").mapInArrow(_rehash, "sha binary")
    return _problem(single.unionByName(several), "hash", F.lower(F.hex("sha")))


def _rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, digest = None, None
    for batch in batches:
        bad = []
        for sha, content in zip(batch.column(0).to_pylist(), batch.column(2)):
            if sha != last:
                if last is not None and digest.digest() != last:
                    bad.append(last)
                last, digest = sha, hashlib.sha256()
            digest.update(content.as_buffer() if content.is_valid else b"")
        yield pa.record_batch([pa.array(bad, pa.binary())], names=["sha"])
    if last is not None and digest.digest() != last:
        yield pa.record_batch([pa.array([last], pa.binary())], names=["sha"])


def total_problems(files: DataFrame, batches: DataFrame) -> DataFrame:
    """Batches whose rows or bytes differ from what the manifest says."""
    have = files.groupBy(F.col("batch").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_b"))
    bad = batches.join(have, "id", "left").where("coalesce(_n, 0) <> paths or coalesce(_b, 0) <> bytes")
    return _problem(bad, "totals", F.col("id"))


def verify(files: DataFrame, dirs: DataFrame, blobs: DataFrame, batches: DataFrame, deep: bool = False, compacted: bool = False) -> DataFrame:
    """All violations as ``check, subject``; no row: all is well. ``deep``: contents are hashed again; ``compacted``: nothing is left for compaction."""
    out = file_problems(files)
    for part in (duplicate_paths(files), file_and_directory(files), part_problems(blobs), blob_problems(files, blobs), dirs_diff(files, dirs), total_problems(files, batches)):
        out = out.unionByName(part)
    if compacted:
        out = out.unionByName(loose_contents(files, blobs))
    return out.unionByName(hash_problems(blobs)) if deep else out


def storage_report(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row: rows and logical bytes; contents, their bytes and parts; parts of equal bytes, and what these repeat; contents no file names, and their bytes."""
    f = files.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))
    b = blobs.agg(F.count_distinct("sha").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("blob_bytes"), F.count(F.lit(1)).alias("parts"))
    same = blobs.groupBy(F.sha2("content", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("s"))
    d = same.agg(F.count(F.lit(1)).alias("unique_parts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_parts"), F.coalesce(F.sum((F.col("n") - 1) * F.col("s")), F.lit(0)).alias("duplicate_bytes"))
    loose = blobs.join(files.select("sha").distinct(), "sha", "left_anti").agg(F.count_distinct("sha").alias("unreferenced"), F.coalesce(F.sum("size"), F.lit(0)).alias("unreferenced_bytes"))
    return f.crossJoin(b).crossJoin(d).crossJoin(loose)  # one row each


def referenced(files: DataFrame) -> DataFrame:
    """How many rows name each content that is not empty."""
    return files.where("size > 0").groupBy("sha").agg(F.count(F.lit(1)).alias("n"))


def private_blobs(history: DataFrame, path: str) -> DataFrame:
    """Contents that only rows at or below a path name."""
    gone, kept = history.where(P.is_under(F.col("path"), path)), history.where(~P.is_under(F.col("path"), path))
    return gone.where("size > 0").groupBy("sha").agg(F.max("size").alias("size")).join(kept.select("sha").distinct(), "sha", "left_anti")


def delete_plan(history: DataFrame, path: str, events: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """One row: what removing a path from every batch takes with it."""
    gone = history.where(P.is_under(F.col("path"), path))
    now = namespace.visible(history)
    parts = [
        gone.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct("batch").alias("batches")),
        now.where(P.is_under(F.col("path"), path)).agg(F.count(F.lit(1)).alias("latest_paths")),
        private_blobs(history, path).agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("blob_bytes")),
        history.where(~P.is_under(F.col("path"), path)).agg(F.count(F.lit(1)).alias("survivors")),
    ]
    if events is not None:
        parts.append(events.where(P.is_under(F.col("trajectory"), path)).agg(F.count(F.lit(1)).alias("events")))
    if excluded is not None:
        parts.append(excluded.where(P.is_under(F.col("path"), path)).agg(F.count(F.lit(1)).alias("excluded")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def frame_gaps(frames: DataFrame) -> DataFrame:
    """``pack, offset, length`` -> for each frame the bytes no frame covers before it, and those an earlier one also covers."""
    w = Window.partitionBy("pack").orderBy("offset", "length")
    end = F.coalesce(F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frames.withColumn("gap", F.greatest(F.lit(0), F.col("offset") - end)).withColumn("overlap", F.greatest(F.lit(0), F.least(end, F.col("offset") + F.col("length")) - F.col("offset")))


def greedy_chunks(items: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Number the chunks of each key: items in order, a new chunk where the limit would be passed. One item beyond the limit is a chunk alone.

    The sum starts anew with each chunk, which no window frame expresses; keys are streamed in order, with two numbers of state.
    """
    schema = T.StructType([*items.schema.fields, T.StructField("chunk", T.IntegerType())])
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk, filled = object(), 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index(size)).to_pylist()):
                if k != last:
                    last, chunk, filled = k, 0, 0
                elif filled + n > limit:
                    chunk, filled = chunk + 1, 0
                filled += n
                out.append(chunk)
            yield batch.append_column("chunk", pa.array(out, pa.int32()))

    return items.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def raw_paths(staged: DataFrame, patterns: list[str]) -> DataFrame:
    """Staged paths that any of the regular expressions finds: what belongs in a store, not beside one."""
    return staged.where(F.col("path").rlike("|".join(f"(?:{p.replace('(?P<', '(?<')})" for p in patterns))) if patterns else staged.limit(0)


def over_limits(staged: DataFrame, patterns: list[str], most_paths: int, most_bytes: int) -> DataFrame:
    """One row: how many such paths, their bytes, and whether either is beyond its limit."""
    found = raw_paths(staged, patterns).agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return found.withColumn("refused", (F.col("paths") > most_paths) | (F.col("bytes") > most_bytes))


def inventory_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path, problem``: declared artifacts that are missing, and present ones that nothing declares."""
    missing = expected.join(actual, "path", "left_anti").select("path", F.lit("missing").alias("problem"))
    return missing.unionByName(actual.join(expected, "path", "left_anti").select("path", F.lit("undeclared").alias("problem")))
