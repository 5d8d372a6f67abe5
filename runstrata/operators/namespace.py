"""The visible namespace and what is asked of it: listings, rollups, find, du, stat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def latest(history: DataFrame) -> DataFrame:
    """The newest row of each path, whatever else hides it."""
    cols = history.columns
    rows = history.groupBy("path").agg(F.max_by(F.struct(*cols), "batch").alias("r"))
    return rows.select(*[F.col(f"r.{c}").alias(c) for c in cols])


def visible(history: DataFrame, batches: int | None = None) -> DataFrame:
    """Rows that no newer batch hides: the path's own newest row, unless a newer batch made an ancestor a file or the path a directory.

    With a single batch nothing can be hidden. Else the conflicts are found on directories, not on files: each path's
    newest batch is reduced to the oldest and newest one of every directory, and few paths are both a file and a
    directory of that table. Full rows are touched last, by one semi-join. Filters other than ``deciding`` go above this.
    """
    if batches == 1:
        return history
    key = history.groupBy("path").agg(F.max("batch").alias("batch"), F.first("dir").alias("dir"))
    direct = key.groupBy("dir").agg(F.min("batch").alias("oldest"), F.max("batch").alias("newest"))
    above = direct.select(F.explode(P.self_and_ancestors(F.col("dir"))).alias("path"), "oldest", "newest").where("path <> ''")
    both = above.groupBy("path").agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest")).join(key.select("path", "batch"), "path")
    became_dir = both.where("newest > batch").select("path")
    became_file = both.where("oldest < batch").select("path", F.col("batch").alias("file_batch"))
    over = direct.select("dir", F.explode(P.self_and_ancestors(F.col("dir"))).alias("path")).join(became_file, "path").groupBy("dir").agg(F.max("file_batch").alias("file_batch"))
    hidden = key.join(over, "dir").where("batch < file_batch").select("path").unionByName(became_dir)
    now = key.join(hidden.distinct(), "path", "left_anti").select("path", "batch")
    return history.join(now, ["path", "batch"], "left_semi").select(*history.columns)


def deciding(directory: str) -> Column:
    """Whether a row of the history matters to what is visible at or below a directory: its own rows, those below it, and files in place of a directory above. ``visible`` of these alone is exact there, so the prefix may reach the scan."""
    parts = directory.split("/")
    above = ["/".join(parts[:k]) for k in range(1, len(parts))]
    inside = P.is_under(F.col("path"), directory)
    return inside | F.col("path").isin(above) if above else inside


def point(history: DataFrame, path: str) -> DataFrame:
    """The visible row of one path, or none: one aggregate over the rows that decide it, without a shuffle of any of them."""
    parts = path.split("/")
    own, above = F.col("path") == path, F.col("path").isin(["/".join(parts[:k]) for k in range(1, len(parts))]) if len(parts) > 1 else F.lit(False)
    newest = lambda test: F.coalesce(F.max(F.when(test, F.col("batch"))), F.lit(0))
    row = F.max_by(F.when(own, F.struct(*history.columns)), F.when(own, F.col("batch")))
    found = history.where(deciding(path)).agg(row.alias("r"), newest(own).alias("at"), newest(above).alias("file"), newest(F.col("path").startswith(path + "/")).alias("below"))
    return found.where("r is not null and file <= at and below <= at").select("r.*")


def shadowed(history: DataFrame) -> DataFrame:
    """Rows of the history that are not visible."""
    return history.join(visible(history).select("path", "batch"), ["path", "batch"], "left_anti").select(*history.columns)


def rollup(files: DataFrame, per_batch: bool = False) -> DataFrame:
    """Directory summaries: files and bytes at any depth, directories right below.

    Files are summed by directory first; only these sums are spread over ancestors, so the rows that reach the second
    shuffle are directories times depth, not files. An empty table has no root.
    """
    key = ["batch"] if per_batch else []
    direct = files.groupBy(*key, "dir").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    spread = direct.select(*key, "n", "b", F.explode(P.self_and_ancestors(F.col("dir"))).alias("dir"))
    total = spread.groupBy(*key, "dir").agg(F.sum("n").alias("n_files"), F.sum("b").alias("bytes"))
    total = total.withColumns({"parent": P.parent(F.col("dir")), "name": P.basename(F.col("dir")), "depth": P.depth(F.col("dir"))})
    below = total.where("dir <> ''").groupBy(*key, F.col("parent").alias("dir")).agg(F.count(F.lit(1)).alias("n_dirs"))
    out = total.join(below, [*key, "dir"], "left")
    return out.select("dir", "parent", "name", F.col("depth").cast("int"), "n_files", F.coalesce("n_dirs", F.lit(0)).cast("long").alias("n_dirs"), "bytes", *key)


def files_under(files: DataFrame, directory: str = "") -> DataFrame:
    """Rows strictly below a directory, by path."""
    return files.where(P.subtree(F.col("path"), directory)).orderBy("path")


def children(files: DataFrame, directory: str = "") -> DataFrame:
    """Directories right below, with their counts, then files right below: ``ls``."""
    inside = files.where(P.subtree(F.col("path"), directory))
    dirs = rollup(inside).where((F.col("parent") == directory) & (F.col("dir") != "")).select(F.lit(True).alias("is_dir"), "name", F.col("dir").alias("path"), "n_files", "n_dirs", F.col("bytes").alias("size"))
    own = files.where(F.col("dir") == directory).select(F.lit(False).alias("is_dir"), "name", "path", F.lit(None).cast("long").alias("n_files"), F.lit(None).cast("long").alias("n_dirs"), "size")
    return dirs.unionByName(own).orderBy(F.desc("is_dir"), "path")


def stored_children(files: DataFrame, dirs: DataFrame, directory: str = "") -> DataFrame:
    """``children`` of a single batch from its stored directory rows: two scans with pushed equalities, nothing summed."""
    below = dirs.where((F.col("parent") == directory) & (F.col("dir") != "")).select(F.lit(True).alias("is_dir"), "name", F.col("dir").alias("path"), "n_files", "n_dirs", F.col("bytes").alias("size"))
    own = files.where(F.col("dir") == directory).select(F.lit(False).alias("is_dir"), "name", "path", F.lit(None).cast("long").alias("n_files"), F.lit(None).cast("long").alias("n_dirs"), "size")
    return below.unionByName(own).orderBy(F.desc("is_dir"), "path")


def listings(files: DataFrame, directory: str = "") -> DataFrame:
    """All listings of a subtree in one scan: directory -> sorted entries."""
    inside = files.where(P.is_under(F.col("path"), directory))
    dirs = rollup(inside).where("dir <> ''").select(F.col("parent").alias("dir"), F.struct(F.lit(0).alias("file"), "name").alias("e"))
    own = inside.select("dir", F.struct(F.lit(1).alias("file"), "name").alias("e"))
    return dirs.unionByName(own).groupBy("dir").agg(F.sort_array(F.collect_list("e")).alias("entries"))


def tree(files: DataFrame, directory: str = "", depth: int = 3, dirs_only: bool = False) -> DataFrame:
    """Everything at most ``depth`` levels below, directories with counts, by path."""
    base = 0 if directory == "" else len(directory.split("/"))
    inside = files.where(P.subtree(F.col("path"), directory))
    dirs = rollup(inside).where(P.is_under(F.col("dir"), directory) & (F.col("depth") > base) & (F.col("depth") <= base + depth)).select(F.col("dir").alias("path"), F.lit(True).alias("is_dir"), "depth", "n_files", F.col("bytes").alias("size"))
    if dirs_only:
        return dirs.orderBy("path")
    level = P.depth(F.col("path"))
    own = inside.where(level <= base + depth).select("path", F.lit(False).alias("is_dir"), level.cast("int").alias("depth"), F.lit(None).cast("long").alias("n_files"), "size")
    return dirs.unionByName(own).orderBy("path")


def size_test(size: Column, text: str) -> Column:
    """``+N``: more than N bytes; ``-N``: fewer."""
    if text[:1] not in ("+", "-"):
        raise ValueError(f"a size test begins with + or -: {text!r}")
    n = P.size_literal(text[1:])
    return size > n if text[0] == "+" else size < n


KINDS = {"f": 0, "l": 1, "e": 2}


def find(files: DataFrame, directory: str = "", name: str | None = None, path: str | None = None, kind: str | None = None, size: str | None = None, attrs: dict[str, str] | None = None) -> DataFrame:
    """Rows below a directory that pass every test given. Globs are whole-text and cross slashes; ``kind``: f (not empty), l or e."""
    test = P.subtree(F.col("path"), directory)
    if name is not None:
        test &= F.col("name").rlike(P.glob_regex(name))
    if path is not None:
        test &= F.col("path").rlike(P.glob_regex(path))
    if kind is not None:
        if kind not in KINDS:
            raise ValueError(f"kind is one of f, l, e: {kind!r}")
        test &= F.col("kind") == KINDS[kind]
    if size is not None:
        test &= size_test(F.col("size"), size)
    for k, v in (attrs or {}).items():
        test &= F.col("attrs")[k] == v
    return files.where(test)


def du(files: DataFrame, directory: str = "") -> DataFrame:
    """One row: files, bytes, distinct contents that are not empty, and their bytes."""
    inside = files.where(P.is_under(F.col("path"), directory))
    # distinct contents are summed once, by a partial aggregate on the hash
    by_sha = inside.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.max("size").alias("one"))
    return by_sha.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.count(F.when(F.col("one") > 0, 1)).alias("blobs"), F.coalesce(F.sum("one"), F.lit(0)).alias("blob_bytes"))


def du_depth(files: DataFrame, directory: str = "", depth: int = 1) -> DataFrame:
    """The same counts for each directory down to a depth."""
    base = 0 if directory == "" else len(directory.split("/"))
    return rollup(files.where(P.is_under(F.col("path"), directory))).where(P.is_under(F.col("dir"), directory) & (F.col("depth") <= base + depth)).select("dir", "n_files", "n_dirs", "bytes").orderBy("dir")


def stat(files: DataFrame, path: str, blobs: DataFrame | None = None) -> DataFrame:
    """The row of a path, with its mode, attributes and time as text and, if ``blobs`` are given, the number of its parts (0 for an empty file)."""
    row = files.where(F.col("path") == path)
    row = row.withColumns({"mode_text": P.mode_text(F.col("kind"), F.col("mode")), "attrs_text": P.attrs_text(F.col("attrs")), "mtime": F.timestamp_micros(F.expr("mtime_ns div 1000")), "mtime_text": P.time_text(F.col("mtime_ns"))})
    if blobs is None:
        return row
    parts = blobs.join(row.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.count(F.lit(1)).alias("parts"))
    return row.join(parts, "sha", "left").fillna(0, ["parts"]).select(*row.columns, "parts")


def stat_version(history: DataFrame, path: str, batch: int) -> DataFrame:
    return history.where((F.col("path") == path) & (F.col("batch") == batch))


def paths_by_sha(files: DataFrame) -> DataFrame:
    """Non-empty contents and the sorted paths that hold them."""
    return files.where("size > 0 and kind <> 2").groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("paths"))
