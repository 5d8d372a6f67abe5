"""Contents by hash: lookup, text, cat, grep, extract. Every distinct content is read once, however many paths hold it."""

from __future__ import annotations

import difflib
import hashlib
import os
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no bytes


def whole_blobs(blobs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``sha, content`` from parts; a content whose parts are not 0..n-1, or whose hash is another, fails the query.

    ``wanted``: the only hashes (``sha``) to read; they are semi-joined before any content is joined or hashed. Few
    contents have several parts; those of one part skip the shuffle that joins parts.
    """
    if wanted is not None:
        blobs = blobs.join(wanted.select("sha").distinct(), "sha", "left_semi")
    checked = lambda df: df.withColumn("content", F.when(F.sha2("content", 256) == F.lower(F.hex("sha")), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("damaged content "), F.lower(F.hex("sha"))))))
    if "part" not in blobs.columns:
        return checked(blobs.select("sha", "content"))
    many = blobs.where("n_parts > 1").groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("p"), F.max("n_parts").alias("n"))
    in_order = F.transform(F.col("p"), lambda x: x["part"].cast("int")) == F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i - 1).cast("int"))
    joined = many.select("sha", F.when(in_order, F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.content))")).otherwise(F.raise_error(F.lit("parts are missing"))).alias("content"))
    return checked(blobs.where("n_parts = 1").select("sha", "content").unionByName(joined))


def some_blobs(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blobs of few hashes: these are collected, and reach the scan as a list (files of a store are sorted by hash)."""
    hashes = [bytes(r.sha) for r in wanted.select("sha").distinct().collect()]
    return blobs.where(F.col("sha").isin(hashes) if hashes else F.lit(False))


def with_content(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files with their bytes; empty files need no blob; a missing blob fails the query. Only contents of these files are read."""
    found = files.join(whole_blobs(blobs, files.where("size > 0")).withColumn("_have", F.lit(True)), "sha", "left")
    missing = F.raise_error(F.concat(F.lit("no content for "), F.col("path")))
    return found.withColumn("content", F.when(F.col("size") == 0, F.lit(b"")).when(F.col("_have"), F.col("content")).otherwise(missing)).drop("_have")


def text_of(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def parse_hash(text: Column) -> Column:
    """A hex hash, blanks around it allowed, as 32 bytes; else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9A-Fa-f]{64}\z"), F.unhex(t))


def first_contents(stores: list[DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """``sha, content`` from the first store that has a hash. Which store that is, is decided on hashes; contents are read once and not aggregated."""
    hashes = lambda b: b.select("sha").distinct() if wanted is None else b.select("sha").distinct().join(wanted, "sha", "left_semi")
    out = whole_blobs(stores[0], wanted)
    for i in range(1, len(stores)):
        own = hashes(stores[i])
        for before in stores[:i]:
            own = own.join(before.select("sha"), "sha", "left_anti")
        out = out.unionByName(whole_blobs(stores[i], own))
    return out


def lookup(keys: DataFrame, stores: list[DataFrame], sha_col: str = "sha") -> DataFrame:
    """``keys`` with ``blob`` and ``text`` of their hash, from the first store that has it; null for an unknown, malformed or null hash."""
    key = F.col(sha_col) if dict(keys.dtypes)[sha_col] == "binary" else parse_hash(F.col(sha_col))
    wanted = keys.select(key.alias("sha")).where("sha is not null").distinct()
    first = first_contents(stores, wanted).withColumnsRenamed({"sha": "_sha", "content": "_content"})
    out = keys.withColumn("_key", key).join(first, F.col("_key") == F.col("_sha"), "left")
    blob = F.when(F.lower(F.hex("_key")) == EMPTY_SHA, F.lit(b"")).otherwise(F.col("_content"))
    return out.withColumn("blob", blob).withColumn("text", text_of(F.col("blob"))).drop("_key", "_sha", "_content")


def cat(files: DataFrame, blobs: DataFrame, paths: list[str]) -> DataFrame:
    """``path, content`` in the order asked for; the hashes of the paths reach the scan of contents."""
    wanted = files.where(F.col("path").isin(paths) & (F.col("kind") != 1))
    place = F.array_position(F.array(*[F.lit(p) for p in paths]), F.col("path"))
    return with_content(wanted, some_blobs(blobs, wanted.where("size > 0"))).orderBy(place).select("path", "content")


def looks_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\0"))


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A pattern of the usual dialect for Java: Unicode classes, line feeds alone end lines."""
    return f"(?mdU{'iu' if ignore_case else ''}){pattern.replace('(?P<', '(?<')}"


def grep(files: DataFrame, blobs: DataFrame, patterns: list[str], directory: str = "", name: str | None = None, ignore_case: bool = False, binary: bool = False) -> DataFrame:
    """``path, line_no, line`` of lines that any pattern matches, in regular non-empty files.

    Distinct hashes are scanned, not paths: contents are filtered and split once, and only hits are joined back.
    """
    test = (F.col("kind") == 0) & P.subtree(F.col("path"), directory)
    if name is not None:
        test &= F.col("name").rlike(P.glob_regex(name))
    wanted = files.where(test).select("sha", "path")
    # contents are joined and checked above the semi-join; the tests stand in the generator, which no rule moves below it
    scanned = whole_blobs(blobs, wanted).withColumn("text", text_of(F.col("content")))
    pattern = "|".join(f"(?:{java_pattern(p, ignore_case)})" for p in patterns)
    body = F.when(F.col("text").endswith("\n"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    told = F.col("text").rlike(pattern) if binary else F.col("text").rlike(pattern) & ~looks_binary(F.col("content"))
    lines = scanned.select("sha", F.posexplode(F.when(told, F.split(body, "\n"))).alias("at", "line")).where(F.col("line").rlike(pattern))
    return lines.join(wanted, "sha").select("path", (F.col("at") + 1).alias("line_no"), "line")


def grep_count(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


def extract(files: DataFrame, blobs: DataFrame, target: str, mtime: bool = False, link: bool = False) -> int:
    """Write files and links below a folder that all executors share; returns how many. Modes are kept, times on request.

    Parts are streamed: a file is never in memory as a whole, and its hash is checked as it is written. ``link``: files
    of equal content, mode (and time, if kept) are hard links of the first of them by path.
    """
    rows = files.select("path", "kind", "mode", "mtime_ns", "size", "sha")
    same = ["sha", "mode", "mtime_ns"] if mtime else ["sha", "mode"]
    own = F.lit(None).cast("string")
    if link:
        first = rows.where("kind = 0").groupBy(*same).agg(F.min("path").alias("first"))
        rows = rows.join(first, same, "left")
        own = F.when((F.col("kind") == 0) & (F.col("first") != F.col("path")), F.col("first"))
    rows = rows.withColumn("link_to", own)
    need = rows.where("size > 0 and link_to is null")
    parts = blobs.join(need.select("sha").distinct(), "sha", "left_semi").select("sha", "part", "n_parts", "content")
    found = rows.join(parts, (rows["sha"] == parts["sha"]) & (F.col("size") > 0) & F.col("link_to").isNull(), "left").select("path", "kind", "mode", "mtime_ns", "size", rows["sha"].alias("sha"), "part", "n_parts", "content", "link_to")
    made = found.where("link_to is null").repartition("path").sortWithinPartitions("path", "part").mapInArrow(lambda it: _write_files(it, target, mtime), "n long")
    n = int(made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    if link:
        made = rows.where("link_to is not null").select("path", "link_to").mapInArrow(lambda it: _write_links(it, target), "n long")
        n += int(made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    return n


def _place(target: str, path: str) -> str:
    out = os.path.join(target, path)
    os.makedirs(os.path.dirname(out), exist_ok=True)
    if os.path.lexists(out):
        os.unlink(out)
    return out


def _write_files(batches, target: str, mtime: bool):
    """Parts sorted by path -> files, each beside its name until its last part is written and its hash is right."""
    last, f, digest, row, n = None, None, None, None, 0

    def finish():
        nonlocal f
        if row is None:
            return
        path, kind, mode, mtime_ns, size, sha, parts, seen = row
        if digest.digest() != bytes(sha) or (size > 0 and seen != parts):
            raise ValueError(f"no content for {path}, or a damaged one")
        f.close()
        out = _place(target, path)
        if kind == 1:
            with open(f.name, "rb") as g:
                os.symlink(g.read().decode("utf-8", "surrogateescape"), out)
            os.unlink(f.name)
        else:
            os.chmod(f.name, mode)
            os.replace(f.name, out)
        if mtime:
            os.utime(out, ns=(mtime_ns, mtime_ns), follow_symlinks=False)

    for batch in batches:
        for path, kind, mode, mtime_ns, size, sha, part, n_parts, content in zip(*(c.to_pylist() for c in batch.columns[:9])):
            if path != last:
                finish()
                last, digest, n = path, hashlib.sha256(), n + 1
                folder = os.path.dirname(os.path.join(target, path))
                os.makedirs(folder, exist_ok=True)
                f = tempfile.NamedTemporaryFile(dir=folder, prefix=".part-", delete=False)  # noqa: SIM115
                row = (path, kind, mode, mtime_ns, size, sha, n_parts, 0)
            if content is not None:
                if part != row[7]:
                    raise ValueError(f"parts of {path} are missing")
                f.write(content)
                digest.update(content)
                row = (*row[:7], part + 1)
    finish()
    yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])


def _write_links(batches, target: str):
    for batch in batches:
        for path, first in zip(*(c.to_pylist() for c in batch.columns)):
            os.link(os.path.join(target, first), _place(target, path))
        yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])


def difference(old: str, new: str, name: str) -> str:
    """What an edit of a stored text would change: a unified difference with three lines around; the store stays as it is."""
    lines = difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{name}", f"b/{name}", n=3)
    return "".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in lines)
