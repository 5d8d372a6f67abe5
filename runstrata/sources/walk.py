"""Walking a source tree into a DataFrame of entries with their contents."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import stat as S
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import literal_path

ENTRY_DDL = "path string, kind int, mode int, size long, mtime_ns long, content binary, problem string, sha binary, piece int, pieces int, head binary"
_SCHEMA = pa.schema([
    ("path", pa.string()), ("kind", pa.int32()), ("mode", pa.int32()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("content", pa.binary()), ("problem", pa.string()),
    ("sha", pa.binary()), ("piece", pa.int32()), ("pieces", pa.int32()), ("head", pa.binary()),
])
#: Larger files are read, stored and written in pieces of so many bytes: a multiple of a stored part.
PIECE = 16 << 20


_LISTED = "dir string, pruned boolean"
#: From so many directories on, a level of the tree is listed by tasks and no more by the driver.
WIDE = 256


def _below(root: str, level: list[str], prune) -> list[tuple[str, bool]]:
    """Directories right below some others, and whether each is pruned; links are not followed, names that are not UTF-8 are left to ``read_tree``."""
    out = []
    for rel in level:
        try:
            with os.scandir(os.path.join(root, rel)) as entries:
                names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
        except OSError:  # told by ``read_tree``
            if not rel:
                raise
            continue
        for name in names:
            try:
                name.encode()
            except UnicodeEncodeError:
                continue
            path = f"{rel}/{name}" if rel else name
            out.append((path, prune(path)))
    return out


def directories(spark: SparkSession, root: str, prune, scratch: str) -> DataFrame:
    """All directories of a tree that all executors see, the root among them: ``dir, pruned``. What is pruned is listed, not entered.

    Level by level: narrow levels on the driver, wide ones as tasks that write the next level below ``scratch``.
    """
    found, level, depth = [("", False)], [""], 0
    while level and len(level) < WIDE:
        below = _below(root, level, prune)
        found += below
        level = [d for d, gone in below if not gone]
    out = spark.createDataFrame(found, _LISTED)
    wide = spark.createDataFrame([(d, False) for d in level], _LISTED) if level else None

    def step(batches):
        for batch in batches:
            rows = _below(root, batch.column(0).to_pylist(), prune)
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["dir", "pruned"])

    while wide is not None:
        n = wide.count()
        if not n:
            break
        path, depth = os.path.join(scratch, f"level-{depth}"), depth + 1
        wide.repartition(max(1, min(4096, n // 32))).mapInArrow(step, _LISTED).write.parquet(path)
        below = spark.read.schema(_LISTED).parquet(literal_path(path))
        out, wide = out.unionByName(below), below.where("not pruned")
    return out


def snapshot(path: str) -> bytes:
    """A file's bytes as of its size when opened: growth at the end is legal, replacement and truncation are not."""
    with open(path, "rb") as f:
        before = os.fstat(f.fileno())
        data = f.read(before.st_size)
        now = os.stat(path)
        if len(data) < before.st_size or now.st_size < before.st_size or (now.st_ino, now.st_dev) != (before.st_ino, before.st_dev):
            raise OSError("changed while it was read")
        return data


def _shared_scratch(spark: SparkSession) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``, if executors and the driver mount it; only a session of one machine may go without."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    if shared.startswith(("/", "file:")):
        return os.path.join("/" + shared.removeprefix("file:").lstrip("/"), f"walk-{uuid.uuid4().hex[:12]}")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("name a folder that the driver and all executors mount")
    out = tempfile.mkdtemp(prefix="runstrata-walk-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    return out


def read_tree(spark: SparkSession, root: str, prune=lambda rel: False, scratch: str | None = None) -> DataFrame:
    """One row for each file, link and empty file below a folder that all executors see, and one for each pruned directory.

    kind: 0 file, 1 link (content: its target), 2 empty. Modes are 0755 or 0644, links 0777. Sockets, devices and the
    like have the problem ``special-file``; names that are not UTF-8 and unreadable files say why. A pruned directory is
    a path that ends in ``/.``. A file of more than ``PIECE`` bytes has a row without content and rows with ``piece``,
    the hash and the bytes of each piece: no cell holds a large file. ``scratch``: a folder that executors mount, for
    the levels of wide trees.
    """
    found = directories(spark, root, prune, scratch or _shared_scratch(spark))
    names = found.where("not pruned").select("dir").repartition(max(1, min(4096, spark.sparkContext.defaultParallelism * 4)))
    marks = found.where("pruned").select(F.concat("dir", F.lit("/.")).alias("path"), F.lit(0).alias("kind"), F.lit(0o644).alias("mode"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"))

    def read(batches):
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                rows, held = [], 0
                try:
                    entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: os.fsencode(e.name))
                except OSError as e:
                    entries = []
                    rows.append(dict.fromkeys(_SCHEMA.names) | {"path": rel, "problem": str(e)})
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        continue
                    row = dict.fromkeys(_SCHEMA.names)
                    try:
                        entry.name.encode()
                        path = f"{rel}/{entry.name}" if rel else entry.name
                    except UnicodeEncodeError:
                        rows.append(row | {"path": os.fsencode(os.path.join(rel, entry.name)).decode(errors="replace"), "problem": "not UTF-8"})
                        continue
                    s = entry.stat(follow_symlinks=False)
                    row |= {"path": path, "mtime_ns": s.st_mtime_ns, "size": s.st_size}
                    try:
                        if S.S_ISLNK(s.st_mode):
                            target = os.fsencode(os.readlink(entry.path))
                            row |= {"kind": 1, "mode": 0o777, "content": target, "size": len(target)}
                        elif S.S_ISREG(s.st_mode) and s.st_size > PIECE:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, held = [], 0
                            digest, size, first = yield from _pieces(entry.path, path)
                            row |= {"kind": 0, "mode": 0o755 if s.st_mode & 0o111 else 0o644, "size": size, "sha": digest, "head": first}
                        elif S.S_ISREG(s.st_mode):
                            data = snapshot(entry.path)
                            row |= {"kind": 0 if data else 2, "mode": 0o755 if s.st_mode & 0o111 else 0o644, "content": data, "size": len(data)}
                        else:
                            row |= {"problem": "special-file"}
                    except OSError as e:
                        row |= {"problem": str(e)}
                    rows.append(row)
                    held += len(row["content"] or b"")
                    if held > 32 << 20 or len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    out = names.mapInArrow(read, ENTRY_DDL).withColumn("head", F.coalesce("head", F.substring("content", 1, 4)))
    return out.unionByName(marks, allowMissingColumns=True)


def _pieces(source: str, path: str):
    """Rows of the pieces of a large file as of its size when opened; returns its hash and size. Bytes that change while they are read are an error."""
    with open(source, "rb") as f:
        before = os.fstat(f.fileno())
        left, digest, head = before.st_size, hashlib.sha256(), b""
        while left:
            data = f.read(min(left, PIECE))
            if not data:
                raise OSError("changed while it was read")
            digest.update(data)
            head = head or data[:4]
            left -= len(data)
        sha, again, n = digest.digest(), hashlib.sha256(), -(-before.st_size // PIECE)
        f.seek(0)
        for k in range(n):
            data = f.read(min(before.st_size - k * PIECE, PIECE))
            again.update(data)
            yield pa.RecordBatch.from_pylist([dict.fromkeys(_SCHEMA.names) | {"path": path, "sha": sha, "size": len(data), "content": data, "piece": k, "pieces": n}], schema=_SCHEMA)
        now = os.stat(source)
        if again.digest() != sha or now.st_size < before.st_size or (now.st_ino, now.st_dev) != (before.st_ino, before.st_dev):
            raise OSError("changed while it was read")
        return sha, before.st_size, head
