"""Helpers every operator of this subpackage uses: scratch tables, skew-safe joins, sorted runs."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEST_ROOTS: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without that setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _TEST_ROOTS:
        _TEST_ROOTS.append("file://" + tempfile.mkdtemp(prefix="runstrata-"))
    return _TEST_ROOTS[0]


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors.

    ``put`` writes and rereads; ``drop`` deletes a table that nothing reads any more. What a
    returned lazy DataFrame still reads is deleted at the end of the ``written`` block it was made in,
    or else when the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def close(self) -> None:
        try:
            delete_path(self.spark, self.base)
        except Exception:  # the session may have ended; the folder then goes with the cluster's own cleaning
            pass


_OPEN: list[Scratch] = []


@contextlib.contextmanager
def written():
    """A block whose results are written before it ends: scratch tables made in it are deleted then, so a long session does not gather them."""
    mark = len(_OPEN)
    try:
        yield
    finally:
        for s in _OPEN[mark:]:
            s.close()
        del _OPEN[mark:]


@atexit.register
def _close_all() -> None:
    for s in _OPEN:
        s.close()


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on, beside others, for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library alone
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """A generator of batches that trims memory when it ends."""

    @functools.wraps(run)
    def trimmed(*args, **options):
        try:
            yield from run(*args, **options)
        finally:
            trim()

    return trimmed


def per_key(df: DataFrame, key: str, *aggs) -> DataFrame:
    """``df.groupBy(key).agg(*aggs)``, partitioned such that a join back on ``key`` deals both sides anew.

    Grouping by a column that follows from the key leaves the aggregate hashed on two columns. A later
    join on ``key`` then puts a plain exchange under each side, which AQE may split where a key is hot;
    partial sums run before the first exchange.
    """
    return df.withColumn("_second", F.xxhash64(F.col(key), F.lit(7))).groupBy(key, "_second").agg(*aggs).drop("_second")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares without case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text has that remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Cut sorted batches where the first ``keys`` columns change and yield tables of whole groups.

    Memory: one batch plus the longest group.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
            if kept:
                change[0] |= col[0] != kept[-1].column(k)[-1].as_py()
        at = np.flatnonzero(change)
        if not len(at):
            kept.append(batch)
            continue
        first, last = int(at[0]), int(at[-1])
        head = kept + ([batch.slice(0, first)] if first else [])
        if head:
            yield pa.Table.from_batches(head)
        if last > first:
            yield pa.Table.from_batches([batch.slice(first, last - first)])
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def group_bounds(*cols: np.ndarray) -> np.ndarray:
    """Positions where groups of equal neighbours begin, and the length at the end."""
    n = len(cols[0])
    change = np.ones(n, bool)
    if n:
        change[1:] = False
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)
