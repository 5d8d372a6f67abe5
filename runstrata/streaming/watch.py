"""Streaming appends: run folders that became ready are stored as batches, once each."""

from __future__ import annotations

import fnmatch
import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.events import Adapter
from ..store import Store

MARKS = "path string"


def labels(listing: DataFrame, adapter: Adapter) -> DataFrame:
    """Labels of marker files in ``listing(path)``: the nearest ancestor whose name matches the pattern, else the parent's name, else the path."""
    marked = listing.where(P.matches(F.col("path"), list(adapter.markers)))
    up = F.reverse(F.filter(F.split(P.parent(F.col("path")), "/"), lambda d: d != ""))
    parent = F.when(F.size(up) > 0, F.element_at(up, 1))
    if adapter.label_ancestor_pattern:
        pattern = adapter.label_ancestor_pattern.replace("(?P<", "(?<")
        near = F.filter(up, lambda d: d.rlike(pattern))
        parent = F.coalesce(F.when(F.size(near) > 0, F.element_at(near, 1)), parent)
    return marked.select(F.coalesce(parent, F.col("path")).alias("label")).distinct()


def next_label(listing: DataFrame, adapter: Adapter, packed: list[str]) -> str | None:
    """The greatest label that no batch has."""
    return labels(listing, adapter).where(~F.col("label").isin(packed) if packed else F.lit(True)).agg(F.max("label")).first()[0]


def append_stream(source: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None):
    """Append every micro-batch of a streaming DataFrame of entries to the store.

    The manifest is the commit: a micro-batch whose number it has already (as the label ``stream-N``) is not stored twice,
    so a restart after a failure between the two commits appends exactly once.
    """

    def write(entries: DataFrame, number: int) -> None:
        label = f"stream-{number:09d}"
        with store.refresh() as handle:
            if label not in [b.label for b in handle.manifest.batches]:
                handle.append(entries, label)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def file_stream(spark, folder: str, trigger_files: int = 1000) -> DataFrame:
    """Files that appear below a folder, as entries."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", trigger_files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    root = "file:" + os.path.abspath(folder).rstrip("/") + "/"
    path = F.when(F.col("path").startswith(root), F.expr(f"substring(path, {len(root) + 1})")).otherwise(F.regexp_replace("path", "^file:/+" + re.escape(os.path.abspath(folder).lstrip("/")) + "/", ""))
    return raw.select(path.alias("path"), F.when(F.col("length") == 0, 2).otherwise(0).alias("kind"), F.lit(0o644).alias("mode"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def poll(store: Store, root: str, adapter: Adapter, max_batches: int | None = None, wait: Callable[[], bool] = lambda: False) -> list[str]:
    """Store ready runs below ``root`` until none is left and ``wait`` says stop. The first batch with an unreadable path is kept and ends it, as does a failure."""
    done: list[str] = []
    while True:
        runs = sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d)) and fnmatch.fnmatch(d, adapter.run_glob or "*"))
        found = False
        for run in runs:
            top = os.path.join(root, run)
            listing = [(os.path.relpath(os.path.join(b, f), top),) for b, _, fs in os.walk(top) for f in fs]
            if not listing:
                continue
            packed = [b.label.removeprefix(f"{run}/") for b in store.manifest.batches if b.label and b.label.startswith(f"{run}/")]
            label = next_label(store.spark.createDataFrame(listing, MARKS), adapter, packed)
            if label is not None:
                batch = store.pack(top, f"{run}/{label}")
                done.append(f"{run}/{label}")
                found = True
                if batch.errors or max_batches and len(done) >= max_batches:
                    return done
        if not found and not wait():
            return done


def every(seconds: float, times: int | None = None) -> Callable[[], bool]:
    """A ``wait`` for ``poll``: look again after so many seconds, so many times or for ever."""
    left = [times]

    def again() -> bool:
        if left[0] is not None:
            if left[0] <= 0:
                return False
            left[0] -= 1
        time.sleep(seconds)
        return True

    return again
