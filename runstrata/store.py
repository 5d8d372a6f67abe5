"""The store: a folder of Parquet tables behind one manifest."""

from __future__ import annotations

import contextlib
import copy
import os
import shutil
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .operators import content, events, ingest, maintenance, namespace, retention
from .sources import walk
from .sources.manifest import Batch, Lease, Manifest, locked, manifest_identity, sweep

FILES = "path string, dir string, name string, kind short, mode int, size long, sha binary, mtime_ns long, batch long, attrs map<string,string>"
SCHEMAS = {
    "files": FILES,
    "dirs": "dir string, parent string, name string, depth int, n_files long, n_dirs long, bytes long, batch long",
    "excluded": "path string, size long, rule string, batch long",
    "blobs": "sha binary, part int, n_parts int, size long, content binary, batch long",
    "events": events.EVENT_DDL + ", batch long",
}


#: Bytes that a written file has at most; a table is cut by ranges until each has.
SEGMENT_BYTES = 256 << 20
#: Bytes of logs that a task parses.
LOG_BYTES = 16 << 20
#: Bytes of a row group of contents: what a lookup reads for one hash.
GROUP_BYTES = 16 << 20


class Store:
    """A handle bound to the manifest it was opened with: its DataFrames list that snapshot's files, whatever is appended later.

    The handle holds a reader's lease: no writer removes a file that it may read. Keep it while its DataFrames are in
    use; the lease ends with ``close``, with a ``with`` block, or with the handle. Writing verbs take the writer's lock, read
    the newest manifest under it, publish once, and leave the handle bound to what they published.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self._bind()

    def _bind(self) -> None:
        lease, identity = Lease(self.root), manifest_identity(self.root)
        manifest = Manifest.load(self.root)
        missing = [p for p in manifest.every() if not os.path.isdir(os.path.join(self.root, p))]
        if missing:
            lease.release()
            raise FileNotFoundError(f"declared but absent: {sorted(missing)[:20]}")
        self._lease, self._identity, self.manifest = lease, identity, manifest

    def close(self) -> None:
        self._lease.release()

    def stale(self) -> bool:
        """Whether a writer has published since this handle was bound."""
        return manifest_identity(self.root) != self._identity

    def follow(self) -> bool:
        """Bind to the newest manifest if there is a newer one; a store that cannot be opened just now leaves the handle as it was."""
        if not self.stale():
            return False
        lease = self._lease
        try:
            self._bind()
        except (OSError, ValueError):
            return False
        lease.release()
        return True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @contextlib.contextmanager
    def _writing(self) -> Iterator[Manifest]:
        """The only writer, on the newest manifest: a copy of it is yielded, and published if the block ends well. Whatever else was written goes."""
        with locked(self.root, exclusive=True):
            self._bind()
            new = copy.deepcopy(self.manifest)
            try:
                yield new
                new.publish(self.root)
            finally:
                self._lease.release()
                sweep(self.root, Manifest.load(self.root))
                self._bind()

    @staticmethod
    def create(spark: SparkSession, root: str, store_id: str, adapter: str = "none", rules: str = "none", source: str = "") -> Store:
        os.makedirs(root, exist_ok=False)
        a = events.resolve(adapter)
        Manifest(store_id, source, {"name": adapter, "version": a.version}, {"name": rules, "version": 1}).publish(root)
        return Store(spark, root)

    def refresh(self) -> Store:
        return Store(self.spark, self.root)

    def table(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """All batches of a table."""
        listed = [P.literal_path(os.path.join(self.root, p)) for p in (manifest or self.manifest).artifacts(name)]
        if not listed:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", "true").parquet(*listed)

    @property
    def history(self) -> DataFrame:
        return self.table("files")

    @property
    def visible(self) -> DataFrame:
        return self.visible_under("")

    def visible_under(self, *directories: str) -> DataFrame:
        """What is visible at and below some directories (or paths); the prefixes reach the scan."""
        history, n = self.history, len(self.manifest.batches)
        if n == 1 or "" in directories:
            return namespace.visible(history, n)
        tests = [namespace.deciding(d) for d in directories]
        return namespace.visible(history.where(reduce(or_, tests)), n)

    @property
    def blobs(self) -> DataFrame:
        return self.table("blobs").drop("batch")

    @property
    def events(self) -> DataFrame:
        """Events of all batches; a log that grew stands in every batch that has it (``derive`` keeps the newest alone)."""
        return self.table("events").drop("batch")

    @property
    def batches(self) -> DataFrame:
        return self._batches(self.manifest)

    def _read(self, path: str, schema=None) -> DataFrame:
        """A folder that was just written, taken literally."""
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(P.literal_path(path))

    def _batches(self, manifest: Manifest) -> DataFrame:
        rows = [(b.id, b.created, b.label, b.paths, b.bytes, b.new_blobs, b.new_blob_bytes, b.excluded) for b in manifest.batches]
        return self.spark.createDataFrame(rows, "id long, created string, label string, paths long, bytes long, new_blobs long, new_blob_bytes long, excluded long")

    def totals(self) -> dict:
        """Rows, bytes, contents and excluded paths over all batches, and the bytes that the store takes, from the manifest and the file system alone."""
        sums = {k: sum(getattr(b, k) for b in self.manifest.batches) for k in ("paths", "bytes", "new_blobs", "new_blob_bytes", "excluded")}
        taken = lambda paths: sum(os.path.getsize(os.path.join(base, f)) for p in paths for base, _, names in os.walk(os.path.join(self.root, p)) for f in names)
        packs = self.manifest.artifacts("blobs")
        return sums | {"batches": len(self.manifest.batches), "content_bytes": taken(packs), "metadata_bytes": taken(self.manifest.every() - set(packs))}

    @property
    def adapter(self) -> events.Adapter:
        return events.resolve(self.manifest.adapter["name"])

    # verbs ------------------------------------------------------------

    def files_under(self, directory: str = "") -> DataFrame:
        directory = P.normalise(directory)
        return namespace.files_under(self.visible_under(directory), directory)

    def children(self, directory: str = "") -> DataFrame:
        """``ls``: of a single batch, from the stored directory rows."""
        directory = P.normalise(directory)
        if len(self.manifest.batches) == 1:
            return namespace.stored_children(self.history, self.table("dirs"), directory)
        return namespace.children(self.visible_under(directory), directory)

    def tree(self, directory: str = "", depth: int = 3, dirs_only: bool = False) -> DataFrame:
        directory = P.normalise(directory)
        return namespace.tree(self.visible_under(directory), directory, depth, dirs_only)

    def find(self, directory: str = "", **tests) -> DataFrame:
        directory = P.normalise(directory)
        return namespace.find(self.visible_under(directory), directory, **tests)

    def du(self, directory: str = "") -> DataFrame:
        directory = P.normalise(directory)
        return namespace.du(self.visible_under(directory), directory)

    def points(self, *names: str) -> DataFrame:
        """Visible rows of some paths, as many at most: few are looked up one by one and collected, so what follows starts from them."""
        if len(names) > 16:
            return self.visible_under(*names).where(F.col("path").isin(list(names)))
        one = [namespace.point(self.history, p) for p in dict.fromkeys(names)]
        return self.spark.createDataFrame(reduce(DataFrame.unionByName, one).collect(), FILES)

    def stat(self, path: str) -> DataFrame:
        path = P.normalise(path)
        return namespace.stat(self.points(path), path, self.blobs)

    def dir_info(self, directory: str = "") -> DataFrame:
        directory = P.normalise(directory)
        if len(self.manifest.batches) == 1:
            return self.table("dirs").where(F.col("dir") == directory).drop("batch")
        inside = self.visible_under(directory).where(P.subtree(F.col("path"), directory))
        return namespace.rollup(inside).where(F.col("dir") == directory)

    def cat(self, *names: str) -> DataFrame:
        names = [P.normalise(p) for p in names]
        return content.cat(self.points(*names), self.blobs, names)

    def grep(self, patterns: list[str], directory: str = "", **options) -> DataFrame:
        directory = P.normalise(directory)
        return content.grep(self.visible_under(directory), self.blobs, patterns, directory, **options)

    def extract(self, target: str, directory: str = "", mtime: bool = False, link: bool = False) -> int:
        directory = P.normalise(directory)
        return content.extract(self.visible_under(directory).where(P.is_under(F.col("path"), directory)), self.blobs, target, mtime, link)

    def edit(self, path: str, change) -> str:
        """The difference that ``change(text) -> text`` would make to a stored file; nothing is written back."""
        row = self.cat(path).first()
        if row is None:
            raise FileNotFoundError(path)
        text = bytes(row.content).decode(errors="replace")
        return content.difference(text, change(text), P.normalise(path))

    def verify(self, deep: bool = False, compacted: bool = False) -> DataFrame:
        return self._verify(self.manifest, deep, compacted)

    def _verify(self, manifest: Manifest, deep: bool, compacted: bool = False) -> DataFrame:
        files = self.table("files", manifest)
        found = maintenance.verify(files, self.table("dirs", manifest), self.table("blobs", manifest).drop("batch"), self._batches(manifest), deep, compacted)
        return found.unionByName(maintenance.order_problems(files)) if manifest.artifacts("files") else found

    def verify_counts(self) -> DataFrame:
        return maintenance.verify_counts(self.history, self.blobs, len(self.manifest.batches))

    # writing ----------------------------------------------------------

    def _write(self, df: DataFrame, rel: str, by: tuple[str, ...] = (), expect: int = 0) -> str:
        """Write a folder, cut and sorted by ``by`` into files of at most ``SEGMENT_BYTES``; ``expect``: bytes it may have. A row beyond that limit is an error."""
        # the layout never partitions by a column of a table, so nothing in a folder's name becomes one
        path, n = os.path.join(self.root, rel), expect // (SEGMENT_BYTES // 2) + 1
        while True:
            cut = df.repartitionByRange(*([n] if n > 1 else []), *by).sortWithinPartitions(*by) if by else df
            out = cut.write.option("compression", "zstd")
            (out.option("parquet.block.size", GROUP_BYTES) if "content" in df.columns else out).parquet(path)
            largest = max((os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet")), default=0)
            if largest <= SEGMENT_BYTES or not by:
                return rel
            rows = self._read(path).count()
            if n > 2 * rows:
                raise ValueError(f"a row of {rel} takes more than {SEGMENT_BYTES} bytes")
            n = max(2 * n, n * -(-largest // SEGMENT_BYTES) * 2)
            shutil.rmtree(path)

    def _write_events(self, logs: DataFrame, sizes: DataFrame, rel: str, fmt: str, version: int, batch: int) -> str:
        """Parse ``logs(path, content)`` once and write their events by (trajectory, seq). Where no record needs another, logs dealt by ranges of paths give them in that order, and no event is shuffled."""
        size, staged = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], f"{rel}.tmp"
        n = max(size // LOG_BYTES, min(size >> 20, self.spark.sparkContext.defaultParallelism)) + 1
        dealt = logs.select("path", "content").repartitionByRange(n, "path").sortWithinPartitions("path")
        self._write(events.parse_events(dealt, fmt, version).withColumn("batch", F.lit(batch).cast("long")), staged)
        path = os.path.join(self.root, staged)
        largest = max((os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet")), default=0)
        if events.stands_alone(fmt) and largest <= SEGMENT_BYTES:
            os.rename(path, os.path.join(self.root, rel))
            return rel
        self._write(self._read(path, SCHEMAS["events"]), rel, ("trajectory", "seq"))
        shutil.rmtree(path)
        return rel

    def append(self, entries: DataFrame, label: str | None = None) -> Batch:
        """Store ``entries(path, kind, mode, size, mtime_ns, content[, head, problem])`` as the next batch.

        Rows equal to what is visible, and contents already stored, are not stored again; nothing new is still a batch.
        """
        return self._append(lambda scratch: entries, label)

    def _append(self, read, label: str | None) -> Batch:
        with self._writing() as manifest:
            adapter, profile = self.adapter, retention.Profile.resolve(manifest.rules["name"])
            number = max([0, *(b.id for b in manifest.batches)]) + 1
            base = f"catalog/{number:06d}-{uuid.uuid4().hex[:8]}"
            staged = os.path.join(self.root, base, "staged.tmp")
            os.makedirs(staged)
            deleted = self.spark.createDataFrame([(d["path"],) for d in manifest.deleted], "path string")
            entries = read(f"{staged}/walk")
            for name, kind in (("problem", "string"), ("piece", "int"), ("sha", "binary")):
                if name not in entries.columns:
                    entries = entries.withColumn(name, F.lit(None).cast(kind))
            # the source is read once: what it gave is written with its hashes, and all that follows reads it back
            entries = entries.withColumn("sha", F.coalesce("sha", F.unhex(F.sha2(F.coalesce("content", F.lit(b"")), 256)))).withColumn("_here", F.col("content").isNotNull())
            entries.write.option("compression", "zstd").parquet(f"{staged}/source")
            entries = self._read(f"{staged}/source", entries.schema)
            pieces = entries.where("piece is not null").select("sha", "piece", "content")
            decided = retention.decide(entries.where("piece is null"), profile, deleted if manifest.deleted else None)
            errors = [f"{r.path}: {r.problem}" for r in decided.where("problem is not null and problem <> 'special-file'").select("path", "problem").limit(20).collect()]
            special = decided.where("problem = 'special-file'").select("path", F.col("size").cast("long"), F.lit("special-file").alias("rule"))
            decided = decided.where("problem is null")
            out = retention.excluded(decided).select("path", F.col("size").cast("long"), "rule").unionByName(special)
            rows = ingest.as_rows(decided.where("rule is null"), adapter.attributes(F.col("path")), number)
            # rows are compared without their contents; these are shuffled once to be told apart, and once to be cut by ranges
            (ingest.changed(rows, self.visible) if manifest.batches else rows).write.option("compression", "zstd").parquet(f"{staged}/rows")
            files, known = self._read(f"{staged}/rows"), self.table("blobs").select("sha")
            source = (entries.where("piece is null") if manifest.batches else decided.where("rule is null")).where("problem is null")
            wanted = ingest.wanted(files, known)
            wanted.write.option("compression", "zstd").parquet(f"{staged}/wanted")
            wanted = self._read(f"{staged}/wanted")
            size = wanted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            blobs = ingest.as_parts(ingest.new_contents(source, wanted if manifest.batches else None)).unionByName(ingest.pieces_as_parts(pieces, files.join(source.where("not _here").select("sha"), "sha", "left_semi"), known, walk.PIECE))
            blobs = blobs.withColumn("batch", F.lit(number).cast("long"))
            segments = {
                "files": [self._write(files, f"{base}/files", ("path",))],
                "dirs": [self._write(namespace.rollup(files, per_batch=True), f"{base}/dirs", ("dir",))],
                "excluded": [self._write(out.withColumn("batch", F.lit(number).cast("long")), f"{base}/excluded", ("path",))],
                "blobs": [self._write(blobs, f"{base}/blobs", ("sha", "part"), size)],
            }
            derived = []
            if adapter.format:
                named = files.where(adapter.is_trajectory(F.col("path"), F.col("kind"))).select("path", "sha", "size")
                logs = source.where(adapter.is_trajectory(F.col("path"), F.col("kind"))).select("path", "sha", "_here", "content")
                logs = self._logs(logs.join(named, ["path", "sha"], "left_semi") if manifest.batches else logs, pieces)
                rel = f"derived/{adapter.name.replace('/', '_')}/events-{number:06d}-{base[-8:]}"
                derived.append(self._write_events(logs, named, rel, adapter.format, adapter.version, number))
            read_ = lambda t: self._read(os.path.join(self.root, segments[t][0]), SCHEMAS[t])
            counts = ingest.summary(read_("files"), read_("blobs"), read_("excluded"))
            shutil.rmtree(staged)
            batch = Batch(number, datetime.now(timezone.utc).isoformat(), label, segments=segments, derived=derived, errors=errors, **counts)
            manifest.batches.append(batch)
        return batch

    def _logs(self, logs: DataFrame, pieces: DataFrame) -> DataFrame:
        """``path, content`` of logs. A log is one cell of a task: those in pieces are joined again."""
        large = logs.where("not _here").select("path", "sha")
        whole = pieces.dropDuplicates(["sha", "piece"]).join(large, "sha").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("piece", "content"))).alias("p"))
        whole = whole.select("path", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.content))").alias("content"))
        return logs.where("_here").select("path", "content").unionByName(whole)

    def pack(self, source: str, label: str | None = None) -> Batch:
        """Append a source tree."""
        profile = retention.Profile.resolve(self.manifest.rules["name"])
        subtrees = profile.always_keep or profile.always_exclude

        def prune(rel: str) -> bool:
            return not subtrees and any(part in profile.exclude_dirs for part in rel.split("/"))

        return self._append(lambda scratch: walk.read_tree(self.spark, source, prune, scratch), label)

    def derive(self) -> None:
        """Parse the visible logs anew: one generation of events takes the place of all."""
        with self._writing() as manifest:
            adapter, last = self.adapter, manifest.batches[-1]
            logs = content.with_content(self.visible.where(adapter.is_trajectory(F.col("path"), F.col("kind"))), self.blobs).select("path", "size", "content")
            rel = f"derived/{adapter.name.replace('/', '_')}/events-{last.id:06d}-{uuid.uuid4().hex[:8]}"
            self._write_events(logs, logs.select("size"), rel, adapter.format or "auto", adapter.version, last.id)
            for b in manifest.batches:
                b.derived = []
            last.derived = [rel]

    _ORDER = {"files": ("path",), "dirs": ("dir",), "excluded": ("path",), "blobs": ("sha", "part"), "events": ("trajectory", "seq")}

    def _rewrite(self, manifest: Manifest, change) -> None:
        """Write every table anew through ``change(table, rows)``, one job a table, all batches at once; the manifest then lists the result, checked."""
        tag = uuid.uuid4().hex[:8]
        for t in SCHEMAS:
            with_t = [b for b in manifest.batches if (b.derived if t == "events" else b.segments.get(t))]
            if not with_t:
                continue
            mark = "events-of" if t == "events" else "of"
            base = f"derived/{self.adapter.name.replace('/', '_')}/{tag}" if t == "events" else f"catalog/{tag}/{t}"
            rows = change(t, self.table(t)).select(*[c.split()[0] for c in SCHEMAS[t].replace("map<string,string>", "map").split(", ")])
            order = self._ORDER[t]
            rows = rows.withColumn(mark, F.col("batch")).repartitionByRange(mark, *order).sortWithinPartitions(mark, *order)
            rows.write.option("compression", "zstd").partitionBy(mark).parquet(os.path.join(self.root, base))
            for b in with_t:
                rel = f"{base}/{mark}={b.id}"
                os.makedirs(os.path.join(self.root, rel), exist_ok=True)  # a batch of which no row is left
                if t == "events":
                    b.derived = [rel]
                else:
                    b.segments[t] = [rel]
        count = lambda t, *aggs: {r.batch: r for r in self.table(t, manifest).groupBy("batch").agg(*aggs).collect()}
        n, size = F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")
        files, blobs, out = count("files", n, size), count("blobs", F.count_distinct("sha").alias("n"), size), count("excluded", n)
        for b in manifest.batches:
            b.paths, b.bytes = (files[b.id].n, files[b.id].b) if b.id in files else (0, 0)
            b.new_blobs, b.new_blob_bytes = (blobs[b.id].n, blobs[b.id].b) if b.id in blobs else (0, 0)
            b.excluded = out[b.id].n if b.id in out else 0
        bad = self._verify(manifest, deep=True).limit(20).collect()
        if bad:
            raise RuntimeError(f"the rewritten store is not sound: {bad}")

    def plan_delete(self, path: str) -> dict:
        return maintenance.delete_plan(self.history, P.normalise(path), self.events, self.table("excluded")).first().asDict()

    def delete(self, path: str) -> dict:
        """Take a file or a subtree out of every batch, with its events, exclusions and the contents only it had; a later append leaves it out."""
        path = P.normalise(path)
        if not path:
            raise ValueError("the root cannot be deleted")
        with self._writing() as manifest:
            plan = self.plan_delete(path)
            if not plan["paths"]:
                raise FileNotFoundError(path)
            history = self.history
            private = maintenance.private_blobs(history, path).select("sha")

            def change(table: str, rows: DataFrame) -> DataFrame:
                if table == "blobs":
                    return rows.join(private, "sha", "left_anti")
                if table == "dirs":
                    return namespace.rollup(history.where(~P.is_under(F.col("path"), path)), per_batch=True)
                return rows.where(~P.is_under(F.col("trajectory" if table == "events" else "path"), path))

            manifest.deleted.append({"path": path, "created": datetime.now(timezone.utc).isoformat()} | plan)
            self._rewrite(manifest, change)
        return plan

    def compact(self) -> dict:
        """Write contents anew: each content once, in its first batch, sorted by hash; the report before and after must agree on what is stored."""
        report = lambda m: maintenance.storage_report(self.table("files", m), self.table("blobs", m).drop("batch")).first().asDict()
        with self._writing() as manifest:
            before, used = report(self.manifest), self.history.select("sha").distinct()
            first = self.table("blobs").groupBy("sha", "part").agg(F.min("batch").alias("_first"))

            def change(table: str, rows: DataFrame) -> DataFrame:
                if table != "blobs":
                    return rows
                once = rows.join(first, ["sha", "part"]).where(F.col("_first") == F.col("batch")).drop("_first").dropDuplicates(["sha", "part"])
                return once.join(used, "sha", "left_semi")

            self._rewrite(manifest, change)
            after = report(manifest)
            if any(before[k] != after[k] for k in ("rows", "logical_bytes")):
                raise RuntimeError(f"compaction changed the store: {before} {after}")
        return {"before": before, "after": after}
