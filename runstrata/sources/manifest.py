"""The manifest: the one small file that says which files are the store, and its atomic replacement."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import uuid
from dataclasses import asdict, dataclass, field

FORMAT = 3
NAME = "MANIFEST.json"
TABLES = ("files", "dirs", "excluded", "blobs")


@dataclass
class Batch:
    """One append. ``segments``: for each table the Parquet folders; ``derived``: folders of events."""

    id: int
    created: str
    label: str | None = None
    paths: int = 0
    bytes: int = 0
    new_blobs: int = 0
    new_blob_bytes: int = 0
    excluded: int = 0
    segments: dict[str, list[str]] = field(default_factory=dict)
    derived: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


@dataclass
class Manifest:
    store_id: str
    source: str = ""
    adapter: dict = field(default_factory=lambda: {"name": "none", "version": 1})
    rules: dict = field(default_factory=lambda: {"name": "none", "version": 1})
    batches: list[Batch] = field(default_factory=list)
    deleted: list[dict] = field(default_factory=list)
    format: int = FORMAT

    @staticmethod
    def parse(text: str) -> Manifest:
        """Formats 1 to 3 are read; older ones lack deletions or tables, and are written anew as 3."""
        t = json.loads(text)
        if t.get("format") not in (1, 2, 3):
            raise ValueError(f"unknown manifest format {t.get('format')!r}")
        t["format"] = FORMAT
        t["batches"] = [Batch(**b) for b in t.get("batches", [])]
        m = Manifest(**t)
        m.check()
        return m

    @staticmethod
    def load(root: str) -> Manifest:
        with open(os.path.join(root, NAME), encoding="utf-8") as f:
            return Manifest.parse(f.read())

    def check(self) -> None:
        ids = [b.id for b in self.batches]
        if len(set(ids)) < len(ids) or any(i < 1 for i in ids):
            raise ValueError("batch ids must be distinct and positive")
        every = [p for b in self.batches for p in [*sum(b.segments.values(), []), *b.derived]]
        if len(set(every)) < len(every):
            raise ValueError("an artifact is declared twice")
        for p in every:
            if p.startswith("/") or ".." in p.split("/"):
                raise ValueError(f"artifact {p!r} is outside the store")
        for b in self.batches:
            if not b.segments.get("files"):
                raise ValueError(f"batch {b.id} has no segment")
            if any(len(p.split("/")) < 3 for p in b.derived):
                raise ValueError(f"batch {b.id}: derived artifacts are named adapter/table")

    def artifacts(self, table: str) -> list[str]:
        """Folders of a table, by batch."""
        if table == "events":
            return [p for b in sorted(self.batches, key=lambda b: b.id) for p in b.derived if p.split("/")[-1].startswith("events-")]
        return [p for b in sorted(self.batches, key=lambda b: b.id) for p in b.segments.get(table, [])]

    def every(self) -> set[str]:
        return {p for b in self.batches for p in [*sum(b.segments.values(), []), *b.derived]}

    def publish(self, root: str) -> None:
        """Write beside, sync, rename: readers see the old or the new store, never a part."""
        self.check()
        target = os.path.join(root, NAME)
        beside = f"{target}.{uuid.uuid4().hex}.tmp"
        with open(beside, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, target)


def manifest_identity(root: str) -> tuple[int, int, int]:
    """What changes whenever a manifest is published."""
    s = os.stat(os.path.join(root, NAME))
    return s.st_ino, s.st_mtime_ns, s.st_size


class Lease:
    """A reader's hold on the files of a store: while any is held, nothing is removed. It ends with ``release`` or with the object."""

    def __init__(self, root: str):
        self._file = open(os.path.join(root, "READERS"), "a")  # noqa: SIM115
        fcntl.flock(self._file, fcntl.LOCK_SH)  # waits for a removal that is under way

    def release(self) -> None:
        self._file.close()


@contextlib.contextmanager
def locked(root: str, exclusive: bool):
    """One writer, or any number that only look."""
    with open(os.path.join(root, "LOCK"), "a") as f:
        try:
            fcntl.flock(f, (fcntl.LOCK_EX if exclusive else fcntl.LOCK_SH) | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"{root} is in use") from None
        yield


def sweep(root: str, manifest: Manifest) -> list[str]:
    """``vacuum``, unless a reader holds the store: what it may still read is removed by a later writer."""
    with open(os.path.join(root, "READERS"), "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            return []
        return vacuum(root, manifest)


def vacuum(root: str, manifest: Manifest) -> list[str]:
    """Remove what no manifest declares: leftovers of runs that died before publishing."""
    import shutil

    kept, gone = manifest.every(), []
    for top in ("catalog", "derived"):
        for base, dirs, _ in os.walk(os.path.join(root, top)):
            for d in list(dirs):
                rel = os.path.relpath(os.path.join(base, d), root)
                if rel not in kept and not any(k.startswith(rel + "/") for k in kept):
                    shutil.rmtree(os.path.join(root, rel))
                    gone.append(rel)
                    dirs.remove(d)
                elif rel in kept:
                    dirs.remove(d)
    for name in os.listdir(root):
        if name.endswith(".tmp"):
            os.unlink(os.path.join(root, name))
            gone.append(name)
    return sorted(gone)
