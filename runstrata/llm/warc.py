"""WARC archives with a two-level capture index.

Writing: pages are dealt by payload digest (a hot payload is split by AQE), every task writes gzip members of
WARC 1.1 records to files of its own, and returns where each record lies. Of equal payloads only the one of the
smallest page id is a response; the others are revisits that name it.

Index: entries sorted by (reversed-host key, page id) over range partitions. Each partition is one index file of
compressed blocks of ``lines`` entries, then the sparse block directory (first key, offset, length of each
block), then a trailer that tells where the directory lies. The first key of each file is the level above.

Reading: wanted keys are dealt to index files by binary search over the files' first keys, then binary-search the
block directory, read just the blocks that may hold them, and at last read the records by coalesced byte ranges.

Files go through pyarrow's file systems (local or shared folders, HDFS, object stores), below the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, group_bounds, per_key

#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Layout:
    """``min_bytes``: payloads below it are never revisits. ``roll``: a file is closed beyond that many bytes. ``gap``/``span``: records closer than gap are read in one range, of span at most."""

    min_bytes: int = 0
    roll: int = 64 << 20
    lines: int = 1000
    level: int = 3
    gap: int = 64 << 10
    span: int = 8 << 20
    date: str = "2000-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def surt(url):
    """Reversed-host key of a url column: ``http://a.b.org/x?y`` -> ``org,b,a)/x?y``; no ``://``: the text itself after ``)``; null: empty."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[^:/?#]*://[^/?#]*", "")
    return F.when(url.isNull(), "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def _clean(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url, payload: bytes, digest: str, refers_to, layout: Layout) -> bytes:
    """One record, not compressed. ``refers_to`` None: a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [VERSION, "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{name}>", f"WARC-Date: {layout.date}"]
    head += [f"WARC-Target-URI: {_clean(url) or 'about:blank'}" if url is not None else "WARC-Target-URI: about:blank", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; a response's digest is taken anew from its payload and must be that of its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length: "))
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    page = field["warc-record-id"].strip("<>")
    out = {"page_id": int(page[9:]) if page.startswith("urn:page:") else None, "record_type": field["warc-type"], "url": field["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "refers_to": None, "payload": payload}
    if field["warc-type"] == "revisit":
        return out | {"refers_to": int(field["warc-refers-to"].strip("<>")[9:]), "payload": None}
    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"damaged record {page}")
    return out


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches, folder: str, layout: Layout):
    task = TaskContext.get()
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    out, name, at, count = None, "", 0, 0
    for batch in batches:
        rows = []
        for page_id, url, payload, digest, refers_to, key in zip(*(c.to_pylist() for c in batch.columns)):
            if out is None or at > layout.roll:
                if out:
                    out.close()
                # the attempt is in the name: what a lost or repeated task left is in no index
                name, at, count = f"{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}.warc.gz", 0, count + 1
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            data = _gzip(record(page_id, url, payload, base32(digest), refers_to, layout), layout.level)
            out.write(data)
            rows.append((key, page_id, name, at, len(data)))
            at += len(data)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY_TYPES)] if rows else [pa.nulls(0, t) for t in _ENTRY_TYPES], names=_ENTRY)
    if out:
        out.close()


_ENTRY = ["key", "page_id", "archive", "offset", "length"]
_ENTRY_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_ENTRY_DDL = "key string, page_id long, archive string, offset long, length long"


def _order(key, page_id):
    """Spark's order of (key, page_id): bytes of the key, null ids first."""
    return (key.encode(), page_id is not None, page_id or 0)


def _index(batches, folder: str, layout: Layout):
    task = TaskContext.get()
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    name = f"{task.partitionId():06d}-{task.taskAttemptId()}.idx"
    out, at, directory, lines = None, 0, [], []

    def flush():
        nonlocal at
        data = zlib.compress(json.dumps(lines).encode(), 6)
        out.write(data)
        directory.append([lines[0][0], lines[0][1], at, len(data)])
        at += len(data)
        lines.clear()

    for batch in batches:
        for line in zip(*(c.to_pylist() for c in batch.columns)):
            if out is None:
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            lines.append(line)
            if len(lines) == layout.lines:
                flush()
    if out is None:
        return
    if lines:
        flush()
    data = zlib.compress(json.dumps(directory).encode(), 6)
    out.write(data + struct.pack("<QQ", at, len(data)))
    out.close()
    yield pa.record_batch([pa.array([name]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([len(directory)], pa.int64())], names=["file", "key", "page_id", "blocks"])


@dataclass
class Capture:
    """Archives and their index. ``tops``: name and first key of each index file, one for each range partition of the index."""

    scratch: Scratch
    layout: Layout
    entries: DataFrame
    tops: list[tuple[str, tuple]]

    @property
    def archives(self) -> str:
        return self.scratch.path("warc")

    @property
    def index(self) -> str:
        return self.scratch.path("index")


def write_archives(pages: DataFrame, layout: Layout = Layout(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Capture:
    """Write a record for each row and build the index.

    A null html is an empty payload, a null url has the empty key, a row without an id is a response that nothing
    names (or a revisit, when a row with an id has its payload); rows that repeat an id are separate records of
    the same type. Other columns are not read. An empty table writes no file.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = per_key(rows.where(F.octet_length("payload") >= layout.min_bytes).select("digest", "page_id"), "digest", F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    dealt = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"), surt(F.col("url")).alias("key"))
    folder = scratch.path("warc")
    entries = scratch.put(dealt.mapInArrow(lambda it: _write(it, folder, layout), _ENTRY_DDL), "entries")
    capture = Capture(scratch, layout, entries, [])
    index = capture.index
    tops = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(lambda it: _index(it, index, layout), "file string, key string, page_id long, blocks long")
    capture.tops = sorted(((r.file, _order(r.key, r.page_id)) for r in tops.collect()), key=lambda x: x[1])  # a row for each partition
    return capture


def lookup(capture: Capture, wanted: DataFrame) -> DataFrame:
    """All captures of the given (key, page_id) pairs, through the index: ``key, page_id, archive, offset, length``."""
    folder, names, firsts = capture.index, [x[0] for x in capture.tops], [x[1] for x in capture.tops]

    def route(batches):
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = [bisect_right(firsts, _order(k, i)) - 1 for k, i in zip(keys, ids)]
            keep = [n for n, x in enumerate(at) if x >= 0]
            yield pa.record_batch([pa.array([at[n] for n in keep], pa.int32()), pa.array([keys[n] for n in keep], pa.string()), pa.array([ids[n] for n in keep], pa.int64())], names=["file", "key", "page_id"])

    def search(batches):
        system, path = file_system(folder)
        opened, source, first, directory, have, block = -1, None, [], [], -1, []
        for batch in batches:
            found = []
            for file, key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                if file != opened:
                    source, opened, have = system.open_input_file(f"{path}/{names[file]}"), file, -1
                    end = source.size()
                    at, size = struct.unpack("<QQ", source.read_at(16, end - 16))
                    directory = json.loads(zlib.decompress(source.read_at(size, at)))
                    first = [_order(x[0], x[1]) for x in directory]
                want = _order(key, page_id)
                k = max(0, bisect_left(first, want) - 1)  # an equal key may begin in the block before
                while k < len(first) and first[k] <= want:
                    if k != have:
                        block = json.loads(zlib.decompress(source.read_at(directory[k][3], directory[k][2])))
                        place = [_order(x[0], x[1]) for x in block]
                        have = k
                    found += block[bisect_left(place, want) : bisect_right(place, want)]
                    k += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), _ENTRY_TYPES)] if found else [pa.nulls(0, t) for t in _ENTRY_TYPES], names=_ENTRY)

    keys = wanted.select(F.col("key").cast("string"), F.col("page_id").cast("long")).where("key is not null").distinct()
    routed = keys.mapInArrow(route, "file int, key string, page_id long")
    return routed.repartition("file").sortWithinPartitions("file", "key", "page_id").mapInArrow(search, _ENTRY_DDL)


def read_records(capture: Capture, found: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``lookup`` found, by byte ranges in the order of the archives."""
    folder, layout = capture.archives, capture.layout
    names = ["page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches):
        system, path = file_system(folder)
        opened, source = "", None
        for batch in batches:
            archive = batch.column(0).to_pylist()
            offset, length = (batch.column(k).to_numpy() for k in (1, 2))
            ends = offset + length
            bounds = group_bounds(batch.column(0).to_numpy(zero_copy_only=False))
            for a, b in zip(bounds[:-1], bounds[1:]):
                if archive[a] != opened:
                    source, opened = system.open_input_file(f"{path}/{archive[a]}"), archive[a]
                while a < b:
                    z = a + 1
                    while z < b and offset[z] - ends[z - 1] <= layout.gap and ends[z] - offset[a] <= layout.span:
                        z += 1
                    data = source.read_at(int(ends[z - 1] - offset[a]), int(offset[a]))
                    rows = [parse(zlib.decompress(data[offset[k] - offset[a] : ends[k] - offset[a]], 31)) for k in range(a, z)]
                    yield pa.record_batch([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
                    a = z

    ddl = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    return found.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(read, ddl)
