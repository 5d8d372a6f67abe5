"""Byte-level BPE over a table of distinct words.

1. Split: documents are cut into the tokenizer's pre-tokens by character classes, vectorised; a task turns its
   documents into blocks of at most ``block`` bytes, a file each in the shared folder: the block's distinct words, the
   commonest first, and for each document the positions of its words in that list. A block's file is read where it is
   needed and never shuffled.
2. Encode: the distinct words of all blocks are dealt by hash, in packets of one block and bucket (buckets grow with
   the blocks, to a number at which a packet still holds several words). A word meets all its occurrences, at most one
   for each block, hence no word is hot, and is encoded once; its ids go back to (block, position). Packets are
   streamed: a task holds the distinct words of one bucket, not their occurrences.
3. Decode: the distinct ids of each packet are joined to the id-to-piece table by id (the vocabulary, of fixed size).
4. Join: a block's positions meet its words' ids and these ids' pieces; ids and pieces of a text are taken by position.

Partitions follow the number of blocks, so no task grows with the corpus. The tokenizer file is a parameter, read once
on the driver and sent to the workers; texts that hold the text of an added token are split at it first, as the
library does.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, frugal, group_bounds, runs
from ._text import utf8, word_hashes
from .warc import file_system


@dataclass(frozen=True)
class Vocabulary:
    """``path``: a tokenizers JSON file of a byte-level BPE with the usual split pattern and no normaliser. ``block``: bytes of text a block; ``buckets``: of words, at most."""

    path: str
    block: int = 16 << 20
    buckets: int = 1 << 14


def public_vocabulary(name: str = "byte_bpe_50k.json") -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def _added_tokens(text: str) -> list[str]:
    """The added tokens of the text of a tokenizer file, which must be of the kind that ``Vocabulary`` says."""
    spec = json.loads(text)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or (spec["post_processor"] or pre)["type"] != "ByteLevel":
        raise ValueError("not a plain byte-level BPE")
    return [x["content"] for x in spec["added_tokens"]]


@lru_cache(1)
def _tokenizer(text: str):
    """The tokenizer in the text of a file."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(spark: SparkSession, text: str, added: list[str]) -> DataFrame:
    """``id, piece``: the bytes of each id of a vocabulary, as many rows as it has ids."""
    t = _tokenizer(text)
    # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    rows = [(i, piece.encode() if piece in added else bytes(byte[c] for c in piece)) for piece, i in t.get_vocab(with_added_tokens=True).items()]
    return spark.createDataFrame(pa.table({"id": pa.array([r[0] for r in rows], pa.int32()), "piece": pa.array([r[1] for r in rows], pa.binary())}))


@lru_cache(1)
def _classes(text: str) -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space; the library's own splitter decides where Unicode versions may differ."""
    t = _tokenizer(text)
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern, beside in ((1, r"\p{L}", "a"), (2, r"\p{N}", "1")):
        found = regex.findall(pattern, every)
        for k in range(0, len(found), 256):
            part = found[k : k + 256]
            spans = [x for _, x in t.pre_tokenizer.pre_tokenize_str("".join(beside + c + "\n" for c in part))]
            starts, ends = {a for a, _ in spans}, {b for _, b in spans}
            for j, c in enumerate(part):
                if 3 * j + 2 in ends and 3 * j + 1 not in starts:
                    out[ord(c)] = kind
    out[[ord(c) for c in regex.findall(r"\s", every)]] = 3
    return out


def split_points(cp: np.ndarray, doc_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin in the code points of several texts; ``doc_starts``: where texts begin.

    The pattern: contractions; an optional space with a run of letters, of numbers or of others; white space but
    for its last character where a word follows.
    """
    n = len(cp)
    kind = classes[cp]
    first = np.zeros(n + 1, bool)  # a text begins here, or all have ended
    first[doc_starts] = True
    first[n] = True
    first, begins = first[:n], first
    space = kind == 3
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    cut = change | first
    # the last white space before a word: a plain space joins the word, any other stands alone
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:n]) if n else np.zeros(0, np.int64)
    cut[last] = True
    plain = last[cp[last] == 32]
    cut[plain + 1] = False
    # contractions: an apostrophe where a word may begin, before s t m d re ve ll
    q = np.flatnonzero(cp == 39)
    if len(q):
        q = q[q + 1 < n]
        q = q[cut[q]]
        if len(q):
            nxt = np.append(cp, [0, 0, 0]).astype(np.int64)
            ends = np.append(begins, [True, True])
            a, b = nxt[q + 1], np.where(ends[q + 2], 0, nxt[q + 2])
            one = np.isin(a, [115, 116, 109, 100])
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            ok = (one | two) & ~begins[q + 1]
            q, size = q[ok], np.where(one[ok], 2, 3)
            cut[q + 1] = False
            after = q + size
            inner = after < n
            cut[after[inner]] = True
            # a space before a word stays with it: after a contraction that only holds where the next is a space
    return np.flatnonzero(cut)


def split_words(buf: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words begin (and the end), and how many words each text has."""
    text = buf.tobytes().decode()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = np.ones(len(cp), np.int64)
    width += cp >= 0x80
    width += cp >= 0x800
    width += cp >= 0x10000
    place = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(width, out=place[1:])
    at = np.searchsorted(place, off)
    starts = at[:-1]
    points = split_points(cp, starts[starts < len(cp)], classes)
    return np.append(place[points], len(buf)), np.diff(np.searchsorted(points, at))


def _added(text: str, added: list[str]) -> list[tuple[str, bool]]:
    """A text cut at added tokens: the parts, and whether each is such a token."""
    pattern = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)))
    out, at = [], 0
    for m in pattern.finditer(text):
        out += [(text[at : m.start()], False), (m[0], True)]
        at = m.end()
    return [x for x in [*out, (text[at:], False)] if x[0]]


_SECTIONS = ("doc_ids", "counts", "codes", "words")
_PACKET = ["bucket", "block", "places", "words"]
_PACKET_DDL = "bucket int, block long, places binary, words binary"


_ZSTD = pa.Codec("zstd", 7)


def _pack(x: np.ndarray) -> bytes:
    """An integer array as planes of its bytes, compressed; the first byte is the width."""
    raw = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T) if len(raw) else np.zeros(0, np.uint8)
    return bytes([raw.itemsize]) + raw.nbytes.to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(data[0], -1).T).view(kind).ravel() if size else np.zeros(0, kind)


def _pack_codes(x: np.ndarray) -> bytes:
    """Positions, most of them small: a byte each, 255 for those that follow in full."""
    small = _pack(np.minimum(x, 255).astype(np.uint8))
    return len(small).to_bytes(8, "little") + small + _pack((x[x >= 255] - 255).astype(np.int32))


def _unpack_codes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = _unpack(data[8 : 8 + n], np.uint8).astype(np.int32)
    out[out == 255] += _unpack(data[8 + n :], np.int32)
    return out


def _pack_words(words: pa.Array) -> bytes:
    """A binary array: lengths, then bytes."""
    off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    lens = _pack(np.diff(off).astype(np.int32))
    raw = memoryview(words.buffers()[2])[off[0] : off[-1]] if len(words) and words.buffers()[2] is not None else b""
    return len(lens).to_bytes(8, "little") + lens + len(raw).to_bytes(8, "little") + _ZSTD.compress(bytes(raw), asbytes=True)


def _unpack_words(data: bytes) -> pa.Array:
    n = int.from_bytes(data[:8], "little")
    lens = _unpack(data[8 : 8 + n], np.int32)
    size = int.from_bytes(data[8 + n : 16 + n], "little")
    raw = pa.decompress(data[16 + n :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    off = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=off[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def _section(folder: str, block: int, *names: str) -> list[bytes]:
    """Sections of a block's file."""
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{block}") as f:
        sizes = np.frombuffer(f.read_at(32, 0), np.int64)
        ends = 32 + np.cumsum(sizes)
        return [f.read_at(int(sizes[k]), int(ends[k] - sizes[k])) for k in map(_SECTIONS.index, names)]


@frugal
def _blocks(batches, classes: bytes, added: list[str], block: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Texts -> the number of each block, once its file is written."""
    from pyspark import TaskContext

    task = TaskContext.get()
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    classes = np.frombuffer(classes, np.uint8)
    marks = [x.encode() for x in added]
    held, ids, counts, size, made = [], [], [], 0, 0

    def flush():
        nonlocal held, ids, counts, size, made
        coded = pa.chunked_array(held).dictionary_encode().unify_dictionaries() if held else None
        coded = coded.combine_chunks() if coded is not None else None
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        words = coded.dictionary if coded is not None else pa.array([], pa.binary())
        codes = coded.indices.to_numpy() if coded is not None else np.zeros(0, np.int32)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        # the attempt is in the number: blocks of two attempts never meet, and what a lost attempt left is in no table
        name = task.taskAttemptId() << 20 | made
        doc, null = np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.int64)
        cells = [_pack(np.concatenate([doc, null])), _pack(np.array(counts, np.int32)), _pack_codes(rank[codes]), _pack_words(words.take(pa.array(order)))]
        with system.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(np.array([len(c) for c in cells], np.int64).tobytes() + b"".join(cells))
        out = pa.record_batch([pa.array([name], pa.int64())], names=["block"])
        held, ids, counts, size, made = [], [], [], 0, made + 1
        return out

    for batch in batches:
        names = batch.column(0).to_pylist()
        buf, off = utf8(batch.column(1))
        lo = 0
        while lo < len(names):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + min(block, 1 << 19), "right")) - 1)
            hi = min(hi, len(names))
            part, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            raw = part.tobytes()
            if any(m in raw for m in marks):
                words, n = [], []
                for d in range(hi - lo):
                    n.append(0)
                    for text, special in _added(raw[at[d] : at[d + 1]].decode(), added):
                        data = np.frombuffer(text.encode(), np.uint8)
                        cuts, _ = (np.array([0, len(data)]), 0) if special else split_words(data, np.array([0, len(data)]), classes)
                        words += [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                        n[-1] += len(cuts) - 1
                held.append(pa.array(words, pa.binary()).dictionary_encode())
            else:
                cuts, n = split_words(part, at, classes)
                held.append(pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode())
            ids += names[lo:hi]
            counts += list(map(int, n))
            size += len(raw)
            lo = hi
            if size >= block:
                yield flush()
    if ids:
        yield flush()


@frugal
def _packets(batches, buckets: int, folder: str):
    """The words of each block by hash: a row for each block and bucket, positions as steps."""
    for batch in batches:
        for block in batch.column(0).to_pylist():
            words = _unpack_words(*_section(folder, block, "words"))
            if not len(words):
                continue
            off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
            h = word_hashes(np.frombuffer(words.buffers()[2], np.uint8), off[:-1], off[1:])
            bucket = (h >> np.uint64(20)) & np.uint64(buckets - 1)
            order = np.argsort(bucket, kind="stable")
            bounds = group_bounds(bucket[order])
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = order[a:b]
                rows.append((int(bucket[own[0]]), block, _pack(np.diff(own, prepend=0).astype(np.int32)), _pack_words(words.take(pa.array(own)))))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=_PACKET)


class _Known:
    """Distinct words of a bucket and their ids, each encoded when it is first met."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, pa.array([], pa.binary())
        self.start, self.size, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def of(self, words: pa.Array) -> np.ndarray:
        """Places of words among the known, which these words now are."""
        at = pa.compute.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(at.is_null()).unique()
            # alone, a word is one pre-token; an added token is itself
            found = self.tokenizer.encode_batch([x.decode() for x in new.to_pylist()], add_special_tokens=False)
            size = np.array([len(e.ids) for e in found], np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter((i for e in found for i in e.ids), np.int64, int(size.sum()))])
            self.words = pa.concat_arrays([self.words, new])
            at = pa.compute.index_in(words, value_set=self.words)
        return at.to_numpy()


_GROUP = 1 << 18  # words looked up at once
_ENCODED = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("used", pa.list_(pa.int32()))])


@frugal
def _encode(batches, text: str):
    """Packets sorted by bucket -> (block, positions, how many ids, ids, distinct ids). Of each bucket, every distinct word is encoded once."""
    t = _tokenizer(text)
    bucket, known, held, n = None, _Known(t), [], 0

    def flush():
        which, at, rows = known.of(pa.concat_arrays([w for _, _, w in held])), 0, []
        for block, places, words in held:
            own = which[at : at + len(words)]
            at += len(words)
            its = known.ids[_ranges(known.start[own], known.size[own])].astype(np.int32)
            rows.append((block, places, _pack(known.size[own].astype(np.int32)), _pack(its), np.unique(its)))
        held.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENCODED)], schema=_ENCODED)

    for batch in batches:
        for b, block, places, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                if held:
                    yield flush()
                bucket, known, n = b, _Known(t), 0
            held.append((block, places, _unpack_words(packed)))
            n += len(held[-1][2])
            if n >= _GROUP:
                yield flush()
                n = 0
    if held:
        yield flush()


def _join_bytes(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Neighbouring values joined into one for each size."""
    off = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off[ends].copy()), values.buffers()[2]])


def _finish(row: dict[str, bytes], right: pa.Table):
    """Of one block: ids and words of its documents, and for each word how many ids it has, these as text, and their pieces."""
    # the pieces of the block's ids, as the join found them
    have = right.filter(pa.compute.is_valid(right["id"])).combine_chunks()
    known, first = np.unique(have["id"].to_numpy(), return_index=True)
    piece_of = have["piece"].combine_chunks().take(pa.array(first)).cast(pa.large_binary()) if len(known) else pa.array([], pa.large_binary())
    text_of = pa.array([b"%d," % i for i in known.tolist()], pa.large_binary())
    parts = right.filter(pa.compute.is_valid(right["places"]))
    none = [np.zeros(0, np.int32)]
    place = np.concatenate([np.cumsum(_unpack(x, np.int32)) for x in parts["places"].to_pylist()] or none)
    size = np.concatenate([_unpack(x, np.int32) for x in parts["sizes"].to_pylist()] or none)
    ids = np.concatenate([_unpack(x, np.int32) for x in parts["ids"].to_pylist()] or none)
    counts, codes = _unpack(row["counts"], np.int32), _unpack_codes(row["codes"])
    doc = _unpack(row["doc_ids"], np.int64).reshape(2, -1)
    # words in the order of the block's list
    start = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=start[1:])
    order = np.argsort(place)
    if len(order) and not (place[order] == np.arange(len(order))).all():
        raise ValueError("a block lacks ids of some words")
    size = size[order].astype(np.int64)
    flat = _ranges(start[order], size)
    ids = ids[flat]
    at = np.searchsorted(known, ids)
    if len(ids) and (not len(known) or not (known[np.minimum(at, len(known) - 1)] == ids).all() or piece_of.null_count):
        raise ValueError("an id is not in the vocabulary")
    text = _join_bytes(text_of.take(pa.array(at)), size)
    piece = _join_bytes(piece_of.take(pa.array(at)), size)
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return doc, ends, codes, size, text, piece


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _slices(values: pa.Array, codes: np.ndarray, ends: np.ndarray, step: int):
    """For each text the joined values of its words, some texts at a time."""
    k = 0
    while k < len(ends) - 1:
        z = max(k + 1, int(np.searchsorted(ends, ends[k] + step, "right")) - 1)
        part = values.take(pa.array(codes[ends[k] : ends[z]]))
        off = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1)
        data = memoryview(part.buffers()[2]) if part.buffers()[2] is not None else memoryview(b"")
        for d in range(k, z):
            yield data[off[ends[d] - ends[k]] : off[ends[d + 1] - ends[k]]]
        k = z


@frugal
def _decode(batches, folder: str, full: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ids and pieces sorted by block -> rows of the documents of each block."""
    for table in runs(batches, 1):
        number = table["block"].to_numpy()
        bounds = group_bounds(number)
        for a, b in zip(bounds[:-1], bounds[1:]):
            row = dict(zip(_SECTIONS, _section(folder, int(number[a]), *_SECTIONS[:3])))
            yield from _documents(row, table.slice(a, b - a), full).combine_chunks().to_batches(max_chunksize=4096)


def _documents(row: dict[str, bytes], right: pa.Table, full: bool) -> pa.Table:
    doc, ends, codes, size, text, piece = _finish(row, right)
    n_tokens, ids_out, ids_sha, decoded, decoded_sha = [], [], [], [], []
    small = size.astype(np.int32)
    for d, (i, p) in enumerate(zip(_slices(text, codes, ends, 1 << 18), _slices(piece, codes, ends, 1 << 18))):
        n_tokens.append(int(small[codes[ends[d] : ends[d + 1]]].sum()))
        out = bytes(p).decode("utf-8", "replace")
        ids_sha.append(hashlib.sha256(i[:-1]).hexdigest())
        decoded_sha.append(hashlib.sha256(out.encode()).hexdigest())
        if full:
            ids_out.append(np.array(bytes(i[:-1]).split(b","), np.int32).tolist() if len(i) else [])
            decoded.append(out)
    doc_ids = pa.array(doc[0], pa.int64(), mask=doc[1].astype(bool))
    cols = {"id": doc_ids, "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
    if full:
        cols |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
    return pa.table(cols)


def encode_decode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and with ``full`` also ``ids`` and ``decoded``.

    A null text counts as empty: no ids, the digest of nothing. A null id stays null; rows that repeat an id
    each get their own row. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    with open(v.path, encoding="utf-8") as f:
        text = f.read()
    added = _added_tokens(text)
    shipped, kinds = spark.sparkContext.broadcast(text), spark.sparkContext.broadcast(_classes(text).tobytes())  # a vocabulary file, and a byte for each code point
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    folder = scratch.path("blocks")
    blocks = scratch.put(base.mapInArrow(lambda it: _blocks(it, kinds.value, added, v.block, folder), "block long"), "numbers")
    many = max(1, blocks.count())
    buckets = 64
    while buckets < many / 4 and buckets < v.buckets:
        buckets *= 2
    packets = blocks.repartition(many).mapInArrow(lambda it: _packets(it, buckets, folder), _PACKET_DDL)
    ids = packets.repartition(min(many, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _encode(it, shipped.value), "block long, places binary, sizes binary, ids binary, used array<int>")
    # a packet's row goes on with its first id; the other ids have rows of their own
    first = lambda c: F.when(F.coalesce(F.col("k"), F.lit(0)) == 0, F.col(c)).alias(c)
    used = ids.select("*", F.posexplode_outer("used").alias("k", "id")).select("block", first("places"), first("sizes"), first("ids"), "id")
    right = used.join(F.broadcast(pieces(spark, text, added)), "id", "left").select("block", "places", "sizes", "ids", "id", "piece")
    right = right.unionByName(blocks, allowMissingColumns=True)  # a block of empty texts has no word
    ddl = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return right.repartition(many, "block").sortWithinPartitions("block").mapInArrow(lambda it: _decode(it, folder, full), ddl).withColumnRenamed("id", id_col)
