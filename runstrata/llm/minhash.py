"""Near-duplicate documents by SetSketch registers (Ertl, VLDB 2021).

A register holds ``K = floor(1 - log_b(x))``, clipped to 0..q+1, of the smallest x of the set's exponential
variates of rate a: exponentially spaced, truncated minima. Registers merge by maximum, and equal registers
are likelier the more two sets share. The plan:

1. one pass gives each document a digest of its word sequence, its set size and its registers;
2. equal digests become one text (a partial minimum), so groups of exact copies go no further;
3. bands of registers are hashed; only bands that several texts share go on;
4. a band of more than one chunk (``block`` texts or ``chunk_bytes`` of shingles) first meets its head, the text
   of least id, chunk by chunk: of a group of near copies nearly all are in one component after rows in
   proportion to the band;
5. then all texts of a band meet in pairs of chunks, but for those of one component: a component of more than a
   chunk has chunks of its own, which never meet each other, so the rows of a hot band grow with what is
   outside its large components, and no band is ever one task;
6. within a pair of chunks, pairs that share this band first and may reach the threshold by size are put
   to a likelihood-ratio test on the joint register counts; texts of a pair that is not clearly below the
   threshold are sent on, once each;
7. there the full shingle sets decide: all intersections come from one incidence matrix product, and
   a spanning forest of the links leaves the task. No list of pairs is ever made;
8. components over the forest; copies get the component of their text.

The first bands go ahead, then the others; after each lot, texts of one component are compared no more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import components, forest
from ._shared import Scratch, frugal, group_bounds, per_key, runs
from ._text import U, shingle_sets, utf8


@dataclass(frozen=True)
class Near:
    """``size`` words a shingle; a link has 100 * intersection >= ``percent`` * union.

    ``registers`` and ``rows`` a band set recall: at 85 % and 120 registers in bands of 6, a pair at the
    threshold shares a band with probability 0.9999. ``cut`` is the log-likelihood ratio against the threshold
    beyond which a pair counts as clearly below it (8: four standard errors). ``block`` texts or ``chunk_bytes``
    of shingles make a chunk; a task compares two.
    """

    size: int = 3
    percent: int = 85
    registers: int = 120
    rows: int = 6
    base: float = 1.001
    rate: float = 20.0
    top: int = 65534
    block: int = 128
    chunk_bytes: int = 32 << 20
    first_bands: int = 3
    cut: float = 8.0
    seed: int = 77

    @property
    def bands(self) -> int:
        return self.registers // self.rows


FIVE_WORDS = Near(size=5, percent=80, rows=5)


def registers(minima: np.ndarray, p: Near) -> np.ndarray:
    """Register values from the smallest 64-bit hashes."""
    x = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**64) / p.rate
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(p.base)), 0, p.top + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def sketch_of(s: np.ndarray, p: Near) -> np.ndarray:
    """Smallest hash of a set under each register's hash function."""
    odd = np.random.default_rng(p.seed).integers(1, 2**63, p.registers, dtype=U) * U(2) + U(1)
    return _minima(s, odd)


def _minima(s: np.ndarray, odd: np.ndarray) -> np.ndarray:
    out = np.full(len(odd), ~U(0))
    for k in range(0, len(s), 256):
        np.minimum(out, (s[k : k + 256, None] * odd).min(axis=0), out=out)
    return out


def log_likelihood(j: np.ndarray, u: np.ndarray, up: np.ndarray, down: np.ndarray, same: np.ndarray, base: float) -> np.ndarray:
    """Joint log-likelihood of Jaccard ``j`` given how many registers are greater, smaller and equal; ``u``: the first set's share of both sizes."""

    def prob(x):
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    v = 1 - u
    a, b = prob(u - v * j), prob(v - u * j)
    tiny = 1e-12
    return up * np.log(np.maximum(a, tiny)) + down * np.log(np.maximum(b, tiny)) + same * np.log(np.maximum(1 - a - b, tiny))


def clearly_below(t: float, size_a, size_b, up, same, p: Near) -> np.ndarray:
    """Whether the likelihood has its peak below ``t`` and exceeds that at ``t`` by more than the cut."""
    u = size_a / (size_a + size_b)
    down = p.registers - up - same
    at = log_likelihood(np.full(len(u), t), u, up, down, same, p.base)
    best = at.copy()
    for j in np.linspace(0.0, t, 25)[:-1]:
        np.maximum(best, log_likelihood(np.full(len(u), j), u, up, down, same, p.base), out=best)
    return best - at > p.cut


@frugal
def _sketches(batches, p: Near):
    odd = np.random.default_rng(p.seed).integers(1, 2**63, p.registers, dtype=U) * U(2) + U(1)
    for batch in batches:
        buf, off = utf8(batch.column(1))
        digests, sizes, low = [], [], np.empty((batch.num_rows, p.registers), U)
        for d, (h, s) in enumerate(shingle_sets(buf, off, p.size)):
            digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            sizes.append(len(s))
            low[d] = _minima(s, odd)
        regs = registers(low, p)
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], names=["id", "digest", "n", "regs"])


def _pairs(bounds: np.ndarray, side: np.ndarray, most: int = 1 << 16):
    """Index pairs of all groups in slices: both in one chunk, or one of each."""
    left, right, n = [], [], 0
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a < 2:
            continue
        if side[a:b].any():
            x, y = np.flatnonzero(side[a:b] == 1) + a, np.flatnonzero(side[a:b] == 2) + a
            i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        else:
            i, j = np.triu_indices(b - a, 1)
            i, j = i + a, j + a
        for k in range(0, len(i), most):
            left.append(i[k : k + most])
            right.append(j[k : k + most])
            n += len(left[-1])
            if n >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


@frugal
def _promising(batches, p: Near):
    """Texts of pairs that may be links, for each pair of chunks of a band."""
    t = p.percent / 100
    for table in runs(batches, 1):
        key, side, band = (table.column(c).to_numpy() for c in ("at", "side", "band"))
        ids, sizes, comp = (table.column(c).to_numpy() for c in ("id", "n", "comp"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, p.registers)
        wanted = np.zeros(len(ids), bool)
        for i, j in _pairs(group_bounds(key), side):
            few, many = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            keep = (comp[i] != comp[j]) & (100 * few >= p.percent * many)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            same = regs[i] == regs[j]
            before = same.reshape(len(i), -1, p.rows).all(axis=2) if p.bands * p.rows == p.registers else same[:, : p.bands * p.rows].reshape(len(i), p.bands, p.rows).all(axis=2)
            first = before.argmax(axis=1) == band[i]  # an earlier band has the pair already
            i, j, same = i[first], j[first], same[first]
            if not len(i):
                continue
            ok = ~clearly_below(t, sizes[i].astype(float), sizes[j].astype(float), (regs[i] > regs[j]).sum(axis=1), same.sum(axis=1), p)
            wanted[i[ok]] = wanted[j[ok]] = True
        at = np.flatnonzero(wanted)
        if len(at):
            yield table.select(["id", "digest", "at", "comp"]).take(pa.array(at)).combine_chunks().to_batches()[0]


@frugal
def _sets(batches, p: Near):
    """The full set of each text, as sorted 64-bit shingles. Rows come by id, so what repeats an id and its text goes."""
    last, seen = None, set()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        buf, off = utf8(batch.column(1))
        rows, held = [], 0
        for i, (h, s) in zip(ids, shingle_sets(buf, off, p.size)):
            digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
            if i != last:
                last, seen = i, set()
            if digest in seen:
                continue
            seen.add(digest)
            rows.append((i, digest, s.tobytes()))
            held += len(rows[-1][2])
            if held > 16 << 20:
                yield _set_rows(rows)
                rows, held = [], 0
        yield _set_rows(rows)


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["id", "digest", "shingles"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[which]
    who, which = who[keep], place[which[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(which, kind="stable")
    who, which = who[order], which[order]
    n = int(which[-1]) + 1 if len(which) else 0
    step = max(1, min(n, max(256, (4 << 20) // len(sets))))
    cuts = np.searchsorted(which, np.arange(0, n + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = np.zeros((len(sets), step), np.float32)
        part[who[a:b], which[a:b] - k * step] = 1
        out += part @ part.T
    return out


@frugal
def _links(batches, p: Near):
    """A spanning forest of the links within each group of texts."""
    for table in runs(batches, 1):
        key = table.column("at").to_numpy()
        ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
        raw = table.column("shingles").to_pylist()
        bounds, us, vs = group_bounds(key), [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            sets = [np.frombuffer(x, U) for x in raw[a:b]]
            size = np.array([len(s) for s in sets], np.float64)
            both = intersections(sets) if b - a > 2 else np.array([[size[0], x := len(np.intersect1d(sets[0], sets[-1], assume_unique=True))], [x, size[-1]]])[: b - a, : b - a]
            link = 100 * both >= p.percent * (size[:, None] + size[None, :] - both)
            i, j = np.nonzero(np.triu(link & (comp[a:b, None] != comp[None, a:b]), 1))
            us.append(ids[a:b][i])
            vs.append(ids[a:b][j])
        u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _star(hot: DataFrame) -> DataFrame:
    """Texts of bands of several chunks -> each chunk with the band's head, in the form of ``_chunk_pairs``."""
    head = F.col("id") == F.col("head")
    part = F.when(head, F.expr("sequence(0L, parts - 1)")).otherwise(F.array(F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts"))))
    return hot.withColumn("part", F.explode(part)).select(F.xxhash64("key", "part").alias("at"), F.when(head, 1).otherwise(2).alias("side"), "band", "id", "digest", "comp")


def _chunk_pairs(rows: DataFrame, p: Near, chunks_of) -> DataFrame:
    """Texts of bands (key, band, id, digest, n, parts, comp) -> a row for each pair of chunks that a text is to be in: ``at``, ``side`` (0: all pairs of the group; 1 against 2), and the text.

    A component beyond one chunk has chunks of its own, dealt by id; all smaller ones share the band's other chunks.
    """
    cols = ["band", "id", "digest", "comp"]
    small = rows.where("parts = 1").select(F.xxhash64("key").alias("at"), F.lit(0).alias("side"), *cols)
    hot = rows.where("parts > 1").withColumn("pair", F.xxhash64("key", "comp"))
    own = per_key(hot, "pair", F.min("key").alias("key"), F.min("comp").alias("c"), F.count(F.lit(1)).alias("n_in"), F.sum("n").alias("shingles"))
    own = own.select("pair", "key", "n_in", "shingles", F.when(chunks_of(F.col("n_in"), F.col("shingles")) > 1, F.col("c")).alias("large"))
    classes = own.groupBy("key", "large").agg(F.sum("n_in").alias("n_in"), F.sum("shingles").alias("shingles")).select(F.col("key").alias("of"), F.col("large").alias("class"), chunks_of(F.col("n_in"), F.col("shingles")).alias("many"))
    by_key = Window.partitionBy("of")  # of each band its classes: fewer than its chunks
    classes = classes.withColumn("lo", F.sum("many").over(by_key.orderBy("class")) - F.col("many")).withColumn("total", F.sum("many").over(by_key))
    placed = own.join(classes, (F.col("key") == F.col("of")) & F.col("large").eqNullSafe(F.col("class"))).select("pair", "large", "lo", "many", "total")
    hot = hot.join(placed, "pair").withColumn("part", F.col("lo") + F.pmod(F.xxhash64("id", F.lit(3)), F.col("many")))
    others = F.filter(F.expr("sequence(0L, total - 1)"), lambda o: F.col("large").isNull() | (o < F.col("lo")) | (o >= F.col("lo") + F.col("many")))
    hot = hot.withColumn("other", F.explode(others))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return small.unionByName(hot.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("at"), side.alias("side"), *cols))


def near_duplicates(docs: DataFrame, p: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    component_id: the smallest id reachable by links, itself included; kept: it is the row's own id.
    Texts that are null or have no word have an empty set and link with nothing. A null id links with
    nothing, has a null component and is kept. Rows that repeat an id share its links. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.put(base.mapInArrow(lambda it: _sketches(it, p), "id long, digest binary, n long, regs binary"), "sketches")
    able = sketches.where(F.col("id").isNotNull() & (F.col("n") > 0))
    texts = scratch.put(able.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "texts")

    width = 2 * p.rows
    chunks_of = lambda n, shingles: F.greatest(F.lit(1), F.ceil(n / p.block), F.ceil(shingles * 8 / p.chunk_bytes)).cast("long")
    key = F.expr(f"transform(sequence(0, {p.bands - 1}), b -> named_struct('band', b, 'key', xxhash64(b, substring(regs, b * {width} + 1, {width}))))")
    banded = texts.select("rep", "digest", "n", F.explode(key).alias("x")).select("rep", "digest", "n", "x.band", "x.key")
    counts = per_key(banded, "key", F.count(F.lit(1)).alias("n_in"), F.sum("n").alias("shingles"), F.min("rep").alias("head")).where("n_in > 1")
    counts = counts.select("key", "head", chunks_of(F.col("n_in"), F.col("shingles")).alias("parts"))
    shared = scratch.put(banded.join(counts, "key").select("key", "band", F.col("rep").alias("id"), "digest", "n", "parts", "head"), "shared")
    # the full sets of all texts that share a band, made once for all lots
    asked = shared.select("id").distinct()
    mine = base.join(asked.hint("merge"), "id", "left_semi")  # the asked ids grow with the corpus: never broadcast
    full = scratch.put(mine.mapInArrow(lambda it: _sets(it, p), "id long, digest binary, shingles binary"), "full")

    # an id whose rows hold several texts ties those texts together
    several = able.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
    tied = able.select("id", "digest").join(several, "id").join(texts.select("digest", "rep"), "digest")
    edges = scratch.put(tied.select(F.col("id").alias("u"), F.col("rep").alias("v")), "tied")
    early = F.col("band") < p.first_bands
    comps = None
    for lot in range(3):
        if lot:
            rows = (shared if lot == 1 else shared.where(~early)).join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
            # a band whose texts are all in one component has nothing left to compare
            open_ = per_key(rows, "key", F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            rows = scratch.put(rows.join(open_, "key"), f"rows-{lot}")  # read several times below: as a table it is planned once
        if lot == 0:
            met = _star(shared.where(early & (F.col("parts") > 1)).withColumn("comp", F.col("id")))
        elif lot == 1:
            met = _chunk_pairs(rows.where(early), p, chunks_of).unionByName(_star(rows.where(~early & (F.col("parts") > 1))))
        else:
            met = _chunk_pairs(rows, p, chunks_of)
        dealt = met.join(texts.select("digest", "n", "regs"), "digest").select("at", "side", "band", "id", "digest", "n", "comp", "regs")
        dealt = dealt.repartition(F.col("at")).sortWithinPartitions("at", "id")
        promising = dealt.mapInArrow(lambda it: _promising(it, p), "id long, digest binary, at long, comp long")
        sets = promising.join(full.withColumnRenamed("digest", "own"), "id").where(F.col("own") == F.col("digest")).select("at", "id", "comp", "shingles")
        found = sets.repartition(F.col("at")).sortWithinPartitions("at", "id").mapInArrow(lambda it: _links(it, p), "u long, v long")
        edges = edges.unionByName(scratch.put(found, f"links-{lot}"))
        if lot:
            scratch.drop(f"rows-{lot}")
        comps = components(edges, scratch, f"comps-{lot}")
    scratch.drop("full", "shared")

    root = texts.select("digest", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("root"))
    out = sketches.select("id", "digest", "n").join(root, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
