"""Near-duplicate embeddings by sorted projection passes.

Equal vectors of a label are one from the start: their class goes on under its least id, with a count.

Each pass gives a vector a code of concatenated random hashes (signs of random projections, drawn anew for
the pass), orders all vectors of a label lexicographically by code and compares each with its next ``window``
neighbours in double precision. Passes are one sorted table (pass, label, code), dealt by range, so neither a
label nor a code is ever one task. The last and first vectors of neighbouring partitions meet in a second,
small step. From each task a spanning forest of the verified pairs leaves, never the pairs.

The union of all passes gives groups, which may lack links that no window met. So every vector then meets every
other of its label once, in tiles: tasks of two parts of a label (dealt by a hash of the id), compared by matrix
products of blocks of at most ``block`` vectors, in the order of their groups. A pair of blocks is left out only where
the angle between their centres less both radii is beyond the threshold's, so no pair in it can link. One count for
each vector and a spanning forest of the links between groups leave. Counts and components are thus exact, at a cost
quadratic in the distinct vectors of a label; a label of n of them has n / (16 block) parts, and each vector is sent
to as many tiles. Vectors travel in the type they are stored in; only comparisons widen them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, forest
from ._shared import Scratch, frugal, group_bounds, per_key, runs


@dataclass(frozen=True)
class Passes:
    """A pair at the threshold of 0.93 agrees in a sign with probability 0.88; the window reaches all vectors that share a prefix of about log2(rows of the label / window) signs."""

    cosine: float = 0.93
    passes: int = 8
    bits: int = 32
    window: int = 64
    block: int = 1024
    seed: int = 11


def unit(raw) -> np.ndarray:
    """Vectors of one length and type from their bytes (the first byte is the width of a number), scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(r[1:] for r in raw), f"f{raw[0][0]}").reshape(len(raw), -1).astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@frugal
def _encode(batches, width: int):
    """(id, label, embedding) -> the same with the vector as bytes; null where it can link with nothing."""
    kind, mark = np.dtype(f"f{width}"), bytes([width])
    for batch in batches:
        col = batch.column(2)
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind)
        off = np.zeros(len(col) + 1, np.int64)
        lens = np.nan_to_num(np.asarray(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
        np.cumsum(lens, out=off[1:])
        out = []
        for a, b in zip(off[:-1], off[1:]):
            v = flat[a:b]
            out.append(mark + (v + kind.type(0)).tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)  # -0 becomes 0
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])


@frugal
def _codes(batches, p: Passes):
    planes: dict[int, np.ndarray] = {}
    weight = np.uint64(1) << np.arange(p.bits - 1, -1, -1, dtype=np.uint64)
    for batch in batches:
        raw = batch.column(2).to_pylist()
        sizes = np.array([len(x) for x in raw])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = unit([raw[i] for i in at])
            dim = x.shape[1]
            if dim not in planes:
                planes[dim] = np.random.default_rng([p.seed, dim]).standard_normal((dim, p.passes * p.bits))
            signs = (x @ planes[dim] > 0).reshape(len(at), p.passes, p.bits)
            code = (signs * weight).sum(axis=2).astype(np.int64)
            rows = batch.take(pa.array(at))
            for k in range(p.passes):
                yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), rows.column(1), pa.array(np.full(len(at), dim, np.int32)), pa.array(code[:, k]), rows.column(0), rows.column(2)], names=["pass", "label", "dim", "code", "id", "vec"])


def _near(x: np.ndarray, group: np.ndarray, p: Passes):
    """Index pairs within the window, in one group, at or above the threshold."""
    us, vs = [], []
    for d in range(1, min(p.window, len(x) - 1) + 1):
        same = group[d:] == group[:-d]
        if not same.any():
            break
        hit = np.flatnonzero(same & (np.einsum("ij,ij->i", x[d:], x[:-d]) >= p.cosine))
        us.append(hit)
        vs.append(hit + d)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


@frugal
def _compare(batches, p: Passes):
    """Windows over one sorted partition; its first and last vectors leave as well, for the neighbours."""
    part = TaskContext.get().partitionId()
    names = ["kind", "u", "v", "border", "place", "pass", "label", "dim", "vec"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def rows(kind, border, t, start):
        n = len(t)
        cols = [[kind] * n, t["id"], [None] * n, [border] * n, range(start, start + n), t["pass"], t["label"], t["dim"], t["vec"]]
        return pa.record_batch([pa.array(c, ty) if not isinstance(c, pa.ChunkedArray) else c.combine_chunks().cast(ty) for c, ty in zip(cols, types)], names=names)

    head, tail, seen = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if head is None or len(head) < p.window:
            head = t.slice(0, p.window) if head is None else pa.concat_tables([head, t]).slice(0, p.window)
        t = t if tail is None else pa.concat_tables([tail, t])
        u, v = _pairs_of(t, p)
        ids = t["id"].to_numpy()
        u, v = forest(ids[u], ids[v])
        n = len(u)
        yield pa.record_batch([pa.array(["link"] * n, pa.string()), pa.array(u, pa.int64()), pa.array(v, pa.int64())] + [pa.nulls(n, ty) for ty in types[3:]], names=names)
        seen += batch.num_rows
        tail = t.slice(max(0, len(t) - p.window))
    if head is not None:
        yield rows("border", part, head, 1 << 40)  # the first rows stand after the last ones of the partition before
        yield rows("border", part + 1, tail, 0)


def _pairs_of(t: pa.Table, p: Passes):
    group = np.stack([t[c].to_numpy().astype(np.int64) for c in ("pass", "label", "dim")])
    raw = t["vec"].to_pylist()
    bounds = group_bounds(*group)
    us, vs = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > 1:
            x = unit(raw[a:b])
            u, v = _near(x, np.zeros(b - a, np.int8), p)
            us.append(u + a)
            vs.append(v + a)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


@frugal
def _borders(batches, p: Passes):
    for table in runs(batches, 1):
        border = table["border"].to_numpy()
        bounds = group_bounds(border)
        for a, b in zip(bounds[:-1], bounds[1:]):
            t = table.slice(a, b - a)
            u, v = _pairs_of(t, p)
            ids = t["u"].to_numpy()
            u, v = forest(ids[u], ids[v])
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _balls(x: np.ndarray, order: np.ndarray, block: int):
    """Blocks of rows in that order, each with a centre and the largest angle from it."""
    out = []
    for k in range(0, len(order), block):
        at = order[k : k + block]
        centre = x[at].sum(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-6 else x[at[0]]
        out.append((at, centre, np.arccos(np.clip((x[at] @ centre).min(), -1, 1))))
    return out


@frugal
def _count(batches, p: Passes):
    """Links of each vector within a tile (n), and links between groups of the passes (other)."""
    reach = np.arccos(p.cosine) + 1e-6
    for table in runs(batches, 1):
        key, side, ids, comp, copies = (table[c].to_numpy() for c in ("at", "side", "id", "component", "copies"))
        raw = table["vec"].to_pylist()
        bounds = group_bounds(key)
        us, vs, out_n = [], [], np.zeros(len(key), np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            x, own, n, times = unit(raw[a:b]), comp[a:b], out_n[a:b], copies[a:b].astype(np.float64)
            order = np.argsort(own, kind="stable")
            one = _balls(x, order[side[a:b][order] < 2], p.block)
            two = _balls(x, order[side[a:b][order] == 2], p.block) if side[a:b].any() else None
            u, v = [], []
            for i, (r, centre, radius) in enumerate(one):
                for j, (s, other, far) in enumerate(one[i:] if two is None else two):
                    if np.arccos(np.clip(centre @ other, -1, 1)) - radius - far > reach:
                        continue
                    hit = x[r] @ x[s].T >= p.cosine
                    if two is None and not j:
                        np.fill_diagonal(hit, False)
                    else:
                        n[s] += (times[r] @ hit).astype(np.int64)
                    n[r] += (hit @ times[s]).astype(np.int64)
                    k, m = np.nonzero(hit & (own[r][:, None] != own[s]))
                    k, m = forest(own[r][k], own[s][m])
                    u.append(k)
                    v.append(m)
            if u:
                u, v = forest(np.concatenate(u), np.concatenate(v))
                us.append(u)
                vs.append(v)
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        yield pa.record_batch([pa.array(ids), pa.array(out_n), pa.nulls(len(ids), pa.int64())], names=["id", "n", "other"])
        yield pa.record_batch([pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()), pa.array(v, pa.int64())], names=["id", "n", "other"])


def near_vectors(vectors: DataFrame, p: Passes = Passes(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and not null and their cosine in double precision is at least
    ``p.cosine``. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing,
    nor do vectors of unequal length with each other. component_id: the smallest id reachable, itself included;
    kept: it is the vector's own. Rows that repeat an id count as one vector (the least by label and embedding).
    Each row with a null id is returned with no links, a null component, kept. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    narrow = dict(vectors.dtypes)[vec_col] == "array<float>"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<float>" if narrow else "array<double>").alias("embedding"))
    nameless = base.where("id is null").select(F.col("id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    one = base.where("id is not null").mapInArrow(lambda it: _encode(it, 4 if narrow else 8), "id long, label long, vec binary").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")
    one = scratch.put(one, "vectors")
    # equal vectors of a label are one class, known by its least id; a hot vector is summed before the shuffle
    able = scratch.put(one.where("label is not null and vec is not null").groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")

    coded = able.select("id", "label", "vec").mapInArrow(lambda it: _codes(it, p), "pass int, label long, dim int, code long, id long, vec binary")
    order = ["pass", "label", "dim", "code", "id"]
    compared = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _compare(it, p), "kind string, u long, v long, border int, place long, pass int, label long, dim int, vec binary")
    compared = scratch.put(compared, "compared")
    at_border = compared.where("kind = 'border'").select("border", "place", "u", "pass", "label", "dim", "vec")
    over = at_border.repartition("border").sortWithinPartitions("border", "place").mapInArrow(lambda it: _borders(it, p), "u long, v long")
    links = compared.where("kind = 'link'").select("u", "v").unionByName(over)
    comps = scratch.put(components(links, scratch, "comps"), "components")
    scratch.drop("compared")

    member = able.join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), "copies", F.xxhash64("label", F.octet_length("vec")).alias("group"), "vec")
    size = per_key(member, "group", F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("vec").cast("long") * (2 if narrow else 1)).alias("bytes"))
    size = size.select("group", F.greatest(F.lit(1), F.ceil(F.col("size") / (16 * p.block)), F.ceil(F.col("bytes") / (32 << 20))).alias("parts"))
    member = member.join(size, "group")
    member = member.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    member = member.select(
        F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")).alias("at"),
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"),
        "id", "component", "copies", "vec",
    )
    met = scratch.put(member.repartition("at").sortWithinPartitions("at", "id").mapInArrow(lambda it: _count(it, p), "id long, n long, other long"), "met")
    counted = met.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    joined = scratch.put(components(met.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")), scratch, "joins"), "joined")
    comps = comps.withColumnRenamed("node", "id").withColumnRenamed("component", "first")
    classes = able.select("id", "label", "vec", "copies").join(comps, "id", "left").withColumn("first", F.coalesce("first", "id"))
    classes = classes.join(joined.withColumnRenamed("node", "first"), "first", "left").join(counted, "id", "left")
    # a class has the links found for it and those among its own copies; rows find theirs by 128 bits of label and vector
    keys = lambda: [F.xxhash64("label", "vec").alias("k"), F.xxhash64(F.lit(7), "label", "vec").alias("k2")]
    classes = classes.select(*keys(), F.coalesce("component", "first").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n"))
    out = one.select("id", F.when(F.col("label").isNotNull() & F.col("vec").isNotNull(), F.struct(*keys())).alias("x")).select("id", "x.k", "x.k2").join(classes, ["k", "k2"], "left")
    component = F.coalesce("root", "id")
    out = out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    return out.unionByName(nameless).withColumnRenamed("id", id_col)
