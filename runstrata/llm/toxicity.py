"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

Confirmed toxic documents are the positives; documents drawn without regard to labels are the unlabelled rest.
A linear classifier over the density of words and word beginnings is fitted in numpy to the class-prior-corrected risk

    R = prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss; where the bracket turns negative, the step goes against it, as the paper has it. Steps
are Adam with a soft threshold, so most words have weight 0 and long texts gather no noise. Words are known by
64-bit hashes, not folded into buckets: a word the training never saw weighs nothing. Beginnings of 4 to 8 bytes stand for stems.

Before the fit, features that are about as frequent in positives as in the rest are screened out by a two-sample z.
Its counts, sums and sums of squares are aggregates over the confirmed documents (for each of their features) and over
all documents that may be learnt from (for those features that ``seen`` confirmed documents hold); only screened
features come to the driver, and of the documents of the fit only these.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, frugal, trim
from ._text import LETTERS, LOWER, U, chunks, mix, utf8, word_hashes, words


@dataclass(frozen=True)
class Learning:
    """``positives`` and ``unlabelled`` bound the documents of the fit, ``confirmed`` the labelled ones of the screen: those whose ids have the least hash. Of the rest the screen reads all. ``seen`` confirmed documents hold a feature, at least; ``z``: the least |z| that passes. The vocabulary is bounded: ``candidates`` features, those that most confirmed documents hold, are screened, and ``features`` of the largest |z| may enter the model."""

    positives: int = 2000
    unlabelled: int = 6000
    confirmed: int = 100_000
    seen: int = 4
    z: float = 3.0
    candidates: int = 1 << 20
    features: int = 1 << 16
    steps: int = 350
    rate: float = 0.1
    sparsity: float = 2e-4
    prior: float | None = None
    seed: int = 5


_LOW = U((1 << 16) - 1)
BEGINNINGS = (4, 5, 6, 7, 8)


def density(count, of):
    """The value of a feature that ``count`` of a text's ``of`` words have: 1 from one word in 25 on."""
    return np.minimum(1.0, 25 * count / of)


class Vocabulary:
    """Sorted feature hashes, and a sieve of their low bits where most unknown ones end."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(words & _LOW).astype(np.int64)] = True

    def found(self, col: pa.Array):
        """Some texts at a time: first and last text, and for each known feature of a text the text, the feature's place and its density."""
        buf, off = utf8(col)
        for lo, hi, h, first in _hashed(buf, off):
            pairs = [np.zeros(0, np.int64)]
            for x, which in h if len(self.words) else []:
                maybe = np.flatnonzero(self.sieve[(x & _LOW).astype(np.int64)])
                at = np.searchsorted(self.words, x[maybe])
                at[at == len(self.words)] = 0
                hit = self.words[at] == x[maybe]
                doc = np.searchsorted(first, which[maybe[hit]], "right") - 1
                pairs.append(doc * len(self.words) + at[hit])
            pair, count = np.unique(np.concatenate(pairs), return_counts=True)
            doc, at = np.divmod(pair, max(1, len(self.words)))
            yield lo, hi, doc, at, density(count, np.diff(first)[doc])


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float

    @cached_property
    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.words)

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.full(len(col), self.bias)
        for lo, hi, doc, at, value in self.vocabulary.found(col):
            out[lo:hi] += np.bincount(doc, self.weights[at] * value, hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _hashed(buf, off):
    """Some texts at a time: hashes of whole words and of beginnings, each with the word it is of, and each text's first word."""
    for lo, hi in chunks(off, 1 << 19):
        part, at = LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
        starts, ends, first = words(part, at, LETTERS)
        every = np.arange(len(starts))
        out = [(word_hashes(part, starts, ends), every)]
        for size in BEGINNINGS:
            longer = np.flatnonzero(ends - starts > size)
            out.append((mix(word_hashes(part, starts[longer], starts[longer] + size)), longer))
        yield lo, hi, out, first


_SUMS = "feature long, n long, s long, q long"
_UNIT = 1 << 20  # sums are of whole parts of this, so no order of tasks changes them


def _sum_rows(feature, n, s, q) -> pa.RecordBatch:
    return pa.record_batch([pa.array(feature.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(s.astype(np.int64)), pa.array(q.astype(np.int64))], names=["feature", "n", "s", "q"])


def _sums_of(at: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.bincount(at, v, n) for v in (None, np.rint(value * _UNIT), np.rint(value * value * _UNIT))]


_MOST = 1 << 20  # features that a task gathers before it sends their sums on


@frugal
def _every_feature(batches):
    """Texts -> for each feature how many hold it, the sum of its densities and that of their squares, summed over many texts."""
    held, sums = np.zeros(0, U), np.zeros((3, 0))
    for batch in batches:
        buf, off = utf8(batch.column(0))
        for lo, hi, h, first in _hashed(buf, off):
            x = np.concatenate([x for x, _ in h])
            doc = np.searchsorted(first, np.concatenate([which for _, which in h]), "right") - 1
            every, which = np.unique(x, return_inverse=True)
            pair, count = np.unique(doc * len(every) + which, return_counts=True)
            doc, which = np.divmod(pair, max(1, len(every)))
            own = _sums_of(which, density(count, np.diff(first)[doc]), len(every))
            both, at = np.unique(np.concatenate([held, every]), return_inverse=True)
            held, sums = both, np.stack([np.bincount(at, np.concatenate([a, b]), len(both)) for a, b in zip(sums, own)])
            if len(held) > _MOST:
                yield _sum_rows(held.view(np.int64), *sums)
                held, sums = np.zeros(0, U), np.zeros((3, 0))
    yield _sum_rows(held.view(np.int64), *sums)


_SLICES = 64
_SLICED = "slice int, sums binary"


def _sliced(total: np.ndarray) -> pa.RecordBatch:
    """(3, features) of whole numbers as a compressed row for each slice of the features."""
    cuts = np.linspace(0, total.shape[1], _SLICES + 1).astype(np.int64)
    return pa.record_batch([pa.array(range(_SLICES), pa.int32()), pa.array([pa.compress(total[:, a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["slice", "sums"])


def _slice(k: int, data: bytes, n: int) -> np.ndarray:
    cuts = np.linspace(0, n, _SLICES + 1).astype(np.int64)
    size = int(cuts[k + 1] - cuts[k])
    return np.frombuffer(pa.decompress(data, decompressed_size=24 * size, codec="zstd", asbytes=True), np.int64).reshape(3, size)


@frugal
def _known_features(batches, words: np.ndarray):
    """The same for the known features alone, a row for each slice of them once for a whole task."""
    known, total = Vocabulary(words), np.zeros((3, len(words)), np.int64)
    for batch in batches:
        for _, _, _, at, value in known.found(batch.column(0)):
            total += np.array(_sums_of(at, value, len(words))).astype(np.int64)
    if total[0].any():
        yield _sliced(total)


@frugal
def _add_slices(batches, n: int):
    """Rows sorted by slice -> one row a slice: (slice, sums) of all tasks."""
    last, total = None, None
    out = lambda: pa.record_batch([pa.array([last], pa.int32()), pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["slice", "sums"])
    for batch in batches:
        for k, data in zip(*(c.to_pylist() for c in batch.columns)):
            if k != last:
                if last is not None:
                    yield out()
                last, total = k, np.zeros_like(_slice(k, data, n))
            total = total + _slice(k, data, n)
    if last is not None:
        yield out()


@frugal
def _known_of(batches, words: np.ndarray):
    """(id, kind, text) -> (id, kind, places of its known features, their densities)."""
    known = Vocabulary(words)
    for batch in batches:
        rows = []
        for lo, hi, doc, at, value in known.found(batch.column(2)):
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            at, value = at.astype(np.int32), value.astype(np.float32)
            rows += [(at[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], names=["id", "kind", "at", "density"])


def screen(n_p: int, in_p: np.ndarray, n_u: int, in_u: np.ndarray) -> np.ndarray:
    """The two-sample z of each feature from (documents, sum, sum of squares) of both kinds."""
    mean_p, mean_u = in_p[1] / n_p, in_u[1] / n_u
    return (mean_p - mean_u) / np.sqrt((in_p[2] / n_p - mean_p**2) / n_p + (in_u[2] / n_u - mean_u**2) / n_u + 1e-9)


def fit(positives: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]], prior: float, p: Learning = Learning(), screened: bool = False) -> Model:
    """Fit to the features (hashes and densities) of each document of both kinds; unless they are ``screened``, the screen is made of these documents alone."""
    if not positives or not unlabelled:
        return Model(np.zeros(0, U), np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -30.0)
    n_p, n_u = len(positives), len(unlabelled)
    docs = positives + unlabelled
    x, value = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
    value, who = value.astype(np.float64), np.repeat(np.arange(n_p + n_u, dtype=np.int32), [len(d[0]) for d in docs])
    vocabulary, place = np.unique(x, return_inverse=True)
    if not screened:
        in_p, in_u = (np.array([np.bincount(place[of], v, len(vocabulary)) for v in (None, value[of], value[of] ** 2)]) for of in (who < n_p, who >= n_p))
        use = (in_p[0] + in_u[0] >= p.seen) & (np.abs(screen(n_p, in_p, n_u, in_u)) >= p.z)
        at = use[place]
        value, who = value[at], who[at]
        vocabulary, place = vocabulary[use], (np.cumsum(use) - 1)[place[at]]
    first, rest = who < n_p, who >= n_p
    pw, pc, px = who[first], place[first], value[first]
    uw, uc, ux = who[rest] - n_p, place[rest], value[rest]
    w, b = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, p.steps + 1):
        zp = b + np.bincount(pw, w[pc] * px, n_p)
        zu = b + np.bincount(uw, w[uc] * ux, n_u)
        pos_minus, un_minus = np.logaddexp(0, zp).mean(), np.logaddexp(0, zu).mean()
        inner = un_minus - prior * pos_minus
        gp, gu = -prior * sig(-zp) / n_p, np.zeros(n_u)  # of prior * R_p(+1)
        if inner >= 0:
            gp -= prior * sig(zp) / n_p
            gu = sig(zu) / n_u
        else:
            gp = prior * sig(zp) / n_p
            gu = -sig(zu) / n_u
        g = np.bincount(pc, gp[pw] * px, len(w)) + np.bincount(uc, gu[uw] * ux, len(w))
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = p.rate / (1 - 0.9**step)
        size = np.sqrt(v / (1 - 0.999**step)) + 1e-8
        w = w - scale * m / size
        w = np.sign(w) * np.maximum(np.abs(w) - p.rate * p.sparsity / size, 0)
        b -= scale * mb / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    keep = w != 0
    return Model(vocabulary[keep], w[keep], b)


def _cells(col: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The arrays in a binary column, without copies."""
    return [np.frombuffer(x.as_buffer(), kind) for chunk in col.chunks for x in chunk]


def train(docs: DataFrame, labels: DataFrame, learns, p: Learning = Learning(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit to rows of ``docs`` for which ``learns`` (a column of the id) holds. Only a 1 in ``labels`` is read as a confirmation; the prior is the share of 1 among labelled rows unless it is given.

    Rows with a null id, and labels that are null or have no id, teach nothing; a null text is an empty one. An id
    labelled both 1 and 0 is a 1. Rows that repeat an id all count in the screen; in the fit the id counts once, by the
    row of least features. Ties of the sample's order go by id. Without confirmed documents, or without documents, the
    model has no word, and every text scores the prior. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxic")
    order = F.xxhash64(F.col("id"), F.lit(p.seed))
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y")).withColumnRenamed("id", id_col).where(learns).withColumnRenamed(id_col, "id")
    counted = marked.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("k")).first()
    prior = p.prior if p.prior is not None else min(0.5, max(1e-4, (counted.k or 0) / counted.n)) if counted.n else 1e-4
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).where(learns & F.col(id_col).isNotNull()).withColumnRenamed(id_col, "id")
    confirmed = scratch.put(marked.where("y = 1").orderBy(order, "id").limit(p.confirmed).select("id"), "confirmed")  # at most p.confirmed rows
    # the screen, over all rows
    sums = [F.sum(c).alias(c) for c in ("n", "s", "q")]
    all_p = base.join(F.broadcast(confirmed), "id").select("text")
    in_p = all_p.mapInArrow(_every_feature, _SUMS).groupBy("feature").agg(*sums).where(F.col("n") >= p.seen).orderBy(F.desc("n"), "feature").limit(p.candidates).toArrow()
    words = np.sort(in_p["feature"].to_numpy().view(U))
    in_p = _columns(in_p, words)
    n_p, n_u = all_p.count(), base.count()
    shared = spark.sparkContext.broadcast(words)  # features that several confirmed documents hold
    in_u = np.zeros((3, len(words)))
    if len(words):
        parts = base.select("text").mapInArrow(lambda it: _known_features(it, shared.value), _SLICED)
        parts = parts.repartition(_SLICES, "slice").sortWithinPartitions("slice").mapInArrow(lambda it: _add_slices(it, len(shared.value)), _SLICED).toArrow()  # a row a slice
        parts = dict(zip(parts["slice"].to_pylist(), parts["sums"].to_pylist()))
        in_u = np.concatenate([_slice(k, parts[k], len(words)) for k in sorted(parts)], axis=1) / [[1], [_UNIT], [_UNIT]] if parts else in_u
    z = np.abs(screen(max(1, n_p), in_p, max(1, n_u), in_u))
    chosen = np.sort(np.argsort(-z, kind="stable")[: p.features])
    words = words[chosen[z[chosen] >= p.z]]
    # the fit, on a bounded sample, a row for each id
    one = confirmed.orderBy(order, "id").limit(p.positives).select("id", F.lit(1).alias("kind"))
    rest = base.select("id").distinct().orderBy(order, "id").limit(p.unlabelled).select("id", F.lit(0).alias("kind"))
    picked = scratch.put(one.unionByName(rest), "picked")  # at most positives + unlabelled rows
    kept = spark.sparkContext.broadcast(words)
    sample = base.join(F.broadcast(picked), "id").select("id", "kind", "text").mapInArrow(lambda it: _known_of(it, kept.value), "id long, kind int, at binary, density binary")
    got = sample.groupBy("id", "kind").agg(F.min(F.struct("at", "density")).alias("x")).select("id", "kind", "x.at", "x.density").toArrow().sort_by([("kind", "ascending"), ("id", "ascending")])
    kind, cells = got["kind"].to_numpy(), list(zip(_cells(got["at"], np.int32), _cells(got["density"], np.float32)))
    pick = lambda k: [(words[cells[i][0]], cells[i][1]) for i in np.flatnonzero(kind == k)]
    model = fit(pick(1), pick(0), prior, p, screened=True)
    del got, cells
    pa.default_memory_pool().release_unused()  # the driver has more to do than this
    return model


def _columns(sums: pa.Table, words: np.ndarray) -> np.ndarray:
    """(3, features): the sums in the order of ``words``; 0 where a feature has none."""
    out = np.zeros((3, len(words)))
    at = np.searchsorted(words, sums["feature"].to_numpy().view(U))
    for k, (c, unit) in enumerate((("n", 1), ("s", _UNIT), ("q", _UNIT))):
        out[k, at] = sums[c].to_numpy() / unit
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text"):
    """The score as a column of ``docs``: the probability that the text is toxic. A null or empty text gets the score of no words."""
    used = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the training sample

    @F.arrow_udf("double")
    def toxic(text: pa.Array) -> pa.Array:
        out = pa.array(used.value.scores(text))
        trim()
        return out

    return toxic(F.col(text_col).cast("string"))
