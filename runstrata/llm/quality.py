"""Document quality by co-training two views.

The text view sees the shape of the text: runs of lower-case, upper-case, digits, marks and blanks with their lengths, in
hashed groups of one to three, and how words repeat. The metadata view sees the record and the layout: size, lines,
language and source. Each view has a logistic classifier. In every round, each view gives the other the unlabelled
documents it is surest of, as pseudo-labels; a round that makes a view's loss on kept-back labels worse ends the exchange.
Each view is calibrated (Platt) on the kept-back rows and a logistic stack joins them: seven numbers in all, hence one
kept-back set. All documents are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, frugal, trim
from ._text import LOWER, NOT_BLANK, U, chunks, mix, utf8, word_hashes, words


@dataclass(frozen=True)
class Learning:
    """``labelled`` and ``unlabelled`` bound the sample: rows of least hash. A fourth of the labelled rows is kept back. A round gives at most ``give`` documents of each class to the other view, each sure by ``sure`` at least."""

    labelled: int = 4000
    unlabelled: int = 3000
    buckets: int = 512
    rounds: int = 4
    give: int = 200
    sure: float = 0.97
    ridge: float = 1e-3
    seed: int = 9


#: Classes of bytes: lower-case and beyond ASCII, upper-case, digit, blank, line end; each mark is its own.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 11, 12]] = 4
_KIND[[10, 13]] = 5


def text_view(buf: np.ndarray, off: np.ndarray, p: Learning) -> np.ndarray:
    """(texts, buckets + 3): square roots of shares of hashed shapes; share of distinct words, of the commonest word, of words in capitals."""
    n = len(off) - 1
    out = np.zeros((n, p.buckets + 3))
    kind = _KIND[buf]
    begins = np.zeros(len(buf), bool)
    begins[off[:-1][off[:-1] < len(buf)]] = True
    change = np.ones(len(buf), bool)
    change[1:] = kind[1:] != kind[:-1]
    at = np.flatnonzero(change | begins)
    size = np.minimum(np.diff(np.append(at, len(buf))), 4)
    symbol = kind[at].astype(U) * U(8) + size.astype(U)
    doc = np.searchsorted(off, at, "right") - 1
    for order in (1, 2, 3):
        m = len(symbol) - order + 1
        if m <= 0:
            continue
        h = mix(symbol[:m] + U(order << 20))
        for j in range(1, order):
            h = mix(h + symbol[j : m + j])
        ok = doc[:m] == doc[order - 1 : m + order - 1]
        out[:, : p.buckets] += np.bincount(doc[:m][ok] * p.buckets + (h[ok] % U(p.buckets)).astype(np.int64), minlength=n * p.buckets).reshape(n, -1)
    total = np.maximum(out[:, : p.buckets].sum(axis=1, keepdims=True), 1)
    out[:, : p.buckets] = np.sqrt(out[:, : p.buckets] / total)
    low = LOWER[buf]
    starts, ends, first = words(low, off, NOT_BLANK)
    h = word_hashes(low, starts, ends)
    capital = (_KIND[buf[starts]] == 2) & (ends - starts > 1) & (_KIND[buf[np.minimum(starts + 1, len(buf) - 1)]] == 2) if len(starts) else np.zeros(0, bool)
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b > a:
            _, count = np.unique(h[a:b], return_counts=True)
            out[d, p.buckets :] = len(count) / (b - a), count.max() / (b - a), capital[a:b].mean()
    return out


SOURCES, LANGS = 64, 16


def meta_view(buf: np.ndarray, off: np.ndarray, lang: list, source: list, n_chars: list) -> np.ndarray:
    """Size, lines and their lengths, hashed language and source, and which of them are null."""
    n = len(off) - 1
    size = np.diff(off)
    line = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf == 10, out=line[1:])
    lines = line[off[1:]] - line[off[:-1]] + 1
    blank = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~NOT_BLANK[buf], out=blank[1:])
    spaces = blank[off[1:]] - blank[off[:-1]]
    stated = np.array([size[i] if x is None else max(0, x) for i, x in enumerate(n_chars)], np.float64)
    out = [np.log1p(stated) / 10, np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 8, spaces / np.maximum(size, 1), size == 0, np.array([x is None for x in n_chars])]
    hot = np.zeros((n, LANGS + SOURCES))
    for i, (a, b) in enumerate(zip(lang, source)):
        if a is not None:
            hot[i, _bucket(a, LANGS)] = 1
        if b is not None:
            hot[i, LANGS + _bucket(b, SOURCES)] = 1
    return np.concatenate([np.stack(out, axis=1).astype(np.float64), hot], axis=1)


def _bucket(text: str, n: int) -> int:
    raw = np.frombuffer(text.encode() or b"\0", np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0] % U(n))


def views(text: pa.Array, lang: list, source: list, n_chars: list, p: Learning):
    """Both views of some rows at a time."""
    buf, off = utf8(text)
    for lo, hi in chunks(off):
        for a in range(lo, hi, 2048):
            b = min(hi, a + 2048)
            part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            yield text_view(part, at, p), meta_view(part, at, lang[a:b], source[a:b], n_chars[a:b])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 12) -> Logistic:
        """Newton's method with a ridge."""
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
        w = np.zeros(z.shape[1])
        pen = np.full(len(w), ridge * weight.sum())
        pen[-1] = 1e-9
        for _ in range(steps):
            q = sigmoid(z @ w)
            g = z.T @ (weight * (q - y)) + pen * w
            h = (z * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ z + np.diag(pen + 1e-9)
            w = w - np.linalg.solve(h, g)
        return Logistic(mean, scale, w[:-1], float(w[-1]))


@dataclass
class Model:
    text: Logistic | None
    meta: Logistic | None
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    stack: np.ndarray
    p: Learning
    rounds: int = 0

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sigmoid(self.stack[0] * (self.text_scale[0] * a + self.text_scale[1]) + self.stack[1] * (self.meta_scale[0] * b + self.meta_scale[1]) + self.stack[2])

    def scores(self, text: pa.Array, lang: list, source: list, n_chars: list) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), float(sigmoid(self.stack[2])))
        out = [self.combine(self.text.margin(a), self.meta.margin(b)) for a, b in views(text, lang, source, n_chars, self.p)]
        return np.concatenate(out) if out else np.zeros(0)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate margins, with the usual smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    m = Logistic.fit(margin[:, None], target, np.ones(len(y)), 1e-6)
    slope = float(m.w[0] / m.scale[0])
    return slope, float(m.b - slope * m.mean[0])


def loss(q: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(np.where(y == 1, q, 1 - q), 1e-9)).mean())


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, p: Learning = Learning()) -> Model:
    """``y``: 1, 0, or -1 where unlabelled."""
    known = np.flatnonzero(y >= 0)
    back, own = known[3::4], np.setdiff1d(known, known[3::4])
    if len(np.unique(y[own])) < 2 or len(np.unique(y[back])) < 2:
        k, n = (y == 1).sum(), len(known)
        return Model(None, None, (1, 0), (1, 0), np.array([0, 0, float(np.log((k + 0.5) / (n - k + 0.5)))]), p)
    x, pool = (text, meta), np.flatnonzero(y < 0)
    got = [(own, y[own].astype(float)), (own, y[own].astype(float))]

    def fitted():
        out = []
        for v in (0, 1):
            rows, target = got[v]
            weight = np.where(np.isin(rows, own), 1.0, 0.3)  # a pseudo-label counts less than a label
            m = Logistic.fit(x[v][rows], target, weight, p.ridge)
            out.append((m, platt(m.margin(x[v][back]), y[back])))
        return out

    def quality(models):
        return [loss(sigmoid(s * m.margin(x[v][back]) + o), y[back]) for v, (m, (s, o)) in enumerate(models)]

    models = fitted()
    best, done = quality(models), 0
    for _ in range(p.rounds):
        saved = list(got)
        for v in (0, 1):
            m, (s, o) = models[v]
            free = np.setdiff1d(pool, got[1 - v][0])
            q = sigmoid(s * m.margin(x[v][free]) + o)
            up, down = np.argsort(-q, kind="stable")[: p.give], np.argsort(q, kind="stable")[: p.give]
            up, down = up[q[up] >= p.sure], down[q[down] <= 1 - p.sure]
            rows = np.concatenate([free[up], free[down]])
            got[1 - v] = (np.concatenate([got[1 - v][0], rows]), np.concatenate([got[1 - v][1], np.ones(len(up)), np.zeros(len(down))]))
        if all(len(a[0]) == len(b[0]) for a, b in zip(got, saved)):
            break
        new = fitted()
        now = quality(new)
        for v in (0, 1):
            if now[v] <= best[v] + 1e-4:
                models[v], best[v] = new[v], now[v]
            else:
                got[v] = saved[v]
        done += 1
    (a, sa), (b, sb) = models
    joint = np.stack([sa[0] * a.margin(text[back]) + sa[1], sb[0] * b.margin(meta[back]) + sb[1]], axis=1)
    s = Logistic.fit(joint, y[back].astype(float), np.ones(len(back)), 1e-2)
    w = s.w / s.scale
    return Model(a, b, sa, sb, np.array([w[0], w[1], s.b - (w * s.mean).sum()]), p, done)


@frugal
def _sample_views(batches, p: Learning):
    for batch in batches:
        text, lang, source, n_chars = batch.column(2), *(batch.column(k).to_pylist() for k in (3, 4, 5))
        at = 0
        for a, b in views(text, lang, source, n_chars, p):
            n = len(a)
            yield pa.record_batch([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array([r.tobytes() for r in a.astype(np.float32)], pa.binary()), pa.array([r.tobytes() for r in b.astype(np.float32)], pa.binary())], names=["id", "y", "a", "b"])
            at += n


def train(docs: DataFrame, labels: DataFrame, learns, p: Learning = Learning(), id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from labelled rows and from unlabelled documents for which ``learns`` (a column of the id) holds. Ids with both labels count as 0.

    Labels that are null, neither 0 nor 1, or without an id, and documents without an id, teach nothing. Any other
    column of a document may be null. Of rows that repeat an id one is in the sample (the least by its views). Ties of
    the sample's order go by id. Where the labels of one class are missing, or there is no document, every document
    scores the smoothed share of 1. Columns other than text, lang, source, n_chars are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    order = F.xxhash64(F.col("id"), F.lit(p.seed))
    marked = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("y")).where(learns & F.col(id_col).isNotNull() & F.col("y").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min("y").alias("y"))
    base = _record(docs, id_col).withColumnRenamed("id", id_col).where(learns & F.col(id_col).isNotNull()).withColumnRenamed(id_col, "id")
    known = marked.orderBy(order).limit(p.labelled)
    rest = base.select("id").distinct().join(marked, "id", "left_anti").orderBy(order).limit(p.unlabelled).select("id", F.lit(-1).alias("y"))
    picked = scratch.put(known.unionByName(rest), "picked")  # at most labelled + unlabelled rows
    rows = base.join(F.broadcast(picked), "id").select("id", "y", "text", "lang", "source", "n_chars")
    got = rows.mapInArrow(lambda it: _sample_views(it, p), "id long, y int, a binary, b binary")
    got = got.groupBy("id").agg(F.min(F.struct("y", "a", "b")).alias("x")).select("id", order.alias("o"), "x.*").toArrow()  # a row for each id
    o, y = got["o"].to_numpy(), got["y"].to_numpy()
    at = np.lexsort((got["id"].to_numpy(), o))
    stack = lambda c: np.frombuffer(b"".join(got[c].to_pylist()), np.float32).reshape(len(o), -1).astype(np.float64)[at] if len(o) else np.zeros((0, 1))
    return cotrain(stack("a"), stack("b"), y[at], p)


def _record(docs: DataFrame, id_col: str | None = None) -> DataFrame:
    cols = {c.lower() for c in docs.columns}
    have = lambda c, t: (F.col(c) if c in cols else F.lit(None)).cast(t).alias(c)
    return docs.select(*([F.col(id_col).cast("long").alias("id")] if id_col else []), have("text", "string"), have("lang", "string"), have("source", "string"), have("n_chars", "long"))


def score(docs: DataFrame, model: Model):
    """The probability of good quality as a column of ``docs`` (columns text, lang, source, n_chars; any may be null)."""
    used = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def good(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = pa.array(used.value.scores(text, lang.to_pylist(), source.to_pylist(), n_chars.to_pylist()))
        trim()
        return out

    return good(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
