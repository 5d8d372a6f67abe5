"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of 1 to 3 letters of space-padded words are hashed to ``2**bits`` features; tf is the share of a text's
n-grams. Document frequencies come from every document that may be learnt from. Weights are learnt by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample, then a temperature is
fitted on the part of the sample kept back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, frugal, trim
from ._text import chunks, mix, utf8

UNDETERMINED = "und"


@dataclass(frozen=True)
class Learning:
    """``sample`` bounds the training rows (those of least hash); every fifth of them is kept back for the temperature."""

    sample: int = 3000
    longest: int = 3
    bits: int = 16
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    seed: int = 3


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # (2**bits, languages), idf and scale included
    bias: np.ndarray
    temperature: float
    p: Learning

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for grams, doc, n in grams_of(col, self.p):
            z = np.zeros((n, max(1, len(self.langs))))
            count = np.zeros(n)
            for h, d in zip(grams, doc):
                if len(h) and len(self.langs):
                    first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                    z[d[first]] += np.add.reduceat(self.weights[h], first, axis=0)
                count += np.bincount(d, minlength=n)
            z = (z / np.maximum(count, 1)[:, None] + (self.bias if len(self.langs) else 0)) / self.temperature
            q = softmax(z)
            best = q.argmax(axis=1)
            known = (count > 0) & (len(self.langs) > 0)
            names += [self.langs[k] if ok else UNDETERMINED for k, ok in zip(best, known)]
            scores.append(np.where(known, q.max(axis=1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@lru_cache(1)
def _lowered() -> np.ndarray:
    """For each code point its lower-case letter, or 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams_of(col: pa.Array, p: Learning):
    """For some texts at a time: hashed n-grams of each length with the text each is of, and the number of texts."""
    buf, off = utf8(col)
    table = _lowered()
    mask = np.uint64((1 << p.bits) - 1)
    for lo, hi in chunks(off, 1 << 19):
        n = hi - lo
        raw = buf[off[lo] : off[hi]]
        cp = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        # texts by code points: bytes that do not continue a character
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        at = lead[off[lo : hi + 1] - off[lo]]
        doc = np.repeat(np.arange(n), np.diff(at))
        low = table[cp].astype(np.uint64)
        blank = low == 32
        begins = np.zeros(len(low), bool)
        begins[at[:-1][at[:-1] < len(low)]] = True
        # pad: a word's first and last letters see a space, at the ends of a text as well
        prev = np.ones(len(low), bool)
        prev[1:] = blank[:-1]
        prev |= begins
        nxt = np.ones(len(low), bool)
        nxt[:-1] = blank[1:] | begins[1:]
        grams, docs = [], []
        letter = np.flatnonzero(~blank)
        h1 = mix(low + np.uint64(1 << 32))
        grams.append((h1[letter] & mask).astype(np.int64))
        docs.append(doc[letter])
        inner = letter[~nxt[letter]]  # followed by a letter of the same word
        space = np.uint64(32)
        first, last = letter[prev[letter]], letter[nxt[letter]]
        h2 = mix(mix(low[inner]) + low[inner + 1])
        parts = [(h2, doc[inner]), (mix(mix(np.full(len(first), space)) + low[first]), doc[first]), (mix(mix(low[last]) + space), doc[last])]
        if p.longest >= 3:
            mid = inner[~nxt[inner + 1]] if len(inner) else inner
            start = first[~nxt[first]]
            end = last[~prev[last]]
            tri = lambda a, b, c: mix(mix(mix(a + np.uint64(7)) + b) + c)
            parts += [(tri(low[mid], low[mid + 1], low[mid + 2]), doc[mid]), (tri(np.full(len(start), space), low[start], low[start + 1]), doc[start]), (tri(low[end - 1], low[end], np.full(len(end), space)), doc[end])]
        for h, d in parts:
            grams.append((h & mask).astype(np.int64))
            docs.append(d)
        yield grams, docs, n


@frugal
def _frequencies(batches, p: Learning):
    """(feature, documents that hold it) summed over a task, and (-1, documents)."""
    df, total = np.zeros(1 << p.bits, np.int64), 0
    for batch in batches:
        for grams, docs, n in grams_of(batch.column(0), p):
            total += n
            ends = [np.searchsorted(d, np.arange(n + 1)) for d in docs]
            seen = np.zeros(1 << p.bits, bool)
            for k in range(n):
                for h, e in zip(grams, ends):
                    seen[h[e[k] : e[k + 1]]] = True
                df += seen
                seen[:] = False
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], names=["feature", "n"])


def counted(col: pa.Array, p: Learning) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct hashed n-grams and how often each occurs."""
    for grams, docs, n in grams_of(col, p):
        h, d = np.concatenate(grams), np.concatenate(docs)
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
        ends = np.searchsorted(d, np.arange(n + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            yield np.unique(h[a:b], return_counts=True)


def fit(texts: list[str], langs: list[str], idf: np.ndarray, p: Learning = Learning()) -> Model:
    """``fit_counts`` to texts."""
    return fit_counts(list(counted(pa.array(texts, pa.string()), p)), langs, idf, p)


def fit_counts(found: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray, p: Learning = Learning()) -> Model:
    """FTRL-proximal over texts given as n-grams and their counts, in the order given, then the temperature on every fifth."""
    names = tuple(sorted(set(langs)))
    size, k = 1 << p.bits, len(names)
    if not k:
        return Model((), np.zeros((size, 0)), np.zeros(0), 1.0, p)
    rows = [(f, c * idf[f] / max(1, c.sum())) for f, c in found]
    norm = np.mean([np.sqrt((x * x).sum()) for _, x in rows if len(x)] or [1.0]) or 1.0
    rows = [(f, x / norm) for f, x in rows]
    y = np.array([names.index(x) for x in langs])
    z, g2 = np.zeros((size, k)), np.zeros((size, k))
    zb, gb2 = np.zeros(k), np.zeros(k)

    def weight(z, g2, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(g2)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i, (f, x) in enumerate(rows):
            if i % 5 == 4 or not len(f):
                continue
            w, b = weight(z[f], g2[f], p.l1), weight(zb, gb2, 0.0)
            q = softmax(x @ w + b)
            q[y[i]] -= 1
            g = x[:, None] * q
            old = g2[f]
            z[f] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / p.alpha * w
            g2[f] = old + g * g
            zb += q - (np.sqrt(gb2 + q * q) - np.sqrt(gb2)) / p.alpha * b
            gb2 += q * q
    w, b = weight(z, g2, p.l1), weight(zb, gb2, 0.0)
    held = [i for i in range(len(rows)) if i % 5 == 4 and len(rows[i][0])]
    best = 1.0
    if held:
        logits = np.array([rows[i][1] @ w[rows[i][0]] + b for i in held])
        target = y[held]
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), target], 1e-12)).mean()
        best = min(np.geomspace(0.05, 5, 81), key=loss)
    return Model(names, w * (idf / norm)[:, None], b, float(best), p)


def train(docs: DataFrame, learns, p: Learning = Learning(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows for which ``learns`` (a column of the id) holds and whose text and language are not null.

    Document frequencies come from all of these rows. The sample has a row for each id (of rows that repeat one, the
    least by language, then n-grams); rows with a null id are counted, but not in the sample. Ties of the sample's
    order go by id. Without any such row the model knows no language, and every text is ``und``. Other columns are not
    read.
    """
    base = _base(docs, learns, id_col, text_col, lang_col)
    df = base.select("text").mapInArrow(lambda it: _frequencies(it, p), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most 2**bits + 1 rows
    at, n = df["feature"].to_numpy(), df["n"].to_numpy()
    count = np.zeros(1 << p.bits)
    count[at[at >= 0]] = n[at >= 0]
    total = int(n[at < 0].sum())
    idf = np.log((1 + total) / (1 + count)) + 1
    got = sampled(docs, learns, p, id_col, text_col, lang_col)
    return fit_counts([(f, c) for _, _, f, c in got], [lang for _, lang, _, _ in got], idf, p)


def _base(docs: DataFrame, learns, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull())


@frugal
def _counts(batches, p: Learning):
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            rows = [(f.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()) for f, c in counted(part.column(2), p)]
            yield pa.record_batch([part.column(0), part.column(1), *(pa.array([r[j] for r in rows], pa.binary()) for j in (0, 1))], names=["id", "lang", "f", "c"])


def sampled(docs: DataFrame, learns, p: Learning, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple]:
    """(id, language, n-grams, counts) of the training sample, a row for each id, at most ``2**bits`` n-grams a row: texts stay on the executors."""
    base = _base(docs, learns, id_col, text_col, lang_col).where(F.col(id_col).isNotNull()).withColumnRenamed(id_col, "id")
    scratch = Scratch(docs.sparkSession, "lang")
    order = F.xxhash64("id", F.lit(p.seed))
    ids = scratch.put(base.select("id").distinct().orderBy(order, "id").limit(p.sample), "ids")  # at most p.sample rows
    rows = base.join(F.broadcast(ids), "id").select("id", "lang", "text").mapInArrow(lambda it: _counts(it, p), "id long, lang string, f binary, c binary")
    got = rows.groupBy("id").agg(F.min(F.struct("lang", "f", "c")).alias("x")).select("id", order.alias("o"), "x.*").orderBy("o", "id").collect()
    return [(r.id, r.lang, np.frombuffer(r.f, np.int32), np.frombuffer(r.c, np.int32)) for r in got]


def predict(docs: DataFrame, model: Model, text_col: str = "text"):
    """A struct column of ``docs``: ``lang`` (``und`` where the text is null or has no letter) and ``score`` (0 there)."""
    used = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows

    @F.arrow_udf("struct<lang:string,score:double>")
    def language(text: pa.Array) -> pa.Array:
        names, scores = used.value.predict(text)
        trim()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return language(F.col(text_col).cast("string"))
