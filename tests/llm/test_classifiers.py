import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runstrata.llm import _text, langid, quality, toxicity
from runstrata.llm._shared import held_out
from runstrata.llm.queries import op2_toxicity, op5_language_id, op6_quality

from llm_helpers import clashing

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "words", "fr", "s", 5), (3, "x " * 200000, None, "s", -1), (3, "12 34 !!", "en", "s", 8), (4, "日本語 ñandú", "es", "", None)]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    return clashing(spark.createDataFrame(ODD, DDL), "id", "y", "kind", "o", "score", "words")


def test_fold(spark):
    ids = [0, 1, 17, 123456789, None]
    got = [r.h for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out("doc_id", 5, 0).alias("h")).collect()]
    assert got == [zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 0 for i in ids]


def test_op2_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op2_toxicity(spark, SF).join(labels, "doc_id", "left").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    test = got[got.held_out & got.toxic.notna()]
    assert (test.predicted[test.toxic == 0] == 0).mean() > 0.95 and (test.predicted[test.toxic == 1]).mean() > 0.5


def test_nonnegative_risk_on_known_words():
    rng = np.random.default_rng(0)
    bad = np.arange(100, 105, dtype=np.uint64)

    def doc(toxic):
        words = np.unique(np.concatenate([rng.integers(1000, 1400, 30).astype(np.uint64), rng.choice(bad, 2) if toxic else np.zeros(0, np.uint64)]))
        return words, np.full(len(words), 0.8, np.float32)

    m = toxicity.fit([doc(True) for _ in range(150)], [doc(rng.random() < 0.1) for _ in range(1500)], 0.1)
    weight = dict(zip(m.words.tolist(), m.weights))
    score = lambda d: m.bias + sum(weight.get(int(w), 0) * x for w, x in zip(*d))
    assert np.mean([score(doc(True)) > 0 for _ in range(200)]) > 0.9 and np.mean([score(doc(False)) > 0 for _ in range(200)]) < 0.05


def plain_words(text):
    """Words and beginnings of a text as ``scores`` sees them, with their densities."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
    words = [w.lower() for w in words]
    out = Counter((w, len(w)) for w in words) + Counter((w[:k], -k) for w in words for k in toxicity.BEGINNINGS if len(w) > k)
    return {w: min(1.0, 25 * n / len(words)) for w, n in out.items()}


def hash_of(word, kind):
    buf = np.frombuffer(word, np.uint8)
    h = _text.word_hashes(buf, np.array([0]), np.array([len(buf)]))
    return int((_text.mix(h) if kind < 0 else h)[0])


def test_op2_scores_are_those_of_a_plain_scorer(spark):
    """Every document of the smallest table, word by word from the fitted model; the screen from a plain count."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, ~held_out("doc_id", 5, 0))
    weight = dict(zip(model.words.tolist(), model.weights))
    got = {r.doc_id: r.score for r in op2_toxicity(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        z = model.bias + sum(weight.get(hash_of(*w), 0.0) * x for w, x in plain_words(r.text).items())
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    every, bad = ([plain_words(r.text) for r in learn if which(r)] for which in (lambda r: True, lambda r: r.doc_id in toxic))
    held = Counter(w for d in bad for w in d)
    passed = set()
    for w in (w for w, n in held.items() if n >= 4):
        a, b = (np.array([d.get(w, 0.0) for d in ds]) for ds in (bad, every))
        if abs(a.mean() - b.mean()) / np.sqrt(a.var() / len(a) + b.var() / len(b) + 1e-9) >= 3.001:
            passed.add(hash_of(*w))
    assert set(model.words.tolist()) <= {hash_of(*w) for w, n in held.items() if n >= 4} and passed


def test_repeated_ids_come_once(spark):
    """A third of all rows under one id: the sample has a row for each id, whatever its texts."""
    rows = [(i, f"word{i % 7} other{i} thing", "en" if i % 2 else "fr", "s", 10) for i in range(60)] + [(7, f"copy {i % 3} of seven", "en", "s", 10) for i in range(30)]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)] * 2, "doc_id long, toxic int, quality int")
    for model in (toxicity.train(docs, labels, F.lit(True)), quality.train(docs, labels, F.lit(True)), langid.train(docs, F.lit(True))):
        assert model is not None
    got = langid.sampled(docs, F.lit(True), langid.Learning())
    assert len(got) == 60 and len({g[0] for g in got}) == 60


def plain_grams(text, bits):
    """Hashed n-grams of one to three letters of the space-padded words of a text."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    mix = lambda x: int(_text.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    out = []
    for w in low.split():
        cp = [32, *map(ord, w), 32]
        out += [mix(c + (1 << 32)) for c in cp[1:-1]]
        out += [mix(mix(a) + b) for a, b in zip(cp, cp[1:])]
        if len(w) > 1:
            out += [mix(mix(mix(a + 7) + b) + c) for a, b, c in zip(cp, cp[1:], cp[2:])]
    return [h & ((1 << bits) - 1) for h in out]


def test_op5_is_a_plain_scorer(spark):
    """Documents of the smallest table, n-gram by n-gram from the fitted model; document frequencies from a plain count."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, ~held_out("doc_id", 4, 2))
    got = {r.doc_id: (r.lang_pred, r.score) for r in op5_language_id(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:150]:
        grams = plain_grams(r.text or "", model.p.bits)
        if not grams:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        z = (sum(model.weights[g] for g in grams) / len(grams) + model.bias) / model.temperature
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id][0] == model.langs[int(q.argmax())] and got[r.doc_id][1] == pytest.approx(q.max(), abs=1e-6)


def plain_views(text, lang, source, n_chars, p):
    """Both views of one document, in plain Python."""
    raw = (text or "").encode()
    mix = lambda x: int(_text.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    kind = lambda c: 1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b" \t\x0b\x0c" else 5 if c in b"\n\r" else c
    shapes = [(k, len(list(g))) for k, g in itertools.groupby(map(kind, raw))]
    symbols = [k * 8 + min(n, 4) for k, n in shapes]
    count = np.zeros(p.buckets)
    for order in (1, 2, 3):
        for k in range(len(symbols) - order + 1):
            h = mix(symbols[k] + (order << 20))
            for x in symbols[k + 1 : k + order]:
                h = mix(h + x)
            count[h % p.buckets] += 1
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", raw)
    same = Counter(w.lower() for w in words)
    caps = sum(w[:2].isalpha() and w[:2].isupper() and len(w) > 1 for w in words)
    n = max(1, len(words))
    one = np.concatenate([np.sqrt(count / max(1, count.sum())), [len(same) / n, max(same.values(), default=0) / n, caps / n]])
    size, lines = len(raw), raw.count(b"\n") + 1
    blanks = sum(c in b" \t\n\x0b\x0c\r" for c in raw)
    stated = size if n_chars is None else max(0, n_chars)
    two = [np.log1p(stated) / 10, np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 8, blanks / max(1, size), float(size == 0), float(n_chars is None)]
    hot = np.zeros(quality.LANGS + quality.SOURCES)
    for value, first, many in ((lang, 0, quality.LANGS), (source, quality.LANGS, quality.SOURCES)):
        if value is not None:
            hot[first + hash_of(value.encode() or b"\0", 1) % many] = 1
    return one, np.concatenate([two, hot])


def test_op6_is_a_plain_scorer(spark):
    """Every document of the smallest table by itself, with margins, calibration and stack written out."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels, ~held_out("doc_id", 5, 1))
    got = {r.doc_id: r.score for r in op6_quality(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and m.text is not None
    margin = lambda f, x: float(((x - f.mean) / f.scale) @ f.w + f.b)
    for r in rows:
        a, b = plain_views(r.text, r.lang, r.source, r.n_chars, m.p)
        one, two = (s[0] * margin(f, x) + s[1] for f, x, s in ((m.text, a, m.text_scale), (m.meta, b, m.meta_scale)))
        z = m.stack[0] * one + m.stack[1] * two + m.stack[2]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_nothing_to_learn_from(spark):
    docs, labels = odd(spark), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    t = toxicity.train(docs, labels, F.lit(True))
    assert docs.select(toxicity.score(docs, t).alias("s")).where("s < 0.5").count() == len(ODD)
    q = quality.train(docs, labels, F.lit(True))
    assert [r.s for r in docs.select(quality.score(docs, q).alias("s")).collect()] == [0.5] * len(ODD)
    m = langid.train(docs, F.lit(False))
    assert {r.p.lang for r in docs.select(langid.predict(docs, m).alias("p")).collect()} == {"und"}
    none = docs.limit(0)
    assert none.select(langid.predict(none, langid.train(none, F.lit(True))).alias("p")).count() == 0
    assert none.select(toxicity.score(none, toxicity.train(none, labels, F.lit(True)))).count() == 0
    assert none.select(quality.score(none, quality.train(none, labels, F.lit(True)))).count() == 0


def test_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (2, None, 1), (None, 1, 1), (4, 0, 0)], "doc_id long, toxic int, quality int")
    t, q, m = toxicity.train(docs, labels, F.lit(True)), quality.train(docs, labels, F.lit(True)), langid.train(docs, F.lit(True))
    out = docs.select("doc_id", "text", toxicity.score(docs, t).alias("a"), quality.score(docs, q).alias("b"), langid.predict(docs, m).alias("p")).collect()
    assert len(out) == len(ODD) and all(0 <= r.a <= 1 and 0 <= r.b <= 1 for r in out)
    assert {r.text: (r.p.lang, r.p.score) for r in out if r.text in (None, "", "12 34 !!")} == {x: ("und", 0.0) for x in (None, "", "12 34 !!")}


def test_op5_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op5_language_id(spark, SF).join(truth, "doc_id").toPandas()
    test = got[got.held_out]
    assert len(test) > 100 and (test.lang_pred == test.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_document_frequencies():
    p = langid.Learning(bits=10)
    out = list(langid._frequencies([pa.record_batch([pa.array(["ab ab", "b", None, "1"])], names=["t"])], p))[0]
    n = dict(zip(out["feature"].to_pylist(), out["n"].to_pylist()))
    grams = {k for g, _, _ in langid.grams_of(pa.array(["ab"]), p) for h in g for k in h.tolist()}
    b = {k for g, _, _ in langid.grams_of(pa.array(["b"]), p) for h in g[:1] for k in h.tolist()}
    assert n[-1] == 4 and all(n[k] >= 1 for k in grams) and all(n[k] == 2 for k in b)


def test_scores_do_not_depend_on_neighbours():
    texts = ["the cat sat", "", "le chat", "ñ", "x" * 5000, "der Hund und die Katze"] * 3
    p = langid.Learning(bits=12)
    m = langid.fit(texts, ["en", "en", "fr", "es", "en", "de"] * 3, np.ones(1 << 12), p)
    names, scores = m.predict(pa.array(texts))
    for i, t in enumerate(texts[:6]):
        one, s = m.predict(pa.array([t]))
        assert one[0] == names[i] and s[0] == pytest.approx(scores[i])


def test_op6_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op6_quality(spark, SF).join(labels, "doc_id", "left").toPandas()
    test = got[got.held_out & got.quality.notna()]
    assert (test.predicted[test.quality == 1] == 1).mean() > 0.95 and (test.predicted[test.quality == 0] == 0).mean() > 0.6


def test_views_give_each_other_labels():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 1500)
    a = np.stack([y + rng.normal(0, 0.5, 1500), rng.normal(0, 1, 1500)], axis=1)
    b = np.stack([y + rng.normal(0, 0.5, 1500), rng.normal(0, 1, 1500)], axis=1)
    known = np.where(np.arange(1500) < 60, y, -1)
    m = quality.cotrain(a, b, known, quality.Learning(give=50, sure=0.9))
    q = m.combine(m.text.margin(a), m.meta.margin(b))
    assert m.rounds > 0 and ((q > 0.5) == y).mean() > 0.8413  # the best that any rule on one view can reach
