import random
import re

import numpy as np
import pytest

from runstrata.llm import _graph, embed_dedup, minhash
from runstrata.llm._shared import Scratch
from runstrata.llm.queries import op3_embedding_near_dedup, op8_minhash_near_dedup

from llm_helpers import clashing


def shingles(text, size):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def least(ids, pairs):
    at = {i: i for i in ids}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {i: root(i) for i in ids}


def brute(rows, size, percent):
    rows = [(i, shingles(t, size)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    return least([i for i, _ in rows if i is not None], pairs), rows


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(30, 150))]
        out += [edited(rng, base, rng.randint(0, 5)) for _ in range(rng.randint(1, 25))]
    common = " ".join(f"p{k}" for k in range(60))
    out += [common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))) for _ in range(40)]
    out += ["", " \t\n", None, "a", "A", "a b", "A  B", "É x y", "é x y", "long " * 30000, "LONG\x0b" * 30000, "a\x85b", "a b"]
    rows = list(enumerate(out)) + [(3, out[3]), (5, "another text of id five here"), (None, out[0]), (1000, "another text of id five here")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("p", [minhash.Near(), minhash.FIVE_WORDS, minhash.Near(block=4, first_bands=1), minhash.Near(block=3, chunk_bytes=4000)])
def test_groups_are_those_of_brute_force(spark, texts, p):
    want, sets = brute(texts, p.size, p.percent)
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string"), "id", "digest", "key", "band", "comp", "n", "rep").repartition(5)
    got = minhash.near_duplicates(df, p).collect()
    assert len(got) == len(texts)
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == sorted(((i, len(s)) for i, s in sets), key=str)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id] if r.n_shingles else r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_words_that_look_alike(spark):
    """Long words of repeated or swapped parts, and words of a megabyte, are told apart."""
    half = ["ab" * 512, "ba" * 512, "x" * 4096 + "y" * 4096, "y" * 4096 + "x" * 4096, "q" * 8, "q" * 16, "q" * (1 << 20), "q" * ((1 << 20) + 8)]
    rng = random.Random(4)
    long = ["".join(rng.choice("ab") for _ in range(5000)) for _ in range(3)]
    rows = list(enumerate([*half, *long, long[0][2500:] + long[0][:2500], *[" ".join([w] * 3 + ["z"]) for w in half[:4]]]))
    want, sets = brute(rows, 3, 85)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (want[i], len(s)) for i, s in sets} and len({c for c, _ in got.values()}) == len(rows)


def test_a_hot_band_of_texts_of_a_megabyte(spark):
    """Near copies, one of a megabyte among them, in chunks bounded by bytes; a repeated id is one text."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**5)}" for _ in range(20000)]
    rows = [(i, edited(rng, base, rng.randint(0, 900))) for i in range(14)] + [(100, " ".join(f"u{k}" for k in range(150000)))] * 3
    rows += [(200 + i, edited(rng, [f"u{k}" for k in range(150000)], 5000)) for i in range(2)]
    want, sets = brute(rows, 3, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(df, minhash.Near(block=4, chunk_bytes=1 << 20)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_by_likelihood():
    rng = np.random.default_rng(1)
    p = minhash.Near()
    for j in (0.5, 0.85, 0.95):
        n = 3000
        both = int(n * 2 * j / (1 + j))
        h = rng.integers(1, 2**63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
        a, b = (minhash.registers(minhash.sketch_of(x, p), p) for x in (h[:n], h[n - both :]))
        up, same = np.array([(a > b).sum()]), np.array([(a == b).sum()])
        assert minhash.clearly_below(0.85, np.array([float(n)]), np.array([float(n)]), up, same, p)[0] == (j == 0.5)
        union = minhash.registers(minhash.sketch_of(h, p), p)
        assert (minhash.merge(a, b) == union).all()


def test_plans_stay_small(spark, monkeypatch):
    """No table's plan reads other tables a dozen times: what a later step reads often is written first, so the driver never holds a large plan."""
    leaves, put = {}, Scratch.put

    def counted(self, df, name):
        leaves[name] = df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
        return put(self, df, name)

    monkeypatch.setattr(Scratch, "put", counted)
    rows = [(k, " ".join(f"w{(k // 4) * 97 + j}" for j in range(30)) + f" end{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, minhash.Near(block=4)).collect()}
    assert got == brute(rows, 3, 85)[0]
    assert {"links-0", "links-1", "links-2"} <= set(leaves)
    assert max(leaves.values()) <= 12, leaves


def test_query_op8(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, _ = brute(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in op8_minhash_near_dedup(spark, sf).collect()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5)]
    want = least({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    u, v = _graph.forest(*(np.array(x) for x in zip(*edges)))
    assert least(want, list(zip(u.tolist(), v.tolist()))) == want


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already, as the forests of tasks mostly are, are not dealt out again; others still take rounds."""
    made, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: made.append(name) or put(self, df, name))
    stars = [(7 * k, 7 * k + j) for k in range(20) for j in range(1, 7)]
    for edges, rounds in ((stars, 0), ([], 0), ([(3, 3)], 0), ([(1, 3), (2, 3)], 1), ([(1, 2), (2, 3)], 1)):
        made.clear()
        got = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()}
        assert got == {k: v for k, v in least({x for e in edges for x in e}, edges).items() if (k, k) not in edges}
        assert len(made) - 1 == rounds, (edges, made)


@pytest.mark.parametrize("p", [embed_dedup.Passes(), embed_dedup.Passes(window=4, block=8)])
def test_vectors(spark, p):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for _ in range(15):
        base = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((k, (base + 0.12 * rng.standard_normal(32)).tolist(), int(rng.integers(0, 2))))
            k += 1
    extra = [(900, None, 0), (901, [], 0), (902, [0.0] * 32, 0), (903, [1.0, None] + [0.0] * 30, 0), (904, [float("nan")] * 32, 0), (905, [float("inf")] + [1.0] * 31, 0), (906, rows[0][1], None), (907, [x * 1e-200 for x in rows[0][1]], rows[0][2]), (908, [1.0], 0), (909, [2.0], 0), (None, rows[0][1], rows[0][2])]
    every = rows + extra + [rows[3]]
    unit = {i: np.array(v) / abs(np.array(v)).max() for i, v, label in rows + [extra[7], extra[8], extra[9]]}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in unit.items()}
    label = {i: y for i, _, y in rows + extra}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= p.cosine]
    want = least([i for i, _, _ in rows + extra if i is not None], links)
    df = clashing(spark.createDataFrame(every, "vec_id long, embedding array<double>, label int"), "id", "vec", "n", "component", "code").repartition(4)
    got = embed_dedup.near_vectors(df, p).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.component_id, r.kept) == (want[r.vec_id], want[r.vec_id] == r.vec_id)
            assert r.n_links == sum(r.vec_id in e for e in links)


def test_star_beyond_the_windows(spark):
    """A centre whose links are not links of each other, and pairs that two passes of window 1 cannot all meet."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    away = rng.standard_normal((3000, 64))
    away -= (away @ centre)[:, None] * centre
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    single = rng.standard_normal((200, 64))
    x = np.concatenate([centre[None], 0.935 * centre + np.sqrt(1 - 0.935**2) * away, single, single + 0.05 * rng.standard_normal((200, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    want = least(range(len(x)), np.argwhere(hit).tolist())
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    for p in (embed_dedup.Passes(), embed_dedup.Passes(passes=2, window=1, block=16)):
        got = {r.vec_id: r for r in embed_dedup.near_vectors(df, p).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert [got[i].n_links for i in range(len(x))] == hit.sum(axis=1).tolist()


def test_equal_vectors_are_one_class(spark):
    """Copies count as links of each other, also where zeros have a sign, in both number types."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 16)).round(2)
    base[0, 0] = 0.0
    rows = [(k, (-1.0 if k % 3 == 0 else 1.0) * 0.0 if j == 0 and k % 6 == 0 else float(v), j) for k in range(90) for j, v in enumerate(base[k % 6])]
    vectors = [(k, [v for i, v, _ in rows if i == k], k % 2) for k in range(90)] + [(500, (base[1] + 0.01).tolist(), 1), (501, base[1].tolist(), None)]
    x = np.array([v for _, v, _ in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([-1 if y is None else y for _, _, y in vectors])
    link = (x @ x.T >= 0.93) & (label[:, None] == label) & (label >= 0)[:, None]
    np.fill_diagonal(link, False)
    ids = [i for i, _, _ in vectors]
    want = least(ids, [(ids[a], ids[b]) for a, b in np.argwhere(link)])
    for kind in ("double", "float"):
        df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df).collect()}
        assert got == {i: (int(n), want[i]) for i, n in zip(ids, link.sum(axis=1))}


def test_no_vectors(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_query_op3(spark):
    sf = "/root/testdata/sf0.001"
    x = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    v = np.array([np.array(e, np.float64) for e in x.embedding])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.93) & (x.label.to_numpy()[:, None] == x.label.to_numpy())
    np.fill_diagonal(link, False)
    got = op3_embedding_near_dedup(spark, sf).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() == link.sum(axis=1)).all()
