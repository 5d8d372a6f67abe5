import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runstrata.llm import _shared, bpe, decontam, minhash, quality, sharding, toxicity, urlfilter
from runstrata.llm._shared import held_out
from runstrata.llm.queries import ORACLES, op4_sharding, op7_decontamination, op9_url_filters, op10_bpe

from llm_helpers import clashing

SF = "/root/testdata/sf0.001"


# sharding -------------------------------------------------------------------------------------


def same_as_duckdb(df, oracle, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(oracle)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(names).collect()), key=str) == want


def test_op4(spark):
    same_as_duckdb(op4_sharding(spark, SF), ORACLES["op4_sharding"], ["documents"])


def test_table_is_even_and_steady():
    t = sharding.Table()
    owner = sharding.fill(t)
    count = np.bincount(owner)
    assert count.max() - count.min() <= 1 and len(owner) == t.slots
    fewer = sharding.fill(sharding.Table(t.shards[:-1]))
    moved = sum(a != b for a, b in zip(owner, fewer) if a < 15)
    assert moved < 0.3 * t.slots
    with pytest.raises(ValueError):
        sharding.fill(sharding.Table(("a",), 10))


def test_placement(spark, tmp_path):
    df = clashing(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (5, None)], "doc_id long, text string"), "slot", "k", "_slot", "_SLOT_")
    got = {(r.doc_id, r.shard) for r in sharding.place(df).collect()}
    assert len(got) == 3 and sharding.place(df).count() == 4 and sharding.place(df.limit(0)).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4 and set(back.columns) == {*df.columns, "shard"} and back.where("_slot = 'clash' and slot = 'clash'").count() == 4
    sharding.write_shards(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("Shard", F.lit(1)), str(tmp_path / "no"))
    plan = sharding.place(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Python" not in plan


# url filters ----------------------------------------------------------------------------------


def test_op9(spark):
    same_as_duckdb(op9_url_filters(spark, SF), ORACLES["op9_url_filters"], ["pages"])


URLS = {
    "http://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
    "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://example.org/EN/1": ("example.org", "/EN/1", "org/", "allow"),
    "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://a.com/fr": ("a.com", "/fr", None, "allow"),
    "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
    "http://org?/": ("org", "", None, "allow"),
    "http://b.net/a/login": ("b.net", "/a/login", None, "block"),
    "http://b.net/xlogin": ("b.net", "/xlogin", None, "allow"),
    "http://b.net/a.EXE": ("b.net", "/a.EXE", None, "block"),
    "mailto:x": ("", "", None, "block"),
    "http://x://y.org/": ("x:", "//y.org/", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://" + "a" * 100000 + ".org/": ("a" * 100000 + ".org", "/", "org/", "allow"),
}


def test_urls(spark):
    df = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.com/de/")], "page_id long, url string"), "host", "path", "_hits", "rule")
    got = urlfilter.judge(df).collect()
    assert {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in got if r.page_id is not None} == dict(enumerate(URLS.values()))
    assert len(got) == len(URLS) + 1 and urlfilter.judge(df.limit(0)).count() == 0


def test_index_finds_what_all_rules_find(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["ads", "a", "b1", "track", "x", "img"])
    rules = [urlfilter.Rule("".join(rng.choice(["^", "*", ".", "/", "|", ""]) + word() for _ in range(rng.randint(1, 3))) + rng.choice(["^", "|", "", "*"]), "block", False) for _ in range(60)]
    urls = ["http://" + "".join(word() + rng.choice("./-_?&=") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), (), rules).collect()}
    regexes = [re.compile(urlfilter.regex_of(r).replace(r"\z", r"\Z")) for r in rules]
    assert got == {i: "block" if any(x.search(u.lower()) for x in regexes) else "allow" for i, u in enumerate(urls)}
    assert "Python" not in urlfilter.judge(spark.createDataFrame([(1, "u")], "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()


def test_twenty_thousand_rules(spark):
    rng = random.Random(7)
    rules = [urlfilter.Rule(f"^ads{rng.randrange(10**6)}/x{k % 50}^", "block", False) for k in range(15000)]
    sites = [urlfilter.Rule(f"h{k}.example.net/p{k % 7}/", "block" if k % 2 else "allow") for k in range(5000)]
    urls = [f"http://{rng.choice(['a.', ''])}h{rng.randrange(6000)}.example.net/p{rng.randrange(7)}/q" for _ in range(150)] + [f"http://z.org/{r.text.strip('^')}/y" for r in rng.sample(rules, 100)] + [f"http://z.org/ads{k}" for k in range(50)]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), sites, rules).collect()}
    by_host, tails = {r.text.split("/")[0]: r for r in sites}, {r.text.strip("^") for r in rules}
    for i, u in enumerate(urls):
        host, path = re.fullmatch(r"http://([^/]*)(/.*)", u).groups()
        site = by_host.get(host.removeprefix("a."))
        if site and path.startswith("/" + site.text.split("/", 1)[1]):
            assert got[i] == (site.text, site.verdict), u
        else:
            assert got[i] == (None, "block" if path[1:].removesuffix("/y") in tails else "allow"), u


# byte-level BPE --------------------------------------------------------------------------------


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_vocabulary().path)
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


PIECES = [" ", "  ", "\n", " \n", "\t", "\r\n", "'", "''", "'s", "'re", " 've", "'ll", "'d", "'S", "a", "Bé", "ñ", "12", "٣", "²", "!", ".", "###", "<|endoftext|>", "<|endof", "\u0085", "\u00a0", "\u200b", "\u2028", "漢字", "😀", "e\u0301", "\U000105c0", "\u0c5c", "can't", "'tis"]


@pytest.mark.parametrize("block", [16 << 20, 50])
def test_bpe_is_the_library(spark, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["", None, "a" * 3000, " " * 3000, "x'", "'"]
    v = bpe.Vocabulary(bpe.public_vocabulary().path, block)
    df = clashing(spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(None, "null id"), (0, "again")], "doc_id long, text string"), "id", "block", "word", "words", "place").repartition(3)
    got = bpe.encode_decode(df, v, full=True).collect()
    assert len(got) == len(texts) + 2 and sorted((r.decoded for r in got if r.doc_id is None or (r.doc_id == 0 and r.decoded == "again"))) == ["again", "null id"]
    want = dict(enumerate(reference(texts)))
    for r in got:
        if r.doc_id is not None and r.decoded != "again":
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id], texts[r.doc_id]
            assert r.decoded == (texts[r.doc_id] or "") and len(r.ids) == r.n_tokens


def test_no_texts(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), bpe.public_vocabulary()).count() == 0


def test_op10(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], reference([r.text for r in rows])))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op10_bpe(spark, SF).collect()} == want


# decontamination --------------------------------------------------------------------------------

ITEM = "Anna Berg drives 120 km from the town of Lund to meet Carl for 45 minutes and then pays 3.50 euros for coffee with Anna Berg today"


def test_templates(spark):
    other = ITEM.replace("120", "87").replace("45", "9,000").replace("Lund", "Oslo").replace("km", "miles")
    renamed = ITEM.replace("Anna", "Ida").replace("Carl", "Olaf")
    mixed = "Anna Berg drives 120 km from the town of Lund to meet Carl for 45 minutes and then pays 3.50 euros for tea. Nothing more of that passage follows in this text"
    docs = [(1, "Before. " + ITEM + " After"), (2, "before, " + other + "."), (3, "x " + renamed), (4, "Some clean text without any such passage at all, with 12 km and Berlin"), (5, None), (6, ""), (7, "word " * 50000 + ITEM.upper()), (None, ITEM), (1, "clean row of a known id"), (8, " ".join(ITEM.split()[:9])), (9, mixed)]
    items = [(10, ITEM), (11, None), (12, "two words"), (None, ""), (13, "Short item of six tokens here")]
    got = decontam.judge(clashing(spark.createDataFrame(docs, "doc_id long, text string"), "key", "mark", "item", "hash"), clashing(spark.createDataFrame(items, "item_id long, text string"), "key", "mark")).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 1)}
    assert sorted(r.contaminated for r in got if r.doc_id == 1) == [False, True]
    assert [r.contaminated for r in got if r.doc_id is None] == [True]
    assert (by[2].kind, by[3].kind) == ("template", "template") and by[2]["items"] == [10]
    assert not any(by[k].contaminated for k in (4, 5, 6, 8)) and by[9].contaminated


def judged(spark, docs, items):
    got = decontam.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r.doc_id: (r.contaminated, r.kind) for r in got}


def test_letter_case_and_names_that_begin_sentences(spark):
    item = "Alice has 5 red apples in a bag. Bob gives her 7 more of them. Alice then eats 2 of all those. Bob wants to know what is left."
    other = item.replace("Alice", "Carol").replace("Bob", "Dan").replace("5", "8")
    docs = [(7, "word " * 50000 + ITEM.upper()), (8, "so " + ITEM.lower()), (9, "Here. " + other), (10, "and " + other), (11, "Alice has a bag. Bob wants it and The rest of them is left.")]
    got = judged(spark, docs, [(10, ITEM), (20, item)])
    assert got == {7: (True, "verbatim"), 8: (True, "verbatim"), 9: (True, "template"), 10: (True, "template"), 11: (False, None)}


def test_items_dense_in_numbers(spark):
    dense = "Compute 12 + 7, 45 - 9 and 30 x 18."
    partly = "Add the list of 4 8 15 16 23 42 108 7 9 11 13 19 25 31 and give the sum of it all"
    docs = [(1, "First. " + dense + " Then more."), (2, "it says " + partly.lower()), (3, "Compute 11 + 7, 45 - 9 and 30 x 19."), (4, "4 8 15 16 23 42 108"), (5, dense.upper())]
    got = judged(spark, docs, [(10, dense), (20, partly)])
    assert got == {1: (True, "verbatim"), 2: (True, "verbatim"), 3: (True, "template"), 4: (False, None), 5: (True, "verbatim")}


def test_dense_items_match_as_a_whole_or_not_at_all(spark):
    dense = "Compute 12 + 7, 45 - 9 and 30 x 18."
    docs = [(1, "So compute 3 + 4, 5 - 6 and 7 x 8 now"), (2, "Compute 3 + 4, 5 - 6 and 7."), (3, "Compute 3 4 5 6 7 and 8 x 9"), (4, "12 7 45 9 30 18 " * 40), (5, "Compute 12 + 12, 45 - 45 and 12 x 45")]
    assert judged(spark, docs, [(1, dense), (2, "Write 4 8 15 16 23 42")]) == {1: (True, "template"), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, "template")}
    # one value in the item must have one value in the text
    assert judged(spark, [(1, "Compute 3 + 3, 5 - 6 and 7 x 8"), (2, "Compute 3 + 4, 5 - 6 and 7 x 8")], [(1, "Compute 9 + 9, 8 - 7 and 6 x 5")]) == {1: (True, "template"), 2: (False, None)}


def test_short_items_and_long_runs(spark):
    long = " ".join(f"word{k} and" for k in range(100))
    items = [(1, "what is zeta"), (2, "yes"), (3, "no way"), (4, long)]
    docs = [(1, "What is Zeta?"), (2, "I ask: what is zeta, now"), (3, "Yes!"), (4, "oh yes indeed"), (5, "no way out"), (6, "No way."), (7, "x " + " ".join(long.split()[40:80]) + " y"), (8, " ".join(long.split()[40:60])), (9, "what zeta is")]
    got = judged(spark, docs, items)
    assert {i for i, (hit, _) in got.items() if hit} == {1, 2, 3, 6, 7}


def test_items_of_one_template_are_one(spark):
    item = "The box of Ida holds {} red pens, {} blue pens and a {} page book about old stone bridges"
    items = [(k, item.format(k, k + 1, k + 2)) for k in range(40)] + [(99, item.format(7, 7, 9)), (None, item.format(5, 6, 7)), (3, item.format(3, 4, 5))]
    docs = [(1, item.format(500, 600, 700)), (2, item.format(12, 13, 14)), (3, item.format(8, 8, 20)), (4, item.format(500, 600, 700)), (None, item.format(500, 600, 700))]
    got = {r.doc_id: r for r in decontam.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[1]["items"], got[1].kind] == [[99], "template"] and got[1].n_items == 2  # the item without an id is the least of its template
    assert got[2].kind == "verbatim" and 12 in got[2]["items"] and 99 in got[3]["items"] and got[4].contaminated and got[None].contaminated


# the same by nested loops over documents, items and alignments, in plain Python

TOKEN = re.compile(r"(?:[A-Za-z0-9\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+")
CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")


def typed(text):
    """(word, kind, kind if a name may begin a sentence) of each token."""
    out = []
    for m in TOKEN.finditer(text):
        word = m[0]
        low = "".join(c.lower() if CAPITAL.match(c) else c for c in word)
        before = text[: m.start()].rstrip(" \t\"'([")
        if re.fullmatch(r"[0-9.,]+", word):
            kind = 1
        elif low in decontam.UNITS and out and out[-1][1] == 1:
            kind = 3
        else:
            kind = 2 if CAPITAL.match(word) and len(word) > 1 and not CAPITAL.match(word[1]) else 0
        opens = kind == 2 and (not out or not before or before[-1] in ".!?:;|\n\r")
        out.append((low, 0 if opens else kind, kind))
    return out


def holds(doc, item, p):
    """Whether a text holds an item, and whether with its own values alone."""
    n, m = len(item), len(doc)
    size = min(p.window, n)
    if not n or m < size:
        return False, False
    if n < p.least:
        found = any([w for w, *_ in doc[k : k + n]] == [w for w, *_ in item] for k in range(m - n + 1))
        return found and (n >= p.alone or m == n), found
    template = lambda ts, v: [t[0] if not t[v] else t[v] for t in ts]
    literals = lambda ts, v: sum(not t[v] for t in ts)
    enough = min(p.literal, size // 2)
    covered, same, longest, whole = set(), True, 0, False
    full = sum(literals(item[k : k + size], 1) > 0 for k in range(n - size + 1))
    for shift in range(-n, m):
        rows = []
        for at in range(max(0, -shift), min(n - size, m - size - shift) + 1):
            a, b = item[at : at + size], doc[at + shift : at + shift + size]
            if [x[0] for x in a] == [x[0] for x in b]:
                rows.append((1, at, a, b, 1))
            for v, w in ((1, 1), (1, 2), (2, 1), (2, 2)):
                if any(k == 2 and template(x, 1) == template(x, 2) for k, x in ((v, a), (w, b))) or template(a, v) != template(b, w):
                    continue
                if literals(a, v) >= enough:
                    rows.append((2 if 2 in (v, w) else 0, at, a, b, v))
                elif v == w == 1 and literals(a, 1):
                    rows.append((3, at, a, b, 1))
        value, plain, agreed, told = {}, set(), set(), set()
        for rank, at, a, b, v in sorted(rows, key=lambda r: r[:2]):
            pairs = [(x[0], y[0]) for x, y in zip(a, b) if x[v]]
            new = dict(reversed(pairs)) | value
            if any(new[x] != y for x, y in pairs):
                continue
            value |= dict(pairs)
            if rank in (0, 3):
                agreed.add(at)
                told |= {at + k for k, x in enumerate(a) if not x[1]}
            if rank == 3:
                continue
            same &= all(x == y for x, y in pairs)
            covered |= set(range(at, at + size))
            if rank == 1:
                plain |= set(range(at, at + size))
        whole |= len(agreed) == full > 0 and len(told) >= p.told
        longest = max([longest, *(sum(1 for _ in itertools.takewhile(plain.__contains__, itertools.count(k))) for k in plain if k - 1 not in plain)])
    share = len(covered) / n
    return share >= p.share or longest >= p.run or whole, same and share > 0


def test_op7_is_the_nested_loops(spark):
    rng = random.Random(17)
    vocabulary = ["the", "a", "red", "stone", "bridge", "counts", "km", "kg", "Anna", "Olaf", "Émile", "12", "7", "3.5", "9,000", "why", "holds", "pens", "and", "of", "Then", "days"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", ",", ":"]) for _ in range(n))
    items = [(k, sentence(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 12, 12, 9])]
    renamed = lambda t: " ".join({"Anna": "Ida", "Olaf": "Sven", "Émile": "Zoé", "12": "85", "7": "4", "3.5": "1.25", "km": "kg"}.get(w, w) for w in t.split())
    docs = []
    for _, text in items * 4:
        words = text.split()
        cut = rng.randint(0, max(0, len(words) // 2))
        part = rng.choice([text, text.upper(), text.lower(), renamed(text), renamed(text), " ".join(words[cut:]), " ".join(words[:cut] + ["zzz"] + words[cut:]), " ".join(w if rng.random() < 0.9 else rng.choice(vocabulary) for w in words)])
        docs.append(rng.choice(["", sentence(3) + " "]) + part + rng.choice(["", ". " + sentence(4)]))
    docs += [sentence(rng.randint(1, 60)) for _ in range(60)] + docs[:5]
    p = decontam.Template()
    want = {}
    for i, d in enumerate(docs):
        found = [x for x in (holds(typed(d), typed(t), p) for _, t in items) if x[0]]
        want[i] = (bool(found), None if not found else "verbatim" if any(x[1] for x in found) else "template")
    got = judged(spark, list(enumerate(docs)), items)
    assert {i: (got[i], d) for i, d in enumerate(docs) if got[i] != want[i]} == {} and len({x for x in want.values()}) == 3


def test_slots_must_agree():
    h = lambda *x: np.array(x, np.uint64).tobytes()
    places, shift = np.array([0, 4]), np.array([7, 7])
    assert decontam.consistent(places, shift, [h(0, 5, 0, 0), h(5, 0, 0, 0)], [h(0, 6, 0, 0), h(6, 0, 0, 0)], 8) == (1.0, False, 0, 2)
    assert decontam.consistent(places, shift, [h(0, 5, 0, 0), h(5, 0, 0, 0)], [h(0, 6, 0, 0), h(9, 0, 0, 0)], 8) == (0.5, False, 0, 1)
    assert decontam.consistent(places, shift, [h(0, 5, 0, 0), h(5, 0, 0, 0)], [h(0, 5, 0, 0), h(5, 0, 0, 0)], 8) == (1.0, True, 0, 2)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.judge(docs, items).collect()] == [False]
    assert decontam.judge(docs.limit(0), items).count() == 0
    assert decontam.clean(docs, items).columns == docs.columns


def test_op7_finds_planted_passages(spark, documents):
    flat = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in documents.collect() if any(x in flat(r.text) for x in items)}
    assert {r.doc_id for r in op7_decontamination(spark, SF).where("contaminated").collect()} == want and want


# pipeline -----------------------------------------------------------------------------------------


def test_scratch_tables_go(spark, documents):
    import os

    before = set(os.listdir(_shared.shared_root(spark).removeprefix("file://")))
    with _shared.written():
        assert minhash.near_duplicates(documents).count() == documents.count()
    assert set(os.listdir(_shared.shared_root(spark).removeprefix("file://"))) == before


def test_pipeline_is_its_stages(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = documents
    scored = docs.withColumn("s", toxicity.score(docs, toxicity.train(docs, labels, ~held_out("doc_id", 5, 0))))
    docs = scored.where("s < 0.5").drop("s").cache()
    scored = docs.withColumn("s", quality.score(docs, quality.train(docs, labels, ~held_out("doc_id", 5, 1))))
    docs = scored.where("s >= 0.5").drop("s").cache()
    kept = [r.doc_id for r in minhash.near_duplicates(docs, minhash.FIVE_WORDS).where("kept").collect()]
    docs = docs.where(F.col("doc_id").isin(kept))
    dirty = [r.doc_id for r in decontam.judge(docs, benchmark).where("contaminated").collect()]
    rows = docs.where(~F.col("doc_id").isin(dirty)).select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], reference([r.text for r in rows])))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < documents.count()


def test_texts_of_one_id_are_judged_by_themselves(spark):
    base = " ".join(f"w{k}" for k in range(40))
    other, third = " ".join(f"x{k}" for k in range(40)), " ".join(f"y{k}" for k in range(40))
    rows = [(1, base), (2, base + " end"), (2, other), (3, other.upper()), (3, third), (3, third), (4, "short"), (4, "short"), (5, "Short"), (6, None), (6, ""), (None, base), (None, base)]
    docs = clashing(spark.createDataFrame([(i, t, f"l{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string"), "_mark", "m", "root", "x").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert [x for x in got if x[0] not in (6, None)] == [(1, base), (2, other), (3, third), (4, "short")]
    assert [x[0] for x in got if x[0] == 6] == [6] and [x for x in got if x[0] is None] == [(None, base)] * 2
    assert [r.lang for r in out.collect() if (r.doc_id, r.text) == (3, third)] == ["l4"]  # of equal rows the least


def test_near_dedup_stage_is_brute_force(spark, documents):
    """Of every component of nested loops over shingle sets, the text of the smallest id."""
    flat = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    rows = [(r.doc_id, flat(r.text)) for r in documents.collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents, SF).collect()) == sorted(i for i in sets if find(i) == i)


def test_stages_keep_columns_and_odd_rows(spark):
    docs = clashing(spark.createDataFrame([(1, None, "en", "s", 3), (None, "", None, None, None), (None, "", None, None, None), (2, "a b c d e f", "en", "s", 9), (3, "A b c d e f", "en", "s", 9), (3, "A b c d e f", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long"), "_score", "_gone", "mark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    left = sorted((r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert left == [1, 2, None, None]
