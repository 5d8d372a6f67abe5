import random
import re
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from runstrata.functions import paths as P


def test_parts(spark):
    rows = {"a/b/c.txt": ("a/b", "c.txt", 3, ["", "a", "a/b"], "txt"), "x": ("", "x", 1, [""], ""), "d/.bashrc": ("d", ".bashrc", 2, ["", "d"], ""), "d/a.tar.gz": ("d", "a.tar.gz", 2, ["", "d"], "gz"), "e/a.": ("e", "a.", 2, ["", "e"], "")}
    p = F.col("p")
    got = {r.p: (r.a, r.b, r.d, r.e, r.x) for r in spark.createDataFrame([(k,) for k in rows], "p string").select("p", P.parent(p).alias("a"), P.basename(p).alias("b"), P.depth(p).alias("d"), P.ancestors(p).alias("e"), P.extension(P.basename(p)).alias("x")).collect()}
    assert got == rows


def test_validity(spark):
    good, bad = ["a", "a/b", ".a/..b", "a b"], ["", "/a", "a/", "a//b", "./a", "a/..", ".", "a\0b"]
    got = {r.p: r.v for r in spark.createDataFrame([(x,) for x in good + bad], "p string").select("p", P.valid(F.col("p")).alias("v")).collect()}
    assert got == {x: True for x in good} | {x: False for x in bad}


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("*.txt", ["a.txt", "d/a.txt", ".txt"], ["a.txt2"]),
    ("**/events.jsonl", ["events.jsonl", "a/b/events.jsonl"], ["xevents.jsonl"]),
    ("logs/**", ["logs/a", "logs/a/b"], ["logs", "xlogs/a"]),
    ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]),
    ("f?[0-9]{x,yz}", ["fa1x", "f/9yz"], ["fa1", "fax"]),
    ("[!a]b", ["cb"], ["ab"]),
])
def test_globs(glob, yes, no):
    r = re.compile(P.glob_regex(glob).replace(r"\z", r"\Z"))
    assert all(r.match(x) for x in yes) and not any(r.match(x) for x in no)


def test_plain_functions():
    assert [P.normalise(x) for x in ("./a/b/", ".", "/", "././ x ")] == ["a/b", "", "", " x "]
    assert P.store_id("a b/ü.x") == "a%20b%2F%C3%BC.x"
    assert [P.size_literal(x) for x in ("4096", "1.5G", "800M", "2k")] == [4096, 1610612736, 838860800, 2048]
    assert P.size_literal("20%", 1000) == 200
    with pytest.raises(ValueError):
        P.size_literal("x")


def test_texts(spark):
    row = spark.range(1).select(P.human(F.lit(1023)).alias("a"), P.human(F.lit(1536)).alias("b"), P.human(F.lit(3 << 30)).alias("c"), P.mode_text(F.lit(0), F.lit(0o755)).alias("d"), P.mode_text(F.lit(1), F.lit(0o777)).alias("e"), P.attrs_text(F.create_map(F.lit("k"), F.lit("v"), F.lit("a"), F.lit("b"))).alias("f")).first()
    assert tuple(row) == ("1023 B", "1.5 KB", "3.00 GB", "-rwxr-xr-x", "lrwxrwxrwx", "a=b,k=v")


def test_sizes_to_the_even_digit(spark):
    """Against exact decimal arithmetic, ties among them."""
    rng = random.Random(4)
    sizes = [0, 1023, 1024, 1280, 1792, 2304, 1048575, 1048576, 1310720, 1572864 + 262144, (1 << 30) - 1, (1 << 30) + (1 << 27), 5368709120 + (1 << 30) // 8 * 3, (1 << 40) + 12345] + [rng.randrange(1 << rng.randrange(1, 42)) for _ in range(2000)]
    sizes += [(a << 10) + 256 for a in range(40)] + [(a << 20) + (3 << 18) for a in range(40)] + [(a << 30) + (1 << 27) for a in range(1, 40)]

    def plain(n):
        if n < 1024:
            return f"{n} B"
        shift, digits, name = (10, "0.1", "KB") if n < 1 << 20 else (20, "0.1", "MB") if n < 1 << 30 else (30, "0.01", "GB")
        return f"{(Decimal(n) / Decimal(1 << shift)).quantize(Decimal(digits), ROUND_HALF_EVEN)} {name}"

    got = {r.n: r.h for r in spark.createDataFrame([(n,) for n in set(sizes)], "n long").select("n", P.human(F.col("n")).alias("h")).collect()}
    with localcontext() as c:
        c.prec = 60
        assert got == {n: plain(n) for n in set(sizes)}


def test_times_as_text(spark):
    want = {0: "1970-01-01T00:00:00+00:00", 1_756_947_602_500_000_000: "2025-09-04T01:00:02.500+00:00", -1: "1969-12-31T23:59:59.999999999+00:00", 1_000: "1970-01-01T00:00:00.000001+00:00", 4_102_444_799_000_000_000: "2099-12-31T23:59:59+00:00"}
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in want], "n long").select("n", P.time_text(F.col("n")).alias("t")).collect()}
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == want
