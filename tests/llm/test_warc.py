import base64
import hashlib
import zlib

import pytest

from runstrata.llm import warc
from runstrata.llm.queries import op1_warc

from llm_helpers import clashing

DDL = "page_id long, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def back(capture, **options):
    return warc.read_records(capture, warc.lookup(capture, capture.entries.select("key", "page_id")), **options)


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        one = first.get(p)
        out.append((i, len(p), digest(p), "response" if one == i or one is None else "revisit", None if one == i else one))
    return sorted(out, key=str)


ROWS = [(3, "http://A.b.org/x?y#z", "é" * 9), (1, "http://a.b.org/x?y#z", "é" * 9), (7, None, None), (8, "no scheme", ""), (None, "http://q.com", "q"), (None, "http://q.com", "é" * 9), (9, "http://t\n.com/\t", "long" * 50000), (9, "http://t\n.com/\t", "long" * 50000), (10, "", "x\r\n\r\ny")]


@pytest.mark.parametrize("layout", [warc.Layout(), warc.Layout(lines=1, roll=10, gap=0)])
def test_round_trip(spark, layout):
    df = clashing(spark.createDataFrame(ROWS, DDL), "key", "digest", "first", "payload", "n").repartition(3)
    got = back(warc.write_archives(df, layout)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in ROWS}


def test_small_payloads_are_responses(spark):
    got = back(warc.write_archives(spark.createDataFrame(ROWS, DDL), warc.Layout(min_bytes=100)), payloads=False).collect()
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == []


def test_empty(spark):
    capture = warc.write_archives(spark.createDataFrame([], DDL))
    assert back(capture).count() == 0


def test_lookup_of_many_blocks(spark):
    rows = [(i, f"http://h{i % 3}.example.org/p{i // 2}", f"t{i}") for i in range(500)]
    capture = warc.write_archives(spark.createDataFrame(rows, DDL).repartition(4), warc.Layout(lines=7))
    wanted = spark.createDataFrame([("org,example,h0)/p0", 0), ("org,example,h1)/p249", 499), ("org,example,h1)/p249", 498), ("zz", 1), ("", 1)], "key string, page_id long")
    assert sorted((r.key, r.page_id) for r in warc.lookup(capture, wanted).collect()) == [("org,example,h0)/p0", 0), ("org,example,h1)/p249", 499)]


def test_damage_is_noticed():
    data = warc.record(1, "http://a", b"abc", digest(b"abc"), None, warc.Layout())
    assert warc.parse(data)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abc", b"abd"))
    member = warc._gzip(data, 6)
    assert zlib.decompress(member, 31) == data


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = op1_warc(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
