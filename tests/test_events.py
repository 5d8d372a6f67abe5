import json
import random

import pytest
from pyspark.sql import functions as F

from runstrata.functions import jsonlines as J
from runstrata.operators import events as E

FIELDS = ("seq", "type", "id", "parent_id", "actor", "tool_name", "exit_code")


def lines(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records)


def parsed(spark, fmt, **logs):
    """Events of several logs at once: name of the log -> its events in order."""
    df = spark.createDataFrame([(k, v if isinstance(v, bytes) else v.encode()) for k, v in logs.items()], "path string, content binary")
    out = {k: [] for k in logs}
    for r in E.parse_events(df, fmt).orderBy("trajectory", "seq").collect():
        out[r.trajectory].append(r)
    return out


def cells(rows, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


def test_physical_lines():
    assert list(J.lines(b"one\ntwo\r\n\t\n\r\nfive\r\r\nlast\r")) == [(0, b"one"), (1, b"two"), (4, b"five\r"), (5, b"last\r")]
    assert list(J.lines(b"\n\n")) == list(J.lines(b"")) == []


@pytest.mark.parametrize(("value", "want"), [
    ("1999-12-31T23:59:59Z", 946684799_000000), ("2000-02-29t12:00:00.123456789+05:30", 951805800_123456), ("1970-01-01 00:00:00-00:01", 60_000000),
    ("2016-12-31T23:59:60Z", 1483228800_000000), ("2021-02-30T00:00:00Z", None), ("2021-03-01T10:00Z", None), ("2021-03-01T10:00:00", None), ("noon", None),
    (999_999_999_999, 999_999_999_999_000000), (1_000_000_000_001, 1_000_000_000_001_000), (-3, -3_000000), (0.5, 500000), (2.5e12, 2_500_000_000_000_000),
    (9_223_372_036_855_000, None), (12345678901234567890, None), (-1e300, None), (False, None), (None, None), ([1], None),
])
def test_times(value, want):
    assert J.micros(value) == want


def test_json_is_strict():
    for bad in (b"Infinity", b"-1e400", b'["\\udfff"]', b"\xc3", b"[1,]", b"{}{}", b"{" * 500):
        assert J.parse(bad) == (False, None)
    assert J.parse(b'{"k":"first","k":[null]}') == (True, {"k": [None]})
    assert J.parse(b"-0")[1] == 0 and isinstance(J.parse(b"-0")[1], float) and isinstance(J.parse(b"99999999999999999999")[1], float)


def test_paths_skip_values_of_another_type():
    v = {"n": 3, "deep": {"er": "text", "list": []}, "big": 1 << 31, "least": -(1 << 31), "half": 2.0, "yes": True}
    assert J.text_at(v, ("n", "deep", "deep.none", "n.x", "deep.er")) == "text" and J.text_at([v], ("n",)) is None
    assert J.int32_at(v, ("yes", "half", "big", "least", "n")) == -(1 << 31) and J.int32_at(v, ("big", "deep.er")) is None
    assert J.time_at(v, ("deep", "yes", "half", "n")) == 2_000000


def test_any_json_lines(spark):
    (rows,) = parsed(spark, "jsonl", a=lines({"kind": "open", "uuid": "q", "time": 12, "parent": "up", "author": "me", "toolName": "rg", "status_code": -4}, "", "not json", '"text"', {"type": 7, "event": "", "id": None, "timestamp": "x", "created_at": 1.5}, b"\xfe\x01".decode("latin-1"))).values()
    assert cells(rows, *FIELDS) == [(0, "open", "q", "up", "me", "rg", -4), (2, "_unparsed", None, None, None, None, None), (3, "_untyped", None, None, None, None, None), (4, "", None, None, None, None, None), (5, "_unparsed", None, None, None, None, None)]
    assert [str(r.ts) for r in rows] == ["1970-01-01 00:00:12", "None", "None", "1970-01-01 00:00:01.500000", "None"]
    assert rows[1].payload_json == '"not json"' and rows[2].payload_json == '"text"'


def test_bytes_that_are_no_text_are_kept(spark):
    (rows,) = parsed(spark, "jsonl", a=b"\x80ok\n{}").values()
    assert cells(rows, "type", "payload_json") == [("_unparsed", '{"bytes":[128,111,107]}'), ("_untyped", "{}")]


def test_names_of_calls_by_call(spark):
    call = lambda kind, **data: {"type": kind, "data": data}
    log = lines(
        call("tool.begin", toolCallId="1", name="fetch"), call("tool.begin", toolCallId="2", tool="build"), call("tool.end", toolCallId="1", exitCode=0), call("tool.log", toolCallId="9"),
        call("tool.begin", toolCallId="1", toolName="patch"), call("model.reply", toolCallId="1", exit_code=5), call("tool.end", toolCallId="1", exit_code=2), call("tool.solo", name="alone"), call("tool.end", toolCallId="2", exitCode="1"),
    )
    other = lines(call("tool.end", toolCallId="1"), {"type": "session.note", "parentId": "p", "id": "i"}, '{"type":"user.says" , "data" : { "n" : 1.50,"u":"\\u00e9" } , "d\\u0061ta": [ 3 ] }')
    got = parsed(spark, "copilot-cli", a=log, b=other)
    assert cells(got["a"], "tool_name") == ["fetch", "build", "fetch", None, "patch", None, "patch", "alone", "build"]
    assert cells(got["a"], "exit_code") == [None, None, 0, None, None, None, 2, None, None]
    assert cells(got["a"], "actor") == ["tool"] * 5 + ["assistant"] + ["tool"] * 3
    assert cells(got["b"], "tool_name", "actor", "id", "parent_id") == [(None, "tool", None, None), (None, "system", "i", "p"), (None, "user", None, None)]
    assert cells(got["b"], "payload_json") == ['{"toolCallId": "1"}', '{"type": "session.note", "parentId": "p", "id": "i"}', "[ 3 ]"]


def test_threads_and_items(spark):
    item = lambda **x: {"type": "item.updated", "item": x}
    log = lines(
        item(id="early", type="reasoning"), {"type": "thread.started", "thread_id": "T1"}, item(id="c", type="file_change", exit_code=1), item(type="web_search", tool="google", exit_code=None), item(type="mcp_tool_call", tool=1, name="ask"),
        item(type="mcp_tool_call", exit_code=3), {"type": "turn.failed", "id": "f", "parent_id": "own"}, {"type": "thread.started", "thread_id": 5}, item(type="agent_message", exit_code=4), {"type": "thread.started", "thread_id": "T2"}, {"type": "x", "thread_id": "shown"},
    )
    (rows,) = parsed(spark, "codex-cli", a=log).values()
    assert cells(rows, "parent_id") == [None, None, "T1", "T1", "T1", "T1", "own", None, None, None, "T2"]
    assert cells(rows, "tool_name", "exit_code", "actor")[:6] == [(None, None, "assistant"), (None, None, None), ("file_change", 1, "tool"), ("google", None, "tool"), ("ask", None, "tool"), (None, None, None)]
    assert cells(rows, "id") == ["early", "T1", "c", None, None, None, "f", None, None, "T2", "shown"] and rows[8].exit_code is None and rows[8].actor == "assistant"


def test_parts_of_messages(spark):
    part = lambda kind, **x: {"type": kind, **x}
    message = lambda kind, *parts, **x: {"type": kind, "uuid": f"u{len(parts)}", "message": {"content": list(parts)} | x}
    log = lines(
        message("user", part("tool_result", tool_use_id="a")), message("assistant", part("text"), part("tool_use", id="a", name="Edit"), part("tool_use", id="b", name="Run"), role="model"),
        message("user", part("tool_result", tool_use_id="b"), part("tool_result", tool_use_id="a")), message("system", part("tool_use", id="a"), part("tool_result", tool_use_id="zz"), "loose", part("tool_use", name="Late")),
        {"type": "summary", "message": {"content": "tool_use"}}, message("user", part("tool_use", id="c", name="Now"), part("tool_result", tool_use_id="c")),
    )
    (rows,) = parsed(spark, "claude-code", a=log).values()
    assert cells(rows, "tool_name") == [None, "Edit", "Run", "Late", None, "Now"]
    assert cells(rows, "actor") == ["user", "model", "user", "system", None, "user"] and cells(rows, "exit_code") == [None] * 6
    assert [json.loads(r.payload_json) for r in rows] == [json.loads(x) for x in log.split("\n")]


def test_formats_are_recognised(spark):
    logs = {
        "a": lines("?", {"type": "plan"}, {"type": "item.started"}, {"type": "user", "uuid": "x"}), "b": lines({"type": "tool.run"}, {"type": "tool.run", "data": None}), "c": lines({"type": "user.x"}, {"type": "summary", "uuid": 0}),
        "d": lines(7, {"event": "user"}), "e": "", "f": lines({"type": "user", "data": 1}),
    }
    want = {"a": "codex-cli", "b": "copilot-cli", "c": "claude-code", "d": "jsonl", "e": "jsonl", "f": "jsonl"}
    assert {k: E.recognise(v.encode()) for k, v in logs.items()} == want
    got = parsed(spark, "auto", **logs)
    for fmt in E.LAYOUTS:
        assert parsed(spark, fmt, **logs) | {k: v for k, v in got.items() if want[k] == fmt} == parsed(spark, fmt, **logs)


def test_calls_and_threads_are_those_of_a_loop(spark):
    """Random logs of every format against one pass with two variables."""
    rng = random.Random(12)
    some = lambda *xs: rng.choice(xs)
    logs, want = {}, {}
    for k in range(40):
        names, records, tools = {}, [], []
        for _ in range(rng.randint(0, 25)):
            call, name = some("1", "2", "3", None), some("x", "y", None)
            records.append({"type": some("tool.a", "tool.b"), "data": {a: b for a, b in (("toolCallId", call), ("name", name)) if b is not None}})
            tools.append(name or names.get(call))
            if call and name:
                names[call] = name
        logs[f"c{k}"], want[f"c{k}"] = lines(*records), tools
    got = parsed(spark, "copilot-cli", **logs)
    assert {k: cells(v, "tool_name") for k, v in got.items()} == want
    logs, want = {}, {}
    for k in range(40):
        thread, records, parents = None, [], []
        for _ in range(rng.randint(0, 15)):
            if rng.random() < 0.3:
                thread = some("t", "u", None)
                records.append({"type": "thread.started"} | ({"thread_id": thread} if thread else {}))
                parents.append(None)
            else:
                own = some("p", None, None)
                records.append({"type": "turn.started"} | ({"parent_id": own} if own else {}))
                parents.append(own or thread)
        logs[f"t{k}"], want[f"t{k}"] = lines(*records), parents
    assert {k: cells(v, "parent_id") for k, v in parsed(spark, "codex-cli", **logs).items()} == want


def test_every_line_is_an_event(spark):
    text = lines({"type": "thread.started"}, "]", 0, [], None, '{"cut":')
    for fmt in E.FORMATS:
        (rows,) = parsed(spark, fmt, a=text).values()
        assert cells(rows, "seq") == [0, 1, 2, 3, 4, 5]
    assert E.parse_events(spark.createDataFrame([("a", None)], "path string, content binary"), "auto", 3).count() == 0


ADAPTER = """
name = "lab"
version = 4
rules = "none"
[[attrs]]
pattern = '^runs/(?P<day>\\d{4})-(?P<host>\\w+)/'
strip_leading_zeros = ["day"]
[[attrs]]
pattern = '/(?P<host>gpu)(?P<slot>\\d)?\\.log$'
strip_leading_zeros = ["slot"]
[trajectories]
globs = ["runs/**/*.log"]
format = "copilot-cli"
[batch_ready]
run_glob = "lab-*"
markers = ["runs/*/END"]
"""


def test_attributes(spark):
    a = E.from_toml(ADAPTER)
    assert (a.name, a.version, a.format, a.markers) == ("lab", 4, "copilot-cli", ("runs/*/END",))
    df = spark.createDataFrame([("runs/0000-north/x",), ("runs/0420-north/gpu0.log",), ("runs/1-north/gpu.log",), ("elsewhere",)], "path string")
    got = [r.m for r in df.select(a.attributes(F.col("path")).alias("m")).collect()]
    assert got == [{"day": "0", "host": "north"}, {"day": "420", "host": "gpu", "slot": "0"}, {"host": "gpu"}, {}]
    with pytest.raises(ValueError):
        E.from_toml('name = "x"\n[trajectories]\nglobs = []\nformat = "yaml"')
    assert [E.resolve(f).globs for f in ("auto", "jsonl:a,b")] == [("**/events.jsonl",), ("a", "b")]
