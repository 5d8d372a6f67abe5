"""Trajectory logs: one physical line is one event.

A format is a ``Layout``: a table of where its records keep the fields of an event. One scanner reads any layout, line by
line and without state. What depends on earlier records (the name of a tool called before, the thread a record belongs
to) is left as columns and resolved by Spark windows over a trajectory.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsonlines as J
from ..functions import paths as P

EVENT_DDL = "trajectory string, seq int, ts timestamp_ntz, type string, id string, parent_id string, actor string, tool_name string, exit_code int, payload_json string, adapter_version int"


@dataclass(frozen=True)
class Layout:
    """Paths are dotted; of several, the first whose value has the right type holds. Names of types that end in a dot stand for all that begin so."""

    globs: tuple[str, ...]
    type: tuple[str, ...] = ("type",)
    ts: tuple[str, ...] = ("timestamp",)
    id: tuple[str, ...] = ("id",)
    parent: tuple[str, ...] = ()
    actor: tuple[str, ...] = ()
    tool: tuple[str, ...] = ()
    exit: tuple[str, ...] = ()
    payload: str | None = None  #: the member whose text is the payload; without it, the line is
    actor_of_type: tuple[tuple[str, str], ...] = ()
    tool_types: tuple[str, ...] = ()  #: types that alone have a tool and an exit code; none: all
    call: str | None = None  #: the call of a tool's record; a record without a name has that of its call
    item: str | None = None  #: the member that says what a record is about
    tool_of_item: tuple[tuple[str, tuple[str, ...]], ...] = ()  #: items that are tools, and what names them
    actor_of_item: tuple[tuple[str, str], ...] = ()
    blocks: str | None = None  #: the list of parts of a message
    call_of_block: tuple[tuple[str, str, str | None], ...] = ()  #: parts that name or answer a call: type, the call, its name
    thread: tuple[str, str] | None = None  #: the type that begins a thread, and the thread's id: the parent of what follows
    known_types: tuple[str, ...] = ()  #: a record of such a type, with ``known_member``, tells the format of a stream
    known_member: str | None = None


#: The fields of each format, in the order in which streams are tried.
LAYOUTS = {
    "codex-cli": Layout(
        globs=("**/events.jsonl",), id=("item.id", "id", "thread_id"), parent=("parent_id",), exit=("item.exit_code",), item="item.type",
        tool_of_item=(
            ("command_execution", ("item.tool", "item.type")), ("file_change", ("item.tool", "item.type")), ("web_search", ("item.tool", "item.type")),
            ("collab_tool_call", ("item.tool", "item.type")), ("mcp_tool_call", ("item.tool", "item.name")),
        ),
        actor_of_item=(("agent_message", "assistant"), ("reasoning", "assistant")), thread=("thread.started", "thread_id"),
        known_types=("thread.started", "turn.started", "turn.completed", "turn.failed", "item.started", "item.updated", "item.completed"),
    ),
    "copilot-cli": Layout(
        globs=("**/events.jsonl",), parent=("parentId",), tool=("data.toolName", "data.name", "data.tool"), exit=("data.exitCode", "data.exit_code"),
        payload="data", actor_of_type=(("assistant.", "assistant"), ("model.", "assistant"), ("tool.", "tool"), ("user.", "user"), ("session.", "system")),
        tool_types=("tool.",), call="data.toolCallId", known_types=("assistant.", "model.", "tool.", "user.", "session."), known_member="data",
    ),
    "claude-code": Layout(
        globs=("**/*.jsonl",), id=("uuid",), parent=("parentUuid",), actor=("message.role",), actor_of_type=(("user", "user"), ("assistant", "assistant"), ("system", "system")),
        blocks="message.content", call_of_block=(("tool_use", "id", "name"), ("tool_result", "tool_use_id", None)),
        known_types=("user", "assistant", "system", "summary"), known_member="uuid",
    ),
    "jsonl": Layout(
        globs=("**/*.jsonl",), type=("type", "event", "kind", "event_type"), ts=("timestamp", "ts", "time", "created_at"), id=("id", "uuid", "event_id"),
        parent=("parentId", "parent_id", "parentUuid", "parent"), actor=("role", "actor", "author"), tool=("tool_name", "toolName", "tool"),
        exit=("exit_code", "exitCode", "returncode", "status_code"),
    ),
}
AUTOMATIC = "auto"  #: the layout of the first record that tells one holds for a whole stream; else the last of ``LAYOUTS``
FORMATS = (*LAYOUTS, AUTOMATIC)


def globs_of(fmt: str) -> tuple[str, ...]:
    return LAYOUTS["codex-cli"].globs if fmt == AUTOMATIC else LAYOUTS[fmt].globs


def _is(kind: str, names) -> bool:
    return any(kind.startswith(n) if n.endswith(".") else kind == n for n in names)


def recognise(content: bytes) -> str:
    """The format of a stream."""
    for _, line in J.lines(content):
        ok, v = J.parse(line)
        kind = J.text_at(v, ("type",)) if ok else None
        for name, layout in LAYOUTS.items() if kind is not None else ():
            if _is(kind, layout.known_types) and (layout.known_member is None or layout.known_member in v):
                return name
    return list(LAYOUTS)[-1]


def scan(content: bytes, layout: Layout) -> Iterator[dict]:
    """A record for each line that is not blank, by itself: the event's own fields, ``mentions`` of calls (call, name), ``opens`` (a thread begins) and ``follows`` (the parent, if none is given, is the thread)."""
    tool_of_item, actor_of_item, call_of_block = dict(layout.tool_of_item), dict(layout.actor_of_item), {k: (c, n) for k, c, n in layout.call_of_block}
    for seq, line in J.lines(content):
        ok, v = J.parse(line)
        if not ok:
            yield {"seq": seq, "type": "_unparsed", "payload_json": J.as_payload(line)}
            continue
        text, kind = line.decode(), J.text_at(v, layout.type)
        kind = "_untyped" if kind is None else kind  # an empty type is a type
        item = J.text_at(v, (layout.item,)) if layout.item else None
        named_by = tool_of_item.get(item, ()) if layout.item else layout.tool if not layout.tool_types or _is(kind, layout.tool_types) else ()
        tool = J.text_at(v, named_by)
        actor = J.text_at(v, layout.actor)
        if actor is None:
            actor = "tool" if layout.item and tool is not None else next((a for t, a in layout.actor_of_type if _is(kind, (t,))), actor_of_item.get(item))
        mentions = [(J.text_at(v, (layout.call,)), tool)] if layout.call and named_by else []
        blocks = J.at(v, layout.blocks) if layout.blocks else None
        for block in blocks if isinstance(blocks, list) else ():
            call, name = call_of_block.get(J.text_at(block, ("type",)), (None, None))
            if call:
                given = J.text_at(block, (name,)) if name else None
                # a part that should name its call and does not, names none
                mentions.append((None if name and given is None else J.text_at(block, (call,)), given))
        yield {
            "seq": seq,
            "ts": J.time_at(v, layout.ts),
            "type": kind,
            "id": J.text_at(v, layout.id),
            "parent_id": J.text_at(v, layout.parent),
            "actor": actor,
            "tool_name": tool,
            "exit_code": J.int32_at(v, layout.exit) if named_by and (tool is not None or not layout.item) else None,
            "payload_json": J.verbatim(text, layout.payload) if layout.payload and isinstance(v, dict) and layout.payload in v else text,
            "mentions": [{"call": c, "name": n} for c, n in mentions] or None,
            "opens": {"id": J.text_at(v, (layout.thread[1],))} if layout.thread and kind == layout.thread[0] else None,
            "follows": bool(layout.thread) and kind != layout.thread[0],
        }


@dataclass(frozen=True)
class Adapter:
    """Which paths are trajectories, how they are parsed, what their paths say, and when a run is ready to be stored."""

    name: str
    version: int = 1
    format: str | None = None
    globs: tuple[str, ...] = ()
    attrs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rules: str | None = None
    run_glob: str | None = None
    markers: tuple[str, ...] = ()
    label_ancestor_pattern: str | None = None
    raw_patterns: tuple[str, ...] = field(default=())

    def is_trajectory(self, path: Column, kind: Column) -> Column:
        """A regular file whose whole path matches a glob."""
        return (kind == 0) & P.matches(path, list(self.globs)) if self.format else F.lit(False)

    def attributes(self, path: Column) -> Column:
        """Named groups of all patterns that match; a later pattern overrides an earlier one's key."""
        names: list[str] = []
        for pattern, _ in self.attrs:
            names += [n for n in re.findall(r"\(\?P?<([A-Za-z]\w*)>", pattern) if n not in names]
        if not names:
            return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        entries = []
        for name in names:
            value = F.lit(None).cast("string")
            for pattern, strip in self.attrs:
                if re.search(rf"\(\?P?<{name}>", pattern):
                    java = re.sub(r"\(\?P<", "(?<", pattern)
                    group = _group_number(pattern, name)
                    found = F.when(path.rlike(java), F.regexp_extract(path, java, group))
                    if _optional(pattern, name):  # an absent group is no attribute, an empty one is
                        found = F.when(found != "", found)
                    if name in strip:
                        found = F.when(found.isNotNull(), F.when(F.ltrim(found, F.lit("0")) == "", "0").otherwise(F.ltrim(found, F.lit("0"))))
                    value = F.coalesce(found, value)
            entries.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _group_number(pattern: str, name: str) -> int:
    return re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groupindex[name]


def _optional(pattern: str, name: str) -> bool:
    """Whether the group can be absent in a match: tried by taking the group's own matches away."""
    compiled = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern))
    start = re.search(rf"\(\?P?<{name}>", pattern).start()
    level, i = 0, start
    while i < len(pattern):
        level += (pattern[i] == "(" and pattern[i - 1 : i] != "\\") - (pattern[i] == ")" and pattern[i - 1 : i] != "\\")
        i += 1
        if not level:
            break
    return compiled.groups > 0 and (pattern[i : i + 1] in ("?", "*") or "|" in pattern[:start])


def resolve(spec: str, base: str = ".") -> Adapter:
    """A format's name, ``none``, ``jsonl:`` and globs, or the path of a TOML file."""
    if spec == "none":
        return Adapter("none")
    if spec.startswith("jsonl:"):
        return Adapter("jsonl", format="jsonl", globs=tuple(spec[6:].split(",")))
    if spec in FORMATS:
        return Adapter(spec, format=spec, globs=globs_of(spec))
    with open(spec if spec.startswith("/") else f"{base}/{spec}", "rb") as f:
        return from_toml(f.read().decode())


def from_toml(text: str) -> Adapter:
    t = tomllib.loads(text)
    log, ready = t.get("trajectories", {}), t.get("batch_ready", {})
    if log and log["format"] not in FORMATS:
        raise ValueError(f"unknown trajectory format {log['format']!r}")
    return Adapter(
        t["name"], t.get("version", 1), log.get("format"), tuple(log.get("globs", ())),
        tuple((a["pattern"], tuple(a.get("strip_leading_zeros", ()))) for a in t.get("attrs", ())),
        t.get("rules"), ready.get("run_glob"), tuple(ready.get("markers", ())), ready.get("label_ancestor_pattern"),
        tuple(t.get("hook", {}).get("raw_patterns", ())),
    )


_ARROW = pa.schema([
    ("trajectory", pa.string()), ("seq", pa.int32()), ("ts", pa.timestamp("us")), ("type", pa.string()), ("id", pa.string()), ("parent_id", pa.string()), ("actor", pa.string()),
    ("tool_name", pa.string()), ("exit_code", pa.int32()), ("payload_json", pa.string()), ("adapter_version", pa.int32()),
    ("mentions", pa.list_(pa.struct([("call", pa.string()), ("name", pa.string())]))), ("opens", pa.struct([("id", pa.string())])), ("follows", pa.bool_()),
])
_SCANNED_DDL = EVENT_DDL + ", mentions array<struct<call:string,name:string>>, opens struct<id:string>, follows boolean"


def scan_logs(logs: DataFrame, fmt: str, version: int = 1, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, content) of whole logs -> records, none of which knows of another. A log is one row and one Arrow cell, so tasks stay as large as their logs."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for record in scan(content or b"", LAYOUTS[recognise(content or b"") if fmt == AUTOMATIC else fmt]):
                    rows.append(record | {"trajectory": path, "adapter_version": version})
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return logs.select(F.col(path_col), F.col(content_col).cast("binary")).mapInArrow(run, _SCANNED_DDL)


def resolve_calls(records: DataFrame) -> DataFrame:
    """Records of ``trajectory, seq`` with the tool of the first call they mention whose name is known: given here, or last given before for the same call."""
    rows = records.select("*", F.posexplode_outer("mentions").alias("k", "m")).withColumn("k", F.coalesce("k", F.lit(0)))
    rows = rows.withColumn("payload_json", F.when(F.col("k") == 0, F.col("payload_json")))  # one copy goes on
    so_far = Window.partitionBy("trajectory", "m.call").orderBy("seq", "k").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("m.call").isNotNull(), F.last("m.name", ignorenulls=True).over(so_far)).otherwise(F.col("m.name"))
    first = F.first("_name", ignorenulls=True).over(Window.partitionBy("trajectory", "seq").orderBy("k").rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("_name", name).withColumn("_name", first).where("k = 0").withColumn("tool_name", F.coalesce("tool_name", "_name")).drop("k", "m", "_name")


def resolve_threads(records: DataFrame) -> DataFrame:
    """Records with the thread begun last as the parent of what follows; one begun without an id takes the parent away."""
    so_far = Window.partitionBy("trajectory").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("parent_id", F.coalesce("parent_id", F.when(F.col("follows"), F.last("opens", ignorenulls=True).over(so_far)["id"])))


def stands_alone(fmt: str) -> bool:
    """Whether each event of a format is told from its own line: no calls and no threads to resolve."""
    return not any(x.call or x.blocks or x.thread for x in (LAYOUTS.values() if fmt == AUTOMATIC else [LAYOUTS[fmt]]))


def parse_events(logs: DataFrame, fmt: str, version: int = 1, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, content) of whole logs -> events. Records are dealt by trajectory once, where the format has anything to resolve."""
    out, layouts = scan_logs(logs, fmt, version, path_col, content_col), list(LAYOUTS.values()) if fmt == AUTOMATIC else [LAYOUTS[fmt]]
    calls, threads = any(x.call or x.blocks for x in layouts), any(x.thread for x in layouts)
    if calls or threads:
        out = out.repartition("trajectory")
    if calls:
        out = resolve_calls(out)
    if threads:
        out = resolve_threads(out)
    return out.select(*[c.split()[0] for c in EVENT_DDL.split(", ")])


def generic_envelope(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """The generic envelope by built-in JSON functions, for lines without duplicate keys: the fast path that stays in the JVM."""
    pick = lambda *keys: F.coalesce(*[F.get_json_object(line_col, f"$.{k}") for k in keys])
    return lines.withColumns({
        "type": F.coalesce(pick("type", "event", "kind", "event_type"), F.lit("_untyped")),
        "id": pick("id", "uuid", "event_id"),
        "parent_id": pick("parentId", "parent_id", "parentUuid", "parent"),
        "actor": pick("role", "actor", "author"),
        "tool_name": pick("tool_name", "toolName", "tool"),
        "exit_code": pick("exit_code", "exitCode", "returncode", "status_code").try_cast("int"),
    })
