"""Exact handling of JSON lines: what a line is, what a value is, and times."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from json.decoder import scanstring

I64 = 1 << 63
DEEPEST = 127


class _Invalid(ValueError):
    pass


def _integer(text: str):
    """Integers beyond 64 bits, and -0, are floating-point numbers."""
    n = int(text) if len(text) < 40 else None
    if n is None or not -I64 <= n < 2 * I64 or (n == 0 and text[0] == "-"):
        return _real(text)
    return n


def _real(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise _Invalid("number out of range")
    return x


def _constant(text: str):
    raise _Invalid(text)


_DECODER = json.JSONDecoder(parse_int=_integer, parse_float=_real, parse_constant=_constant)
_SURROGATE = re.compile("[\ud800-\udfff]")


def _check(value, level: int = 0) -> None:
    if isinstance(value, str):
        if _SURROGATE.search(value):
            raise _Invalid("half a surrogate pair")
    elif isinstance(value, (dict, list)):
        if level >= DEEPEST:
            raise _Invalid("nested too deeply")
        for x in value if isinstance(value, list) else [*value, *value.values()]:
            _check(x, level + 1)


def parse(line: bytes):
    """(True, value), or (False, None) for what is not one JSON value in UTF-8. The last of equal keys holds."""
    try:
        text = line.decode()
        value = _DECODER.decode(text)
        if "\\u" in text or text.count("[") + text.count("{") > DEEPEST:
            _check(value)
        return True, value
    except (ValueError, RecursionError):
        return False, None


def lines(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each physical line. A carriage return before the line feed goes; blank lines count but are not given."""
    parts = content.split(b"\n")
    last = len(parts) - 1  # what follows the last line feed: not ended by one
    for i, line in enumerate(parts):
        if i < last and line.endswith(b"\r"):
            line = line[:-1]
        if line.strip(b" \t\r"):
            yield i, line


def at(value, path: str):
    """The value at a dotted path of members; None where there is none."""
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def text_at(value, paths) -> str | None:
    """The first value among the paths that is a string."""
    return next((x for x in (at(value, p) for p in paths) if isinstance(x, str)), None)


def int32_at(value, paths) -> int | None:
    """The first value among the paths that is an integer of 32 bits."""
    return next((x for x in (at(value, p) for p in paths) if type(x) is int and -(1 << 31) <= x < 1 << 31), None)


def time_at(value, paths) -> int | None:
    """Microseconds of the first value among the paths that is a time."""
    return next((t for t in (micros(at(value, p)) for p in paths) if t is not None), None)


_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:([Zz])|([+-])(\d\d):(\d\d))", re.ASCII)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(value) -> int | None:
    """Microseconds since 1970 of an RFC 3339 text with an offset, or of a number: seconds below 10**12, else milliseconds. What does not fit 64 bits is None."""
    if isinstance(value, str):
        m = _RFC3339.fullmatch(value)
        if not m:
            return None
        year, month, day, hour, minute, second = map(int, m.group(1, 2, 3, 4, 5, 6))
        fraction = int(((m[7] or "") + "000000")[:6])
        if second == 60:
            second, fraction = 59, fraction + 1_000_000
        offset = timedelta(0) if m[8] else timedelta(hours=int(m[10]), minutes=int(m[11])) * (-1 if m[9] == "-" else 1)
        if abs(offset) >= timedelta(hours=24) or (m[11] and int(m[11]) > 59):
            return None
        try:
            at = datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc)
        except ValueError:
            return None
        return (at - _EPOCH - offset) // timedelta(microseconds=1) + fraction
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if isinstance(value, int) and -I64 <= value < I64:
        out = value * (1_000 if abs(value) >= 10**12 else 1_000_000)
        return out if -I64 <= out < I64 else None
    x = float(value)
    out = x * 1e3 if abs(x) >= 1e12 else x * 1e6
    return int(out) if -float(I64) <= out < float(I64) else None


def verbatim(text: str, key: str) -> str | None:
    """The last top-level value of ``key`` in the text of a JSON object, character for character."""
    blank = re.compile(r"[ \t\n\r]*")
    at = blank.match(text).end()
    if text[at : at + 1] != "{":
        return None
    at = blank.match(text, at + 1).end()
    found = None
    while text[at] != "}":
        name, at = scanstring(text, at + 1, True)
        at = blank.match(text, at).end() + 1
        start = blank.match(text, at).end()
        _, at = _DECODER.raw_decode(text, start)
        if name == key:
            found = text[start:at]
        at = blank.match(text, at).end()
        if text[at] == ",":
            at = blank.match(text, at + 1).end()
    return found


def as_payload(line: bytes) -> str:
    """A line that is no JSON, kept without loss: as a JSON string, or as its bytes if it is not UTF-8."""
    try:
        return json.dumps(line.decode(), ensure_ascii=False)
    except UnicodeDecodeError:
        return '{"bytes":[' + ",".join(map(str, line)) + "]}"
