"""Column expressions and plain functions over ``/``-separated paths."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_replace(path, r"(?s)(^|/)[^/]*\z", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(directory: Column) -> Column:
    """0 for the root, else the number of components."""
    return F.when(directory == "", 0).otherwise(F.size(F.split(directory, "/")))


def ancestors(path: Column) -> Column:
    """All proper prefixes, the root (empty) first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array(F.lit("")))


def self_and_ancestors(directory: Column) -> Column:
    """A directory and all above it; the root only once."""
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(ancestors(directory), F.array(directory)))


def is_under(path: Column, directory: str) -> Column:
    """The directory itself or anything below it; the empty directory holds all."""
    if directory == "":
        return F.lit(True)
    return (path == directory) | path.startswith(directory + "/")


def subtree(path: Column, directory: str) -> Column:
    """Strictly below a directory, as a byte range that reaches the scan: ``0`` follows ``/``."""
    if directory == "":
        return F.lit(True)
    return (path >= directory + "/") & (path < directory + "0")


def extension(name: Column) -> Column:
    """What follows the last dot, unless that dot comes first."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1)


def valid(path: Column) -> Column:
    """Neither empty nor with NUL, nor with an empty, ``.`` or ``..`` component."""
    return (path != "") & ~F.contains(path, F.lit("\0")) & ~path.rlike(r"(^|/)\.{0,2}(/|\z)")


def glob_regex(glob: str) -> str:
    """A whole-string Java regular expression. ``*`` and ``?`` cross slashes, ``**/`` is any number of directories, ``/**`` anything below; classes and alternatives as usual."""
    out, i, braces = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/"):
            end = i + 2
            if end == len(glob):
                out.append(".*" if i == 0 else ".+")
                i = end
                continue
            if glob[end] == "/":
                out.append("(?:.*/)?")
                i = end + 1
                continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "^") else i + 2)
            if j < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : j]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = j
        elif c == "{":
            braces += 1
            out.append("(?:")
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
        elif c == "," and braces:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if braces:
        raise ValueError(f"unclosed alternative in glob {glob!r}")
    return "(?s)^" + "".join(out) + r"\z"


def matches(text: Column, globs: list[str]) -> Column:
    """Whether any of the globs matches the whole text."""
    if not globs:
        return F.lit(False)
    return reduce(or_, [text.rlike(glob_regex(g)) for g in globs])


def normalise(path: str) -> str:
    """A path as typed: leading ``./`` and outer slashes go, ``.`` is the root."""
    while path.startswith("./"):
        path = path[2:]
    path = path.strip("/")
    return "" if path == "." else path


def store_id(relative: str) -> str:
    """Bytes beyond letters, digits and ``._-`` are percent-encoded."""
    return "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "._-") else f"%{b:02X}" for b in relative.encode())


def human(size: Column) -> Column:
    """Bytes with a unit to the base 1024: B, KB and MB with one decimal, GB with two; ties go to the even digit.

    Whole numbers throughout: digits are counted in tenths (hundredths) of the unit, so no rounding is done twice.
    """
    size = size.cast("long")

    def digits(shift: int, scale: int) -> Column:
        unit, rest = F.lit(1 << shift), F.pmod(size, F.lit(1 << shift)) * scale  # below 2**30 * 100
        low, over = F.shiftrightunsigned(size, shift) * scale + F.floor(rest / unit).cast("long"), F.pmod(rest, unit) * 2
        return low + F.when((over > unit) | ((over == unit) & (F.pmod(low, F.lit(2)) == 1)), 1).otherwise(0)

    def shown(shift: int, decimals: int, name: str) -> Column:
        n, scale = digits(shift, 10**decimals), F.lit(10**decimals)
        return F.concat((F.floor(n / scale)).cast("string"), F.lit("."), F.lpad(F.pmod(n, scale).cast("string"), decimals, "0"), F.lit(f" {name}"))

    small = F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, shown(10, 1, "KB"))
    return small.when(size < 1 << 30, shown(20, 1, "MB")).otherwise(shown(30, 2, "GB"))


def mode_text(kind: Column, mode: Column) -> Column:
    """``-rwxr-xr-x``; a link begins with ``l``."""
    bit = lambda n, c: F.when(mode.bitwiseAND(F.lit(1 << n)) != 0, c).otherwise("-")
    return F.concat(F.when(kind == 1, "l").otherwise("-"), *[bit(8 - k, "rwx"[k % 3]) for k in range(9)])


def time_text(ns: Column) -> Column:
    """Nanoseconds since 1970 in UTC as RFC 3339, with three, six or nine digits of a second where any are needed."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    seconds = ((ns - rest).cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("long")
    day = F.pmod(seconds, F.lit(86400))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), ((seconds - day) / 86400).cast("int")), "yyyy-MM-dd")
    clock = F.format_string("T%02d:%02d:%02d", F.floor(day / 3600).cast("int"), F.floor(F.pmod(day, F.lit(3600)) / 60).cast("int"), F.pmod(day, F.lit(60)).cast("int"))
    digits = F.lpad(rest.cast("string"), 9, "0")
    shown = F.when(rest == 0, "").when(F.pmod(rest, F.lit(1_000_000)) == 0, F.substring(digits, 1, 3)).when(F.pmod(rest, F.lit(1000)) == 0, F.substring(digits, 1, 6)).otherwise(digits)
    return F.concat(date, clock, F.when(shown != "", F.concat(F.lit("."), shown)).otherwise(""), F.lit("+00:00"))


def literal_path(path: str) -> str:
    """A path that a reader takes as it is: characters of file patterns are escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def attrs_text(attrs: Column) -> Column:
    """``k=v`` by key, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


_SIZE = re.compile(r"(\d+(?:\.\d+)?)\s*([KMGT]?)B?", re.IGNORECASE)


def size_literal(text: str, whole: int | None = None) -> int:
    """``1.5G``, ``800M``, ``4096``; ``20%`` of ``whole``."""
    text = text.strip()
    if text.endswith("%"):
        if whole is None:
            raise ValueError("a share needs a whole")
        return int(float(text[:-1]) / 100 * whole)
    m = _SIZE.fullmatch(text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " KMGT".index(m[2].upper() or " "))
