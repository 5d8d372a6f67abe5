"""URL filtering: pattern rules indexed by their rarest literal token.

A rule is a site rule (host and path prefix) or a pattern (``*`` any text, ``^`` a separator or the end, ``|`` an end of the
url). A rule's literal tokens are its runs of letters and digits that a url must hold as whole tokens. Each rule is
filed under the one of these that the fewest urls of the table hold; a rule without any is fetched for every url.
The index is an array of hash buckets, sized by the rules, that goes to the workers with the plan, as any constant does
(about 150 bytes a rule). A token finds its candidates in constant time, and only candidates run their regular
expressions. No join, no shuffle of urls: a hot host is no matter. What is counted for the index, the urls of each token
of a rule, is one partial aggregate over a table of as many rows as the rules have tokens.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``text``: ``host/path`` of a site rule, or a pattern."""

    text: str
    verdict: str
    site: bool = True


SITE_RULES = (Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block"))
#: What the method itself says where no site rule fits: block if one of these matches, else allow.
PATTERNS = tuple(Rule(x, "block", False) for x in ("^wp-login.php^", "^cgi-bin^", "^login^", "^logout^", "^signup^", "^cart^", "^checkout^", "^phpsessid=", "^sessionid=", "*.exe|", "*.zip|", "*.iso|", "*.apk|", "|javascript:", "|mailto:"))

TOKEN = "[a-z0-9]+"
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


def regex_of(rule: Rule) -> str:
    """Java regular expression: of a site rule over host and path, of a pattern over the url in lower case."""
    quote = lambda s: re.sub(r"([^\w])", lambda m: "\\" + m[1] if ord(m[1]) < 128 else m[1], s)
    if rule.site:
        host, _, path = rule.text.partition("/")
        return f"^(?:[^/]*\\.)?{quote(host)}/{quote(path)}"
    text = rule.text.lower()
    out = "".join({"*": "(?s:.*)", "^": _SEPARATOR}.get(c) or ("^" if c == "|" and k == 0 else r"\z" if c == "|" and k == len(text) - 1 else quote(c)) for k, c in enumerate(text))
    return out


def tokens_of(rule: Rule) -> list[str]:
    """Runs that stand between two literal non-token characters or ends, and so are whole tokens of a matching url."""
    text = rule.text.lower()
    out = []
    for m in re.finditer(TOKEN, text):
        before = text[m.start() - 1] if m.start() else ("." if rule.site else "*")
        after = text[m.end()] if m.end() < len(text) else "*"
        if before != "*" and after != "*":
            out.append(m[0])
    return sorted(set(out))


def _file(rules: list[Rule], count: dict[str, int]) -> list[list[dict]]:
    """Buckets by crc32 of the token; bucket 0 beyond the rest holds rules without token."""
    size = 1
    while size < 2 * len(rules):
        size *= 2
    out: list[list[dict]] = [[] for _ in range(size + 1)]
    for r in rules:
        token = min(tokens_of(r), key=lambda t: (count.get(t, 0), -len(t), t), default="")
        out[zlib.crc32(token.encode()) % size + 1 if token else 0].append({"token": token, "regex": regex_of(r), "rule": r.text, "verdict": r.verdict, "site": r.site, "size": len(r.text)})
    return out


def parts(url):
    """(host, path) columns: the host after the first ``://`` up to ``/ ? #``, A-Z lowered; the path from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, site_rules=SITE_RULES, patterns=PATTERNS, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``.

    rule: the longest site rule that fits (of equally long ones the least text), else null. verdict: that rule's; else
    that of the longest matching pattern, else ``default``. A null url, or one without ``://``, has an empty host and
    path. Null and repeated ids pass through; an empty table gives no rows; other columns are not read.
    """
    rules = [*site_rules, *patterns]
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col), url.alias("_url"))
    host, path = parts(F.col("_url"))
    base = base.select(id_col, "_url", host.alias("host"), path.alias("path"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("_url"), F.lit(f"({TOKEN})"), F.lit(1)))
    base = base.withColumn("_tokens", found)
    wanted = sorted({t for r in rules for t in tokens_of(r)})
    count: dict[str, int] = {}
    if wanted:  # in how many urls each token of a rule is: at most as many rows as the rules have tokens
        own = pages.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(wanted)), "array<string>")).alias("t"))
        held = base.select(F.explode("_tokens").alias("t")).join(F.broadcast(own), "t", "left_semi")
        count = {r.t: r.n for r in held.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = _file(rules, count)
    kind = "struct<token:string,regex:string,rule:string,verdict:string,site:boolean,size:int>"
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{kind}>>")
    size = len(buckets) - 1
    fetch = lambda t: F.filter(F.element_at(index, (F.pmod(F.crc32(t.cast("binary")), F.lit(size)) + 2).cast("int")), lambda r: r["token"] == t)
    candidates = F.concat(F.flatten(F.transform("_tokens", fetch)), F.element_at(index, 1))
    site = F.concat("host", "path")
    low = F.lower("_url")
    hits = F.filter(candidates, lambda r: F.when(r["site"], F.rlike(site, r["regex"])).otherwise(F.rlike(low, r["regex"])))
    best = lambda which: F.array_min(F.transform(F.filter("_hits", which), lambda r: F.struct((-r["size"]).alias("s"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    out = base.withColumn("_hits", hits).withColumn("_site", best(lambda r: r["site"])).withColumn("_pattern", best(lambda r: ~r["site"]))
    return out.select(id_col, "host", "path", F.col("_site.rule").alias("rule"), F.coalesce("_site.verdict", "_pattern.verdict", F.lit(default)).alias("verdict"))


def oracle(site_rules=SITE_RULES, patterns=PATTERNS, default: str = "allow") -> str:
    """DuckDB SQL for ``judge`` over ``pages``."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    fits = []
    for r in site_rules:
        host, _, path = r.text.partition("/")
        fits.append(f"CASE WHEN (host = {text(host)} OR ends_with(host, {text('.' + host)})) AND starts_with(path, {text('/' + path)}) THEN {{'s': {-len(r.text)}, 'rule': {text(r.text)}, 'verdict': {text(r.verdict)}}} END")
    other = " ".join(f"WHEN regexp_matches(lower(u), {text(regex_of(r))}) THEN {text(r.verdict)}" for r in sorted(patterns, key=lambda r: (-len(r.text), r.text)))
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM a),
c AS (SELECT *, list_min(list_filter([{", ".join(fits)}], lambda x: x IS NOT NULL)) AS r FROM b)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE {other} ELSE {text(default)} END) AS verdict FROM c
"""
