"""Command line: ``python -m runstrata -S STORE VERB ...``. Exit 0; 1 for a failed verify, unreadable sources or no grep hit; 2 for errors.

STORE is the folder of a store, or the id of one below ``store_root`` of the nearest ``runstrata.toml`` (keys
``store_root``, ``adapter``, ``rules``, the latter two for ``create``).
"""

from __future__ import annotations

import argparse
import json
import os
import shlex
import subprocess
import sys
import tempfile
import tomllib
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .operators import maintenance, namespace
from .plans import sql as S
from .sources import manifest
from .store import Store

CONFIG = "runstrata.toml"


def config(start: str = ".") -> dict:
    """The nearest configuration file at or above a folder; its ``store_root`` is relative to it. Without one, nothing."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, CONFIG)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                found = tomllib.load(f)
            return found | {"store_root": os.path.join(folder, found.get("store_root", "stores"))}
        if folder == os.path.dirname(folder):
            return {}
        folder = os.path.dirname(folder)


def resolve_store(arg: str, found: dict) -> str:
    """The folder of a store given by path or by id."""
    tried = [arg] + ([os.path.join(found["store_root"], P.store_id(arg))] if "store_root" in found else [])
    for path in tried:
        if os.path.isfile(os.path.join(path, manifest.NAME)):
            return path
    raise FileNotFoundError(f"{arg}: neither a store nor the id of one below store_root")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runstrata")
    p.add_argument("-S", "--store", action="append", default=[], help="a store; several for sql")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, /, *args: str, **options):
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        for k, kind in options.items():
            flag = ("-" if len(k) == 1 else "--") + k.replace("_", "-")
            v.add_argument(flag, dest=k, **({"action": "store_true"} if kind is bool else {"action": "append", "default": []} if kind is list else {"type": kind}))
        return v

    v = verb("create", id=str, adapter=str, rules=str)
    v = verb("pack", "source", label=str)
    for name, options in {
        "ls": {"l": bool, "R": bool}, "tree": {"depth": int, "d": bool}, "du": {"depth": int},
        "find": {"name": str, "path_glob": str, "kind": str, "size": str, "attr": list},
    }.items():
        v = verb(name, **options)
        v.add_argument("path", nargs="?", default="")
    verb("stat", "path")
    verbs.add_parser("cat").add_argument("paths", nargs="+")
    verb("grep", e=list, path=str, name=str, i=bool, l=bool, c=bool, a=bool)
    v = verb("extract", "target", path=str, mtime=bool, link=bool)
    verb("edit", "path", editor=str)
    v = verb("sql", "query", csv=bool, show_views=bool)
    verb("verify", deep=bool, storage=bool, require_compact=bool)
    verb("derive")
    verb("delete", "path", plan=bool)
    verb("compact")
    return p


def listing(df, out) -> int:
    n = 0
    for r in df.toLocalIterator():
        print(*["" if v is None else v for v in r], sep="\t", file=out)
        n += 1
    return n


def run(argv: Sequence[str], spark: SparkSession, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if not a.store or len(a.store) > 1 and a.verb != "sql":
        raise ValueError("one store is asked for (-S)")
    found = config()
    if a.verb == "create":
        Store.create(spark, a.store[0], a.id or P.store_id(a.store[0].strip("/")), a.adapter or found.get("adapter", "none"), a.rules or found.get("rules", "none"))
        return 0
    stores = [Store(spark, resolve_store(s, found)) for s in a.store]
    try:
        return answer(a, spark, stores, out)
    finally:
        for s in stores:
            s.close()


def show_files(s: Store, directory: str, long: bool, full: bool, out) -> int:
    """Files right in a directory (or the file itself), as ``ls`` shows them."""
    rows = s.visible_under(directory)
    rows = rows.where(F.col("path") == directory) if full else rows.where(F.col("dir") == directory)
    name = F.col("path" if full else "name")
    attrs = P.attrs_text(F.col("attrs"))
    text = F.concat(P.mode_text(F.col("kind"), F.col("mode")), F.lit("  "), F.lpad(P.human(F.col("size")), 10, " "), F.lit("  "), name, F.when(attrs != "", F.concat(F.lit("  ["), attrs, F.lit("]"))).otherwise(""))
    return listing(rows.orderBy("path").select(text if long else name), out)


def show_directory(s: Store, directory: str, long: bool, out) -> int:
    dirs = s.children(directory).where("is_dir").orderBy("path")
    text = F.concat(F.lit("d---------  "), F.lpad(P.human(F.col("size")), 10, " "), F.lit("  "), F.lpad(F.col("n_files").cast("string"), 6, " "), F.lit(" files  "), "name", F.lit("/"))
    n = listing(dirs.select(text if long else F.concat("name", F.lit("/"))), out)
    return n + show_files(s, directory, long, False, out)


def edited(text: str, editor: str) -> str:
    """A text after an editor had a copy of it."""
    with tempfile.NamedTemporaryFile("w+", suffix=".txt", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        subprocess.run([*shlex.split(editor), f.name], check=True)
        with open(f.name, encoding="utf-8", errors="replace") as g:
            return g.read()


def answer(a: argparse.Namespace, spark: SparkSession, stores: list[Store], out) -> int:
    s = stores[0]
    if a.verb == "pack":
        b = s.pack(a.source, a.label)
        print(json.dumps({"batch": b.id, "paths": b.paths, "bytes": b.bytes, "new_blobs": b.new_blobs, "new_blob_bytes": b.new_blob_bytes, "excluded": b.excluded, "errors": b.errors}), file=out)
        return 1 if b.errors else 0
    if a.verb in ("ls", "tree", "du", "find"):
        directory = P.normalise(a.path)
        if a.verb == "ls":
            is_dir = not directory or bool(s.dir_info(directory).take(1))
            if not is_dir:
                if not show_files(s, directory, a.l, True, out):
                    raise FileNotFoundError(directory)
            elif a.R:
                below = namespace.rollup(s.visible_under(directory).where(P.subtree(F.col("path"), directory))).where(P.is_under(F.col("dir"), directory))
                for row in below.select("dir").orderBy("dir").toLocalIterator():
                    print(f"{row.dir or '.'}:", file=out)
                    show_directory(s, row.dir, a.l, out)
                    print(file=out)
            else:
                show_directory(s, directory, a.l, out)
        elif a.verb == "tree":
            listing(s.tree(directory, 3 if a.depth is None else a.depth, a.d).select("path", "n_files", P.human(F.col("size"))), out)
        elif a.verb == "du":
            if a.depth is not None:
                listing(namespace.du_depth(s.visible, directory, a.depth), out)
            listing(s.du(directory), out)
        else:
            tests = {"name": a.name, "path": a.path_glob, "kind": a.kind, "size": a.size, "attrs": dict(x.split("=", 1) for x in a.attr)}
            listing(s.find(directory, **tests).select("path").orderBy("path"), out)
        return 0
    if a.verb == "stat":
        rows = s.stat(a.path)
        rows = rows if rows.take(1) else s.dir_info(a.path)
        if not rows.take(1):
            raise FileNotFoundError(a.path)
        print(json.dumps({k: v.hex() if isinstance(v, (bytes, bytearray)) else str(v) if k == "mtime" else v for k, v in rows.first().asDict().items()}, ensure_ascii=False), file=out)
        return 0
    if a.verb == "cat":
        found = s.cat(*a.paths).collect()
        if len(found) < len({P.normalise(p) for p in a.paths}):
            raise FileNotFoundError("some paths are not in the store")
        for r in found:
            getattr(out, "buffer", sys.stdout.buffer).write(bytes(r.content))
        return 0
    if a.verb == "grep":
        directory = P.normalise(a.path or "")
        if directory and not s.dir_info(directory).take(1):
            raise FileNotFoundError(f"{directory}: no such directory")
        hits = s.grep(a.e, directory, name=a.name, ignore_case=a.i, binary=a.a)
        if a.l:
            n = listing(hits.select("path").distinct().orderBy("path"), out)
        elif a.c:
            n = listing(hits.groupBy("path").count().select(F.concat_ws(":", "path", "count")).orderBy(F.lit(1)), out)
        else:
            n = listing(hits.orderBy("path", "line_no").select(F.concat_ws(":", "path", "line_no", "line")), out)
        return 0 if n else 1
    if a.verb == "extract":
        print(s.extract(a.target, a.path or "", a.mtime, a.link), file=out)
        return 0
    if a.verb == "sql":
        if a.show_views:
            for name, df in S.views(spark, stores).items():
                print(name, ", ".join(f"{c} {t}" for c, t in df.dtypes), file=out)
            return 0
        df = S.sql(spark, stores, sys.stdin.read() if a.query == "-" else a.query)
        out.writelines(S.to_csv(df) if a.csv else S.to_table(df))
        return 0
    if a.verb == "edit":
        print(s.edit(a.path, lambda text: edited(text, a.editor or os.environ.get("EDITOR", "vi"))), end="", file=out)
        return 0
    if a.verb == "verify":
        bad = s.verify(a.deep, a.require_compact).limit(20).collect()
        report = s.verify_counts().first().asDict() | {"violations": [[r.check, r.subject] for r in bad]}
        if a.storage:
            report["storage"] = maintenance.storage_report(s.history, s.blobs).first().asDict() | s.totals()
        print(json.dumps(report), file=out)
        return 1 if bad else 0
    if a.verb == "delete" and a.plan:
        print(json.dumps(s.plan_delete(a.path)), file=out)
        return 0
    print(json.dumps({"derive": s.derive, "compact": s.compact, "delete": lambda: s.delete(a.path)}[a.verb]()), file=out)
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("runstrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(sys.argv[1:], spark)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
