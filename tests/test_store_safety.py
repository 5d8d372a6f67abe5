"""Writers beside writers, beside readers, and after a death; large files and wide trees; plans of the verbs."""

import fcntl
import hashlib
import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from runstrata.functions import paths as P
from runstrata.functions import stored
from runstrata.operators import content, maintenance
from runstrata.sources import walk
from runstrata.sources.manifest import Lease, Manifest, sweep
from runstrata.store import Store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plant(root, files):
    for path, data in files.items():
        out = os.path.join(root, path)
        os.makedirs(os.path.dirname(out), exist_ok=True)
        with open(out, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


def folders(root):
    return sorted(os.path.relpath(os.path.join(b, d), root) for top in ("catalog", "derived") for b, ds, _ in os.walk(os.path.join(root, top)) for d in ds)


def declared(root):
    return Manifest.load(root).every()


def sound(s):
    return s.verify(deep=True).count() == 0


def test_two_handles_write_in_turn(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "s")
    plant(src, {"d/a": "same", "d/b": "other"})
    one = Store.create(spark, root, "x")
    two = Store(spark, root)
    one.pack(src)
    plant(src, {"d/c": "same", "e/f": "new"})
    batch = two.pack(src)  # a handle opened before batch 1
    assert (batch.id, batch.paths, batch.new_blobs) == (2, 2, 1) and sound(two)
    assert one.manifest.batches[-1].id == 1 and one.refresh().history.count() == 4
    assert sorted(r.path for r in two.cat("d/a", "d/c").collect()) == ["d/a", "d/c"] and two.grep(["same"]).count() == 2
    plan = one.delete("e")  # a handle that has not seen batch 2
    assert plan["paths"] == 1 and [b.id for b in Manifest.load(root).batches] == [1, 2] and sound(one)
    assert [b.paths for b in one.manifest.batches] == [2, 1] and one.manifest.batches[1].new_blobs == 0
    two.compact()
    two.derive()
    assert sound(two) and sorted(r.path for r in two.refresh().visible.collect()) == ["d/a", "d/b", "d/c"]


def test_only_one_writes(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), "x")
    with open(tmp_path / "s/LOCK", "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        with pytest.raises(RuntimeError, match="in use"):
            s.pack(str(tmp_path))
    assert s.manifest.batches == []


def test_readers_keep_their_files(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "s")
    plant(src, {"a": "1", "b": "2", "c/d": "3"})
    writer = Store.create(spark, root, "x")
    writer.pack(src)
    with Store(spark, root) as reader:
        before, rows = declared(root), reader.visible
        writer.compact()
        writer.delete("a")
        assert rows.count() == 3 and len(reader.grep(["1"]).collect()) == 1  # of the snapshot it was opened with
        assert all(os.path.isdir(os.path.join(root, p)) for p in before)
    assert sweep(root, Manifest.load(root)) == []  # the writer's own handle still reads
    writer.pack(src)  # a later writer removes what nobody reads
    assert not any(os.path.isdir(os.path.join(root, p)) for p in before) and writer.find("a").count() == 0 and sound(writer)


def test_a_handle_follows(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "s")
    plant(src, {"a": "1"})
    writer = Store.create(spark, root, "x")
    reader = Store(spark, root)
    assert not reader.stale() and not reader.follow()
    writer.pack(src)
    assert reader.stale() and reader.history.count() == 0 and reader.follow() and reader.history.count() == 1 and not reader.stale()
    os.rename(os.path.join(root, "catalog"), os.path.join(root, "aside"))
    Manifest.load(root).publish(root)
    assert reader.stale() and not reader.follow() and len(reader.manifest.batches) == 1
    os.rename(os.path.join(root, "aside"), os.path.join(root, "catalog"))
    assert reader.follow()


def test_a_failed_rewrite_changes_nothing(spark, tmp_path, monkeypatch):
    src, root = str(tmp_path / "src"), str(tmp_path / "s")
    plant(src, {"a": "1", "b/c": "2"})
    s = Store.create(spark, root, "x")
    s.pack(src)
    before, listed = Manifest.load(root), folders(root)
    problem = spark.createDataFrame([("made up", "x")], "check string, subject string")
    monkeypatch.setattr(Store, "_verify", lambda self, *a, **k: problem)
    for verb in (lambda: s.delete("b"), s.compact):
        with pytest.raises(RuntimeError, match="not sound"):
            verb()
        assert Manifest.load(root) == before and folders(root) == listed
    monkeypatch.undo()
    assert s.find("b").count() == 1 and s.manifest.deleted == [] and sound(s)


def test_a_writer_that_dies(spark, tmp_path):
    """A process that ends where it would publish leaves the store as it was; the next writer removes what it left."""
    src, root = str(tmp_path / "src"), str(tmp_path / "s")
    plant(src, {"a": "1", "b/c": "2"})
    s = Store.create(spark, root, "x")
    s.pack(src)
    before = Manifest.load(root)
    for verb in ("pack(sys.argv[2])", "delete('b')"):
        code = f"""
            import os, sys
            from pyspark.sql import SparkSession
            from runstrata.sources.manifest import Manifest
            from runstrata.store import Store
            spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
            def die(self, root):
                open(os.path.join(root, "MANIFEST.json.x.tmp"), "w").close()
                os._exit(9)
            Manifest.publish = die
            Store(spark, sys.argv[1]).{verb}
        """
        done = subprocess.run([sys.executable, "-c", textwrap.dedent(code), root, src], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, timeout=240)
        assert done.returncode == 9, done.stderr[-2000:]
        assert Manifest.load(root) == before and os.path.exists(os.path.join(root, "MANIFEST.json.x.tmp"))
    assert sound(s.refresh())
    plant(src, {"n": "3"})
    s.pack(src)
    assert not os.path.exists(os.path.join(root, "MANIFEST.json.x.tmp")) and sound(s) and len(s.manifest.batches) == 2
    kept = declared(root)
    assert all(any(k == d or k.startswith(d + "/") or d.startswith(k + "/") for k in kept) for d in folders(root))


def test_leases_wait_for_nobody(tmp_path):
    a, b = Lease(str(tmp_path)), Lease(str(tmp_path))
    Manifest("x").publish(str(tmp_path))
    (tmp_path / "catalog/left/files").mkdir(parents=True)
    assert sweep(str(tmp_path), Manifest.load(str(tmp_path))) == []
    a.release()
    assert sweep(str(tmp_path), Manifest.load(str(tmp_path))) == []
    b.release()
    assert sweep(str(tmp_path), Manifest.load(str(tmp_path))) == ["catalog/left"]


def test_large_files_come_in_pieces(spark, tmp_path):
    src, root, out = str(tmp_path / "src"), str(tmp_path / "s"), str(tmp_path / "out")
    rng = random.Random(3)
    big = rng.randbytes(2 * walk.PIECE + 12345)
    log = b'{"type":"x","id":"%d"}\n' * 2 + b'{"type":"big","text":"' + b"y" * (walk.PIECE + 7) + b'"}\n'
    plant(src, {"big.bin": big, "copy/big.bin": big, "exact": big[: walk.PIECE], "just": big[: walk.PIECE + 1], "run/events.jsonl": log, "small": "s"})
    os.chmod(os.path.join(src, "copy/big.bin"), 0o755)
    s = Store.create(spark, root, "x", adapter="auto")
    batch = s.pack(src)
    assert (batch.paths, batch.new_blobs, batch.errors) == (6, 5, []) and sound(s)
    assert s.blobs.agg(F.max("size"), F.max("n_parts")).first()[:] == (1 << 20, 33)
    assert s.stat("big.bin").first().parts == 33 and s.stat("small").first().parts == 1
    assert [hashlib.sha256(bytes(r.content)).digest() for r in s.cat("copy/big.bin").collect()] == [hashlib.sha256(big).digest()]
    assert s.events.count() == 3
    again = s.pack(src)
    assert (again.paths, again.new_blobs) == (0, 0)
    assert s.extract(out, link=True) == 6
    for path in ("big.bin", "copy/big.bin", "exact", "just", "run/events.jsonl", "small"):
        with open(os.path.join(src, path), "rb") as f, open(os.path.join(out, path), "rb") as g:
            assert f.read() == g.read(), path
    assert os.stat(os.path.join(out, "copy/big.bin")).st_mode & 0o777 == 0o755 and not [f for _, _, fs in os.walk(out) for f in fs if f.startswith(".part-")]


def test_links_share_equal_files(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    plant(src, {"a": "same", "b/c": "same", "d": "same", "e": "else", "f": "", "g": ""})
    os.chmod(os.path.join(src, "d"), 0o755)
    s = Store.create(spark, str(tmp_path / "s"), "x")
    s.pack(src)
    assert s.extract(out, link=True) == 6 and s.extract(out, link=True) == 6
    node = lambda p: os.stat(os.path.join(out, p)).st_ino
    assert node("a") == node("b/c") and len({node(p) for p in "adefg"}) == 5
    damaged = s.blobs.withColumn("content", F.lit(b"bad"))
    with pytest.raises(Exception, match="damaged"):
        content.extract(s.visible, damaged, out)


def test_wide_trees_are_listed_by_tasks(spark, tmp_path):
    src = str(tmp_path / "src")
    plant(src, {f"d{k:03d}/s{j}/f": f"{k}" for k in range(walk.WIDE + 40) for j in range(2)} | {"skip/x/y": "1", "d000/skip/z": "1", "top": "t"})
    os.symlink("d000", os.path.join(src, "link"))
    prune = lambda rel: rel.split("/")[-1] == "skip"
    got = walk.directories(spark, src, prune, str(tmp_path / "levels")).collect()
    want = {os.path.relpath(os.path.join(b, d), src) for b, ds, _ in os.walk(src) for d in ds} - {"skip/x", "link"} | {""}
    assert sorted(r.dir for r in got) == sorted(want) and {r.dir for r in got if r.pruned} == {"skip", "d000/skip"}
    assert os.listdir(tmp_path / "levels")
    entries = walk.read_tree(spark, src, prune).collect()
    assert len(entries) == 2 * (walk.WIDE + 40) + 2 + 2 and sorted(r.path for r in entries if r.path.endswith("/.")) == ["d000/skip/.", "skip/."]


def below(plan, mark):
    """The lines of a plan that stand below each line with a mark."""
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if mark in line:
            yield [x for x in lines[i + 1 :][: next((k for k, y in enumerate(lines[i + 1 :]) if depth(y) <= depth(line)), None)]]


def test_contents_are_read_after_they_are_chosen(spark, tmp_path):
    src = str(tmp_path / "src")
    plant(src, {f"d{k}/f{j}": f"{k} {j}\n" for k in range(4) for j in range(5)})
    s = Store.create(spark, str(tmp_path / "s"), "x")
    s.pack(src)
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (s.grep(["1"], "d2"), content.lookup(s.history.select("sha"), [s.blobs]), content.with_content(s.find("d1"), s.blobs)):
        found = list(below(optimized(df), "LeftSemi"))
        assert found and not any("sha2(" in line or "raise_error" in line for part in found for line in part)
    scan = s.cat("d1/f1")._jdf.queryExecution().executedPlan().toString()
    assert "In(sha" in scan or "EqualTo(sha" in scan
    assert "GreaterThanOrEqual(path,d2/)" in s.find("d2")._jdf.queryExecution().executedPlan().toString()
    ls = s.children("d1")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in ls and "EqualTo(parent,d1)" in ls


def test_prefixes_below_the_shadowing(spark, tmp_path):
    """What is visible under a directory from the rows that matter there is what is visible of all."""
    rng, root = random.Random(5), str(tmp_path / "s")
    s = Store.create(spark, root, "x")
    names = ["a", "a/b", "a/b/c", "a/b/d", "a-b", "a/e", "f/g", "f"]
    for k in range(3):
        own = [p for p in rng.sample(names, 5)]
        own = [p for p in own if not any(q.startswith(p + "/") for q in own)]
        rows = [(p, 0, 0o644, 2, 0, f"{k}{i}".encode()) for i, p in enumerate(own)]
        s.append(spark.createDataFrame(rows, "path string, kind int, mode int, size long, mtime_ns long, content binary"))
    every = {r.path: r.batch for r in s.visible.collect()}
    for d in names:
        got = {r.path: r.batch for r in s.visible_under(d).where(P.is_under(F.col("path"), d)).collect()}
        assert got == {p: n for p, n in every.items() if p == d or p.startswith(d + "/")}, d
    assert {r.path: r.batch for r in s.points(*names, "none", "a").collect()} == every
    assert {r.path: r.batch for r in s.points(*names, *[f"no{k}" for k in range(20)]).collect()} == every
    assert [(r.path, r.batch) for d in names for r in s.stat(d).collect()] == [(d, every[d]) for d in names if d in every]
    assert [r.path for r in s.cat(*names).collect()] == [d for d in names if d in every]
    assert sound(s)


def test_checks_of_order_and_compaction(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), "x")
    plant(str(tmp_path / "src"), {"a": "1", "b": "2", "c": "1"})
    s.pack(str(tmp_path / "src"))
    bad = str(tmp_path / "bad")
    s.history.orderBy(F.desc("path")).coalesce(1).write.parquet(bad)
    kinds = lambda df: sorted({(r.check, r.subject) for r in df.collect()})
    assert kinds(maintenance.order_problems(spark.read.parquet(bad))) == [("order", "1:a"), ("order", "1:b")] and kinds(maintenance.order_problems(s.history)) == []
    assert s.verify(compacted=True).count() == 0
    loose = maintenance.loose_contents(s.history.where("path <> 'b'"), s.blobs.unionByName(s.blobs.limit(1)))
    assert sorted(r.check for r in loose.collect()) == ["stored-twice", "unreferenced"]
    assert s.verify_counts().first()[:] == (3, 2, 0) and s.totals()["batches"] == 1 and s.totals()["content_bytes"] > 0
    frames = spark.createDataFrame([(1, 8, 90, b"\x01", 0, 5), (1, 8, 90, b"\x00", 1, 7), (1, 98, 5, b"\x02", 0, 1)], "pack int, offset long, length long, sha binary, part int, size long")
    got = {(r.offset): (r.members, r.bytes, [(c.sha, c.part) for c in r.contents]) for r in maintenance.frame_members(frames).collect()}
    assert got == {8: (2, 12, [("00", 1), ("01", 0)]), 98: (1, 1, [("02", 0)])}


def test_odd_names_and_a_configuration(spark, tmp_path, monkeypatch):
    from runstrata.__main__ import config, resolve_store

    top = tmp_path / "work"
    plant(str(top), {"runstrata.toml": 'store_root = "kept"\nadapter = "auto"\n', "deep/er/x": "1"})
    s = Store.create(spark, str(tmp_path / "s {a,b} [c]* ?"), "x")
    s.pack(str(top / "deep"))
    assert s.history.count() == 1 and s.cat("er/x").count() == 1 and sound(s)
    os.makedirs(top / "kept")
    Store.create(spark, str(top / "kept" / P.store_id("lab/run 1")), "y").close()
    found = config(str(top / "deep" / "er"))
    assert found["adapter"] == "auto" and resolve_store("lab/run 1", found) == str(top / "kept" / "lab%2Frun%201")
    assert resolve_store(s.root, {}) == s.root and config("/") == {}
    with pytest.raises(FileNotFoundError):
        resolve_store("lab/none", found)


def test_segments_are_bounded(spark, tmp_path, monkeypatch):
    import runstrata.store as module

    monkeypatch.setattr(module, "SEGMENT_BYTES", 40_000)
    rng = random.Random(1)
    s = Store.create(spark, str(tmp_path / "s"), "x")
    rows = [(f"f{k:04d}", 0, 0o644, 3000, 0, rng.randbytes(3000)) for k in range(100)]
    s.append(spark.createDataFrame(rows, "path string, kind int, mode int, size long, mtime_ns long, content binary"))
    sizes = [os.path.getsize(os.path.join(b, f)) for b, _, fs in os.walk(s.root) for f in fs if f.endswith(".parquet")]
    assert max(sizes) <= 40_000 and len(sizes) > 8 and sound(s)
    with pytest.raises(ValueError, match="takes more than"):
        s.append(spark.createDataFrame([("huge", 0, 0o644, 60000, 0, rng.randbytes(60000))], "path string, kind int, mode int, size long, mtime_ns long, content binary"))
    assert len(s.manifest.batches) == 1


def test_functions_by_hash(tmp_path):
    assert stored.parse("ab" * 32) == b"\xab" * 32 and stored.parse(f" {'AB' * 32}\n") == b"\xab" * 32 and stored.parse(b"x" * 32) == b"x" * 32
    assert [stored.parse(x) for x in (None, "", "zz" * 32, "ab", b"x", 5)] == [None] * 6
    assert stored.contents([[]], {stored.EMPTY, b"y" * 32}) == {stored.EMPTY: b""}
