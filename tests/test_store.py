import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from runstrata.operators import content, ingest, maintenance
from runstrata.plans.sql import sql, to_csv, to_table
from runstrata.sources.manifest import Manifest, locked, vacuum
from runstrata.store import Store
from runstrata.streaming import watch

LOG = '{"type":"tool.start","data":{"toolCallId":"c","toolName":"sh"}}\nnot json\n{"type":"tool.end","data":{"toolCallId":"c","exitCode":1}}\n'


def plant(root, files):
    for path, data in files.items():
        out = os.path.join(root, path)
        os.makedirs(os.path.dirname(out), exist_ok=True)
        with open(out, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


TREE = {
    "rounds/round-001/builder/out.stdout": "ok\nTraceback x\n", "rounds/round-001/builder/copy.stdout": "ok\nTraceback x\n", "rounds/round-001/empty": "", "rounds/round-001/events.jsonl": LOG,
    "rounds/round-002/ü file.json": '{"a":1}', "rounds/round-002/big.bin": bytes(range(256)) * 8200, "node_modules/x/y.js": "1", "a.pyc": "z",
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    src = base / "src"
    plant(src, TREE)
    os.symlink("out.stdout", src / "rounds/round-001/builder/link")
    os.chmod(src / "rounds/round-002/ü file.json", 0o755)
    s = Store.create(spark, str(base / "s"), "one", adapter="copilot-cli", rules="no-build-products")
    s.pack(str(src), "first")
    return s, src


def test_pack_and_verbs(store):
    s, _ = store
    b = s.manifest.batches[0]
    assert (b.paths, b.excluded, b.new_blobs) == (7, 2, 5)
    assert s.verify(deep=True).count() == 0
    assert sorted(map(tuple, s.table("excluded").select("path", "size", "rule").collect())) == [("a.pyc", 1, "exclude_ext"), ("node_modules", 0, "exclude_dirs")]
    assert [(r.is_dir, r.name) for r in s.children("rounds/round-001").collect()] == [(True, "builder"), (False, "empty"), (False, "events.jsonl")]
    d = s.du("rounds").first()
    assert (d.files, d.blobs) == (7, 5)
    assert s.find(name="*.stdout").count() == 2 and s.find(kind="l").count() == 1 and s.find(kind="e").count() == 1 and s.find(size="+1M").count() == 1
    assert s.stat("rounds/round-002/ü file.json").first().mode_text == "-rwxr-xr-x"
    assert s.blobs.where("n_parts > 1").count() == 3
    assert bytes(s.cat("rounds/round-002/big.bin").first().content) == TREE["rounds/round-002/big.bin"]
    assert sorted((r.path, r.line_no) for r in s.grep(["^Traceback"]).collect()) == [("rounds/round-001/builder/copy.stdout", 2), ("rounds/round-001/builder/out.stdout", 2)]
    assert [(r.seq, r.type, r.tool_name) for r in s.events.orderBy("seq").collect()] == [(0, "tool.start", "sh"), (1, "_unparsed", None), (2, "tool.end", "sh")]


def test_extract(store, tmp_path):
    s, src = store
    assert s.extract(str(tmp_path / "out"), mtime=True) == 7
    for path, data in TREE.items():
        if "node_modules" not in path and not path.endswith(".pyc"):
            assert (tmp_path / "out" / path).read_bytes() == (data if isinstance(data, bytes) else data.encode())
    assert os.readlink(tmp_path / "out/rounds/round-001/builder/link") == "out.stdout"
    assert os.stat(tmp_path / "out/rounds/round-002/ü file.json").st_mode & 0o777 == 0o755


def test_sql_over_stores(spark, store):
    s, _ = store
    got = sql(spark, [s], "SELECT f.store, c.text FROM files f JOIN contents c ON c.sha = f.sha WHERE f.name = 'ü file.json'").first()
    assert tuple(got) == ("one", '{"a":1}')
    csv = lambda q, stores: "".join(to_csv(sql(spark, stores, q)))
    assert csv("SELECT count(*) AS n, 'a,b' AS t, cast(NULL AS int) AS z FROM files", [s, s]) == 'n,t,z\n14,"a,b",\n'
    assert csv("SELECT path FROM files WHERE false", [s]) == "path\n" and csv("SELECT cast(NULL AS int) AS z", [s]) == "z\n\n"
    assert csv("-- a remark\n/* and */ (SELECT 1 AS `a b`)", [s]) == "a b\n1\n"
    assert "".join(to_table(sql(spark, [s], "SELECT 1 AS one, 'x' AS b"))) == "+-----+---+\n| one | b |\n+-----+---+\n| 1   | x |\n+-----+---+\n"
    assert "".join(to_table(sql(spark, [s], "SELECT 1 AS a WHERE false"))) == "(no rows)\n"
    for bad in ("DROP TABLE files", "", "  -- nothing", "(", "/* open"):
        with pytest.raises(ValueError):
            sql(spark, [s], bad)


def test_contents_in_sql(spark, store, tmp_path):
    s, _ = store
    plant(tmp_path / "src", {"only": "in two", "same": '{"a":1}'})
    two = Store.create(spark, str(tmp_path / "two"), "two")
    two.pack(str(tmp_path / "src"))
    rows = sql(spark, [s, two], "SELECT store, name, text(sha) AS t, octet_length(blob(sha)) AS n, text(lower(hex(sha))) = text(sha) AS same FROM files WHERE name LIKE '%.json' OR name IN ('only', 'empty', 'same', 'big.bin')").collect()
    got = {(r.store, r.name): (r.t if r.n and r.n < 100 else None, r.n, r.same) for r in rows}
    assert got == {("one", "ü file.json"): ('{"a":1}', 7, True), ("one", "big.bin"): (None, 256 * 8200, True), ("one", "empty"): (None, 0, True), ("two", "only"): ("in two", 6, True), ("two", "same"): ('{"a":1}', 7, True)}
    odd = sql(spark, [s], f"SELECT text(NULL) AS a, text('{'0' * 64}') AS b, blob('xyz') AS c, text(unhex('00')) AS d, text(' {content.EMPTY_SHA} ') AS e").first()
    assert tuple(odd) == (None, None, None, None, "")
    assert sql(spark, [s, two], "SELECT count(*) AS n FROM files f JOIN contents c USING (sha) WHERE c.text LIKE '%Trace%'").first().n == 2


def test_life_of_a_store(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "s")
    plant(src, {"a/x.txt": "one", "a/y.txt": "two", "b/z.txt": "one", "l/events.jsonl": '{"type":"session.x","data":1}\n'})
    s = Store.create(spark, root, "st", adapter="auto")
    s.pack(src)
    again = s.pack(src)
    assert (again.paths, again.new_blobs) == (0, 0)
    plant(src, {"a/x.txt": "three", "l/events.jsonl": '{"type":"session.x","data":1}\n{"type":"session.y","data":2}\n'})
    third = s.pack(src)
    assert (third.paths, third.new_blobs) == (2, 2)
    assert s.history.count() == 6 and s.visible.count() == 4
    assert s.events.count() == 3
    s.derive()
    assert s.events.count() == 2
    old = Store(spark, root)
    plan = s.delete("a")
    assert (plan["paths"], plan["blobs"], plan["latest_paths"]) == (3, 2, 2)
    assert s.find("a").count() == 0 and s.verify(deep=True).count() == 0
    assert old.manifest.batches[0].paths == 4
    after = s.pack(src)
    assert after.paths == 0 and {r.rule for r in s.table("excluded").collect()} == {"deleted"}
    report = s.compact()
    assert report["after"]["unreferenced"] == 0 and s.verify(deep=True).count() == 0
    with pytest.raises(FileNotFoundError):
        s.delete("nothing")


def test_violations_are_reported(spark, store):
    s, _ = store
    f, b, d = s.history, s.blobs, s.table("dirs")
    kinds = lambda df: {r.check for r in df.collect()}
    assert kinds(maintenance.file_problems(f.withColumn("mode", F.lit(0o4644)))) == {"mode"}
    assert kinds(maintenance.file_problems(f.withColumn("dir", F.lit("q")).withColumn("kind", F.lit(9).cast("short")))) == {"dir", "kind"}
    assert kinds(maintenance.file_problems(f.withColumn("path", F.concat(F.lit("/"), "path")))) >= {"path"}
    assert kinds(maintenance.file_problems(f.withColumn("attrs", F.lit(None).cast("map<string,string>")))) == {"null"}
    assert kinds(maintenance.duplicate_paths(f.unionByName(f))) == {"duplicate"}
    inner = f.limit(1).withColumn("path", F.concat("path", F.lit("/in")))
    assert kinds(maintenance.file_and_directory(f.unionByName(inner))) == {"file-and-directory"}
    assert kinds(maintenance.part_problems(b.where("part <> 1"))) == {"parts"}
    assert kinds(maintenance.blob_problems(f, b.where("n_parts > 1"))) == {"missing-blob"}
    assert kinds(maintenance.blob_problems(f.withColumn("size", F.col("size") + (F.col("size") > 0).cast("int")), b)) == {"size-mismatch"}
    assert kinds(maintenance.dirs_diff(f, d.where("depth > 0"))) == {"dirs-missing"}
    assert kinds(maintenance.hash_problems(b.withColumn("content", F.lit(b"x")))) == {"hash"}
    assert kinds(maintenance.total_problems(f, s.batches.withColumn("bytes", F.col("bytes") + 1))) == {"totals"}
    with pytest.raises(Exception, match="damaged content"):
        content.whole_blobs(b.withColumn("content", F.lit(b"x"))).collect()
    with pytest.raises(Exception, match="no content"):
        content.with_content(f, b.limit(0)).collect()


def test_lookup(spark):
    blobs = spark.createDataFrame([(b"a\xff",), (b"b",)], "content binary").select(F.unhex(F.sha2("content", 256)).alias("sha"), F.lit(0).alias("part"), F.lit(1).alias("n_parts"), "content")
    keys = blobs.select(F.concat(F.lit(" "), F.hex("sha")).alias("sha"))
    assert sorted(r.text for r in content.lookup(keys, [blobs]).collect()) == ["a�", "b"]


def test_grep_is_as_re_says(spark):
    rng = random.Random(5)
    texts = ["\n".join("".join(rng.choice("abÉ1 .\r") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    data = [(f"f{i}", t.encode()) for i, t in enumerate(texts)] + [("bin", b"a\0b")]
    f = spark.createDataFrame(data, "path string, content binary").withColumns({"sha": F.unhex(F.sha2("content", 256)), "kind": F.when(F.octet_length("content") == 0, 2).otherwise(0), "name": F.col("path"), "size": F.octet_length("content").cast("long")})
    blobs = ingest.as_parts(f.where("size > 0").select("sha", "content").dropDuplicates(["sha"]))
    for pattern, flag in (("a.b", False), (r"^\w+$", False), ("é1?", True), (r"\d{2}$", False), ("b\r", False)):
        want = {(f"f{i}", n) for i, t in enumerate(texts) if t for n, line in enumerate(t.removesuffix("\n").split("\n"), 1) if re.search(pattern, line, re.I if flag else 0)}
        got = {(r.path, r.line_no) for r in content.grep(f.drop("content"), blobs, [pattern], ignore_case=flag).collect()}
        assert got == want, pattern


def test_manifest(tmp_path):
    m = Manifest("x")
    m.publish(str(tmp_path))
    assert Manifest.load(str(tmp_path)).store_id == "x"
    os.makedirs(tmp_path / "catalog/000001/files")
    (tmp_path / "x.tmp").write_text("")
    assert vacuum(str(tmp_path), m) == ["catalog/000001", "x.tmp"]
    assert Manifest.parse('{"format": 1, "store_id": "old"}').format == 3
    for bad in ('{"format": 9, "store_id": "x"}', '{"format": 3, "store_id": "x", "batches": [{"id": 0, "created": "", "segments": {"files": ["a/b"]}}]}', '{"format": 3, "store_id": "x", "batches": [{"id": 1, "created": "", "segments": {"files": ["../b"]}}]}'):
        with pytest.raises(ValueError):
            Manifest.parse(bad)
    with locked(str(tmp_path), True), pytest.raises(RuntimeError), locked(str(tmp_path), False):
        pass


def test_stream_appends_once(spark, tmp_path):
    src = tmp_path / "in"
    plant(src, {"a.txt": "1", "d/b.txt": "2"})
    s = Store.create(spark, str(tmp_path / "s"), "st")
    stream = lambda: watch.append_stream(watch.file_stream(spark, str(src)), s, str(tmp_path / "ck")).awaitTermination(120)
    stream()
    plant(src, {"c.txt": "3"})
    stream()
    now = s.refresh()
    assert sorted(r.path for r in now.visible.collect()) == ["a.txt", "c.txt", "d/b.txt"]
    assert [b.label for b in now.manifest.batches] == ["stream-000000000", "stream-000000001"]
    assert now.verify(deep=True).count() == 0


def test_ready_runs(spark, tmp_path):
    from runstrata.operators.events import Adapter

    a = Adapter("r", markers=("rounds/round-*/DONE",), run_glob="run*", label_ancestor_pattern=r"^round-\d+$")
    plant(tmp_path / "top/run1", {"rounds/round-1/DONE": "", "rounds/round-2/x": "y"})
    s = Store.create(spark, str(tmp_path / "s"), "st")
    assert watch.poll(s, str(tmp_path / "top"), a) == ["run1/round-1"]
    plant(tmp_path / "top/run1", {"rounds/round-2/sub/DONE": ""})
    assert watch.poll(s, str(tmp_path / "top"), a) == ["run1/round-2"]
    assert watch.poll(s, str(tmp_path / "top"), a) == []


def test_greedy(spark):
    items = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 1, 20, 3, 7])] + [("b", 0, 4)], "k string, i int, n long")
    got = maintenance.greedy_chunks(items, "k", "i", "n", 10).orderBy("k", "i").collect()
    assert [r.chunk for r in got] == [0, 0, 1, 2, 3, 3, 0]


def test_command_line(spark, store, tmp_path):
    import io

    from runstrata.__main__ import run as main

    s, _ = store

    def call(*argv, code=0):
        out = io.StringIO()
        assert main(["-S", s.root, *argv], spark, out) == code
        return out.getvalue()

    assert call("ls", "rounds/round-001") == "builder/\nempty\nevents.jsonl\n"
    assert call("ls", "rounds/round-001/empty") == "rounds/round-001/empty\n"
    assert call("ls", "-l", "rounds/round-001") == "d---------        40 B       3 files  builder/\n-rw-r--r--         0 B  empty\n" + f"-rw-r--r--  {len(LOG):>8} B  events.jsonl\n"
    assert call("ls", "-R", "rounds/round-001") == "rounds/round-001:\nbuilder/\nempty\nevents.jsonl\n\nrounds/round-001/builder:\ncopy.stdout\nlink\nout.stdout\n\n"
    assert call("sql", "SELECT 1 AS n") == "+---+\n| n |\n+---+\n| 1 |\n+---+\n"
    assert call("edit", "rounds/round-002/ü file.json", "--editor", "sed -i s/1/2/").splitlines()[2:] == ["@@ -1 +1 @@", '-{"a":1}', "\\ No newline at end of file", '+{"a":2}', "\\ No newline at end of file"]
    assert call("find", "--name", "*.stdout", "--kind", "f").count("\n") == 2
    assert call("grep", "-e", "^Trace", "-c") == "rounds/round-001/builder/copy.stdout:1\nrounds/round-001/builder/out.stdout:1\n"
    assert call("grep", "-e", "nowhere", code=1) == ""
    assert call("sql", "--csv", "SELECT count(*) AS n FROM events") == "n\n3\n"
    report = json.loads(call("verify", "--deep", "--storage", "--require-compact"))
    assert report["violations"] == [] and (report["files"], report["blobs"], report["shadowed"]) == (7, 5, 0) and report["storage"]["content_bytes"] > 0
    with pytest.raises(FileNotFoundError):
        call("grep", "-e", "x", "--path", "no/such")
    assert '"mode_text": "-rw-r--r--"' in call("stat", "rounds/round-001/empty")
    assert '"latest_paths": 2' in call("delete", "rounds/round-002", "--plan")
    assert call("tree", "--depth", "1") == "rounds\t7\t2.0 MB\n"
    with pytest.raises(FileNotFoundError):
        call("ls", "nothing")


def test_raw_paths_and_inventory(spark):
    staged = spark.createDataFrame([("rounds/round-1/a", 5), ("x/rounds/round-2/b", 7), ("src/c", 9)], "path string, size long")
    assert sorted(r.path for r in maintenance.raw_paths(staged, [r"(^|/)rounds/round-\d+/"]).collect()) == ["rounds/round-1/a", "x/rounds/round-2/b"]
    assert tuple(maintenance.over_limits(staged, [r"(^|/)rounds/"], 1, 100).first()) == (2, 12, True)
    have = spark.createDataFrame([("a",), ("c",)], "path string")
    want = spark.createDataFrame([("a",), ("b",)], "path string")
    assert sorted(map(tuple, maintenance.inventory_diff(want, have).collect())) == [("b", "missing"), ("c", "undeclared")]
