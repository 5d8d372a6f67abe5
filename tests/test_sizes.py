"""What must not grow faster than its input."""

import hashlib
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from runstrata.functions import stored
from runstrata import store as store_module
from runstrata.operators import ingest
from runstrata.plans import catalog_queries
from runstrata.store import Store


def test_distinct_keys_carry_no_registers(spark, tmp_path):
    rows = [(f, k) for f, n in (("A", 50), (None, 30)) for k in range(n)] + [("B", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog_queries.QUERIES["approx_distinct"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == [("A", 50, True), ("B", 0, True), (None, 30, True)]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "keys=[l_returnflag" in x and "l_partkey" in x.split("functions=")[0] and "approx_count_distinct" in x]


def test_appends_compare_rows_without_contents(spark, tmp_path, monkeypatch):
    seen, changed = [], ingest.changed
    monkeypatch.setattr(ingest, "changed", lambda rows, before: seen.append(rows.columns) or changed(rows, before))
    adapter = tmp_path / "a.toml"
    adapter.write_text('name = "t"\n[trajectories]\nglobs = ["**/*.jsonl"]\nformat = "jsonl"\n')
    s = Store.create(spark, f"{tmp_path}/s", "t", adapter=str(adapter))

    def entries(lo, hi, tail=""):
        content = F.concat(F.lit('{"type":"a","id":"'), F.col("id") % 7, F.lit(tail + '"}\n{"type":"b"}'))
        df = spark.range(lo, hi).select(F.concat(F.lit("d/l"), "id", F.lit(".jsonl")).alias("path"), F.lit(0).alias("kind"), F.lit(0o644).alias("mode"), F.octet_length(content).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), content.cast("binary").alias("content"))
        return df

    s.append(entries(0, 40))
    s.append(entries(20, 60))
    b = s.append(entries(50, 60, "x"))
    assert len(seen) == 2 and not any("content" in c for c in seen)
    assert [x.paths for x in s.manifest.batches] == [40, 20, 10] and b.new_blobs == 7
    assert s.history.select("sha").distinct().count() == 14 == s.blobs.count() and s.verify(deep=True, compacted=True).count() == 0
    assert s.events.count() == 140 and s.events.where("type = 'a' and id like '%x'").count() == 10
    for x in s.manifest.batches:  # events of logs dealt by path rise from file to file, and none is there twice
        folder = os.path.join(s.root, x.derived[0])
        assert not os.path.exists(folder + ".tmp")
        got = [[(r.trajectory, r.seq) for r in spark.read.parquet(os.path.join(folder, f)).collect()] for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]
        flat = [k for part in got for k in part]
        assert flat == sorted(set(flat)) and len(flat) == 2 * x.paths
    s.close()


def test_events_beyond_a_segment_are_cut_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "SEGMENT_BYTES", 6000)
    s = Store.create(spark, f"{tmp_path}/s", "t", adapter="jsonl:**/*.jsonl")
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit('{"id":"'), F.sha2(i.cast("string"), 256), F.lit('"}'))), "\n")
    content = F.concat(lines, F.lit("\n"), F.col("id").cast("string"))
    s.append(spark.range(6).select(F.concat(F.lit("l"), "id", F.lit(".jsonl")).alias("path"), F.lit(0).alias("kind"), F.lit(0o644).alias("mode"), F.octet_length(content).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), content.cast("binary").alias("content")))
    assert s.events.count() == 6 * 61
    s.close()


def test_a_lookup_reads_a_row_group_once(tmp_path, monkeypatch):
    data = {hashlib.sha256(x).digest(): x for x in (b"content %d" % i for i in range(1000))}
    rows = sorted(data.items())
    table = pa.table({"sha": pa.array([k for k, _ in rows], pa.binary()), "part": pa.array([0] * 1000, pa.int32()), "n_parts": pa.array([1] * 1000, pa.int32()), "content": pa.array([v for _, v in rows], pa.binary())})
    pq.write_table(table, f"{tmp_path}/a.parquet", row_group_size=50)
    reads, groups = [], stored._groups(str(tmp_path))

    class Counted:
        def __init__(self, at, group):
            self.at, self.group = at, group

        def count_rows(self, **k):
            return self.group.count_rows(**k)

        def to_batches(self, **k):
            reads.append(self.at)
            return self.group.to_batches(**k)

    monkeypatch.setattr(stored, "_groups", lambda path: [(lo, hi, Counted(i, g)) for i, (lo, hi, g) in enumerate(groups)])
    assert len(groups) == 20 and stored.contents([[str(tmp_path)]], set(data) | {b"x" * 32}) == data and sorted(reads) == list(range(20))
    reads.clear()
    near = dict(rows[110:140])
    assert stored.contents([[str(tmp_path)]], set(near)) == near and reads == [2]
