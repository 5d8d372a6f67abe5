"""A written store over the driver's tables, for queries that must go through one: built once for a session and folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Store
from . import testviews as V

ADAPTER = r"""
name = "tables"
[[attrs]]
pattern = '^(?P<source>src\d+)/(?P<lang>[a-z]+)/'
[trajectories]
globs = ["**/*.jsonl"]
format = "jsonl"
"""

_BUILT: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession) -> str:
    """Below the shared folder that the session names; a session of one machine may go without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and (shared.startswith("/") or shared.startswith("file:")):
        return os.path.join("/" + shared.removeprefix("file:").lstrip("/"), f"store-{uuid.uuid4().hex[:12]}")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors mount")
    return os.path.join(tempfile.mkdtemp(prefix="runstrata-store-"), "s")


def _entries(df: DataFrame, path, content) -> DataFrame:
    content = content.cast("binary")
    size = F.octet_length(content).cast("long")
    return df.select(path.alias("path"), F.when(size == 0, 2).otherwise(0).alias("kind"), F.lit(0o644).alias("mode"), size.alias("size"), F.lit(0).cast("long").alias("mtime_ns"), content.alias("content"))


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a log of JSON lines."""
    line = F.to_json(F.struct(F.lit("turn").alias("type"), F.col("turn").cast("string").alias("id"), "role", F.col("turn").alias("ts"), "text"))
    logs = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return logs.select(F.concat(F.lit("talk/conv-"), "conv_id", F.lit("/events.jsonl")).alias("path"), "content")


def store(spark: SparkSession, sf_dir: str) -> Store:
    """Batch 1: all documents; batch 2: all conversations and all users' events as logs; batch 3: all benchmark items, each in place of a document's path or beside them."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _BUILT:
        root = _folder(spark)
        os.makedirs(os.path.dirname(root), exist_ok=True)
        with open(f"{root}.toml", "w", encoding="utf-8") as f:
            f.write(ADAPTER)
        s = Store.create(spark, root, "tables", adapter=f"{root}.toml")
        d = V.table(spark, sf_dir, "documents")
        s.append(_entries(d, F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")), F.coalesce(F.col("text"), F.lit(""))), "documents")
        logs = conversation_logs(spark, sf_dir).unionByName(V.event_lines(spark, sf_dir, "jsonl"))
        s.append(_entries(logs, F.col("path"), F.col("content")), "logs")
        b = V.table(spark, sf_dir, "benchmark").join(d.select("doc_id", "source", "lang"), F.col("item_id") == F.col("doc_id"), "left")
        place = F.when(F.col("doc_id").isNotNull(), F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.lpad(F.col("item_id").cast("string"), 8, "0"), F.lit(".txt"))).otherwise(F.concat(F.lit("items/"), F.col("item_id").cast("string")))
        s.append(_entries(b, place, F.col("text")), "benchmark")
        _BUILT[key] = s.root
        s.close()
    return Store(spark, _BUILT[key])


@atexit.register
def _remove() -> None:
    for root in _BUILT.values():
        shutil.rmtree(root, ignore_errors=True)
        with contextlib.suppress(OSError):
            os.unlink(f"{root}.toml")


#: The visible files of that store as CTEs of DuckDB: path, text, size, batch, sha.
STORED = """docs AS (SELECT doc_id, source || '/' || lang || '/doc-' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, coalesce(text, '') AS text, 1 AS batch FROM documents),
talk AS (SELECT conv_id AS id, count(*) AS lines FROM conversations GROUP BY conv_id UNION ALL SELECT user_id, count(*) FROM events GROUP BY user_id),
items AS (SELECT coalesce(path, 'items/' || item_id) AS path, b.text, 3 AS batch FROM benchmark b LEFT JOIN docs ON item_id = doc_id),
stored AS (SELECT path, text, batch, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha FROM (SELECT path, text, batch FROM docs WHERE path NOT IN (SELECT path FROM items) UNION ALL SELECT * FROM items))"""
