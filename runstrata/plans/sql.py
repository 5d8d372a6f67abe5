"""SQL over one or more stores."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stored
from ..operators import content
from ..store import SCHEMAS, Store

TABLES = ("files", "dirs", "excluded", "blobs", "events")


def views(spark: SparkSession, stores: list[Store]) -> dict[str, DataFrame]:
    """All batch history of each table over all stores, rows marked with their store. Contents stay out: ``text`` and ``blob`` fetch them."""
    out = {}
    for t in TABLES:
        every = None
        for s in stores:
            if not s.manifest.artifacts(t):
                continue
            rows = s.table(t)
            rows = rows.drop("content", *(["batch"] if t in ("events", "blobs") else []))
            rows = rows.select(F.lit(s.manifest.store_id).alias("store"), "*")
            every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
        if every is not None:
            out[t] = every
    return out


_READS = {"select", "with", "from", "values", "table", "describe", "desc", "show", "explain", "map", "reduce"}


def _first_word(query: str) -> str:
    """The first word of a query, past blanks, comments and opening brackets."""
    at = 0
    while at < len(query):
        if query[at].isspace() or query[at] == "(":
            at += 1
        elif query.startswith("--", at):
            at = query.find("\n", at) % (len(query) + 1)
        elif query.startswith("/*", at):
            end = query.find("*/", at + 2)
            at = len(query) if end < 0 else end + 2
        else:
            break
    return re.match(r"\w*", query[at:])[0].lower()


def sql(spark: SparkSession, stores: list[Store], query: str) -> DataFrame:
    """Run a query over the views ``files dirs excluded blobs events`` and ``contents(sha, blob, text)``, with ``text(sha)`` and ``blob(sha)``.

    The functions take a hash as 32 bytes or as hex text and give the content from the first store that has it; null
    for a null, malformed or unknown hash, an error for a damaged content. They read the hashes of a batch of rows at
    once, each once, by ranges of the files (which are sorted by hash). For many rows join ``contents`` on ``sha``
    instead. A view exists if a store has a file for it.
    """
    word = _first_word(query)
    if word not in _READS:
        raise ValueError("only queries are run here" if word else "the query is empty")
    for name, df in views(spark, stores).items():
        df.createOrReplaceTempView(name)
    first = content.first_contents([s.blobs for s in stores]).select("sha", F.col("content").alias("blob"))
    empty = spark.range(1).select(F.unhex(F.lit(content.EMPTY_SHA)).alias("sha"), F.lit(b"").alias("blob"))
    first.unionByName(empty).withColumn("text", content.text_of(F.col("blob"))).createOrReplaceTempView("contents")
    folders = [[os.path.join(s.root, p) for p in s.manifest.artifacts("blobs")] for s in stores]
    spark.udf.register("blob", stored.lookup_udf(folders, as_text=False))
    spark.udf.register("text", stored.lookup_udf(folders, as_text=True))
    return spark.sql(query)


def csv_cell(v) -> str:
    """Null is nothing; quotes stand only where a comma, a quote or the end of a line asks for them."""
    text = "" if v is None else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v).lower() if isinstance(v, bool) else str(v)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def to_csv(df: DataFrame) -> Iterator[str]:
    """A result as lines of CSV, the header first, even for no rows; rows come a partition at a time."""
    yield ",".join(map(csv_cell, df.columns)) + "\n"
    for row in df.toLocalIterator():
        yield ",".join(map(csv_cell, row)) + "\n"


def to_table(df: DataFrame) -> Iterator[str]:
    """A result as lines of a framed table; ``(no rows)`` for none. Rows are read twice, for the widths first, and never gathered."""
    shown = df.select([F.coalesce(F.hex(c) if t == "binary" else F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)])
    widths = shown.agg(*[F.max(F.length(c)).alias(c) for c in shown.columns]).first()
    if widths[0] is None:
        yield "(no rows)\n"
        return
    sizes = [max(len(c), int(w)) for c, w in zip(df.columns, widths)]
    rule = "+" + "+".join("-" * (n + 2) for n in sizes) + "+\n"
    line = lambda cells: "|" + "|".join(f" {c:<{n}} " for c, n in zip(cells, sizes)) + "|\n"
    yield rule + line(df.columns) + rule
    for row in shown.toLocalIterator():
        yield line(row)
    yield rule
