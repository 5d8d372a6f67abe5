"""Sharding by a permutation-filled lookup table (Maglev hashing, Eisenbud et al. 2016).

Every shard has a preference order over the slots of a prime-sized table, from two hashes of its name. Shards take
turns and claim the first slot of their order that is still free, until the table is full. A key's hash picks a
slot, the slot its shard: a broadcast join of at most ``slots`` rows, so placement takes constant time, no shuffle,
and a hot key moves no data. When a shard leaves, few keys of other shards move.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh


@dataclass(frozen=True)
class Table:
    """``slots``: a prime, at least 100 times the number of shards."""

    shards: tuple[str, ...] = tuple(f"shard-{k:02d}" for k in range(16))
    slots: int = 1613


def number(text: str) -> int:
    """The first 60 bits of the md5 of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(t: Table) -> list[int]:
    """The shard's number for each slot."""
    m = t.slots
    if not t.shards or len(set(t.shards)) < len(t.shards) or len(t.shards) > m or any(m % k == 0 for k in range(2, int(m**0.5) + 1)):
        raise ValueError("distinct shards and a prime number of slots, no fewer than shards, are asked for")
    begin = [number(f"{s}#offset") % m for s in t.shards]
    skip = [number(f"{s}#skip") % (m - 1) + 1 for s in t.shards]
    at, owner, left = [0] * len(t.shards), [-1] * m, m
    while left:
        for k in range(len(t.shards)):
            while owner[slot := (begin[k] + at[k] * skip[k]) % m] >= 0:
                at[k] += 1
            owner[slot] = k
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, t: Table) -> DataFrame:
    """``slot, shard``: as many rows as slots, from a literal."""
    names = F.array(*[F.lit(s) for s in t.shards])
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, fill(t)))), ",")).alias("slot", "k"))
    return rows.select("slot", F.element_at(names, F.col("k").cast("int") + 1).alias("shard"))


def slot_of(key, t: Table):
    """A key column's slot: the first 60 bits of its text's md5, modulo the slots. A null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(t.slots)).cast("int")


def place(df: DataFrame, t: Table = Table(), key_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: ``key_col``, ``slot``, ``shard``. Equal keys share a shard, null keys that of the empty text; an empty table gives no rows; other columns are not read."""
    keyed = df.select(F.col(key_col), slot_of(F.col(key_col), t).alias("slot"))
    return keyed.join(F.broadcast(lookup_table(df.sparkSession, t)), "slot").select(F.col(key_col), "slot", "shard")


def write_shards(df: DataFrame, path: str, t: Table = Table(), key_col: str = "doc_id", per_file: int = 1_000_000) -> None:
    """Write all columns below ``path``, one folder a shard. Rows stay where they are: no shard is one task, files are bounded in rows.

    Null keys go where the empty text goes, repeated rows all go, an empty table writes no shard. A column named
    ``shard`` (in any case) is refused; any other name is kept.
    """
    if "shard" in [c.lower() for c in df.columns]:
        raise ValueError("the table has a column named shard")
    slot = fresh("_slot", df.columns)
    table = lookup_table(df.sparkSession, t).withColumnRenamed("slot", slot)
    out = df.withColumn(slot, slot_of(F.col(key_col), t)).join(F.broadcast(table), slot).drop(slot)
    out.write.option("maxRecordsPerFile", per_file).partitionBy("shard").parquet(path)


def oracle(t: Table = Table(), relation: str = "documents", key_col: str = "doc_id") -> str:
    """DuckDB SQL for ``place``; it fills the table by itself."""
    n, m = len(t.shards), t.slots
    names = ", ".join(f"({k}, '{s}')" for k, s in enumerate(t.shards))
    bits = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE shards(k, name) AS (VALUES {names}),
prefs AS (
  SELECT k, list((begin_at + j * skip) % {m} ORDER BY j) AS slots
  FROM (SELECT k, {bits("name || '#offset'")} % {m} AS begin_at, {bits("name || '#skip'")} % {m - 1} + 1 AS skip FROM shards), range({m}) r(j)
  GROUP BY k
),
orders AS (SELECT list(slots ORDER BY k) AS o FROM prefs),
fill(step, owner) AS (
  SELECT 0, [(-1)::INTEGER FOR x IN range({m})]
  UNION ALL
  SELECT step + 1, list_concat(list_concat(owner[1:claimed], [(step % {n})::INTEGER]), owner[claimed + 2:])
  FROM (SELECT step, owner, list_filter(o[step % {n} + 1], lambda s: owner[s + 1] < 0)[1] AS claimed FROM fill, orders WHERE step < {m})
),
slots AS (SELECT generate_subscripts(owner, 1) - 1 AS slot, unnest(owner) AS k FROM fill WHERE step = {m})
SELECT {key_col}, slot::INTEGER AS slot, name AS shard
FROM (SELECT {key_col}, {bits(f"coalesce({key_col}::VARCHAR, '')")} % {m} AS slot FROM {relation}) JOIN slots USING (slot) JOIN shards USING (k)
"""
