"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, embed_dedup, langid, minhash, quality, sharding, toxicity, urlfilter, warc
from ._shared import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records, then read back through the capture index."""
    capture = warc.write_archives(_table(spark, sf_dir, "pages"))
    found = warc.lookup(capture, capture.entries.select("key", "page_id"))
    return warc.read_records(capture, found, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, back = _table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~back)
    out = docs.select("doc_id", back.alias("held_out"), toxicity.score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, back = _table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = langid.train(docs, ~back)
    out = docs.select("doc_id", back.alias("held_out"), langid.predict(docs, model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out of training: ids whose crc32 has the remainder 1 by 5."""
    docs, back = _table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1)
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~back)
    out = docs.select("doc_id", back.alias("held_out"), quality.score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), bpe.public_vocabulary())


QUERIES = {f.__name__: f for f in (op1_warc, op2_toxicity, op3_embedding_near_dedup, op4_sharding, op5_language_id, op6_quality, op7_decontamination, op8_minhash_near_dedup, op9_url_filters, op10_bpe)}

#: The digest of op1 is base32, which DuckDB's SQL has no function for; ops 2, 3, 5, 6, 7, 8 and 10 learn, iterate or tokenise. These are tested against brute force.
ORACLES = {"op4_sharding": sharding.oracle(), "op9_url_filters": urlfilter.oracle()}
