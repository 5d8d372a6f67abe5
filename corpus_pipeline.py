"""The corpus pipeline: five stages, each on all that the stage before kept, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runstrata.llm import bpe, decontam, minhash, quality, toxicity
from runstrata.llm._shared import Scratch, fresh, held_out, written


def _kept(docs: DataFrame, score, keep) -> DataFrame:
    name = fresh("_score", docs.columns)
    return docs.withColumn(name, score).where(keep(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 5, 0))
    return _kept(docs, toxicity.score(docs, model), lambda s: s < 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is below 0.5 go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 5, 1))
    return _kept(docs, quality.score(docs, model), lambda s: s >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of texts linked by five-word shingles with a similarity of 0.8 or more, the one of the smallest id stays.

    Texts are judged, not ids: rows that share an id but not a text go or stay by themselves (of several texts of the
    smallest id, that of the least hash stays). Rows equal in id and text are one row (the least by its other columns
    as JSON). Rows with a null id stay, all of them.
    """
    mark, text = fresh("_mark", docs.columns), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.where("doc_id is not null").withColumn(mark, F.xxhash64(F.col("doc_id").cast("long"), text))
    groups = minhash.near_duplicates(named.select(F.col(mark).alias("doc_id"), "text"), minhash.FIVE_WORDS)
    groups = groups.select(F.col("doc_id").alias("m"), F.col("component_id").alias("root")).distinct()
    ids = named.select(F.col(mark).alias("m"), F.col("doc_id").cast("long").alias("id")).groupBy("m", "id").agg(F.count(F.lit(1)).alias("rows"))
    best = groups.join(ids, "m").groupBy("root").agg(F.min(F.struct("id", "m")).alias("best")).select("best.m")
    scratch = Scratch(spark, "near_copies")
    stay = scratch.put(ids.join(best, "m").select(F.col("m").alias(mark), "rows"), "stay")  # grows with the corpus: never broadcast
    again = scratch.put(stay.where("rows > 1").select(mark), "again")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = named.join(stay.where("rows = 1").select(mark).hint("merge"), mark, "left_semi").select(*cols)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    several = named.join(again, mark, "left_semi")
    several = several.groupBy(mark).agg(F.min_by(F.struct(*cols), F.to_json(F.struct(*rest)) if rest else F.lit(0)).alias("x"))
    several = several.select(*[F.col(f"x.`{c}`").alias(c) for c in docs.columns])
    return once.unionByName(several).unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it stands or with other numbers, names and units, go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of ids and decoded text."""
    return bpe.encode_decode(docs, bpe.public_vocabulary())


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("bpe", tokenize)]

#: Classifiers, near-duplicates and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with written():
            docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
