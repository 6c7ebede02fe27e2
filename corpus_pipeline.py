"""Corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents`` with the values they had, whatever their names; the last
adds ``shard`` and ``slot`` (and replaces input columns of these two names).
SQL cannot express language identification, so there is no oracle; tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm import decontaminate, langid, mixing, sharding, simhash
from casewise.llm.common import packed
from casewise.session import materialize

#: A document is rejected if no language is more likely than all others together.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language stays open.

    The model learns from the labelled documents that are not held out.
    """
    model = langid.train(langid.split_held_out(docs).filter(~F.col("held_out")))
    judged = langid.predict(docs.select(packed(docs), "text"), model)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") > LEAST_SCORE)).select("_in.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component (three-word shingles, two bits)."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three copies, or none."""
    mixed = mixing.mix(docs.select(packed(docs), "doc_id", "text", "source"))
    return mixed.filter("copies > 0").select("_in", F.explode(F.sequence(F.lit(1), "copies"))).select("_in.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uniform shuffle into 24 shards of equal row counts."""
    return sharding.shard_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("source_mixing", source_mixing), ("sharding", shards)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline_{name}")
    return docs
