"""Exact deduplication by skew-safe combining.

Three stages, each of which compares whole texts (the text is a grouping key
beside its digest, so a digest collision never merges two texts):

1. local: the map side of the first aggregation leaves one row for each text
   and input task;
2. salted: rows of one digest are merged in ``salts`` independent groups, so a
   text that holds a third of all rows never meets in one task;
3. global: at most ``salts`` winners of a text are combined.

The document that stays is the one with the largest id.

Edge cases: a null text counts as the empty text; a null id never beats
another id, and stays only if its whole group has null ids; identical rows
(same id and text) are one document, so all of them bear the same verdict; an
empty table gives an empty result; other columns are ignored whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedup_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                  digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    rows = (df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
              .withColumn("_digest", digest(F.col("_text"))))
    winners = (rows.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
                   .groupBy("_digest", "_text", "_salt").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
                   .groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"),
                                                    F.unhex(F.sha2(F.first("_text"), 256)).alias("_sha")))
    slim = materialize(winners.select("_digest", "_keep", "_n", "_sha"), "exact_dedup")
    clash = slim.groupBy("_digest").count().filter("count > 1").select("_digest")
    if clash.isEmpty():
        joined = rows.select("_id", "_digest").join(slim, "_digest")
    else:
        # Some digest stands for several texts: those rows are joined on the text itself.
        plain = rows.select("_id", "_digest").join(slim.join(clash, "_digest", "left_anti"), "_digest")
        mixed = rows.join(clash, "_digest", "left_semi").join(winners, ["_digest", "_text"])
        cols = ["_id", "_keep", "_n", "_sha"]
        joined = plain.select(*cols).unionByName(mixed.select(*cols))
    return joined.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
                         F.col("_n").alias("group_size"),
                         F.coalesce(F.col("_id") == F.col("_keep"), F.col("_keep").isNull()).alias("kept"),
                         F.lower(F.hex("_sha")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
