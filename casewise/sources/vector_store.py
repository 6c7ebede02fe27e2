"""Incremental vector store.

A store is a folder with immutable parts and one pointer::

    vectors/<id>   vectors by text digest; a refresh adds a part with the texts that no part has yet
    rows/<id>      one version of the corpus: its columns and each row's text digest
    CURRENT        names the version: its rows, its vector parts, row count and fingerprint

``refresh`` computes vectors for new texts only (an anti-join of distinct digests),
writes them and the rows, and then swaps the pointer by an atomic rename.  Until
then readers see the old version whole; a refresh that dies leaves parts that
nobody names.  After ``most_parts`` refreshes the parts that are still in use are written as one.
Rows removed from the corpus vanish with the next version.

The digest is SHA-256 of the text; equal texts share one vector, so ids may
repeat or be null.  A corpus with the same rows as the current version changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, p, p.getFileSystem(conf), conf


def current(spark: SparkSession, root: str) -> dict | None:
    """The current version, or None for a folder without one."""
    jvm, path, fs, _ = _hadoop(spark, f"{root}/{POINTER}")
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0])


def _swap(spark: SparkSession, root: str, version: dict) -> None:
    """Write the pointer beside the old one and rename it over it (one atomic step of the file system)."""
    jvm, target, fs, conf = _hadoop(spark, f"{root}/{POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/_{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), options)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def refresh(corpus: DataFrame, root: str, id_col: str = "complaint_id", text_col: str = "complaint_text", vector=None,
            most_parts: int = 8) -> dict:
    """Bring the store to ``corpus``; returns the version with ``computed`` and ``reused`` (distinct texts).

    ``vector``: column of a text column (default: hashed tokens).  A store keeps the function it was made with.
    """
    from ..operators.similar import hash_tokens
    from .io import content_hash
    spark, make = corpus.sparkSession, vector or hash_tokens
    old = current(spark, root)
    print_ = content_hash(corpus, id_col, text_col).first()
    mark = [print_["n"], str(print_["h"])]
    if old and old["fingerprint"] == mark and old["columns"] == corpus.columns:
        return old | {"computed": 0, "reused": old["texts"]}
    name = uuid.uuid4().hex
    rows = corpus.withColumn("_digest", text_digest(F.col(text_col)))
    rows.write.parquet(f"{root}/rows/{name}")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/rows/{name}")
    texts = rows.groupBy("_digest").agg(F.first(text_col).alias("_text"))
    parts = old["parts"] if old else []
    known = _vectors(spark, root, parts)
    fresh = texts.join(known.select("_digest"), "_digest", "left_anti") if known is not None else texts
    fresh = fresh.select("_digest", make(F.col("_text")).alias("vector"))
    if len(parts) >= most_parts:
        fresh = fresh.unionByName(known.join(texts.select("_digest"), "_digest", "left_semi"))
    fresh.write.parquet(f"{root}/vectors/{name}")
    added = spark.read.parquet(f"{root}/vectors/{name}").count()
    n_texts = texts.count()
    if len(parts) >= most_parts:
        reused = known.join(texts.select("_digest"), "_digest", "left_semi").count()
        parts = []
    else:
        reused = n_texts - added
    version = {"rows": name, "parts": parts + [name], "fingerprint": mark, "columns": corpus.columns, "texts": n_texts}
    _swap(spark, root, version)
    return version | {"computed": n_texts - reused, "reused": reused}


def _vectors(spark: SparkSession, root: str, parts: list[str]) -> DataFrame | None:
    return spark.read.parquet(*[f"{root}/vectors/{p}" for p in parts]) if parts else None


def read(spark: SparkSession, root: str, version: dict | None = None) -> DataFrame:
    """The corpus of a version (default: the current one) with ``vector`` and ``part``, the refresh that computed it."""
    version = version or current(spark, root)
    if version is None:
        raise FileNotFoundError(f"no vector store at {root}")
    rows = spark.read.parquet(f"{root}/rows/{version['rows']}")
    found = [spark.read.parquet(f"{root}/vectors/{p}").withColumn("part", F.lit(p)) for p in version["parts"]]
    vectors = found[0]
    for part in found[1:]:
        vectors = vectors.unionByName(part)
    return rows.join(vectors, "_digest").drop("_digest")
