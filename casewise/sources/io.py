"""Readers and writers.

CSV columns are matched by the header's names and cast to a fixed schema (no
inference pass over the data); ``"`` escapes quotes, null is written as ``\\N`` so that empty
texts and outer blanks survive.  Texts with line breaks need ``multi_line``,
which makes a file unsplittable, so it is an option.  Timestamps are parsed with
``try_to_timestamp`` so a bad value becomes null instead of failing the job
(Spark 4 runs in ANSI mode).  Outputs are Parquet by default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require_columns(df: DataFrame, required) -> None:
    """Fail before any job when required columns are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Dataset is missing required columns: {missing}")


CSV_OPTIONS = {"header": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required=None, multi_line: bool = False) -> DataFrame:
    """Columns of ``schema`` found by name (absent ones are null); ``required`` names must be in the header."""
    raw = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).csv(path)
    require_columns(raw, required or [])
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
                        for f in schema.fields])


def read_complaints(spark: SparkSession, raw_path: str, processed_path: str | None = None, multi_line: bool = False) -> DataFrame:
    """S1 + S2: the warehouse table; falls back to the processed copy when the raw one is absent.

    ``created_at`` becomes a timestamp; unparseable values are null.
    """
    path = raw_path if path_exists(spark, raw_path) or not processed_path else processed_path
    schema = schemas.WAREHOUSE
    if processed_path and path == processed_path:
        schema = T.StructType(schemas.WAREHOUSE.fields + [T.StructField("cleaned_text", T.StringType())])
    df = read_csv(spark, path, schema, ["complaint_text"], multi_line)
    return df.withColumn("created_at", F.try_to_timestamp(F.col("created_at"), F.lit("yyyy-MM-dd HH:mm:ss")))


def _read_required(spark: SparkSession, path: str, schema: T.StructType, what: str, multi_line: bool) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{what} dataset not found: {path}")
    return read_csv(spark, path, schema, ["complaint_text"], multi_line)


def read_validation(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S3."""
    return _read_required(spark, path, schemas.VALIDATION, "Validation", multi_line)


def read_cfpb(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S4."""
    return _read_required(spark, path, schemas.CFPB, "CFPB", multi_line)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a table (CSV with header, or Parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.parquet(path)
    return path


def preprocess_dataset(spark: SparkSession, input_path: str, output_path: str, fmt: str = "parquet",
                       multi_line: bool = False) -> DataFrame:
    """S5 + P1: read, check the text column, add ``cleaned_text``, write."""
    from ..functions.text import preprocess_text
    df = read_csv(spark, input_path, schemas.WAREHOUSE, ["complaint_text"], multi_line)
    out = df.withColumn("cleaned_text", preprocess_text(F.col("complaint_text")))
    save_table(out, output_path, fmt)
    return spark.read.parquet(output_path) if fmt == "parquet" else read_csv(
        spark, output_path, T.StructType(schemas.WAREHOUSE.fields + [T.StructField("cleaned_text", T.StringType())]), None, multi_line)


def write_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """Save a set of named result tables, one directory each."""
    paths = {}
    for name, df in tables.items():
        paths[name] = save_table(df, f"{out_dir.rstrip('/')}/{name}", fmt)
    return paths


# ---------------------------------------------------------------------------
# Vector store
# ---------------------------------------------------------------------------

def content_hash(df: DataFrame, id_col: str = "complaint_id", text_col: str = "complaint_text") -> DataFrame:
    """Order-free fingerprint: row count and the sum of per-row 64-bit hashes (as decimal, no overflow)."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).cast("decimal(38,0)")).alias("h"))


def save_vectors(corpus: DataFrame, path: str, id_col: str = "complaint_id", text_col: str = "complaint_text") -> str:
    """S7 + S8: metadata and hashed token vector of every row (see ``vector_store``)."""
    from . import vector_store
    vector_store.refresh(corpus, path, id_col, text_col)
    return path


def load_or_build_vectors(spark: SparkSession, corpus: DataFrame, path: str, id_col: str = "complaint_id",
                          text_col: str = "complaint_text") -> DataFrame:
    """Stored vectors of the corpus; only texts that the store does not hold are computed."""
    from . import vector_store
    vector_store.refresh(corpus, path, id_col, text_col)
    return vector_store.read(spark, path).drop("part")
