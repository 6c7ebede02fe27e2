"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small driver-side table as a plan literal (``schema``: DDL of one row)."""
    doc = json.dumps(rows, ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(doc), f"array<struct<{schema}>>")))


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``_in``, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in")


def row_hashes(df: DataFrame, seed: int, n: int) -> list[Column]:
    """``n`` independent 64-bit hashes of a whole row (columns that hold maps are left out)."""

    def plain(t) -> bool:
        if isinstance(t, T.MapType):
            return False
        if isinstance(t, T.ArrayType):
            return plain(t.elementType)
        if isinstance(t, T.StructType):
            return all(plain(f.dataType) for f in t.fields)
        return True

    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if plain(f.dataType)]
    # The inner null flags keep (null, 'a') apart from ('a', null).
    flags = [c.isNull() for c in cols]
    return [F.xxhash64(F.lit(seed), F.lit(k), *cols, *flags) for k in range(n)]


def canonical(value: Column, t: T.DataType) -> Column:
    """A value of any type as text that tells all values apart, also nulls at any depth."""
    if isinstance(t, T.ArrayType):
        inner = F.concat(F.size(value).cast("string"), F.lit(":"), F.array_join(F.transform(value, lambda e: canonical(e, t.elementType)), ""))
    elif isinstance(t, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)]))
        inner = canonical(F.map_entries(value), entries)
    elif isinstance(t, T.StructType):
        inner = F.concat(F.lit("{"), *[canonical(value.getField(f.name), f.dataType) for f in t.fields])
    else:
        text = (F.base64(value) if isinstance(t, T.BinaryType) else F.to_json(value) if isinstance(t, T.VariantType)
                else F.unix_micros(value).cast("string") if isinstance(t, T.TimestampType) else value.cast("string"))
        inner = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("~")).otherwise(inner)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 (32 bytes) of a whole row: equal exactly for identical rows."""
    return F.unhex(F.sha2(F.concat(F.lit(""), *[canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]), 256))


def small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are small enough, else as it is."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df
