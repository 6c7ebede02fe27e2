"""Mergeable distinct counts.

A sketch (HyperLogLog, 2^``precision`` registers) of a column is a few kilobytes
whatever the number of rows, and the sketch of a union is the merge of the
sketches.  So distinct counts per group are stored once and combined later
for any coarser grouping without reading rows again, which exact distinct counts
cannot do.  The relative standard error is about 1.04 / sqrt(2^precision).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 12


def standard_error(precision: int = PRECISION) -> float:
    return 1.04 / 2 ** (precision / 2)


def sketch_table(df: DataFrame, group_cols: list[str], cols: list[str], precision: int = PRECISION) -> DataFrame:
    """One row per group: ``rows`` and a sketch ``s_<column>`` of each column's non-null values (as text)."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("rows"), *[
        F.hll_sketch_agg(F.col(c).cast("string"), F.lit(precision)).alias(f"s_{c}") for c in cols])


def merged(table: DataFrame, group_cols: list[str]) -> DataFrame:
    """The sketches of coarser groups: ``table`` (or any union of such tables) merged by ``group_cols``."""
    cols = [c for c in table.columns if c.startswith("s_")]
    return table.groupBy(*group_cols).agg(F.sum("rows").alias("rows"), *[F.hll_union_agg(c).alias(c) for c in cols])


def estimates(table: DataFrame) -> DataFrame:
    """``table`` with ``approx_<column>`` in place of each sketch."""
    return table.select(*[F.hll_sketch_estimate(c).alias("approx_" + c[2:]) if c.startswith("s_") else F.col(c) for c in table.columns])
