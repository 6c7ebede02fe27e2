"""Readers for the driver tables (Parquet) and the CSV inputs of the reference layout."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(table_path(sf_dir, name))


TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "benchmark": "item_id"}


def read_text_table(spark: SparkSession, sf_dir: str, name: str, by_key: bool = False) -> DataFrame:
    """Read a text table and spread it if the scan is too coarse (see ``spread``); ``by_key``: lay it by its key in any case.

    Where rows become many more (terms of a text) and are grouped by key and more, texts are the smaller shuffle.
    """
    from ..session import spread
    return spread(read_table(spark, sf_dir, name), TEXT_KEYS.get(name, ""), always=by_key) if name in TEXT_KEYS else \
        read_table(spark, sf_dir, name)
