import hashlib

import duckdb
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from casewise.llm import exact_dedup as X
from casewise.llm.queries import op10_exact_dedup

TEXTS = [None, "", "a", "A", "a ", "é", "é", "long " * 50_000, "bb", "cc"]


@pytest.mark.parametrize("digest", [X.sha256, F.length, lambda t: F.lit(1)], ids=["sha256", "length", "one digest"])
def test_equals_brute_force(spark, digest):
    rows = [(None if i % 17 == 0 else i, TEXTS[i * i % 10], "x", False) for i in range(120)] + [(5, "a", "x", False)] * 3 + [(None, "only", "y", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest string, kept boolean").repartition(5)
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    want = []
    for d, t, *_ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in X.dedup_classes(df, salts=3, digest=digest).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_matches_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    got = sorted(tuple(r) for r in op10_exact_dedup(spark, SF_SMALL).collect())
    assert got == sorted(con.execute(X.ORACLE).fetchall())


def test_empty(spark):
    assert X.dedup_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
