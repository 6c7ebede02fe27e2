"""Registered queries against their DuckDB oracle at sf0.001 (a representative subset; the
full set runs with tools/oracle_check.py)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from casewise.sources.tables import TABLES

from conftest import SF_SMALL

SUBSET = ["rule_triage_summary", "rule_triage_rows", "clean_documents", "keyword_frequency", "priority_distribution",
          "length_histogram_documents", "group_split", "similar_complaints", "retrieval_triage", "consensus",
          "model_metrics", "confusion_matrix", "response_validation", "generated_warehouse",
          "embedding_vote_accuracy", "hashed_vectors", "verdict_normalization", "vector_store", "evaluation_report",
          "report_rows", "rule_triage_documents", "rule_triage_conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == want
