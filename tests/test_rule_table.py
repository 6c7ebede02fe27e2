"""Rule tables matched by join: phrases, ties, unknown issues, large tables, empty input."""

import re

import pytest
from pyspark.sql import functions as F

from casewise.functions import lexicon as L
from casewise.operators.rule_table import phrases, triage_by_table
from casewise.plans.catalog import load_all

RULES = "issue string, term string, weight double"


def _run(spark, texts, rules, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    return {r["id"]: r for r in triage_by_table(df, spark.createDataFrame(rules, RULES), "id", "body", **kw).collect()}


def test_phrases_need_single_spaces_and_whole_words(spark):
    rules = [("Double charge", "charged twice", 1.5), ("Praise", "Great", 1.0)]
    got = _run(spark, ["I was CHARGED  twice!", "charged, twice", "uncharged twice", "charged twiced", "greatness is great"], rules)
    assert [got[i]["core_issue"] for i in range(5)] == ["Double charge", L.NO_RULE_ISSUE, L.NO_RULE_ISSUE, L.NO_RULE_ISSUE, "Praise"]
    assert got[0]["score"] == 1.5 and got[0]["evidence"] == ["charged twice"] and got[1]["score"] == 0.0


def test_ties_weights_and_blank_texts(spark):
    rules = [("B", "x", 1.0), ("A", "y", 0.5), ("A", "z", 0.5), ("C", "w", -1.0), ("D", None, 9.0), (None, "x", 9.0)]
    got = _run(spark, ["x y z", "x x y", "w", "", None], rules)
    assert (got[0]["core_issue"], got[0]["evidence"], got[0]["n_matches"]) == ("A", ["y", "z"], 3)
    assert (got[1]["core_issue"], got[1]["score"]) == ("B", 1.0)          # a phrase counts once in a text
    assert [got[i]["core_issue"] for i in (2, 3, 4)] == [L.NO_RULE_ISSUE] * 3


def test_empty_tables_and_bad_terms(spark):
    assert _run(spark, ["x"], [])[0]["core_issue"] == L.NO_RULE_ISSUE
    assert _run(spark, [], [("A", "x", 1.0)]) == {}
    with pytest.raises(ValueError):
        _run(spark, ["x"], [("A", "a.b", 1.0)])


def test_large_table_is_joined_without_broadcast_and_equals_brute_force(spark):
    rules = [(f"issue {i % 7}", f"w{i} w{i + 1}" if i % 2 else f"w{i}", 0.25 * (1 + i % 5)) for i in range(60)]
    texts = [" ".join(f"w{(7 * i + 3 * j) % 64}" if j % 3 else f"w{(7 * i) % 64} w{(7 * i + 1) % 64}," for j in range(12)) for i in range(40)]
    small, large = _run(spark, texts, rules), _run(spark, texts, rules, small_bytes=0)
    assert small == large
    for i, text in enumerate(texts):
        scores = {}
        for issue, term, weight in rules:
            if re.search(rf"\b{term}\b", text):
                scores[issue] = scores.get(issue, 0) + weight
        best = min(scores, key=lambda k: (-scores[k], k)) if scores else L.NO_RULE_ISSUE
        assert (large[i]["core_issue"], large[i]["score"]) == (best, scores.get(best, 0.0))


def test_excluded_model_and_document_neighbours_are_registered(spark):
    specs = load_all()
    assert {"rule_triage_custom", "evaluation_without_ml", "similar_documents", "cluster_documents"} <= set(specs)
    near = specs["similar_documents"].build(spark, "/root/testdata/sf0.001").collect()
    assert near and all(r["doc_id"] % 100 == 0 and r["doc_id"] != r["neighbour_id"] for r in near)


def test_hits_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, "a b, c")], "id long, t string")
    rules = spark.createDataFrame([("A", "a b", 1.0)], "issue string, term string, weight double")
    plan = triage_by_table(df, rules, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_phrases_of_all_lengths(spark):
    texts = ["a b c d e", "a b, c d e", "a", "", "a,b", "x  y \x01 z", "a a a a"]
    lengths = [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", phrases(F.col("t"), lengths).alias("p"))
    for r in df.collect():
        runs = [[w for w in run.split(" ") if w] for run in re.split(r"[^\w ]+", r["t"])]
        want = {" ".join(run[i:i + n]) for run in runs for n in lengths for i in range(len(run) - n + 1)}
        assert sorted(r["p"]) == sorted(want)
