import itertools
import math

import numpy as np
import pytest
from conftest import SF_MID

from casewise.llm import langid as L
from casewise.llm.queries import op6_language_id


def brute(word, pieces, probs):
    """Sum over all segmentations of the marked word, letter by letter fallback included."""
    marked = L.START + word
    index = {p: i for i, p in enumerate(pieces)}
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(marked)]
        p, start = 1.0, 0
        for end in ends:
            part = marked[start:end]
            known = probs[index[part]] if part in index else 0.0
            if end - start == 1:
                known += L.BARE_START if start == 0 else L.UNKNOWN
            p, start = p * known, end
        total += p
    return total


PIECES = ["▁a", "▁ab", "ab", "b", "ba", "abc", "c", "▁", "é"][:7] + ["é"]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    probs = np.zeros((len(PIECES) + 1, 2))
    probs[:-1] = rng.dirichlet(np.ones(len(PIECES)), 2).T
    words = ["a", "ab", "abc", "abab", "bac", "xa", "é", "cabé", "abcabc"]
    got = L.forward(L.Lattice(PIECES), probs, words)
    for w, row in zip(words, got):
        for j in range(2):
            assert row[j] == pytest.approx(math.log(brute(w, PIECES, probs[:, j])), rel=1e-9), w


def test_expected_counts_by_differences():
    """The expected count of a piece is the derivative of log P by the log of its probability."""
    probs = np.append(np.random.default_rng(1).dirichlet(np.ones(len(PIECES))), 0.0)
    lattice, words, weights = L.Lattice(PIECES), ["abab", "abc", "xab"], np.array([2.0, 1.0, 3.0])
    got = L.expected_counts(lattice, probs, words, weights)
    for i in range(len(PIECES)):
        up = probs.copy()
        up[i] *= 1 + 1e-6
        change = (L.forward(lattice, up[:, None], words) - L.forward(lattice, probs[:, None], words))[:, 0] @ weights / 1e-6
        assert got[i] == pytest.approx(change, abs=1e-3)


def test_edge_rows(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"),
                                   (None, "en"), ("", "de"), ("le chat", None)] * 4)], "doc_id long, text string, lang string")
    model = L.train(train)
    assert model["languages"] == ["de", "en"]
    texts = [None, "", " 12 ... ²³", "the dog", "die Katze", "THE CAT " * 40_000, "x" * 5000, "日本語", "İ"]
    df = spark.createDataFrame([(i, t, "fr", "src", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, _in string, score int")
    got = {r["doc_id"]: r for r in L.predict(df, model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert all(got[i]["lang_pred"] in ("de", "en") for i in (6, 7, 8))
    assert all(0 <= r["score"] <= 1 and r["_in"] == "src" for r in got.values())
    none = L.train(train.filter("lang = 'xx'"))
    assert {r["lang_pred"] for r in L.predict(df, none).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0


def test_memo_limit_changes_nothing():
    import pandas as pd
    model = L.fit([("en", "the", 5), ("en", "cat", 2), ("de", "der", 5), ("de", "hund", 2)], L.load_pieces())
    texts = [pd.Series(["the cat", "der hund", "den hut"]), pd.Series(["hat the hund", None])]
    a = pd.concat(L.scorer(model)(iter(texts)))
    b = pd.concat(L.scorer(model, memo=2)(iter(texts)))
    assert (a["lang_pred"].tolist() == b["lang_pred"].tolist()) and np.allclose(a["score"], b["score"])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    got = op6_language_id(spark, SF_MID).join(docs, "doc_id").filter("held_out and lang is not null")
    right, n = got.filter("lang = lang_pred").count(), got.count()
    assert n > 100 and right >= 0.98 * n
