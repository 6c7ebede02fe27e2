"""Phrase matching of rule terms against the regexes it stands for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from casewise.functions import lexicon as L
from casewise.functions import phrases as P
from casewise.functions.text import normalize_text
from casewise.operators import rules as R


def test_every_built_in_term_is_unfolded_to_what_it_matches():
    for term in L.rule_terms():
        found = P.unfold(term.regex)
        assert found and all(re.fullmatch(term.regex, p) for p in found)
        # No text built of the pattern's words is matched whole but missing from the set.
        words = sorted(set(re.findall(r"[a-z0-9]+", " ".join(found))))
        rng = random.Random(term.ord)
        for _ in range(300):
            text = " ".join(rng.choices(words, k=rng.randint(1, 3))) if rng.random() < 0.8 else "".join(rng.choices(words, k=2))
            assert bool(re.fullmatch(term.regex, text)) == (text in found), (term.regex, text)


@pytest.mark.parametrize("pattern", [r"\bcat+\b", r"refund", r"\b(a|b", r"\brefund\w*\b", r"\b[ab]c\b", r"\bfoo-bar\b", r"\b\s+x\b", r"\b(x{1,9}){2,3}\b"])
def test_other_patterns_stay_regexes(pattern):
    try:
        re.compile(pattern)
    except re.error:
        return
    assert P.unfold(pattern) is None


def test_hits_equal_python_regexes(spark):
    """Random texts made of phrases, their parts, borders of all kinds and other words."""
    terms = L.rule_terms() + [L.Term(77, "pattern", r"\bre(fund)+s?\b", r"\bre(fund)+s?\b", "Refund delay", 0, 2.0)]
    whole = [p for t in terms[:-1] for p in P.unfold(t.regex)]
    bits = whole + [w for p in whole for w in p.split(" ")] + ["", "the", "über", "café", "refundrefunds", "x_y", "500", "ı", "ſ"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", " ", "  ", "\n", ", ", "-", "_", ".", "! ", "é", " ", "'s ", "0", "\x01", " \x01 "])
                     for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = R.with_hits(df.withColumn("_rt_t", normalize_text(F.col("text"))), terms).select("id", "_rt_t", "_rt_hits").collect()
    n = 0
    for r in got:
        want = [at for at, t in enumerate(terms) if re.search(t.regex, r["_rt_t"])]
        assert r["_rt_hits"] == want, r["_rt_t"]
        n += len(want)
    assert n > 1500


def test_substring_terms(spark):
    texts = [" ".join(x) for x in zip(*(random.Random(k).choices(
        [w for _, ws in L.ENTITY_VOCAB for w in ws] + L.HIGH_PRIORITY_TERMS + ["happy", "reordered", "xurgently", "none"], k=200) for k in range(3)))] + ["", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "complaint_text string")
    for r in R.rule_triage(df).select("complaint_text", "analysis.detected_entities").collect():
        assert r["detected_entities"] == [label for label, ws in L.ENTITY_VOCAB if any(w in r["complaint_text"] for w in ws)]
