"""Naive Bayes against a plain statement of its formula; TF-IDF against numpy."""

import hashlib
import math
from collections import Counter

from casewise.operators import bayes as NB
from casewise.operators import terms as TM


def bucket(word):
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 384


def test_naive_bayes(spark):
    rows = [("late parcel late", "Logistics"), ("parcel lost", "Logistics"), ("card charged twice", "Billing"), (None, "Billing"), ("odd", None)]
    train = spark.createDataFrame(rows, "complaint_text string, true_department string")
    model = NB.fit_one(train, "true_department", "complaint_text")
    assert model.labels == ["Billing", "Logistics"]
    texts = ["parcel late", "card", "", "unseen words here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, complaint_text string")
    labelled = train.selectExpr("*", "true_department AS true_core_issue", "'Low' AS true_priority")
    got = [r.ml for r in NB.bayes_triage(df, NB.fit(labelled)).orderBy("id").collect()]
    counts = {c: Counter(bucket(w) for t, d in rows if d == c and t for w in t.split()) for c in model.labels}
    for text, verdict in zip(texts, got):
        score = {}
        for c in model.labels:
            n = counts[c].total()
            score[c] = round(1000 * math.log(2 / 4)) + sum(round(1000 * math.log((counts[c][bucket(w)] + 1) / (n + 384))) for w in text.split())
        want = max(sorted(score), key=lambda c: score[c])
        assert verdict.department == want
    assert got[0].department == "Logistics" and got[1].department == "Billing"


def test_tfidf(spark):
    docs = ["red fox red", "red dog", "blue dog the fox", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, text string")
    counts = TM.term_counts(df, "id", "text")
    stats = TM.term_stats(counts, 4)
    assert {r.term: r.df for r in stats.collect()} == {"red": 2, "fox": 2, "dog": 2}
    idf = math.log(5 / 3) + 1
    x = {"red": (1 + math.log(2)) * idf, "fox": idf}
    norm = math.sqrt(sum(v * v for v in x.values()))
    got = {r.term: r.weight for r in TM.tfidf(counts, stats).where("id = 0").collect()}
    assert all(abs(got[t] - x[t] / norm) < 1e-12 for t in x) and len(got) == 2
