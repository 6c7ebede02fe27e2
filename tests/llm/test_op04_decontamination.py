import random
from collections import Counter

from casewise.llm import decontaminate as D


def brute(text, item):
    """Best similarity and first start over all windows of the item's size."""
    words, want = D.words_of(text), D.words_of(item)
    if not words or not want:
        return None
    k, n = min(5, len(want)), min(len(want), len(words))
    target = Counter(D.shingles(want, k))
    found = [(D.weighted_jaccard(Counter(D.shingles(words[s:s + n], k)), target), -s) for s in range(len(words) - n + 1)]
    best = max(found)
    return (-best[1], n, best[0]) if best[0] >= 0.8 else None


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)] + ["Été", "naïve", "x_1"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [prose(rng.choice([4, 9, 18, 30, 45, 70])) for _ in range(25)] + [None, "", "...", "one"]
    items.append(items[0])
    texts = [None, "", "!!!", "one", prose(3000)]
    for _ in range(120):
        item = rng.choice(items[:25]).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            item[rng.choice([0, 1, len(item) - 1, rng.randrange(len(item))])] = "changed"
        if rng.random() < 0.2:
            item = item[:int(len(item) * 0.9)]
        text = " ".join(item).upper() if rng.random() < 0.3 else ",  ".join(item) + "."
        texts.append(" ".join([prose(rng.randint(0, 80)), text, prose(rng.randint(0, 80))]).strip())
    return texts, items


def test_equals_brute_force(spark):
    texts, items = make(4)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, j): b for i, t in enumerate(texts) for j, x in enumerate(items) if (b := brute(t, x))}
    for block in (20_000, 7):
        got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], r["similarity"])
               for r in D.matches(docs, bench, items_per_block=block).collect()}
        assert got == want and len(want) > 60
    clean = {r["doc_id"] for r in D.clean(docs, bench, items_per_block=7).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "m")], "doc_id long, text string, _m string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).count() == 0
    assert D.clean(docs, none).collect() == docs.collect()
    assert D.clean(docs.limit(0), docs.selectExpr("doc_id as item_id", "text")).count() == 0
