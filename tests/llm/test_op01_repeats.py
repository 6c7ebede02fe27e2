import random
from collections import Counter

import pytest

from casewise.llm import repeats


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        spans = [i for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(d), sum(gone), len(spans), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    texts = [None, "", "short", "x" * 700, "ab" * 500, "x" * 399, "x" * 400]
    for _ in range(50):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s) + 1), 2))
            parts += [rng.choice([s, s[a:b], s[:a] + "Z" + s[a:]]), text(rng.randint(0, 20))]
        texts.append(" ".join(parts))
    twice = rng.sample(texts, 8)
    return texts + twice + [shared[0] * 3]


@pytest.mark.parametrize("seed,window", [(1, 400), (2, 40)])
def test_equals_brute_force(spark, seed, window):
    texts = corpus(seed)
    rows = [(i if i % 9 else None, t, "extra", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _data string, core int").repartition(3)
    got = repeats.remove_repeats(df, window=window).collect()
    have = Counter((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]),
                    bytes(r["kept"])) for r in got)
    assert have == Counter((i if i % 9 else None, *b) for i, b in enumerate(brute(texts, window)))


def test_slices_of_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = [body, "q" + body[1000:5000], body[2500:2890]]
    one = [repeats.runs_of(t.encode(), 400, 100) for t in texts]
    whole = [[x.tolist() for x in part] for part in one[0]]
    monkeypatch.setattr(repeats, "SLICE_BITS", 10)
    cut = [[x.tolist() for x in part] for part in repeats.runs_of(texts[0].encode(), 400, 100)]
    flat = lambda parts: [(b + k, o - k) for p in parts for b, o, n in zip(*p) for k in range(n)]
    assert flat(cut) == flat(whole)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).count() == 0
