from collections import Counter, defaultdict
from datetime import datetime
from math import comb

import numpy as np

from casewise.llm import sharding as S
from casewise.llm.common import row_digest


def test_hypergeometric_law():
    rng = np.random.default_rng(3)
    good, bad, draws, n = 7, 9, 6, 40_000
    seen = Counter(S.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(7):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9
    big = [S.hypergeometric(rng, 10**10, 23 * 10**10, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 10**6 / 24) < 5 * (10**6 / 24 / 300) ** 0.5


def test_matrix_margins():
    sizes = [0, 5, 1000, 3, 77, 0, 12]
    m = S.communication_matrix(sizes, 5, 1)
    assert [sum(r) for r in m] == sizes
    columns = [sum(c) for c in zip(*m)]
    assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1 and min(map(min, m)) >= 0


def test_exact_sizes_and_slots(spark):
    rows = [(i if i % 7 else None, None if i % 5 == 0 else f"text {i % 50}", 3, {"a": 1}) for i in range(1003)] + [(1, "same", 3, {"a": 1})] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, _part map<string,int>")
    out = S.shard_documents(df.repartition(3), shards=24, rows_per_cell=16, partitions=32).cache()
    per = defaultdict(list)
    for r in out.collect():
        per[r["shard"]].append(r["slot"])
    assert sorted(per) == list(range(24)) and sum(map(len, per.values())) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    again = S.shard_documents(df.repartition(11), shards=24, rows_per_cell=16, partitions=32)
    key = lambda d: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in d.collect())
    assert key(out) == key(again)
    assert out.columns == ["doc_id", "text", "_part", "shard", "slot"]


def test_shuffle_is_uniform(spark):
    """A document's shard and the order inside shards are independent of its id."""
    out = S.shard_documents(spark.range(6000).withColumnRenamed("id", "doc_id"), shards=4, seed=21).collect()
    halves = Counter((r["doc_id"] < 3000, r["shard"]) for r in out)
    assert all(abs(n - 750) < 110 for n in halves.values())
    order = [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.06
    other = S.shard_documents(spark.range(6000).withColumnRenamed("id", "doc_id"), shards=4, seed=22).collect()
    assert {r["doc_id"]: r["shard"] for r in out} != {r["doc_id"]: r["shard"] for r in other}


def test_copies_are_shuffled_like_other_rows(spark):
    """Up-sampled documents and one row that is a third of the table: shards and slots are independent of being a copy."""
    rows = [(i, {"a": i % 2}) for i in range(1000) for _ in range(3)] + [(-1, {"a": k}) for k in (0, 1) for _ in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, m map<string,int>")
    out = S.shard_documents(df.repartition(5), shards=4, rows_per_cell=64, partitions=16).collect()
    assert Counter((r["doc_id"], r["m"]["a"]) for r in out) == Counter((i, m["a"]) for i, m in rows)
    assert max(Counter((r["shard"], r["slot"]) for r in out).values()) == 1
    assert sorted(Counter(r["shard"] for r in out).values()) == [1500] * 4
    where = defaultdict(list)
    for r in out:
        where[r["doc_id"]].append(r["shard"])
    pairs = [a == b for d, (a, b, c) in ((d, v) for d, v in where.items() if d >= 0) for a, b in ((a, b), (b, c), (a, c))]
    assert abs(np.mean(pairs) - 1 / 4) < 0.06
    assert all(abs(n - 750) < 110 for n in Counter(where[-1]).values())
    order = [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    beside = np.mean([a == b for a, b in zip(order, order[1:]) if a == -1])
    assert abs(beside - 1 / 2) < 0.06 and np.mean([a == b for a, b in zip(order, order[1:]) if a >= 0]) < 0.01
    counts = df.select(row_digest(df).alias("_h")).groupBy("_h").count().withColumnRenamed("count", "_n")
    assert S.numbered(counts).distinct().count() == len(rows)


def test_rows_that_differ_in_nested_nulls_only(spark, monkeypatch):
    """Every row comes out as it went in: arrays, structs and maps that differ in the place of a null, text or number forms alike."""
    monkeypatch.setattr(S, "RUN", 4)
    schema = ("doc_id long, tags array<string>, s struct<a: string, b: array<struct<c: int, d: string>>>, m map<string, array<int>>, "
              "x double, t timestamp, b binary")
    cases = [(["x", None], None, None), ([None, "x"], None, None), (["x"], None, None), ([None, None], None, None), ([], None, None),
             (None, None, None), (["x", ""], None, None), (["", "x"], None, None), (["x,"], None, None), (["~"], None, None),
             (None, (None, None), None), (None, (None, []), None), (None, ("", None), None), (None, (None, [(None, None)]), None),
             (None, (None, [None]), None), (None, (None, [(1, None)]), None), (None, (None, [(None, "1")]), None),
             (None, None, {}), (None, None, {"k": None}), (None, None, {"k": []}), (None, None, {"k": [None]}), (None, None, {"k": [None, None]})]
    late = [datetime(2020, 1, 1, 0, 0, 0, n) for n in (1, 2)]
    rows = [(n % 3 or None, *c, None, None, None) for n in range(9) for c in cases]
    rows += [(1, None, None, None, x, t, b) for x in (0.0, -0.0, None, float("nan")) for t in (None, *late) for b in (None, b"", b"a", b"\xff")] * 2
    df = spark.createDataFrame(rows, schema)
    out = S.shard_documents(df.repartition(3), shards=3, partitions=8).drop("shard", "slot")
    text = lambda d: Counter(map(repr, d.collect()))
    assert text(out) == text(df) and out.dtypes == df.dtypes


def test_small_and_empty(spark):
    df = spark.range(5).withColumnRenamed("id", "doc_id")
    assert sorted(r["shard"] for r in S.shard_documents(df).collect()) == [0, 1, 2, 3, 4]
    assert S.shard_documents(df.limit(0)).count() == 0
