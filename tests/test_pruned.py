"""Pruned exact search against the full search and numpy."""

import numpy as np
import pandas as pd
import pytest

from casewise.operators import similar as S
from casewise.operators.pruned import Bounds, _angles, pruned_top_k


def rows_of(df):
    return sorted((r["qid"], r["rank"], r["did"], r["score"]) for r in df.collect())


def sparse_rows(rng, n, templates=6, width=40):
    base = [rng.integers(0, width, 12) for _ in range(templates)]
    out = [np.concatenate([base[rng.integers(templates)], rng.integers(0, width, rng.integers(0, 5))]).tolist() for _ in range(n - 3)]
    return out + [[], [3], [3, 3, 3]]


@pytest.mark.parametrize("exclude_self", [False, True])
def test_sparse_equals_full_search(spark, exclude_self):
    rng = np.random.default_rng(1)
    rows = sparse_rows(rng, 700)
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "did long, v array<int>").repartition(4)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(rows[:150] + rows[-3:])], "qid long, v array<int>")
    report = {}
    got = pruned_top_k(queries, corpus, 4, width=40, exclude_self=exclude_self, q_block=40, d_block=50, report=report)
    want = S.top_k_similar(queries, corpus, 4, width=40, exclude_self=exclude_self)
    assert rows_of(got) == rows_of(want)
    assert report["scored"] < 0.8 * report["pairs"] and report["tile_pairs_seen"] <= report["tile_pairs"]


@pytest.mark.parametrize("normalize", [False, True])
def test_dense_equals_full_search(spark, normalize):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 10)) * 3
    m = centres[rng.integers(8, size=500)] + rng.standard_normal((500, 10)) * 0.3
    m[7] = 0
    m[8:20] = m[20]                                        # ties
    m *= rng.uniform(0.1, 4, (500, 1))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "did long, v array<double>")
    queries = df.withColumnRenamed("did", "qid").where("qid % 5 = 0 OR qid = 7")
    args = dict(mode="dense", exclude_self=True, normalize=normalize)
    assert rows_of(pruned_top_k(queries, df, 5, d_block=64, **args)) == rows_of(S.top_k_similar(queries, df, 5, **args))


def test_bounds_hold():
    """No member of a tile scores above the tile's bound."""
    rng = np.random.default_rng(3)
    rows = np.abs(rng.standard_normal((400, 12))) ** 3
    pivots = rows[:20] / np.linalg.norm(rows[:20], axis=1)[:, None]
    angle, norm = _angles(rows, pivots)
    tile = angle.argmin(axis=1)
    a = np.column_stack([angle[np.arange(400), tile], angle])
    stats = [{"tile": t, "n": int((tile == t).sum()), "norm": norm[tile == t].max(), "low": a[tile == t].min(axis=0),
              "high": a[tile == t].max(axis=0)} for t in np.unique(tile)]
    queries = rng.standard_normal((50, 12))
    for scaled in (True, False):
        _, upper = Bounds(pivots, stats).upper(queries, scaled)
        score = queries @ rows.T
        if scaled:
            score /= np.linalg.norm(queries, axis=1)[:, None] * norm[None, :]
        for col, s in enumerate(stats):
            assert (score[:, tile == s["tile"]].max(axis=1) <= upper[:, col] + 1e-9).all()


def test_small_and_empty(spark):
    none = spark.createDataFrame([], "did long, v array<int>")
    one = spark.createDataFrame([(1, [2, 3]), (2, [])], "did long, v array<int>")
    q = spark.createDataFrame([(9, [3]), (8, [])], "qid long, v array<int>")
    assert pruned_top_k(q, none, 3, width=5).collect() == []
    assert [(r["qid"], r["did"]) for r in pruned_top_k(q, one, 3, width=5).collect()] == [(9, 1)]
    assert pruned_top_k(q, one.where("did = 2"), 3, width=5).collect() == []
    assert pruned_top_k(q.limit(0), one, 3, width=5).collect() == []


def test_few_queries_of_a_large_corpus_take_the_full_search(spark, monkeypatch):
    """The number of pairs decides: 5 queries of 60 vectors are fewer pairs than 20 vectors have among themselves."""
    from casewise.operators import pruned

    def never(*args, **kw):
        raise AssertionError("pruned")

    rows = sparse_rows(np.random.default_rng(5), 60)
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "did long, v array<int>")
    queries = corpus.where("did < 5").withColumnRenamed("did", "qid")
    want = rows_of(S.top_k_similar(queries, corpus, 4, width=40))
    monkeypatch.setattr(pruned, "pruned_top_k", never)
    assert rows_of(S.search(queries, corpus, 4, full_up_to=20, width=40)) == want


def test_routed_queries_leave_in_small_batches(spark, monkeypatch):
    """A batch of routed queries holds few vector entries however many tiles a query goes to; the rows are the same."""
    from casewise.operators import pruned
    rows = sparse_rows(np.random.default_rng(6), 300)
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "did long, v array<int>")
    queries = corpus.where("did % 3 = 0").withColumnRenamed("did", "qid")
    want = rows_of(S.top_k_similar(queries, corpus, 4, width=40))
    monkeypatch.setattr(pruned, "MOST_ENTRIES", 64)
    assert rows_of(pruned_top_k(queries, corpus, 4, width=40)) == want


@pytest.mark.parametrize("exclude_self", [False, True])
def test_blocks_score_few_pairs_twice(monkeypatch, exclude_self):
    """The block kernel agrees with plain numpy, ties to the smaller id, and scores few pairs in float64."""
    import pandas as pd
    rng = np.random.default_rng(8)
    rows = sparse_rows(rng, 1500, templates=12)
    rows[40:60] = [rows[40]] * 20                          # ties
    ids = rng.permutation(1500)
    scored = []
    plain = S._exact_sparse
    monkeypatch.setattr(S, "_exact_sparse", lambda *a: scored.append(len(a[4])) or plain(*a))
    fn = S._block_fn("sparse", 4, 40, exclude_self, True)
    got = fn(pd.DataFrame({"qid": ids, "v": rows}), pd.DataFrame({"did": ids, "v": rows}))
    m = np.array([np.bincount(np.array(r, dtype=int), minlength=40) for r in rows], dtype=np.float64)
    n2 = (m * m).sum(axis=1)
    score = (m @ m.T) / np.sqrt(np.maximum(n2[:, None] * n2[None, :], 1))
    if exclude_self:
        np.fill_diagonal(score, 0)
    want = set()
    for i in range(1500):
        best = sorted((-score[i, j], ids[j]) for j in np.flatnonzero(score[i] > 0))[:4]
        want |= {(ids[i], d, -s) for s, d in best}
    assert {(r.qid, r.did, r.score) for r in got.itertuples()} == want
    assert sum(scored) < 0.05 * 1500 * 1500


def _counts(spark, n, seed, key):
    """Sparse vectors of a few kinds with ties, copies, empty and null lists."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [int(x) for x in np.r_[np.arange(6), 10 * (i % 9) + rng.integers(0, 8, 6), rng.integers(100, 104, 2)]]
        rows.append((i * 7 % n, None if i % 61 == 0 else [] if i % 53 == 0 else v))
    return spark.createDataFrame(rows, f"{key} long, v array<int>")


def test_tiles_of_count_vectors_give_the_rows_of_the_full_search(spark):
    from casewise.operators import pruned, similar
    q, d = _counts(spark, 400, 1, "qid"), _counts(spark, 900, 2, "did")
    for args in ({"k": 5}, {"k": 3, "exclude_self": True}):
        full = sorted(map(tuple, similar.top_k_similar(q, d, width=128, **args).collect()))
        tiled = sorted(map(tuple, pruned.tiled_top_k(q, d, width=128, q_block=64, d_block=100, centres=30, **args).collect()))
        assert tiled == full and full


def test_tiles_of_count_vectors_with_few_or_no_entries(spark):
    from casewise.operators import pruned, similar
    q = spark.createDataFrame([(1, [1, 2]), (2, [5]), (3, []), (4, [1, 1])], "qid long, v array<int>")
    for rows in ([(9, [1]), (8, [2, 1]), (7, [])], [(9, [])], []):
        d = spark.createDataFrame(rows, "did long, v array<int>")
        assert sorted(map(tuple, pruned.tiled_top_k(q, d, 5, width=16).collect())) == sorted(
            map(tuple, similar.top_k_similar(q, d, 5, width=16).collect()))


def test_tiles_multiply_fewer_pairs(spark):
    """A block of queries that knows its k-th scores leaves out the tiles that cannot reach them."""
    from casewise.operators import pruned
    centres = np.zeros((2, 16))
    centres[0, :2], centres[1, 8:10] = 0.5 ** 0.5, 0.5 ** 0.5
    seen = []
    plain, pruned._exact_sparse = pruned._exact_sparse, lambda qm, dm, a, b, rows, cols: seen.append(len(rows)) or plain(qm, dm, a, b, rows, cols)
    try:
        run = pruned._tiles_block_fn(centres, 1, 16, False)
        d = pd.DataFrame({"did": [1, 2, 3, 4], "v": [[0, 1], [0, 0, 1], [8, 9], [8, 8, 9]], "tile": [0, 0, 1, 1]})
        got = run(pd.DataFrame({"qid": [5], "v": [[0, 1]], "reached": [1.0]}), d)
    finally:
        pruned._exact_sparse = plain
    assert got[["qid", "did"]].values.tolist() == [[5, 1]] and sum(seen) == 1


def test_large_sparse_searches_take_the_tiles(spark, monkeypatch):
    from casewise.operators import pruned, similar
    called = []
    monkeypatch.setattr(pruned, "tiled_top_k", lambda q, d, k, **a: called.append(a) or similar.top_k_similar(q, d, k, **a))
    q, d = _counts(spark, 50, 1, "qid"), _counts(spark, 60, 2, "did")
    similar.search(q, d, 3, width=128, tiled_from=1000)
    similar.search(q, d, 3, width=128)
    assert called == [{"width": 128}]
