import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF_SMALL

from casewise.llm import whitening as W
from casewise.llm.queries import op12_whitening


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1, 1], [3, 3, 1, 1, 0, 0], [1e6, 1, 1e-6], [0, 0], [7], [2, 2 + 1e-9, 1], list(range(40, 0, -1)),
    [1e8] + [1e-3] * 5])
def test_spectrum(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    e, v = W.spectrum(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.all(np.diff(e) <= 1e-14 * size)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size, rtol=0)
    assert np.linalg.norm(v.T @ v - np.eye(len(e))) < 1e-12
    assert np.linalg.norm(a @ v - v * e) < 1e-13 * size * len(e)


def test_polar_factor():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.allclose(W.polar_sign(a), v @ np.diag(np.sign(e)) @ v.T, atol=1e-12)


def slow(rows, k=32):
    """Whitening by exact fractions and a library eigensolver."""
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    n, width = len(kept), len(kept[0][1])
    s = [sum(x[d] for _, x in kept) for d in range(width)]
    dev = [[n * x[d] - s[d] for d in range(width)] for _, x in kept]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in dev), n ** 3)) for j in range(width)] for i in range(width)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    w = (np.array([[float(Fraction(c, n)) for c in r] for r in dev]) @ u) / np.sqrt(e)
    return kept, n, [sum(c * c for c in r) for r in dev], w, e / np.trace(v)


def compare(got, rows):
    kept, n, deviation, w, explained = slow(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == w.size and set(by) == {i for i, _ in kept}
    sign = None
    for row, (i, _) in enumerate(kept):
        mine = [by[i][c + 1] for c in range(w.shape[1])]
        sign = sign or [math.copysign(1, a["whitened"]) * math.copysign(1, b) for a, b in zip(mine, w[row])]
        assert {a["n"] for a in mine} == {n} and {a["deviation"] for a in mine} == {deviation[row]}
        assert np.allclose([a["whitened"] * s for a, s in zip(mine, sign)], w[row], atol=1e-8)
        assert np.allclose([a["explained"] for a in mine], explained, rtol=1e-9)
        assert all(0 <= a["identity_error"] < 1e-10 for a in mine)


def test_given_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(op12_whitening(spark, SF_SMALL).collect(), rows)


def test_bad_rows_and_offsets(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal([1e6, -3, 0.01, 5], [50, 1, 0.5, 2])]) for i in range(300)]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 2.0, 3.0]), (903, [float("inf"), 1.0, 2.0, 3.0]),
           (904, []), (905, [1.0, 2.0]), (906, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<double>, n int, whitened string")
    compare(W.whiten(df.repartition(5)).collect(), good)


def test_degenerate(spark):
    schema = "vec_id string, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([("a", None)], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 3, schema)).collect() == []
    # One direction only: one component; repeated rows and a null id stay.
    rows = [(None if t == 2 else str(t), [float(t), 2.0 * t, 0.0]) for t in (0, 1, 2, 3, 3)]
    got = W.whiten(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and {r["component"] for r in got} == {1}
    assert sum(r["whitened"] ** 2 for r in got) == pytest.approx(5) and {round(r["explained"], 12) for r in got} == {1.0}
    # A deviation beyond a long is null.
    got = W.whiten(spark.createDataFrame([("a", [1e12]), ("b", [-1e12])], schema)).collect()
    assert [r["deviation"] for r in got] == [None, None] and [abs(r["whitened"]) for r in got] == pytest.approx([1, 1])
