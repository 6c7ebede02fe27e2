"""Embedding whitening by QDWH spectral divide and conquer.

Entries are quantised, ``x = floor(64 c) + 1000000``.  A first pass sums each
dimension (S) and counts rows (n), a second sums the products of entries
centred by the whole number next to S / n.  Both are exact whole numbers, so
``V = sum (x - S/n)(x - S/n)^T / n`` comes out correctly rounded and does not
depend on how rows were dealt.

``spectrum`` splits V on the driver.  For a shift s the polar decomposition
of ``V - s I``, by QDWH iterations (QR steps first, Cholesky steps once the matrix is
well conditioned), has the matrix sign as its orthogonal factor U.
``(U + I) / 2`` projects on the eigenvectors above the shift; bases of its range and of
the rest split V into two smaller matrices, down to single components.  Then the
leading ``components`` vectors are shipped with the task and every row is projected.
A third pass measures the covariance of the whitened rows.  The driver holds
matrices of width x width numbers only, whatever the number of rows.

Edge cases: rows whose vector is null or empty or holds a null, NaN, infinite or
huge entry (2^47 or more) are dropped, as are rows of another width than
the most frequent (ties: the larger); components whose variance is rounding
error (at most width x 2^-52 of the largest) are left out, so one row or equal
rows give an empty result; equal eigenvalues get any orthonormal basis of
their space, the same for all rows; a deviation beyond a long is null; null,
equal and non-numeric ids pass through; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SCALE, OFFSET = 64, 1_000_000
LARGEST = float(1 << 47)
EPS = 2.0 ** -52


# ---------------------------------------------------------------------------
# Spectral divide and conquer (driver, width x width)
# ---------------------------------------------------------------------------

def polar_sign(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: its sign function."""
    n = len(a)
    eye = np.eye(n)
    bound = min(np.linalg.norm(a), np.abs(a).sum(axis=0).max())
    x = a / bound
    low = EPS  # no singular value that counts is smaller, relative to the largest
    for _ in range(40):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        r = np.sqrt(1 + d)
        wa = r + np.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * r)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x @ x), x)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _split(a: np.ndarray, shift: float, rng: np.random.Generator):
    """Orthonormal bases of the eigenvectors above and below ``shift``, and what couples them; None if one is empty."""
    n = len(a)
    above = (polar_sign(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(above)))
    if not 0 < k < n:
        return None
    basis = above @ rng.standard_normal((n, k))
    for _ in range(2):
        basis = above @ np.linalg.qr(basis)[0]
    q = np.linalg.qr(basis, mode="complete")[0]
    return q[:, :k], q[:, k:], np.linalg.norm(q[:, k:].T @ a @ q[:, :k])


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    scale, rng, values, vectors = np.linalg.norm(v), np.random.default_rng(12), [], []
    todo = [(v, np.eye(len(v)))] if len(v) else []
    while todo:
        a, basis = todo.pop()
        n, mean = len(a), np.trace(a) / len(a)
        if n == 1 or np.linalg.norm(a - mean * np.eye(n)) <= n * EPS * scale:
            values += [mean] * n if n > 1 else [a[0, 0]]
            vectors += list(basis.T)
            continue
        # The mean lies strictly between the least and the largest eigenvalue; other shifts avoid one that hits an eigenvalue.
        spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
        best = None
        for shift in (np.median(np.diag(a)), mean, *(mean + spread * rng.uniform(-0.9, 0.9) for _ in range(20))):
            cut = _split(a, shift, rng)
            if cut is not None and (best is None or cut[2] < best[2]):
                best = cut
            if best is not None and best[2] <= 10 * n * EPS * scale:
                break
        if best is None:  # all eigenvalues within rounding of each other
            values += list(np.diag(a))
            vectors += list(basis.T)
            continue
        for q in best[:2]:
            part = q.T @ a @ q
            todo.append(((part + part.T) / 2, basis @ q))
    order = np.argsort(-np.array(values), kind="stable")
    found = np.array(vectors).T[:, order] if vectors else np.zeros((0, 0))
    if len(found):
        found = np.linalg.qr(found)[0] * np.sign(np.einsum("ij,ij->j", np.linalg.qr(found)[0], found))
    return np.einsum("ij,ij->j", found, v @ found) if len(found) else np.zeros(0), found


# ---------------------------------------------------------------------------
# Passes over the rows
# ---------------------------------------------------------------------------

def _quantised(column, width: int) -> np.ndarray:
    """Rows of whole numbers ``floor(64 c)`` as doubles (all below 2^53, so exact)."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(values.reshape(-1, width) * SCALE)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Sum of outer products of whole numbers, as Python integers."""
    largest = float(np.abs(y).max(initial=0))
    rows = int(2.0 ** 52 // max(largest * largest, 1))
    if rows < 1:
        big = y.astype(np.int64).astype(object)
        return big.T @ big
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for at in range(0, len(y), rows):
        total += (y[at:at + rows].T @ y[at:at + rows]).astype(np.int64).astype(object)
    return total


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(``_id``, ``_v``: array of double) of the rows that count, and their width (0: none)."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    good = rows.filter(F.coalesce((F.size("_v") > 0) & F.forall("_v", lambda e: F.coalesce(F.abs(e) < LARGEST, F.lit(False))),
                                  F.lit(False)))
    widths = good.groupBy(F.size("_v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = widths["w"] if widths else 0
    return good.filter(F.size("_v") == width), width


def moments(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of x, and the covariance V of x (correctly rounded)."""

    def sums(batches):
        n, total = 0, np.zeros(width, dtype=object)
        for b in batches:
            q = _quantised(b.column(0), width)
            n += len(q)
            for at in range(0, len(q), 32):  # 32 numbers below 2^53 are summed exactly as 64-bit integers
                total += q[at:at + 32].astype(np.int64).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width + 1), pa.int32()),
                                          "s": pa.array([Decimal(int(t)) for t in [*total, n]], pa.decimal128(38, 0))})

    got = {r["i"]: int(r["s"]) for r in rows.select("_v").mapInArrow(sums, "i int, s decimal(38,0)")
           .groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    n = got.get(width, 0)
    if not n:
        return 0, [], np.zeros((0, 0))
    raw = [got[i] for i in range(width)]
    centre = [(2 * s + n) // (2 * n) for s in raw]  # the whole number next to the mean
    at = np.array(centre, dtype=np.float64)
    upper = np.triu_indices(width)

    def products(batches):
        total = np.zeros((width, width), dtype=object)
        for b in batches:
            total += _exact_products(_quantised(b.column(0), width) - at)
        yield pa.RecordBatch.from_pydict({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()),
                                          "s": pa.array([Decimal(int(t)) for t in total[upper]], pa.decimal128(38, 0))})

    v, left = np.zeros((width, width)), [s - n * c for s, c in zip(raw, centre)]
    for r in (rows.select("_v").mapInArrow(products, "i int, j int, s decimal(38,0)").groupBy("i", "j")
                  .agg(F.sum("s").cast("decimal(38,0)").alias("s")).toLocalIterator()):
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["s"]) - left[i] * left[j]) / (n * n)  # whole numbers, one rounding
    return n, [s + n * OFFSET for s in raw], v


def fit_whitening(rows: DataFrame, width: int, components: int = 32) -> dict:
    """n, S, mean, projection (width x components, scaled), explained shares, and the measured identity error."""
    n, sums, v = moments(rows, width)
    if not n:
        return {"n": 0, "sums": [], "width": width, "matrix": np.zeros((width, 0)), "explained": [], "identity_error": 0.0}
    values, vectors = spectrum(v)
    keep = int(min(components, np.count_nonzero(values > width * EPS * max(values[0], 0.0))))
    model = {"n": n, "sums": sums, "width": width, "matrix": vectors[:, :keep] / np.sqrt(values[:keep]),
             "vectors": vectors[:, :keep], "explained": (values[:keep] / np.trace(v)).tolist() if keep else []}
    if not keep:
        return model | {"identity_error": 0.0}
    project = _projector(model)

    def spread(batches):
        total, first = np.zeros((keep, keep)), np.zeros(keep)
        for b in batches:
            w = project(_quantised(b.column(0), width))[0]
            total, first = total + w.T @ w, first + w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(keep + 1, dtype=np.int32), keep),
                                          "j": np.tile(np.arange(keep, dtype=np.int32), keep + 1),
                                          "s": np.concatenate([total.ravel(), first])})

    c = np.zeros((keep + 1, keep))
    for r in rows.select("_v").mapInArrow(spread, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        c[r["i"], r["j"]] = r["s"] / n
    covariance = c[:keep] - np.outer(c[keep], c[keep])
    return model | {"identity_error": float(np.abs(covariance - np.eye(keep)).max())}


def _projector(model: dict):
    """Function from rows of ``floor(64 c)`` to (whitened rows, centred whole numbers times n, less what is left)."""
    n = model["n"]
    raw = [s - n * OFFSET for s in model["sums"]]
    centre = [(2 * s + n) // (2 * n) for s in raw]
    at = np.array(centre, dtype=np.float64)
    left = [s - n * c for s, c in zip(raw, centre)]
    rest = np.array([k / n for k in left])
    matrix = model["matrix"]

    def project(q: np.ndarray):
        y = q - at
        return (y - rest) @ matrix, y, left

    return project


def _deviations(y: np.ndarray, left: list[int], n: int) -> list:
    """Exact sum over dimensions of (n x - S)^2 of each row; None beyond a long."""
    largest = n * float(np.abs(y).max(initial=0)) + max(map(abs, left), default=0)
    if largest * largest * max(y.shape[1], 1) < 2.0 ** 62:
        d = y.astype(np.int64) * n - np.array(left, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    d = y.astype(np.int64).astype(object) * n - np.array(left, dtype=object)
    return [s if s < 1 << 63 else None for s in map(int, (d * d).sum(axis=1))]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows, width = usable(df, id_col, vec_col)
    model = fit_whitening(rows, width, components)
    id_type = df.schema[id_col].dataType
    schema = (f"`{id_col}` {id_type.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    keep, n, project = len(model["explained"]), model["n"], _projector(model) if model["n"] else None
    explained, error, kind = np.array(model["explained"]), model["identity_error"], to_arrow_type(id_type)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows if keep else 0, 4096):
                part = b.slice(at, 4096)
                w, y, left = project(_quantised(part.column(1), width))
                each = np.repeat(np.arange(len(w)), keep)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)).cast(kind), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(w))),
                    pa.array(np.full(len(each), n)), pa.array(_deviations(y, left, n), pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel()), pa.array(np.tile(explained, len(w))), pa.array(np.full(len(each), error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
