"""Hashed text vectors (M1-M3) and exact top-k inner-product search.

Vectors
    Tokens are runs of two or more word characters of the lower-cased text.
    Each token goes to bucket ``int(md5(token)[:8], 16) % width`` (unsigned
    counts, no sign flip) and the vector is L2-normalized.  The bucket rule is
    plain SQL, so DuckDB computes the same vectors.

Search
    Exact search is quadratic by nature; the job spreads it evenly instead of
    shipping a side whole anywhere.  Queries are hashed into ``QB`` blocks and
    the corpus into ``CB`` blocks (sizes come from two counts).  Each query row
    is replicated to the ``CB`` corpus blocks and each corpus row to the ``QB``
    query blocks; ``cogroup`` on ``(qb, cb)`` puts one query block and one
    corpus block into one task, where numpy multiplies them and keeps the
    local top-k per query.  A final ``row_number`` window (partial + final
    WindowGroupLimit) merges the ``CB`` local lists.  No task ever holds more
    than one block pair; no hot key exists because blocks are hash-assigned.

    Larger corpora go through ``pruned.pruned_top_k``, which runs the same block
    products on tiles that bounds do not rule out.

Exactness
    Float32 block products only pick candidates; those are scored again in
    float64, where integer counts are exact, so the similarity
    ``dot / sqrt(n2q * n2d)`` has the same bits as the SQL oracle.  Ties go to
    the smaller corpus id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicon import HASH_WIDTH
from ..functions.text import normalize_text
from ..session import materialize

HASH_TOKEN = r"[\p{L}\p{N}_]{2,}"


def hash_tokens(text, width: int = HASH_WIDTH) -> Column:
    """M1: array of bucket ids, one per token occurrence."""
    col = F.col(text) if isinstance(text, str) else text
    toks = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(HASH_TOKEN), 0)
    return F.transform(toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"),
                                              F.lit(width)).cast("int"))


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, width: int = HASH_WIDTH) -> DataFrame:
    """M1-M3 in long form: (id, bucket, tf, weight) with weight = tf / ||tf||."""
    long = (df.select(F.col(id_col).alias("id"), F.explode(hash_tokens(text_col, width)).alias("bucket"))
              .groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("tf")))
    w = Window.partitionBy("id")
    return long.withColumn("weight", F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w)))


# ---------------------------------------------------------------------------
# Block top-k
# ---------------------------------------------------------------------------

def _dense_counts(bucket_lists, width: int) -> np.ndarray:
    """Rows of bucket-id lists -> dense count matrix (one bincount, no per-row loop)."""
    n = len(bucket_lists)
    lens = np.fromiter((0 if b is None else len(b) for b in bucket_lists), dtype=np.int64, count=n)
    if lens.sum() == 0:
        return np.zeros((n, width), dtype=np.float32)
    flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in bucket_lists if b is not None and len(b)])
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    return np.bincount(rows * width + flat, minlength=n * width).reshape(n, width).astype(np.float32)


def _select_topk(rows: np.ndarray, cols: np.ndarray, exact: np.ndarray, k: int):
    """Among candidate (row, col) pairs keep, per row, the k best by (exact desc, col asc)."""
    if rows.size == 0:
        return rows, cols, exact
    order = np.lexsort((cols, -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    pos = np.arange(rows.size) - np.repeat(starts, np.diff(np.r_[starts, rows.size]))
    keep = pos < k
    return rows[keep], cols[keep], exact[keep]


def _candidates(score: np.ndarray, k: int, valid: np.ndarray | None = None, margin: float = 1e-5,
                scale: np.ndarray | float = 0.0):
    """(row, col) pairs whose approximate score can still be in the row's top k.

    ``score`` is a float32 estimate (relative error far below ``margin``);
    every pair whose exact score reaches the k-th best exact score survives,
    so the final exact ranking is unaffected.  Without ``valid``, only
    positive scores count (sparse cosine).  ``scale`` is the size of the products
    behind a score, where that can exceed the score itself.
    """
    n = score.shape[1]
    kk = min(k, n)
    if valid is not None:
        score = np.where(valid, score, np.float32(-np.inf))
    kth = np.partition(score, n - kk, axis=1)[:, n - kk:n - kk + 1]
    thr = kth - np.maximum(np.abs(kth), scale) * margin - margin * 1e-3
    if valid is None:
        return np.nonzero((score >= thr) & (score > 0))
    return np.nonzero((score >= thr) & np.isfinite(score))


def _exact_sparse(qm, dm, n2q, n2d, rows, cols) -> np.ndarray:
    """Float64 cosines of pairs, in slices."""
    exact = np.empty(len(rows))
    for i in range(0, len(rows), 16384):
        r, c = rows[i:i + 16384], cols[i:i + 16384]
        dot = np.einsum("ij,ij->i", qm[r].astype(np.float64), dm[c].astype(np.float64))
        exact[i:i + 16384] = dot / np.sqrt((n2q[r] * n2d[c]).astype(np.float64))
    return exact


def _sparse_block(qid, did, qm, dm, n2q, n2d, k: int, exclude_self: bool, margin: float = 1e-5, pivots: int = 32):
    """Lists (rows, cols, cosines) that hold each query's ``k`` best of the block, skipping what cannot be among them.

    The block's vectors are grouped by the nearest of a few of them.  A query sees the group of its own nearest pivot first
    and after it the groups that the triangle inequality on angles does not rule out against its k-th score so far.
    """
    unit = lambda m, n2: m / np.sqrt(np.where(n2 > 0, n2, 1))[:, None]
    qu, du = unit(qm, n2q).astype(np.float32), unit(dm, n2d).astype(np.float32)
    g = max(1, min(pivots, len(did) // 64))
    pick = np.linspace(0, len(did) - 1, g).astype(int)
    centre = unit(dm[pick].astype(np.float64), n2d[pick])
    angles = lambda m, n2: np.arccos(np.clip((m.astype(np.float64) @ centre.T) / np.sqrt(np.where(n2 > 0, n2, 1))[:, None], -1, 1))
    qa, da = angles(qm, n2q), angles(dm, n2d)
    home, group = qa.argmin(axis=1), da.argmin(axis=1)
    members = [np.flatnonzero(group == j) for j in range(g)]
    upper = np.full((len(qid), g), -1.0, dtype=np.float32)
    for j, m in enumerate(members):
        if len(m):
            least = np.maximum(qa - da[m].max(axis=0), da[m].min(axis=0) - qa).max(axis=1)
            upper[:, j] = np.cos(np.clip(least - 1e-6, 0.0, math.pi))
    best = np.full((len(qid), k), -np.inf, dtype=np.float32)          # approximate scores, the least first
    reach = lambda kth: np.where(kth > 0, kth * (1 - margin) - margin * 1e-3, -np.inf)
    out, waiting = [], []

    def settle():
        """Score in float64 what can still be among a query's best."""
        rows, cols, score = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        keep = score >= reach(best[rows, 0])
        rows, cols = rows[keep], cols[keep]
        out.append(_select_topk(rows, cols, _exact_sparse(qm, dm, n2q, n2d, rows, cols), k))

    def see(rows, m):
        for top in range(0, len(rows), 2048):
            r = rows[top:top + 2048]
            for at in range(0, len(m), 1024):
                c = m[at:at + 1024]
                score = qu[r] @ du[c].T
                if exclude_self:
                    score[qid[r][:, None] == did[c][None, :]] = -1.0
                hit = np.flatnonzero(score.max(axis=1) >= reach(best[r, 0]))
                if not len(hit):
                    continue
                r2, score = r[hit], score[hit]
                # Zero and negative scores never count, so a k-th score above 0 is that of k neighbours.
                both = np.concatenate([best[r2], score], axis=1)
                best[r2] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k:], axis=1)
                i, x = np.nonzero((score >= reach(best[r2, 0])[:, None]) & (score > 0))
                waiting.append((r2[i], c[x], score[i, x]))
                if sum(len(w[0]) for w in waiting) > 1 << 20:
                    settle()

    for j, m in enumerate(members):
        see(np.flatnonzero(home == j), m)
    for j, m in enumerate(members):
        if len(m):
            kth = best[:, 0]
            see(np.flatnonzero((home != j) & (upper[:, j] >= kth * (1 - np.sign(kth) * margin) - margin)), m)
    if waiting:
        settle()
    return out


def _block_fn(mode: str, k: int, width: int, exclude_self: bool, normalize: bool):
    def fn(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "did": pd.Series([], dtype="int64"),
                              "score": pd.Series([], dtype="float64")})
        if len(qpdf) == 0 or len(dpdf) == 0:
            return empty
        dpdf = dpdf.sort_values("did", kind="stable")
        qid = qpdf["qid"].to_numpy(dtype=np.int64)
        did = dpdf["did"].to_numpy(dtype=np.int64)
        if mode == "sparse":
            qm = _dense_counts(qpdf["v"].tolist(), width)
            dm = _dense_counts(dpdf["v"].tolist(), width)
            n2q = (qm.astype(np.int64) ** 2).sum(axis=1)
            n2d = (dm.astype(np.int64) ** 2).sum(axis=1)
        else:
            qm = np.stack([np.asarray(v, dtype=np.float64) for v in qpdf["v"]])
            dm = np.stack([np.asarray(v, dtype=np.float64) for v in dpdf["v"]])
            n2q = (qm * qm).sum(axis=1)
            n2d = (dm * dm).sum(axis=1)
        if mode == "sparse":
            found = _sparse_block(qid, did, qm, dm, n2q, n2d, k, exclude_self)
            if not found:
                return empty
            rows, cols, exact = _select_topk(*(np.concatenate(x) for x in zip(*found)), k)
            return pd.DataFrame({"qid": qid[rows], "did": did[cols], "score": exact})
        with np.errstate(divide="ignore", invalid="ignore"):
            inv_q = np.where(n2q > 0, 1.0 / np.sqrt(n2q.astype(np.float64)), 0.0).astype(np.float32)
            inv_d = np.where(n2d > 0, 1.0 / np.sqrt(n2d.astype(np.float64)), 0.0).astype(np.float32)
        qm32 = qm.astype(np.float32)
        dm32 = dm.astype(np.float32)
        out_q, out_d, out_s = [], [], []
        step = 4096
        for start in range(0, len(did), step):
            sl = slice(start, start + step)
            approx = qm32 @ dm32[sl].T
            if normalize:
                approx *= inv_q[:, None]
                approx *= inv_d[None, sl]
            valid = np.ones(approx.shape, dtype=bool)
            if exclude_self:
                valid &= qid[:, None] != did[None, sl]
            # Candidates of a few queries at a time, scored in float64 in slices: ties cannot fill the memory.
            for top in range(0, len(qid), 256):
                part = slice(top, top + 256)
                scale = 0.0 if normalize else np.sqrt(n2q[part, None] * n2d[sl].max())
                rows, cols = _candidates(approx[part], k, valid[part], scale=scale)
                rows, cols = rows + top, cols + start
                exact = np.empty(len(rows))
                for i in range(0, len(rows), 16384):
                    r, c = rows[i:i + 16384], cols[i:i + 16384]
                    dot = np.einsum("ij,ij->i", qm[r].astype(np.float64), dm[c].astype(np.float64))
                    if normalize:
                        den = np.sqrt(n2q[r] * n2d[c])
                        with np.errstate(divide="ignore", invalid="ignore"):
                            dot = np.where(den > 0, dot / den, 0.0)
                    exact[i:i + 16384] = dot
                rows, cols, exact = _select_topk(rows, cols, exact, k)
                out_q.append(qid[rows])
                out_d.append(did[cols])
                out_s.append(exact)
        if not out_q:
            return empty
        return pd.DataFrame({"qid": np.concatenate(out_q), "did": np.concatenate(out_d),
                             "score": np.concatenate(out_s)})
    return fn


def top_k_similar(queries: DataFrame, corpus: DataFrame, k: int = 5, *, q_id: str = "qid", q_vec: str = "v",
                  d_id: str = "did", d_vec: str = "v", mode: str = "sparse", width: int = HASH_WIDTH,
                  exclude_self: bool = False, normalize: bool = True,
                  q_block: int = 8192, d_block: int = 8192) -> DataFrame:
    """Exact top-k by similarity: rows (qid, did, score, rank), rank 1 = best.

    ``mode='sparse'``: vectors are arrays of bucket ids (``hash_tokens``);
    cosine of the count vectors; only positive scores are kept.
    ``mode='dense'``: vectors are float arrays; inner product (``normalize``
    divides by the norms).  Block sizes bound the memory of one task.
    """
    k = k or 5
    nq = queries.count()
    nd = corpus.count()
    spark = queries.sparkSession
    schema = "qid long, did long, score double, rank int"
    if nq == 0 or nd == 0:
        return spark.createDataFrame([], schema)
    qb_n = max(1, math.ceil(nq / q_block))
    cb_n = max(1, math.ceil(nd / d_block))
    q = (queries.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).alias("v"))
                .withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qb_n)).cast("int"))
                .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb_n - 1)))))
    d = (corpus.select(F.col(d_id).cast("long").alias("did"), F.col(d_vec).alias("v"))
               .withColumn("cb", F.pmod(F.xxhash64("did"), F.lit(cb_n)).cast("int"))
               .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb_n - 1)))))
    # Block pairs are heavy in compute but light in bytes, so adaptive execution
    # would coalesce them into a few lopsided tasks.  An explicit partition
    # count (which AQE keeps) spreads them; both sides share the same hash
    # partitioning, so the cogroup adds no further exchange.
    n_parts = max(min(2 * qb_n * cb_n, 4096), spark.sparkContext.defaultParallelism)
    q = q.repartition(n_parts, "qb", "cb")
    d = d.repartition(n_parts, "qb", "cb")
    local = (q.groupBy("qb", "cb").cogroup(d.groupBy("qb", "cb"))
              .applyInPandas(_block_fn(mode, k, width, exclude_self, normalize),
                             "qid long, did long, score double"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("did"))
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, k: int, *, full_up_to: int = 1 << 20, tiled_from: int = 1 << 33, **args) -> DataFrame:
    """Exact top-k, the same rows by whatever way: sparse vectors go by ``tiled_top_k`` beyond ``tiled_from`` pairs.  Dense
    ones take all block pairs up to ``full_up_to`` vectors, or for as few pairs as that corpus has against itself, and
    ``pruned_top_k`` beyond.
    """
    from .pruned import pruned_top_k, tiled_top_k
    nd = corpus.count()
    if args.get("mode", "sparse") == "sparse" and queries.count() * nd > tiled_from:
        return tiled_top_k(queries, corpus, k, **{x: args[x] for x in ("width", "exclude_self") if x in args})
    if nd <= full_up_to or queries.count() * nd <= full_up_to ** 2:
        return top_k_similar(queries, corpus, k, **args)
    return pruned_top_k(queries, corpus, k, **args)


def distinct_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, *, exclude_self: bool = False,
                   width: int = HASH_WIDTH, **blocks) -> DataFrame:
    """Sparse top-k over distinct vectors: (qid, did, score, rank), the same rows as ``top_k_similar``.

    Repeated texts are the normal case, and copies have equal vectors.  Each distinct vector is searched
    once, under its least id; a corpus vector brings its ``k`` least ids along, and results are
    expanded to all queries at the end.
    """
    keep = (k or 5) + int(exclude_self)
    ordered = lambda df, i: df.select(i, F.array_sort("v").alias("v")).withColumn("key", F.sha2(F.array_join("v", ","), 256))
    q, d = ordered(queries, "qid"), ordered(corpus, "did")
    q_one = q.groupBy("key").agg(F.min("qid").alias("q0"), F.first("v").alias("v"))
    near = d.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("did"))).where(F.col("r") <= keep)
    d_one = materialize(near.groupBy("key").agg(F.min("did").alias("d0"), F.first("v").alias("v"),
                                                F.sort_array(F.collect_list("did")).alias("dids")), "distinct_vectors")
    q_one = materialize(q_one, "distinct_queries")
    hits = search(q_one.select(F.col("q0").alias("qid"), "v"), d_one.select(F.col("d0").alias("did"), "v"), keep,
                  width=width, **blocks)
    best = Window.partitionBy("q0").orderBy(F.desc("score"), F.asc("did"))
    spread_out = (hits.select(F.col("qid").alias("q0"), F.col("did").alias("d0"), "score").join(d_one.select("d0", "dids"), "d0")
                      .select("q0", "score", F.explode("dids").alias("did"))
                      .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep))
    rows = q.select("qid", "key").join(q_one.select("key", "q0"), "key").join(materialize(spread_out, "vector_neighbours"), "q0")
    if not exclude_self:
        return rows.select("qid", "did", "score", "rank")
    mine = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("did"))
    return (rows.where("qid <> did").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= keep - 1)
                .select("qid", "did", "score", "rank"))


def similar_complaints(queries: DataFrame, corpus: DataFrame, k: int = 5, *, id_col: str = "complaint_id",
                       text_col: str = "complaint_text", exclude_self: bool = False) -> DataFrame:
    """C4: for each query complaint, the k most similar corpus complaints with their labels.

    Blank queries (P18) are dropped before the search.
    Returns (query_id, rank, complaint_id, complaint_text, department, priority,
    core_issue, similarity) with similarity clipped to [0, 1] and rounded to 3.
    """
    asked = queries.where(normalize_text(F.col(text_col)) != "")
    qv = asked.select(F.col(id_col).cast("long").alias("qid"), hash_tokens(text_col).alias("v"))
    dv = corpus.select(F.col(id_col).cast("long").alias("did"), hash_tokens(text_col).alias("v"))
    hits = distinct_top_k(qv, dv, k, exclude_self=exclude_self)
    meta = corpus.select(F.col(id_col).cast("long").alias("did"),
                         F.col(id_col).cast("string").alias("complaint_id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("complaint_text"),
                         F.coalesce(F.col("true_department"), F.lit("Customer Service")).alias("department"),
                         F.coalesce(F.col("true_priority"), F.lit("Medium")).alias("priority"),
                         F.coalesce(F.col("true_core_issue"),
                                    F.lit("General complaint requiring manual triage")).alias("core_issue"))
    # The hit list is k rows per query; the corpus side is keyed by id, so this
    # is an ordinary equi-join (sort-merge or shuffle-hash chosen by AQE).
    return (hits.join(meta, "did")
                .select(F.col("qid").alias("query_id"), "rank", "complaint_id", "complaint_text", "department",
                        "priority", "core_issue",
                        F.round(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)), 3).alias("similarity"),
                        F.col("score").alias("raw_score")))


def dense_neighbours(df: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                     exclude_self: bool = True, normalize: bool = False) -> DataFrame:
    """J6 dense: self top-k by inner product over a vector column (qid, did, score, rank)."""
    v = df.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("v"))
    d = df.select(F.col(id_col).alias("did"), F.col(vec_col).alias("v"))
    return search(v, d, k or 5, mode="dense", exclude_self=exclude_self, normalize=normalize)


def weighted_label_vote(neigh: DataFrame, labels: DataFrame, id_col: str = "vec_id",
                        label_col: str = "label") -> DataFrame:
    """A14 on vectors: each query's label by similarity-weighted vote of its neighbours' labels.

    Weights are similarities clipped to [0, 1] in thousandths; ties go to the
    label seen first (best rank).  Each query holds at most k rows.
    """
    lab = labels.select(F.col(id_col).alias("did"), F.col(label_col).alias("nl"))
    rows = neigh.join(lab, "did").select(
        "qid", F.struct(F.col("rank"), F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * 1000 + 0.5)
                        .cast("long").alias("milli"), F.col("nl")).alias("n"))
    g = rows.groupBy("qid").agg(F.array_sort(F.collect_list("n")).alias("neigh"))
    nb = F.col("neigh")
    values = F.array_distinct(F.transform(nb, lambda x: x["nl"]))
    scored = F.transform(values, lambda val: F.struct(
        F.aggregate(F.filter(nb, lambda x: x["nl"] == val), F.lit(0).cast("long"), lambda a, x: a + x["milli"]).alias("w"),
        (-F.array_min(F.transform(F.filter(nb, lambda x: x["nl"] == val), lambda x: x["rank"]))).alias("r"),
        val.alias("val")))
    return g.select("qid", F.array_max(scored)["val"].alias("predicted_label"))
