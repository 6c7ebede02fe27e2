"""Exact top-k search that skips what cannot reach the k-th score.

The corpus is cut into tiles: every vector joins the nearest of about
sqrt(n) pivots (picked by hash, at most ``MOST_PIVOTS``).  A tile keeps, for its
own pivot and for ``REFERENCES`` of the pivots, the least and largest angle of
its members.  By the triangle inequality on angles no member is nearer to a
query than ``max(query's angle - largest, least - query's angle)`` over these pivots, so

    score(query, member) <= |query| * largest |member| * cos(that angle).

Round one searches the tile of the query's nearest pivot and so finds a score t
that k vectors reach.  Round two sends the query to exactly those other tiles
whose bound reaches t; ties at t are kept.  The result is that of the
full search (``similar.top_k_similar``), row for row.

Scale: pivots and tile bounds are tables of at most ``MOST_PIVOTS`` rows and
travel with the task.  A tile with many members is split into blocks of
``d_block``, and the queries that it gets into blocks of ``q_block``, so one task
holds one pair of blocks whatever is hot.

``tiled_top_k`` is the form for sparse count vectors.  Its pivots are centres of a bounded hash sample (a few
steps of k-means), so tiles are tight, and besides the angle to the pivot a tile's largest count share per
bucket bounds a score: vectors are nowhere negative.  No query is routed by itself: blocks of queries that lie in neighbouring
tiles meet blocks of neighbouring tiles, carrying the k-th score of round one, and a tile is multiplied with those
queries of the block that may still find something in it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .similar import _block_fn, _dense_counts, _exact_sparse, _select_topk

MOST_PIVOTS, REFERENCES = 1024, 32
#: Vector entries in one batch of routed queries: a query goes to many tiles, each time with its whole vector.
MOST_ENTRIES = 1 << 21
#: Slack for rounding in angles: far above their error, far below differences of scores that matter.
SLACK = 1e-6
#: Tiles of the sparse search, and rows of the sample that their centres are taken from.
MOST_CENTRES, SAMPLE = 4096, 16384


def _matrix(values, mode: str, width: int) -> np.ndarray:
    if mode == "sparse":
        return _dense_counts(list(values), width).astype(np.float64)
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _angles(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angles to unit pivots, norms); a zero vector is at a right angle to everything."""
    norm = np.sqrt((rows * rows).sum(axis=1))
    cos = (rows @ pivots.T) / np.where(norm > 0, norm, 1.0)[:, None]
    return np.arccos(np.clip(cos, -1.0, 1.0)), norm


def _pick_pivots(corpus: DataFrame, n: int, mode: str, width: int) -> np.ndarray:
    """Unit vectors of the ``n`` rows with the least hash of their id."""
    picked = corpus.orderBy(F.xxhash64("did", F.lit(6)), "did").limit(n).select("v").collect()
    rows = _matrix([r["v"] for r in picked], mode, width)
    norm = np.sqrt((rows * rows).sum(axis=1))
    return np.unique(rows[norm > 0] / norm[norm > 0][:, None], axis=0)


def _placed(df: DataFrame, key: str, pivots: np.ndarray, mode: str, width: int) -> DataFrame:
    """(key, v, tile, norm, a): nearest pivot, and the angles to it and to the reference pivots."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at:at + 4096]
                angle, norm = _angles(_matrix(part["v"], mode, width), pivots)
                tile = angle.argmin(axis=1)
                a = np.column_stack([angle[np.arange(len(part)), tile], angle[:, :REFERENCES]])
                yield pd.DataFrame({key: part[key], "v": part["v"], "tile": tile.astype(np.int32), "norm": norm, "a": list(a)})

    kind = "array<int>" if mode == "sparse" else "array<double>"
    return df.select(key, F.col("v").cast(kind).alias("v")).mapInPandas(run, f"{key} long, v {kind}, tile int, norm double, a array<double>")


class Bounds:
    """Bounds of all tiles (at most ``MOST_PIVOTS`` of them), and which tiles a query has to see."""

    def __init__(self, pivots: np.ndarray, stats: list):
        self.pivots = pivots
        self.tile = np.array([r["tile"] for r in stats], dtype=np.int64)
        self.count = np.array([r["n"] for r in stats], dtype=np.int64)
        self.norm = np.array([r["norm"] for r in stats])
        self.low, self.high = np.array([r["low"] for r in stats]), np.array([r["high"] for r in stats])

    def upper(self, rows: np.ndarray, scaled: bool) -> tuple[np.ndarray, np.ndarray]:
        """(angles to the tiles' pivots, upper bounds of scores), queries x tiles; ``scaled``: cosines, else inner products."""
        angle, norm = _angles(rows, self.pivots)
        own = angle[:, self.tile]
        least = np.maximum(own - self.high[None, :, 0], self.low[None, :, 0] - own)
        for i in range(min(REFERENCES, self.pivots.shape[0])):
            least = np.maximum(least, np.maximum(angle[:, i, None] - self.high[None, :, i + 1], self.low[None, :, i + 1] - angle[:, i, None]))
        best = np.cos(np.clip(least, 0.0, math.pi))
        return own, best if scaled else np.maximum(best, 0.0) * norm[:, None] * self.norm[None, :]


def _search(routed: DataFrame, placed: DataFrame, bounds: Bounds, mode: str, k: int, width: int, exclude_self: bool,
            normalize: bool, q_block: int, d_block: int) -> DataFrame:
    """Local top-k lists of (qid, v, tile) against the members of the tile, one task per pair of blocks."""
    spark = routed.sparkSession
    asked = {r["tile"]: r["count"] for r in routed.groupBy("tile").count().collect()}  # a row per tile
    rows = [(int(t), max(1, -(-int(n) // d_block)), max(1, -(-asked[int(t)] // q_block)))
            for t, n in zip(bounds.tile, bounds.count) if int(t) in asked]
    blocks = F.broadcast(spark.createDataFrame(rows, "tile int, db int, qb int"))  # at most MOST_PIVOTS rows
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = (routed.join(blocks, "tile").withColumn("q", F.pmod(F.xxhash64("qid"), F.col("qb")).cast("int")).withColumn("d", upto("db"))
               .select("qid", "v", "tile", "q", "d"))
    d = (placed.join(blocks, "tile").withColumn("d", F.pmod(F.xxhash64("did"), F.col("db")).cast("int")).withColumn("q", upto("qb"))
               .select("did", "v", "tile", "q", "d"))
    parts = max(2 * spark.sparkContext.defaultParallelism, min(sum(a * b for _, a, b in rows), 4096))
    keys = ["tile", "q", "d"]
    return (q.repartition(parts, *keys).groupBy(*keys).cogroup(d.repartition(parts, *keys).groupBy(*keys))
             .applyInPandas(_block_fn(mode, k, width, exclude_self, normalize), "qid long, did long, score double"))


def pruned_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, *, mode: str = "sparse", width: int = 384,
                 exclude_self: bool = False, normalize: bool = True, q_block: int = 8192, d_block: int = 8192,
                 pivots: int | None = None, report: dict | None = None) -> DataFrame:
    """Exact top-k: rows (qid, did, score, rank) from queries (qid, v) and corpus (did, v); see ``similar.top_k_similar``.

    ``report`` gets ``pairs`` (all pairs of query and vector), ``scored`` (pairs multiplied), ``tiles`` and the
    (query, tile) pairs ``tile_pairs`` and ``tile_pairs_seen``.
    """
    schema = "qid long, did long, score double, rank int"
    spark = queries.sparkSession
    corpus = corpus.select("did", "v")
    nd = corpus.count()
    picked = _pick_pivots(corpus, pivots or min(MOST_PIVOTS, max(1, math.isqrt(nd))), mode, width) if nd else np.zeros((0, 1))
    if not len(picked):
        if nd == 0 or mode == "sparse":
            return spark.createDataFrame([], schema)
        picked = np.zeros((1, len(corpus.first()["v"])))
    scaled = mode == "sparse" or normalize
    placed = materialize(_placed(corpus, "did", picked, mode, width), "search_tiles")
    seen = range(1 + min(REFERENCES, len(picked)))
    stats = placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"),
                                       F.array(*[F.min(F.col("a")[i]) for i in seen]).alias("low"),
                                       F.array(*[F.max(F.col("a")[i]) for i in seen]).alias("high"))
    bounds = Bounds(picked, stats.collect())
    kind = "array<int>" if mode == "sparse" else "array<double>"
    asked = queries.select("qid", F.col("v").cast(kind).alias("v"))
    need = k + int(exclude_self)

    def nearest(batches):
        """The tile of the nearest pivot among those with enough members."""
        enough = bounds.count >= need
        for pdf in batches:
            if not len(pdf):
                continue
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at:at + 4096]
                own = _angles(_matrix(part["v"], mode, width), bounds.pivots)[0][:, bounds.tile]
                if enough.any():
                    own[:, ~enough] = np.inf
                yield pd.DataFrame({"qid": part["qid"], "v": part["v"], "tile": bounds.tile[own.argmin(axis=1)].astype(np.int32)})

    args = dict(mode=mode, k=k, width=width, exclude_self=exclude_self, normalize=normalize, q_block=q_block, d_block=d_block)
    home = materialize(asked.mapInPandas(nearest, f"qid long, v {kind}, tile int"), "search_home")
    first = materialize(_search(home, placed, bounds, **args), "search_first")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("did"))
    ranked = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    reached = ranked.filter(F.col("rank") == k).select(F.col("qid").alias("q0"), F.col("score").alias("reached"))

    def others(batches):
        """All other tiles whose bound reaches the score that ``k`` vectors have already."""
        for pdf in batches:
            if not len(pdf):
                continue
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at:at + 2048]
                upper = bounds.upper(_matrix(part["v"], mode, width), scaled)[1]
                least = np.nan_to_num(part["reached"].to_numpy(dtype=np.float64), nan=-np.inf)
                margin = SLACK * (1.0 if scaled else np.maximum(np.abs(upper), 1.0))
                rows, tiles = np.nonzero((upper >= least[:, None] - margin) & (bounds.tile[None, :] != part["tile"].to_numpy()[:, None]))
                qid, v = part["qid"].to_numpy(), part["v"].to_numpy()
                ends = np.cumsum(np.array([0 if x is None else len(x) for x in v], dtype=np.int64)[rows]) // MOST_ENTRIES
                for at_row in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(ends)) + 1):
                    yield pd.DataFrame({"qid": qid[rows[at_row]], "v": v[rows[at_row]], "tile": bounds.tile[tiles[at_row]].astype(np.int32)})

    second = home.join(reached, F.col("qid") == F.col("q0"), "left").select("qid", "v", "tile", "reached")
    routed = materialize(second.mapInPandas(others, f"qid long, v {kind}, tile int"), "search_routed")
    if report is not None:
        size = dict(zip(bounds.tile.tolist(), bounds.count.tolist()))
        visits = {r["tile"]: r["count"] for r in home.select("tile").union(routed.select("tile")).groupBy("tile").count().collect()}
        nq = home.count()
        report.update(pairs=nq * nd, scored=sum(size[t] * n for t, n in visits.items()), tiles=len(size),
                      tile_pairs=nq * len(size), tile_pairs_seen=sum(visits.values()))
    more = _search(routed, placed, bounds, **args)
    return (first.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                 .select("qid", "did", "score", "rank"))


def _centres(corpus: DataFrame, n: int, width: int, steps: int = 4) -> np.ndarray:
    """At most ``n`` unit vectors: centres of the ``SAMPLE`` rows with the least hash of their id, alike ones side by side."""
    picked = corpus.orderBy(F.xxhash64("did", F.lit(6)), "did").limit(SAMPLE).select("v").collect()
    rows = _dense_counts([r["v"] for r in picked], width)
    norm = np.sqrt((rows * rows).sum(axis=1))
    rows = rows[norm > 0] / norm[norm > 0][:, None]
    centres = rows[:n]
    for _ in range(steps if len(centres) else 0):
        near = (rows @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        size = np.sqrt((total * total).sum(axis=1))
        centres = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centres)
    if len(centres):
        centres = centres[np.argsort((centres @ centres[:32].T).argmax(axis=1), kind="stable")].astype(np.float64)
        centres /= np.sqrt((centres * centres).sum(axis=1))[:, None]
    return centres


def _tiled(df: DataFrame, key: str, centres: np.ndarray, open_tiles: np.ndarray, width: int) -> DataFrame:
    """(key, v, tile): the tile of the nearest centre among ``open_tiles``."""

    def run(batches):
        at, c = open_tiles.astype(np.int32), centres[open_tiles].astype(np.float32).T
        for pdf in batches:
            for top in range(0, len(pdf), 4096):
                part = pdf.iloc[top:top + 4096]
                yield pd.DataFrame({key: part[key], "v": part["v"], "tile": at[(_dense_counts(part["v"].tolist(), width) @ c).argmax(axis=1)]})

    return df.select(key, F.col("v").cast("array<int>").alias("v")).mapInPandas(run, f"{key} long, v array<int>, tile int")


def _cut(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int]], int]:
    """([(tile, first block, blocks)], number of blocks): neighbouring tiles share a block of about ``size`` rows, big ones are cut."""
    out, block, held = [], 0, 0
    for tile in sorted(counts):
        n = counts[tile]
        if held and held + n > size:
            block, held = block + 1, 0
        pieces = max(1, -(-n // size))
        out.append((tile, block, pieces))
        block, held = (block + pieces, 0) if pieces > 1 else (block, held + n)
    return out, block + int(held > 0)


def _tiles_block_fn(centres: np.ndarray, k: int, width: int, exclude_self: bool, margin: float = 1e-5):
    """Local top-k lists of a block of queries (qid, v, reached) against whole tiles (did, v, tile)."""

    def fn(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "did": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if len(qpdf) == 0 or len(dpdf) == 0:
            return empty
        dpdf = dpdf.sort_values(["tile", "did"], kind="stable")
        qid, did = qpdf["qid"].to_numpy(dtype=np.int64), dpdf["did"].to_numpy(dtype=np.int64)
        qm, dm = _dense_counts(qpdf["v"].tolist(), width), _dense_counts(dpdf["v"].tolist(), width)
        # Squares in slices: whole blocks as integers or doubles would take twice the memory.
        squares = lambda m: np.concatenate([(m[i:i + 4096].astype(np.int64) ** 2).sum(axis=1) for i in range(0, len(m), 4096)])
        n2q, n2d = squares(qm), squares(dm)
        length = lambda n2: np.sqrt(np.where(n2 > 0, n2, 1))
        qu, du = qm / length(n2q)[:, None].astype(np.float32), dm / length(n2d)[:, None].astype(np.float32)
        by_id = np.argsort(did, kind="stable")           # ties go to the least id, whatever its tile
        place = np.empty_like(by_id)
        place[by_id] = np.arange(len(by_id))
        tile = dpdf["tile"].to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(tile)) + 1]
        ends = np.r_[starts[1:], len(tile)]
        own = centres[tile[starts]]
        turned = lambda m, n2, c: np.arccos(np.clip((m.astype(np.float64) @ c.T) / length(n2)[:, None], -1, 1))
        da = [turned(dm[a:b], n2d[a:b], own[j:j + 1])[:, 0] for j, (a, b) in enumerate(zip(starts, ends))]
        low, high = np.array([a.min() for a in da]), np.array([a.max() for a in da])
        upper = qu @ np.maximum.reduceat(du, starts, axis=0).T
        for i in range(0, len(qid), 4096):
            qa = turned(qm[i:i + 4096], n2q[i:i + 4096], own)
            least = np.maximum(qa - high, low - qa)
            upper[i:i + 4096] = np.minimum(upper[i:i + 4096], np.cos(np.clip(least - SLACK, 0.0, math.pi)))
        upper = upper * (1 + margin) + margin
        best = np.full((len(qid), k), -np.inf, dtype=np.float32)
        floor = np.nan_to_num(qpdf["reached"].to_numpy(dtype=np.float64), nan=-np.inf)
        reach = lambda r: (lambda x: np.where(x > 0, x * (1 - margin) - margin * 1e-3, -np.inf))(np.maximum(best[r, 0], floor[r]))
        out, waiting = [], []

        def settle():
            """Score in float64 what can still be among a query's best."""
            rows, cols, score = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            keep = score >= reach(rows)
            rows, cols = rows[keep], cols[keep]
            out.append(_select_topk(rows, place[cols], _exact_sparse(qm, dm, n2q, n2d, rows, cols), k))

        for j in np.argsort(-upper.max(axis=0), kind="stable"):
            rows = np.flatnonzero(upper[:, j] >= reach(slice(None)))
            for top in range(0, len(rows), 2048):
                r = rows[top:top + 2048]
                for at in range(starts[j], ends[j], 1024):
                    to = min(at + 1024, ends[j])
                    score = qu[r] @ du[at:to].T
                    if exclude_self:
                        score[qid[r][:, None] == did[at:to][None, :]] = -1.0
                    hit = np.flatnonzero(score.max(axis=1) >= reach(r))
                    if not len(hit):
                        continue
                    r2, score = r[hit], score[hit]
                    # Only columns that reach something matter: zero and negative scores never count.
                    both = np.concatenate([best[r2], score], axis=1)
                    best[r2] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k:], axis=1)
                    i, x = np.nonzero((score >= reach(r2)[:, None]) & (score > 0))
                    waiting.append((r2[i], x + at, score[i, x]))
                    if sum(len(w[0]) for w in waiting) > 1 << 20:
                        settle()
        if waiting:
            settle()
        if not out:
            return empty
        rows, cols, exact = _select_topk(*(np.concatenate(x) for x in zip(*out)), k)
        return pd.DataFrame({"qid": qid[rows], "did": did[by_id[cols]], "score": exact})

    return fn


def tiled_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, *, width: int = 384, exclude_self: bool = False,
                q_block: int | None = None, d_block: int = 32768, centres: int | None = None) -> DataFrame:
    """Exact top-k of sparse count vectors: rows (qid, did, score, rank) from (qid, v) and (did, v); see ``similar.top_k_similar``."""
    schema = "qid long, did long, score double, rank int"
    spark = queries.sparkSession
    corpus = corpus.select("did", "v")
    nd = corpus.count()
    picked = _centres(corpus, centres or min(MOST_CENTRES, max(1, 2 * math.isqrt(nd))), width) if nd else np.zeros((0, width))
    if not len(picked):  # no vector of the sample has an entry: leave it to all block pairs
        from .similar import top_k_similar
        return top_k_similar(queries, corpus, k, q_id="qid", d_id="did", width=width, exclude_self=exclude_self) if nd else \
            spark.createDataFrame([], schema)
    sizes = lambda df: {r["tile"]: r["count"] for r in df.groupBy("tile").count().collect()}  # noqa: E731  (a row per tile)
    placed = materialize(_tiled(corpus, "did", picked, np.arange(len(picked)), width), "search_tiles")
    members = sizes(placed)
    enough = np.array(sorted(t for t, n in members.items() if n >= k + int(exclude_self)) or sorted(members))
    home = materialize(_tiled(queries.select("qid", "v"), "qid", picked, enough, width), "search_home")
    asked = sizes(home)
    if not asked:
        return spark.createDataFrame([], schema)
    args = dict(mode="sparse", k=k, width=width, exclude_self=exclude_self, normalize=True, q_block=8192, d_block=8192)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("did"))
    tiles = np.array(sorted(members))
    found = _search(home, placed, _Tiles(tiles, np.array([members[int(t)] for t in tiles])), **args)
    reached = (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
                    .select(F.col("qid").alias("q0"), F.col("score").alias("reached")))
    q_cut, q_n = _cut(asked, q_block or max(4096, min(32768, sum(asked.values()) // 12)))
    d_cut, d_n = _cut(members, d_block)

    def blocked(df, key, cut, name):
        block = F.broadcast(spark.createDataFrame(cut, "tile int, first int, pieces int"))  # a row per tile
        return (df.join(block, "tile").withColumn(name, (F.col("first") + F.pmod(F.xxhash64(key), F.col("pieces"))).cast("int"))
                  .drop("first", "pieces"))

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = materialize(home.join(reached, F.col("qid") == F.col("q0"), "left").select("qid", "v", "tile", "reached"), "search_reached")
    q = blocked(q, "qid", q_cut, "qb").select("qid", "v", "reached", "qb").withColumn("cb", upto(d_n))
    d = blocked(placed, "did", d_cut, "cb").select("did", "v", "tile", "cb").withColumn("qb", upto(q_n))
    parts = max(min(2 * q_n * d_n, 4096), spark.sparkContext.defaultParallelism)
    lists = (q.repartition(parts, "qb", "cb").groupBy("qb", "cb").cogroup(d.repartition(parts, "qb", "cb").groupBy("qb", "cb"))
              .applyInPandas(_tiles_block_fn(picked, k, width, exclude_self), "qid long, did long, score double"))
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "did", "score", "rank")


class _Tiles:
    """Tiles and their sizes, as ``_search`` reads them."""

    def __init__(self, tile: np.ndarray, count: np.ndarray):
        self.tile, self.count = tile, count
