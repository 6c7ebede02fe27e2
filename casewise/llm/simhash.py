"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: bit k is 1 if it is set in more than half of the XXH64 hashes
(seed 42) of a text's word shingles, repeats included.  Words are what ASCII
white space separates, A-Z lower-cased; a text with fewer words than a
shingle has one shingle of all its words, one without words has fingerprint 0.

Distinct fingerprints are dealt into tiles: a cell holds the fingerprints whose
four 16-bit quarters have the same population counts, a cell above
``tile_rows`` is cut into several tiles.  Fingerprints within ``radius`` bits
have counts that differ by ``radius`` at most over all quarters, so every other
pair of tiles is skipped unseen.  A fingerprint stays in its own tile and visits
the tiles of smaller near cells; a task holds one tile and streams its visitors through
numpy exclusive-or and bit counts.  Of the links found in a tile only a
spanning forest leaves it, so a group of n near copies costs O(n) links.  The
driver holds counts per cell only (at most 17^4).

Components: alternating large-star and small-star rounds (joins and
minimum aggregates, no collected groups), each round written to the checkpoint
folder.

Edge cases: null and empty texts have fingerprint 0 and link like any other;
a null id gets a component but never names one unless no other id is
there; repeated rows share their result; very long texts are hashed in slices;
empty tables give empty results; clashing input columns are ignored
(``near_duplicates``) or kept (``keep_one``, which adds none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import packed, row_hashes

SLICE = 1 << 15


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint as a signed integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(lengths + 1) - 1
        starts, ends = (stop - lengths)[:1 - shingle].tolist(), stop[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(starts), SLICE):
        got = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i:i + SLICE], ends[i:i + SLICE])])
        bits = np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return df.withColumn("_fp", fingerprint(F.col(text_col)))


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Steps between population-count vectors within ``radius``, none but the null step excluded."""
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=4) if 0 < sum(map(abs, d)) <= radius]


def spanning(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Indexes of links (a[i], b[i]) that join different components; ``labels`` (least member) is updated."""
    kept = [np.zeros(0, np.int64)]
    at = np.arange(len(a))
    while True:
        x, y = labels[a[at]], labels[b[at]]
        differ = x != y
        if not differ.any():
            return np.concatenate(kept)
        at, low, high = at[differ], np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        order = np.lexsort((low, high))
        first = order[np.append(True, high[order][1:] != high[order][:-1])]
        kept.append(at[first])
        parent = np.arange(len(labels))
        parent[high[first]] = low[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        labels[:] = parent[labels]


def _tile_links(home: np.ndarray, labels: np.ndarray, visitors: np.ndarray, radius: int):
    """Links of one chunk of visitors to a tile, as far as they join components of the tile's fingerprints."""
    rows, cols = np.nonzero(np.bitwise_count(home[:, None] ^ visitors[None, :]) <= radius)
    both = np.concatenate([labels, np.arange(len(home), len(home) + len(visitors))])
    pick = spanning(rows, cols + len(home), both)
    labels[:] = both[:len(home)]
    return home[rows[pick]], visitors[cols[pick]]


def links(fingerprints: DataFrame, radius: int = 2, tile_rows: int = 2048) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within ``radius`` bits; input: one column ``_fp``."""
    spark = fingerprints.sparkSession
    quarter = [F.bit_count(F.shiftrightunsigned("_fp", s).bitwiseAND(F.lit(0xFFFF))) for s in (48, 32, 16, 0)]
    cell = ((quarter[0] * 17 + quarter[1]) * 17 + quarter[2]) * 17 + quarter[3]
    celled = fingerprints.select("_fp", cell.cast("int").alias("_cell"))
    counts = {r["_cell"]: r["count"] for r in celled.groupBy("_cell").count().collect()}
    tiles = {c: -(-n // tile_rows) for c, n in counts.items()}
    steps = _neighbours(radius)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(tiles.values()) // 64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint to its own tile (role 0) and, as a visitor (role 1), to smaller tiles that may hold links."""
        near = {}
        for batch in batches:
            fps = batch.column(0).to_numpy()
            cells = batch.column(1).to_numpy()
            out = []
            for c in np.unique(cells).tolist():
                own = fps[cells == c]
                if c not in near:
                    q = (c // 4913, c // 289 % 17, c // 17 % 17, c % 17)
                    found = []
                    for d in steps:
                        p = [x + y for x, y in zip(q, d)]
                        code = ((p[0] * 17 + p[1]) * 17 + p[2]) * 17 + p[3]
                        if code < c and 0 <= min(p) and max(p) <= 16 and code in tiles:
                            found.append(code)
                    near[c] = found
                mixed = own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                sub = (mixed >> np.uint64(33)).astype(np.int64) % tiles[c]
                out.append((c * (1 << 32) + sub, 0, own))
                for s in range(tiles[c] - 1):
                    out.append((np.full(int((sub > s).sum()), c * (1 << 32) + s), 1, own[sub > s]))
                for code in near[c]:
                    for s in range(tiles[code]):
                        out.append((np.full(len(own), code * (1 << 32) + s), 1, own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[0] for o in out])),
                 pa.array(np.concatenate([np.full(len(o[2]), o[1], np.int8) for o in out])),
                 pa.array(np.concatenate([o[2] for o in out]))], names=["_tile", "_role", "_fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by tile and role: hold a tile's own rows, stream its visitors."""
        tile, home, labels = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            tile_of, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            found = []
            code = tile_of * 2 + role
            cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist() + [len(code)]
            for i, j in zip(cuts, cuts[1:]):
                if tile_of[i] != tile:
                    tile, home, labels = tile_of[i], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for k in range(i, j, 256):
                    chunk = fps[k:min(k + 256, j)]
                    if role[i] == 0:      # a tile's own rows may come in several batches
                        home = np.concatenate([home, chunk])
                        labels = np.concatenate([labels, np.arange(len(labels), len(home))])
                    if len(home):
                        found.append(_tile_links(home, labels, chunk, radius))
            found = [f for f in found if len(f[0])]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    dealt = celled.mapInArrow(deal, "_tile long, _role byte, _fp long")
    return (dealt.repartition(parts, "_tile").sortWithinPartitions("_tile", "_role")
                 .mapInArrow(compare, "a long, b long").filter("a <> b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b): root is the least node reachable."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
                        .distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = mark(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Both sides of these joins are written tables, so the edges of a large star are split over tasks.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.filter("u <> v"), "large_star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "small_star")
        before, state = state, mark(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _roots(fps: DataFrame, radius: int) -> DataFrame:
    """(_fp, _root) for every distinct fingerprint."""
    distinct = fps.select("_fp").distinct()
    comp = components(links(distinct, radius))
    return distinct.join(comp, F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("root", "_fp").alias("_root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (least id reachable)."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = materialize(with_fingerprint(rows, "_text", shingle).select("_id", "_fp"), "fingerprints")
    least = rows.groupBy("_fp").agg(F.min("_id").alias("_least"))
    roots = materialize(least.join(_roots(rows, radius), "_fp"), "near_roots")
    names = materialize(roots.groupBy("_root").agg(F.min("_least").alias("component_id")), "near_names")
    named = materialize(roots.join(names, "_root").select("_fp", "component_id"), "near_classes")
    return rows.join(named, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                                          "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component: that of the least id (null ids last); identical rows count as one."""
    k1, k2 = (h.alias(n) for h, n in zip(row_hashes(df, 5, 2), ("_k1", "_k2")))
    keyed = df.select(packed(df), k1, k2)
    rows = with_fingerprint(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), k1, k2), "_text", shingle)
    rows = materialize(rows.select("_id", "_fp", "_k1", "_k2"), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_k1", "_k2")).alias("_first")
    best = rows.groupBy("_fp").agg(first)
    stays = (best.join(_roots(rows, radius), "_fp").groupBy("_root").agg(F.min("_first").alias("_first"))
                 .select("_first._k1", "_first._k2"))
    stays = materialize(stays, "near_kept")
    return keyed.join(stays, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_in.*")
