"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item, each window of the item's word count in a document
gets a 64-bit SimHash of its word shingles.  A multi-index over the items of
that size (8 blocks of 8 bits: two fingerprints within ``radius`` differ by at
most radius // 8 bits in some block) finds every item within the radius;
the candidates are verified by exact weighted Jaccard similarity of shingle
counts, and reported from ``min_similarity`` on.

Windows that share no shingle with any item of their size have similarity 0
with all of them, so they are not fingerprinted: a scan with the benchmark's own
words finds the others.  Documents shorter than an item are one window.

Words are letters, digits and underscores, lower-cased; shingles have five
words, an item of fewer words is one shingle of all of them.

The benchmark is a stated small set: it is read in blocks of at most
``items_per_block`` rows, each block is one pass over the documents and travels
with the tasks.  Documents are never shuffled.

Edge cases: null or word-less items match nothing and null or empty documents
match no item; repeated items are reported each; the first of equally similar
windows is reported; an empty benchmark or table gives no matches; other columns pass
through ``clean`` unchanged whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

WORD = re.compile(r"\w+")
MATCH = "array<struct<item:long, start:int, n_words:int, distance:int, similarity:double>>"
BLOCKS = 8


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str], k: int) -> list[str]:
    return [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    either = a.total() + b.total() - both
    return both / either if either else 0.0


def _bits(grams: list[str]) -> np.ndarray:
    got = b"".join([xxhash.xxh64_digest(g.encode()) for g in grams])
    return np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1)


def _pack(ones: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints (rows of 8 bytes) from per-bit sums over n shingles."""
    return np.packbits(2 * ones > n, axis=-1)


class Index:
    """Items of a block: word codes for the scan, and a multi-index of fingerprints per item size."""

    def __init__(self, items: list[tuple[int, str]], radius: int, shingle: int = 5):
        self.radius, self.shingle = radius, shingle
        self.vocabulary: dict[str, int] = {}
        self.counts: dict[int, Counter] = {}
        by_size = defaultdict(list)
        scan = defaultdict(lambda: defaultdict(set))
        for at, text in items:
            words = words_of(text)
            if not words:
                continue
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            k = min(shingle, len(words))
            grams = shingles(words, k)
            self.counts[at] = Counter(grams)
            by_size[len(words)].append((at, _pack(_bits(grams).sum(axis=0, dtype=np.int64), len(grams))))
            ids = np.array([self.vocabulary[w] for w in words])
            for code in self._codes(ids, k).tolist():
                scan[k][code].add(len(words))
        self.scan = {}
        for k, codes in scan.items():
            keys = np.array(sorted(codes), np.uint64)
            self.scan[k] = (keys, [sorted(codes[c]) for c in keys.tolist()])
        near = np.array([[(x ^ y).bit_count() <= radius // BLOCKS for y in range(256)] for x in range(256)])
        self.by_size = {}
        for size, found in by_size.items():
            fps = np.array([f for _, f in found], np.uint8)
            # near[value, items' byte]: which items a window's byte may belong to, per block
            self.by_size[size] = ([a for a, _ in found], fps, [near[:, fps[:, b]] for b in range(BLOCKS)])

    @staticmethod
    def _codes(ids: np.ndarray, k: int) -> np.ndarray:
        n = len(ids) - k + 1
        code = np.zeros(max(n, 0), np.uint64)
        for j in range(k):
            code = (code + ids[j:j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(31)
        return code

    def hits(self, ids: np.ndarray) -> dict[int, list[np.ndarray]]:
        """Per item size: positions of shingles that occur in an item of that size."""
        out = defaultdict(list)
        for k, (keys, sizes) in self.scan.items():
            if len(ids) < k or not len(keys):
                continue
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            codes = self._codes(ids, k)[at]
            slot = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            same = keys[slot] == codes
            for p, s in zip(at[same].tolist(), slot[same].tolist()):
                for size in sizes[s]:
                    out[size].append(p)
        return out

    def matches(self, text: str | None, least: float) -> list[tuple]:
        words = words_of(text)
        if not words or not self.counts:
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words])
        best: dict[int, tuple] = {}
        for size, found in self.hits(ids).items():
            k, window = min(self.shingle, size), min(size, len(words))
            last = len(words) - window
            at = np.array(found)
            # Windows of this size that contain one of the shingles, as runs of starts.
            low, high = np.clip(at - (window - k), 0, last), np.clip(at, 0, last)
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order])
            new = np.append(True, low[1:] > high[:-1] + 1)
            ends = np.append(high[:-1][new[1:]], high[-1])
            for a, b in zip(low[new].tolist(), ends.tolist()):
                for i in range(a, b + 1, 4096):
                    self._run(words, size, window, k, i, min(i + 4095, b), least, best)
        return sorted((item, *hit) for item, hit in best.items())

    def _run(self, words, size, window, k, first, last, least, best) -> None:
        """Compare the windows that start at first..last with the items of one size."""
        items, fps, blocks = self.by_size[size]
        grams = shingles(words[first:last + window], k)
        n = window - k + 1
        sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(grams), axis=0, dtype=np.int32)))
        prints = _pack(sums[n:] - sums[:-n], n)
        maybe = blocks[0][prints[:, 0]]
        for b in range(1, BLOCKS):
            maybe = maybe | blocks[b][prints[:, b]]
        at, which = np.nonzero(maybe)
        distance = np.bitwise_count(prints[at] ^ fps[which]).sum(axis=1)
        inside = distance <= self.radius
        for s, j, d in zip(at[inside].tolist(), which[inside].tolist(), distance[inside].tolist()):
            item = items[j]
            similarity = weighted_jaccard(Counter(grams[s:s + n]), self.counts[item])
            if similarity >= least and (item not in best or (-similarity, first + s) < (-best[item][3], best[item][0])):
                best[item] = (first + s, window, d, similarity)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, items_per_block: int) -> list[list[tuple]]:
    """Benchmark rows in blocks; the driver holds one block at a time while tasks are planned."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    n = rows.count()
    parts = max(1, -(-n // items_per_block))
    at = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    return [[(r["i"], r["t"]) for r in rows.filter(at == p).collect()] for p in range(parts)]


def _with_matches(df: DataFrame, text_col: str, items: list[tuple], radius: int, least: float, out: str) -> DataFrame:
    texts = [(at, text) for at, (_, text) in enumerate(items)]
    ids = [i for i, _ in items]

    @F.pandas_udf(MATCH)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(texts, radius)
        for batch in batches:
            yield pd.Series([[{"item": ids[at], "start": start, "n_words": n, "distance": d, "similarity": s}
                              for at, start, n, d, s in index.matches(t, least)] for t in batch])

    return df.withColumn(out, found(F.col(text_col)))


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", min_similarity: float = 0.8, radius: int = 24, items_per_block: int = 20_000) -> DataFrame:
    """One row per document and item it contains: id, item id, ``start`` and ``n_words`` of the best window,
    ``distance`` in bits, ``similarity``."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    parts = [_with_matches(rows, "_text", items, radius, min_similarity, "_m").select("_id", F.explode("_m").alias("_m"))
             for items in _blocks(benchmark, item_col, item_text_col, items_per_block)]
    return reduce(DataFrame.unionByName, parts).select(
        F.col("_id").alias(id_col), F.col("_m.item").alias(item_col), "_m.start", "_m.n_words", "_m.distance", "_m.similarity")


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          min_similarity: float = 0.8, radius: int = 24, items_per_block: int = 20_000) -> DataFrame:
    """Rows of ``df`` that contain no benchmark item."""
    rows = df.select(packed(df), F.col(text_col).alias("_text"))
    for items in _blocks(benchmark, item_col, item_text_col, items_per_block):
        rows = _with_matches(rows, "_text", items, radius, min_similarity, "_m").filter(F.size("_m") == 0)
    return rows.select("_in.*")
