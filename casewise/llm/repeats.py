"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every byte position whose suffix is at least ``window`` (400) bytes long is a
suffix to sort, by its first ``window`` bytes only.  Suffixes whose window
occurs again end in one group; all others fall out as soon as their group has
one member.  Sorting every suffix by itself would move a row per byte, so the passes work on
runs of neighbouring suffixes:

* Every window picks an anchor: the least hashed 8-byte gram in it (the first of equals).
  Equal windows pick equal anchors at equal offsets, so the pair (anchor,
  offset) aligns all occurrences of a repeated window.
* A run holds the suffixes that share an anchor and whose offsets lie in one
  cell of 100.  The bytes that all its windows have in common are its most
  significant digit.  A run whose digit occurs nowhere else is finished:
  none of its windows is repeated.
* Runs that agree on all bytes of all their windows are finished too: every
  window in them is repeated.
* What is left are edges, where one occurrence goes on and another ends.  They
  are split into cells of 10 and then 1 and go through the next passes, with
  longer digits; at depth 1 the digit is the whole window and
  the groups with several members are exactly the repeated windows.  A run that is finished but equal
  in its digit to an unfinished one sends one representative along.

Digits are 64-bit hashes; two windows or runs count as equal on 128 bits of
hash over all their bytes.  Group counts are partial aggregates and
joins split by skew, so a passage that a third of all rows share never meets in
one task; every pass is written to the checkpoint folder.

Bytes are removed if any repeated window covers them; windows are judged on
the input.  Edge cases: a null text counts as empty; texts shorter than the
window keep all bytes; repeated rows repeat each other, so they lose all
windows; rows are told apart by id and a 64-bit hash of the text, so null and equal ids are allowed; very long texts are scanned in slices; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

GRAM = 8
CELLS = (100, 10, 1)
SLICE_BITS = 20
#: A run as one number: first window, offset of that window to the anchor (13 bits), number of windows (7 bits).
BASE, OFF, MANY = 20, 7, 127
RUNS = "core long, whole long, _id {id}, _sum long, span long"


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    block = padded.reshape(-1, width)
    forth = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], forth[width - 1:n])


def _anchors(data: bytes, first: int, count: int, window: int) -> np.ndarray:
    """Anchor position of the windows that start at first .. first + count - 1."""
    n = count + window - GRAM
    grams = np.ndarray((n,), np.uint64, buffer=data, offset=first, strides=(1,))
    key = grams * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    low = np.uint64((1 << (SLICE_BITS + 1)) - 1)
    key = (key & ~low) | np.arange(n, dtype=np.uint64)
    return (_sliding_min(key, window - GRAM + 1) & low).astype(np.int64) + first


def runs_of(data: bytes, window: int, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(base, off, n) of all runs of a text: first window, its offset to the anchor, number of windows."""
    total = len(data) - window + 1
    for first in range(0, max(total, 0), 1 << SLICE_BITS):
        count = min(1 << SLICE_BITS, total - first)
        anchor = _anchors(data, first, count, window)
        off = anchor - np.arange(first, first + count)
        yield _split(first, off, anchor, cell)


def _split(first: int, off: np.ndarray, anchor: np.ndarray, cell: int):
    """Cut neighbouring windows where the anchor or the cell of their offset changes."""
    code = anchor * 65536 + off // cell
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    n = np.diff(np.append(at, len(off)))
    return at + first, off[at], n


def digests(data: bytes, shift: int, base, off, n, cell: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run: hash of the bytes common to a whole cell's windows, and of all bytes of its own windows.

    ``data`` starts at byte ``shift`` of the text.
    """
    if cell == 1:
        pair = b"".join([xxhash.xxh3_128_digest(data[b:b + window]) for b in (base - shift).tolist()])
        both = np.frombuffer(pair, np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()
    number = off // cell
    anchor = base + off - shift
    top = np.minimum((number + 1) * cell, window - GRAM + 1)
    low, high = (anchor - number * cell).tolist(), (anchor - top + 1 + window).tolist()
    seeds = number.tolist()
    core = [xxhash.xxh3_64_intdigest(data[a:b], s) for a, b, s in zip(low, high, seeds)]
    start = base - shift
    whole = [xxhash.xxh3_64_intdigest(data[a:b], s + 1000) for a, b, s in
             zip(start.tolist(), (start + n - 1 + window).tolist(), seeds)]
    return np.array(core, np.uint64).view(np.int64), np.array(whole, np.uint64).view(np.int64)


def _unpack(span):
    return span >> BASE, (span >> OFF) & ((1 << (BASE - OFF)) - 1), span & MANY


def _batch(ids: pa.Array, crcs: pa.Array, found: list) -> pa.RecordBatch:
    """Run rows; ``found``: (row number, core, whole, base, off, n) arrays."""
    row = pa.array(np.concatenate([np.full(len(f[1]), f[0]) for f in found]))
    core, whole, base, off, n = (np.concatenate([f[k] for f in found]) for k in range(1, 6))
    span = (base << BASE) | (off << OFF) | n
    return pa.RecordBatch.from_arrays([pa.array(core), pa.array(whole), ids.take(row), crcs.take(row), pa.array(span)],
                                      names=["core", "whole", "_id", "_sum", "span"])


def _text_runs(docs: DataFrame, window: int, cell: int) -> DataFrame:
    """Runs of whole texts (columns _id, _sum, _data)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for r, data in enumerate(batch.column(2).to_pylist()):
                if data is None or len(data) < window:
                    continue
                for base, off, n in runs_of(data, window, cell):
                    found.append((r, *digests(data, 0, base, off, n, cell, window), base, off, n))
                    held += len(base)
                if held > 100_000:
                    yield _batch(batch.column(0), batch.column(1), found)
                    found, held = [], 0
            if found:
                yield _batch(batch.column(0), batch.column(1), found)

    return docs.mapInArrow(emit, RUNS.format(id=docs.schema["_id"].dataType.simpleString()))


def _piece_runs(pieces: DataFrame, window: int, cell: int) -> DataFrame:
    """Runs of smaller cells inside pieces (columns _id, _sum, span, _data)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for r, (span, data) in enumerate(rows):
                start, off, n = _unpack(span)
                off = off - np.arange(n)
                base, off, n = _split(start, off, np.zeros_like(off), cell)
                found.append((r, *digests(data, start, base, off, n, cell, window), base, off, n))
            if found:
                yield _batch(batch.column(0), batch.column(1), found)

    return pieces.mapInArrow(emit, RUNS.format(id=pieces.schema["_id"].dataType.simpleString()))


def _cut_pieces(owners: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The bytes of runs: owners (_id, _sum, _start, _data) hold them; spans (_id, _sum, span).

    A run of ``n`` windows needs n + window - 1 bytes.
    """
    wanted = spans.groupBy("_id", "_sum").agg(F.collect_set("span").alias("_spans"))
    wanted = wanted.withColumnsRenamed({"_id": "_i", "_sum": "_c"})
    joined = owners.join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sum") == F.col("_c")))
    each = joined.select("_id", "_sum", "_start", "_stop", "_data", F.explode("_spans").alias("span"))
    base, n = F.shiftright("span", BASE), F.col("span").bitwiseAND(F.lit(MANY))
    inside = (base >= F.col("_start")) & (base + n + window - 1 <= F.col("_stop"))
    data = F.substring("_data", (base - F.col("_start") + 1).cast("int"), (n + window - 1).cast("int"))
    return each.filter(inside).select("_id", "_sum", "span", data.alias("_data"))


def _classify(runs: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """One pass: spans of runs that are repeated as a whole, and runs to split (one per content)."""
    if last:
        # The digest pair is the whole window; groups of several members are the answer.
        repeated = materialize(runs.groupBy("core", "whole").count().filter("count > 1").select("core", "whole"), "windows")
        return materialize(runs.join(repeated, ["core", "whole"], "left_semi").select("_id", "_sum", "span"), "spans"), None
    shared = materialize(runs.groupBy("core").count().filter("count > 1").select("core"), "digits")
    open_runs = materialize(runs.join(shared, "core", "left_semi"), "open_runs")
    one = [F.first(c).alias(c) for c in ("_id", "_sum", "span")]
    groups = materialize(open_runs.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("members"), *one), "groups")
    again = groups.filter("members > 1").select("core", "whole")
    spans = materialize(open_runs.join(again, ["core", "whole"], "left_semi").select("_id", "_sum", "span"), "spans")
    edges = groups.groupBy("core").agg(F.min("members").alias("least")).filter("least = 1").select("core")
    edges = materialize(edges, "edges")           # a written table: a digest with many contents is split over tasks
    split = groups.join(edges, "core", "left_semi").select("_id", "_sum", "span")
    return spans, materialize(split, "split")


def repeated_windows(docs: DataFrame, window: int, cells=CELLS) -> DataFrame:
    """(_id, _sum, span): runs of window starts that occur again, from docs (_id, _sum, _data)."""
    spans, split = _classify(_text_runs(docs, window, cells[0]), cells[0] == 1)
    found = [spans]
    owners = docs.withColumns({"_start": F.lit(0).cast("long"), "_stop": F.length("_data").cast("long")})
    for cell in cells[1:]:
        pieces = materialize(_cut_pieces(owners, split, window), "pieces")
        spans, split = _classify(_piece_runs(pieces, window, cell), cell == 1)
        found.append(spans)
        start = F.shiftright("span", BASE)
        owners = pieces.select("_id", "_sum", start.alias("_start"), (start + F.length("_data")).alias("_stop"), "_data")
    return reduce(DataFrame.unionByName, found)


def _cover(spans: list | None, window: int) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) covered by the windows of ``spans``."""
    if not spans:
        return []
    base, _, n = _unpack(np.array(spans, np.int64))
    end = base + n - 1 + window
    order = np.argsort(base, kind="stable")
    base, end = base[order], np.maximum.accumulate(end[order])
    new = np.append(True, base[1:] > end[:-1])
    return list(zip(base[new].tolist(), np.append(end[:-1][new[1:]], end[-1]).tolist()))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``removed`` (array of start, end), ``kept`` (remaining bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_sum"), text.cast("binary").alias("_data"))
    spans = repeated_windows(docs, window)
    spans = spans.groupBy("_id", "_sum").agg(F.collect_set("span").alias("_spans"))
    spans = spans.withColumnsRenamed({"_id": "_i", "_sum": "_c"})
    joined = docs.join(spans, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sum") == F.col("_c")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            texts = batch.column(1).to_pylist()
            for data, spans in zip(texts, batch.column(2).to_pylist()):
                gone = _cover(spans, window)
                ends = [0, *(e for _, e in gone)]
                starts = [*(s for s, _ in gone), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, starts)))
                removed.append([{"start": a, "end": b} for a, b in gone])
            sizes = pa.array([len(d) for d in texts], pa.int64())
            pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(removed, pair), pa.array(kept, pa.binary())],
                                             names=["_id", "n_bytes", "removed", "kept"])

    kind = docs.schema["_id"].dataType.simpleString()
    out = joined.select("_id", "_data", "_spans").mapInArrow(
        cut, f"_id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("_id", id_col)
