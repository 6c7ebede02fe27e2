"""Token ids in binary files of independent zstandard frames with a trailing seek table.

Writing.  Documents are range-partitioned by id (nulls first), sorted, encoded
and cut into frames of about ``frame_bytes`` of little-endian unsigned 32-bit
ids.  A document that fits shares a frame with its neighbours, a longer one
fills several frames of its own.  Every frame is a zstandard frame by itself,
so any of them can be decompressed alone.  The files are written by Spark's
text sink: a row is a frame, the last row of a file its trailer, and
``maxRecordsPerFile`` starts the next file.  So every store that Spark writes
to works, a lost executor's files never appear, and a task holds one frame.

One file, in order (all numbers little endian)::

    frame, gap            for each frame; the gap is a skippable frame that ends in a line feed;
                          gaps alone fill up files that a long document did not fit into
    document table        skippable frame 0x184D2A51 around a zstandard frame:
                          n ids (int64), n null flags (uint8), n token counts (uint64)
    seek table            skippable frame 0x184D2A5E: per frame its size with the gap, its
                          size decompressed, a checksum (low half of XXH64, seed 0);
                          then the frame count, the byte 0x80, the number 0x8F92EAB1
    tail                  skippable frame 0x184D2A50: offsets of the two tables, tokens,
                          documents, partition, file number, tag ``CWTOK001``, line feed

A plain zstandard decompressor that reads all frames of a file yields its id
stream.

Reading.  ``binaryFile`` delivers the files (bounded in size by
``frames_per_file``); tasks decompress the frames that hold the documents asked
for and check length and checksum of each; a damaged frame raises with the
file's name.  ``manifest`` sums up the files (one row each, with the tokens of
all files before), so a document's place in the whole stream is known without
reading others.

Encoding.  A tokenizer that drops white space and takes runs of letters apart from
runs of marks never merges across either border, so the words between them are
encoded one by one and kept in a bounded table.  ``word_by_word`` must be False
for other tokenizers.

Edge cases: a null text is empty (one end id); null ids come first; equal ids
are ordered by a hash of the text, and identical rows are dealt over
partitions; texts of any length are encoded in pieces cut at a space; an empty
table gives a folder without documents; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, materialize
from .common import small

#: Fixed values of the public zstandard and seekable formats, and this format's tag.
SKIPPABLE, TABLE, SEEK, SEEKABLE = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
TAG = b"CWTOK001"
GAP = struct.pack("<II", SKIPPABLE, 1)
TAIL = "<QQQQII8s"
TAIL_BYTES = struct.calcsize(TAIL) + 1

#: Documents in a frame, words that a worker keeps, characters in a piece, longest word kept.
DOCS_PER_FRAME, WORDS_KEPT, PIECE, LONG_WORD = 4096, 1 << 19, 1 << 20, 64
#: Characters encoded together (a longer text goes in pieces), and the mark between words given to the tokenizer.
CHARS, MARK = 4 << 20, "\x01"
#: Between these two groups a tokenizer that takes runs of letters and runs of marks always cuts.
APART = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?#*&])"


def pieces(text: str, size: int = PIECE):
    """``text`` in pieces of about ``size`` characters, cut before a space."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Encoder:
    """Ids of texts as little-endian 32-bit integers, one byte string for each text.

    With ``word_by_word`` Arrow splits the texts, finds the distinct words and looks them up among the
    words met lately; the tokenizer sees the others, joined by a mark that is a token by itself.  Once
    more than ``WORDS_KEPT`` words are kept, those of the newest texts stay.
    """

    def __init__(self, definition: str, word_by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer, self.word_by_word = Tokenizer.from_str(definition), word_by_word
        self.words = pa.array([], pa.large_string())
        self.ids = pa.LargeListArray.from_arrays(pa.array([0], pa.int64()), pa.array([], pa.uint32()))
        mark = self._encoded([MARK, f"a {MARK} b"])
        self.mark = mark[0][0] if len(mark[0]) == 1 and np.count_nonzero(mark[1] == mark[0][0]) == 1 else None

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.word_by_word:
            return [i.tobytes() for i in self._encoded(texts)]
        parts, owner, out = [], [], [[] for _ in texts]
        for n, text in enumerate(texts):
            own = list(pieces(text))
            parts += own
            owner += [n] * len(own)
        first = 0
        while first < len(parts):  # some million characters at a time
            last, chars = first, 0
            while last < len(parts) and (last == first or chars + len(parts[last]) <= CHARS):
                chars += len(parts[last])
                last += 1
            for n, ids in zip(owner[first:last], self._split(parts[first:last])):
                out[n].append(ids)
            first = last
            pa.default_memory_pool().release_unused()
        return [b"".join(x) for x in out]

    def _split(self, parts: list[str]):
        column = pc.replace_substring_regex(pa.array(parts, pa.large_string()), "[\\n\\t]", " ")
        words = pc.split_pattern(pc.replace_substring_regex(column, APART, "\\1 \\2"), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        known = pc.index_in(distinct, value_set=self.words)
        fresh = distinct.filter(known.is_null())
        ids = self._new(fresh)
        place = pc.if_else(known.is_null(), pa.array(np.cumsum(known.is_null().to_numpy(zero_copy_only=False)) - 1 + len(self.words),
                                                     pa.int32()), known)
        both = pa.concat_arrays([self.ids, ids])
        # The ids of every word in its place, and where each part of the text ends among them.
        size = np.diff(both.offsets.to_numpy())[place.to_numpy()]
        flat = both.take(place.take(coded.indices)).flatten().to_numpy().tobytes()
        upto = np.concatenate([[0], np.cumsum(size[coded.indices.to_numpy()])])
        ends = (4 * upto[np.cumsum(pc.list_value_length(words).to_numpy())]).tolist()
        self._keep(pa.concat_arrays([self.words, fresh]), both, place)
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _new(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of words, 8,192 in a call."""
        if self.mark is None:
            found = [self._encoded(words[at:at + 8192].to_pylist()) for at in range(0, len(words), 8192)]
            size, values = [len(i) for part in found for i in part], [i for part in found for i in part]
            return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), np.concatenate([*values, []]).astype("<u4"))
        size, values = [np.zeros(1, np.int64)], [np.zeros(0, "<u4")]
        for at in range(0, len(words), 8192):
            some = words[at:at + 8192].to_pylist()
            odd = {n: i for n, i in zip([n for n, w in enumerate(some) if MARK in w], self._encoded([w for w in some if MARK in w]))}
            ids = self._encoded([f" {MARK} ".join("" if n in odd else w for n, w in enumerate(some))])[0]
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:
                raise ValueError("the tokenizer does not keep words apart: set word_by_word=False")
            if odd:
                values += [odd.get(n, i[i != self.mark]) for n, i in enumerate(np.split(ids, cuts))]
                size.append(np.array([len(v) for v in values[-len(some):]], np.int64))
            else:
                values.append(ids[ids != self.mark])
                size.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        return pa.LargeListArray.from_arrays(np.cumsum(np.concatenate(size)), np.concatenate(values))

    def _keep(self, words: pa.Array, ids: pa.LargeListArray, last: pa.Array) -> None:
        if len(words) > WORDS_KEPT:
            words, ids = words.take(last), ids.take(last)
        if len(words) > WORDS_KEPT or pc.max(pc.binary_length(words)).as_py() or 0 > LONG_WORD:
            short = pc.less_equal(pc.binary_length(words), LONG_WORD)
            words, ids = words.filter(short)[:WORDS_KEPT], ids.filter(short)[:WORDS_KEPT]
        self.words, self.ids = words, pa.LargeListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), ids.flatten())


def encoder(definition: str, word_by_word: bool) -> Encoder:
    """The process's encoder for this tokenizer: a reused worker keeps it, and its words, from task to task."""
    store = sys.modules.setdefault("casewise_encoders", types.ModuleType("casewise_encoders")).__dict__
    key = f"{zlib.crc32(definition.encode())}:{len(definition)}:{word_by_word}"
    if key not in store:
        store[key] = Encoder(definition, word_by_word)
    return store[key]


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FileBuilder:
    """Cuts a stream of documents into frames and files; each returned byte string is one row of the sink."""

    def __init__(self, part: int, frame_bytes: int, frames_per_file: int, level: int):
        import zstandard
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.part, self.frame_bytes, self.frames_per_file, self.number = part, frame_bytes, frames_per_file, 0
        self.buffer, self.in_frame = [], 0
        self._new_file()

    def _new_file(self):
        self.frames, self.offset, self.buffered = [], 0, 0
        self.ids, self.nulls, self.counts = [], bytearray(), []

    def _frame(self, raw: bytes) -> bytes:
        import xxhash
        row = self.packer.compress(raw) + GAP
        self.frames.append((len(row) + 1, len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.offset += len(row) + 1
        return row

    def _flush(self):
        if self.buffer:
            yield self._frame(b"".join(self.buffer))
            self.buffer, self.buffered, self.in_frame = [], 0, 0

    def add(self, doc, ids: bytes):
        own = max(1, -(-len(ids) // self.frame_bytes))  # frames of its own, if more than one
        if own > 1 or self.buffered + len(ids) > self.frame_bytes or self.in_frame == DOCS_PER_FRAME:
            yield from self._flush()
        own = min(own, self.frames_per_file)
        if not self.buffer and len(self.frames) + own > self.frames_per_file:
            # The sink counts rows: empty skippable frames stand for those that a long document leaves unused.
            for _ in range(self.frames_per_file - len(self.frames)):
                self.offset += len(GAP) + 1
                yield GAP
            yield self._trailer()
        self.ids.append(doc or 0)
        self.nulls.append(doc is None)
        self.counts.append(len(ids) // 4)
        if len(ids) <= self.frame_bytes:
            self.buffer.append(ids)
            self.buffered += len(ids)
            self.in_frame += 1
            return
        step = max(self.frame_bytes, -(-len(ids) // (4 * own)) * 4)  # a document never leaves its file
        for at in range(0, len(ids), step):
            yield self._frame(ids[at:at + step])

    def end(self):
        yield from self._flush()
        if self.frames:
            yield self._trailer()

    def _trailer(self) -> bytes:
        n = len(self.ids)
        table = skippable(TABLE, self.packer.compress(
            struct.pack(f"<{n}q", *self.ids) + bytes(self.nulls) + struct.pack(f"<{n}Q", *self.counts)))
        seek = skippable(SEEK, b"".join(struct.pack("<III", *f) for f in self.frames)
                         + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE))
        tail = struct.pack(TAIL, self.offset, self.offset + len(table), sum(self.counts), n, self.part, self.number, TAG)
        row = table + seek + struct.pack("<II", SKIPPABLE, TAIL_BYTES) + tail
        self.number += 1
        self._new_file()
        return row


def _encode_partition(definition: str, end_id: int, word_by_word: bool, frame_bytes: int, frames_per_file: int, level: int):
    end = struct.pack("<I", end_id)

    def run(batches):
        encode = encoder(definition, word_by_word)
        files = FileBuilder(TaskContext.get().partitionId(), frame_bytes, frames_per_file, level)
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < len(ids):
                some, held = [], 0
                while at + len(some) < len(ids) and held <= CHARS:
                    some.append(texts[at + len(some)].as_py())
                    held += len(some[-1])
                for doc, packed in zip(ids[at:at + len(some)], encode(some)):
                    for row in files.add(doc, packed + end):
                        yield rows([row])
                at += len(some)
        for row in files.end():
            yield rows([row])

    return run


def write_tokens(df: DataFrame, definition: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 word_by_word: bool = True, frame_bytes: int = 1 << 18, frames_per_file: int = 128, part_bytes: int = 64 << 20,
                 level: int = 3) -> str:
    """Write the ids of every document (``end_id`` after each) in ascending id order; returns the folder.

    ``definition`` is the tokenizer's JSON text (a vocabulary: bounded, and shipped with the task).
    Without ``path`` the folder lies in the shared checkpoint folder.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens/{uuid.uuid4().hex}"
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    # Ties: a hash of the text, then the input row's number, which only deals identical rows over partitions.
    order = [F.col("_id").asc_nulls_first(), F.col("_h"), F.col("_u")]
    keyed = docs.withColumns({"_h": F.xxhash64("_text"), "_u": F.xxhash64(F.monotonically_increasing_id())})
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_id", "_text")
    rows = placed.mapInArrow(_encode_partition(definition, end_id, word_by_word, frame_bytes, frames_per_file, level), "row binary")
    (rows.select(F.col("row").cast("string").alias("value")).write.option("maxRecordsPerFile", frames_per_file + 1)
         .option("lineSep", "\n").option("compression", "none").text(path))
    return path


class TokenFile:
    """One file's bytes: its tables, and its documents on demand."""

    def __init__(self, data, name: str):
        self.data, self.name = memoryview(data), name
        if len(self.data) < TAIL_BYTES + 8 or bytes(self.data[-9:-1]) != TAG:
            raise ValueError(f"{name}: not a token file, or cut off")
        (self.table_at, self.seek_at, self.n_tokens, self.n_docs, self.part, self.number,
         _) = struct.unpack(TAIL, self.data[-TAIL_BYTES:-1])

    def _body(self, at: int, magic: int):
        found, size = struct.unpack("<II", self.data[at:at + 8])
        if found != magic or at + 8 + size > len(self.data):
            raise ValueError(f"{self.name}: damaged table at byte {at}")
        return self.data[at + 8:at + 8 + size]

    def documents(self) -> list[tuple]:
        """(id, number of tokens) in file order."""
        import zstandard
        n, raw = self.n_docs, zstandard.ZstdDecompressor().decompress(self._body(self.table_at, TABLE))
        ids, nulls, counts = struct.unpack(f"<{n}q", raw[:8 * n]), raw[8 * n:9 * n], struct.unpack(f"<{n}Q", raw[9 * n:])
        return [(None if null else i, c) for i, null, c in zip(ids, nulls, counts)]

    def frames(self) -> list[tuple]:
        """(offset, size with gap, size decompressed, checksum)."""
        body, out, at = self._body(self.seek_at, SEEK), [], 0
        (n, _, magic) = struct.unpack("<IBI", body[-9:])
        if magic != SEEKABLE or len(body) != 12 * n + 9:
            raise ValueError(f"{self.name}: damaged seek table")
        for size, raw, check in struct.iter_unpack("<III", body[:12 * n]):
            out.append((at, size, raw, check))
            at += size
        return out

    def read(self, wanted=None):
        """(id, first token's place in the file, ids as bytes) of all documents or of those in ``wanted``.

        Decompresses only frames that hold tokens of such documents.
        """
        import xxhash
        import zstandard
        unpack, frames = zstandard.ZstdDecompressor(), self.frames()
        k, frame_from, raw, place = 0, 0, None, 0  # frame, its first byte in the stream, its bytes, byte in the stream
        for doc, n in self.documents():
            start, stop, out = place, place + 4 * n, []
            place = stop
            if wanted is not None and doc not in wanted:
                continue
            while start < stop:
                while start >= frame_from + frames[k][2]:
                    k, frame_from, raw = k + 1, frame_from + frames[k][2], None
                if raw is None:
                    at, size, length, check = frames[k]
                    try:
                        raw = unpack.decompress(self.data[at:at + size])
                    except zstandard.ZstdError as e:
                        raise ValueError(f"{self.name}: damaged frame {k}: {e}") from e
                    if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                        raise ValueError(f"{self.name}: damaged frame {k}: wrong checksum")
                until = min(stop, frame_from + len(raw))
                out.append(raw[start - frame_from:until - frame_from])
                start = until
            yield doc, (stop - 4 * n) // 4, b"".join(out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
                 .select(F.col("path"), F.col("content")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path``, ``part``, ``number``, ``n_docs``, ``n_tokens``, ``first_id``, ``last_id``, ``start``.

    ``start`` counts the tokens of all files before; its window orders one small row per file.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                f = TokenFile(content.as_buffer(), name.as_py())
                docs = f.documents()
                row = dict(path=f.name, part=f.part, number=f.number, n_docs=f.n_docs, n_tokens=f.n_tokens,
                           first_id=docs[0][0], last_id=docs[-1][0])
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
    files = _files(spark, path).mapInArrow(
        run, "path string, part int, number int, n_docs long, n_tokens long, first_id long, last_id long")
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))


def read_tokens(spark: SparkSession, path: str, only: list | None = None) -> DataFrame:
    """(``doc_id``, ``start``, ``ids``: binary) of all documents, or of the ids listed in ``only``.

    With ``only`` (a short list) files without such ids are not opened, and in
    the others only the frames that hold them are decompressed.
    """
    index = manifest(spark, path)
    if only is not None:
        known = [i for i in only if i is not None]
        inside = F.exists(F.array(*map(F.lit, known)).cast("array<bigint>"),
                          lambda i: (F.coalesce(F.col("first_id"), i) <= i) & (F.coalesce(F.col("last_id"), i - 1) >= i))
        index = index.filter(inside | (F.col("first_id").isNull() if None in only else F.lit(False)))
    index = materialize(index.select("path", "start"), "token_manifest")
    n = index.count()
    wanted = None if only is None else frozenset(only)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for name, content, first in zip(batch.column(0), batch.column(1), batch.column(2)):
                rows, size = [], 0
                for doc, at, ids in TokenFile(content.as_buffer(), name.as_py()).read(wanted):
                    rows.append({"doc_id": doc, "start": first.as_py() + at, "ids": ids})
                    size += len(ids)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = _files(spark, path).join(small(index, n, 256), "path")
    return files.select("path", "content", "start").mapInArrow(run, "doc_id long, start long, ids binary")
