import glob
import os
import random
import zlib

import pytest
import zstandard
from conftest import SF_SMALL

from casewise.llm import token_files as T
from casewise.llm.queries import op11_token_files

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def definition():
    with open(P.path("word_bpe_49k.json")) as f:
        return f.read()


def plain(definition, rows):
    """(id, ids) of each row by one call of the tokenizer over its whole text."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(definition)
    return [(i, t.encode(text or "", add_special_tokens=False).ids + [2]) for i, text in rows]


ODD = ["", " ", "ΑΣ ΣΑΣ ς", "é ́x  ̸ ≠", "a\x1cb\x1d \x85c\xa0d e", "don't I'LL 've''re", "x" * 200 + " " + "y" * 70,
       "<|endoftext|>a <|startoftext|> <|end", "\t\r\n a\r b\n\n", "漢字かな 한국어 ٠١٢ ½²", "🙂🙂 👩‍👩‍👧 ", "İI ıß ǅ", "\x00 \x01 a\x01b ﻿ ​"]


def test_word_by_word_equals_whole_text(definition, monkeypatch):
    rng = random.Random(1)
    alphabet = list("\x01abc 'ABCÉé̸́Σς \n\t\r\x0b\x1c\xa0 .,!?<|>0१½漢🙂‍각 ")
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    encode = T.Encoder(definition)
    want = [ids[:-1] for _, ids in plain(definition, enumerate(texts))]
    for text, ids, whole in zip(texts, encode(texts), want):
        assert memoryview(ids).cast("I").tolist() == whole, repr(text)
    monkeypatch.setattr(T, "PIECE", 7)
    monkeypatch.setattr(T, "CHARS", 50)
    monkeypatch.setattr(T, "WORDS_KEPT", 20)
    assert [memoryview(i).cast("I").tolist() for i in encode(texts)] == want
    whole = T.Encoder(definition, word_by_word=False)
    assert [memoryview(i).cast("I").tolist() for i in whole(texts)] == want


def test_given_documents(spark, definition):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want, start = [], 0
    for i, ids in plain(definition, rows):
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted(map(tuple, op11_token_files(spark, SF_SMALL).collect())) == want


def small_files(spark, definition, tmp_path, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(3)
    path = str(tmp_path / "tokens")
    assert T.write_tokens(df, definition, 2, path, frame_bytes=256, frames_per_file=4) == path
    return path


def test_round_trip_ties_and_long_texts(spark, definition, tmp_path):
    rng = random.Random(2)
    words = ["cat", "Dog", "it's", "naïve", "x1y2", "漢字"]
    rows = [(rng.choice([None, 1, 2, 7, -5, *range(100, 160)]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(200)))]))
            for _ in range(300)] + [(8, "long words " * 4000)] + [(9, "same text")] * 40
    path = small_files(spark, definition, tmp_path, rows)
    got = T.read_tokens(spark, path).orderBy("start").collect()
    starts = [0]
    for r in got:
        assert r["start"] == starts[-1]
        starts.append(starts[-1] + len(r["ids"]) // 4)
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], memoryview(r["ids"]).cast("I").tolist()) for r in got), key=key) == sorted(plain(definition, rows), key=key)
    # Every file is a valid stream for a plain decompressor, and no file exceeds its frames (a long document stays in one).
    stream = b""
    for m in T.manifest(spark, path).orderBy("start").collect():
        data = open(m["path"].removeprefix("file:"), "rb").read()
        assert len(T.TokenFile(data, "x").frames()) <= 4
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
            stream += reader.read()
    assert stream == b"".join(bytes(r["ids"]) for r in got)


def test_asked_documents_only_and_damage(spark, definition, tmp_path):
    rows = [(i, f"document number {i} " * 20) for i in range(60)] + [(None, "no id")]
    path = small_files(spark, definition, tmp_path, rows)
    whole = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in T.read_tokens(spark, path).collect()}
    some = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in T.read_tokens(spark, path, only=[3, 40, None, 999]).collect()}
    assert some == {i: whole[i] for i in (3, 40, None)}
    name = next(m["path"] for m in T.manifest(spark, path).collect() if m["first_id"] is not None and m["n_docs"] > 2).removeprefix("file:")
    data = bytearray(open(name, "rb").read())
    f = T.TokenFile(bytes(data), name)
    first, last = f.documents()[0][0], f.documents()[-1][0]
    at, size = f.frames()[-1][:2]
    data[at + size // 2] ^= 255
    os.chmod(name, 0o644)
    open(name, "wb").write(data)
    for crc in glob.glob(os.path.join(os.path.dirname(name), ".*.crc")):
        os.remove(crc)
    # The damaged frame is not touched for a document in another frame.
    assert [bytes(r["ids"]) for r in T.read_tokens(spark, path, only=[first]).collect()] == [whole[first][1]]
    with pytest.raises(Exception, match="damaged frame"):
        T.read_tokens(spark, path, only=[last]).collect()


def test_empty_table(spark, definition, tmp_path):
    path = small_files(spark, definition, tmp_path, [])
    assert T.read_tokens(spark, path).collect() == []
    with pytest.raises(ValueError, match="not a token file"):
        T.TokenFile(b"short", "x")
