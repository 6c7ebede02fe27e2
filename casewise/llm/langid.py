"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces
(forward algorithm), the probability of a text the product over its words, and
the prediction the language with the largest one.  Piece probabilities are
fitted by expectation maximisation over the same lattice, on word counts of a
bounded hash sample of labelled rows (``docs_per_language`` in expectation).

Words are maximal runs of letters, lower-cased, with a word-start mark; runs
over ``MAX_WORD`` letters are cut into words of that length.  A letter outside the vocabulary is a
piece of its own with a small fixed probability.  Scoring counts words in each
Arrow batch and runs the lattice once for each distinct word, as numpy
operations over all words at once; a bounded memo keeps words between batches.

Edge cases: a text that is null, empty or without a letter is ``und`` with
score 0; ties go to the first language in code point order; very long texts
are scored whole; with no labelled row at all every text is ``und``; an empty
table gives an empty result; other columns pass through and those named like a
result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_WORD = 24
MAX_PIECE = 12
UNKNOWN = 1e-7        # a letter that stands alone, besides the pieces
BARE_START = 0.01     # a start mark that stands alone, before an inner piece
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model (driver side; tasks get the list)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    found = {p for p in pieces if p == p.lower() and p.lstrip(START) and len(p) <= MAX_PIECE
             and LETTERS.fullmatch(p[1:] if p[0] == START else p)}
    return sorted(found)


def count_words(text: str) -> Counter:
    """Words of a text with their counts."""
    words = Counter(LETTERS.findall(text.lower()))
    odd = [w for w in words if len(w) > MAX_WORD or not w.isalpha()]
    for w in odd:                        # long runs are cut; superscripts and the like are no letters
        n = words.pop(w)
        for run in "".join(c if c.isalpha() else " " for c in w).split():
            for i in range(0, len(run), MAX_WORD):
                words[run[i:i + MAX_WORD]] += n
    return words


class Lattice:
    """Piece lookup for substrings of many words at once (open-addressed hash table in numpy)."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        codes = np.zeros((self.n, MAX_PIECE), np.uint64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        for i, p in enumerate(pieces):
            codes[i, :len(p)] = [ord(c) for c in p]
        keys = np.zeros(self.n, np.uint64)
        for k in range(MAX_PIECE):
            keys = np.where(k < lengths, self._step(keys, codes[:, k]), keys)
        assert len(set(keys.tolist())) == self.n, "two pieces share a hash"
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.arange(self.n)[order]
        bits = 20
        self.shift = np.uint64(64 - bits)
        starts = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(self.keys, starts), self.n)
        self.longest_chain = int((self.first[1:] - self.first[:-1]).max())

    @staticmethod
    def _step(keys, codes):
        with np.errstate(over="ignore"):
            return ((keys ^ (codes + np.uint64(1))) * _MULT) ^ ((keys ^ codes) >> np.uint64(29))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece id of each key, ``n`` (no piece) if there is none."""
        slot = (keys >> self.shift).astype(np.int64)
        out = np.full(len(keys), self.n, np.int32)
        low, high = self.first[slot], self.first[slot + 1]
        for k in range(self.longest_chain):
            live = np.flatnonzero(low + k < high)
            if not len(live):
                break
            at = low[live] + k
            hit = self.keys[at] == keys[live]
            out[live[hit]] = self.ids[at[hit]]
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``piece[l - 1, w, i]``: piece id of characters i..i+l of word w with its start mark; lengths with mark."""
        marked = [START + w for w in words]
        lengths = np.array([len(w) for w in marked], np.int64)
        width = int(lengths.max())
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le"), np.uint32)
        codes = flat.reshape(len(words), width).astype(np.uint64)
        piece = np.full((min(MAX_PIECE, width), len(words), width), self.n, np.int32)
        keys = np.zeros_like(codes)
        for k in range(piece.shape[0]):
            keys = self._step(keys[:, :width - k], codes[:, k:])
            inside = np.arange(width - k)[None, :] + k < lengths[:, None]
            piece[k, :, :width - k][inside] = self.find(keys[inside])
        return piece, lengths


def forward(lattice: Lattice, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word) under each language, summed over all segmentations; ``probs``: pieces + 1 (zeros) x languages."""
    if not words:
        return np.zeros((0, probs.shape[1]))
    order = np.argsort([-len(w) for w in words], kind="stable")
    piece, lengths = lattice.edges([words[i] for i in order])
    alpha = _alpha(piece, lengths, probs)
    out = np.empty((len(words), probs.shape[1]))
    out[order] = np.log(alpha[np.arange(len(words)), lengths])
    return out


def _alpha(piece, lengths, probs):
    """Forward sums; words are sorted by falling length.  A letter may always stand alone (``UNKNOWN``)."""
    n, width = piece.shape[1], piece.shape[2]
    alpha = np.zeros((n, width + 1, probs.shape[1]))
    alpha[:, 0] = 1.0
    for t in range(1, width + 1):
        live = int(np.searchsorted(-lengths, -t, side="right"))
        total = alpha[:live, t - 1] * (BARE_START if t == 1 else UNKNOWN)
        for k in range(1, min(piece.shape[0], t) + 1):
            ids = piece[k - 1, :live, t - k]
            has = np.flatnonzero(ids != len(probs) - 1)
            if len(has):
                total[has] += alpha[has, t - k] * probs[ids[has]]
        alpha[:live, t] = total
    return alpha


def expected_counts(lattice: Lattice, probs: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words under one language (forward-backward)."""
    order = np.argsort([-len(w) for w in words], kind="stable")
    words, weights = [words[i] for i in order], weights[order]
    piece, lengths = lattice.edges(words)
    p = probs[:, None]
    alpha = _alpha(piece, lengths, p)[:, :, 0]
    n, width = piece.shape[1], piece.shape[2]
    beta = np.zeros((n, width + 1))
    beta[np.arange(n), lengths] = 1.0
    total = alpha[np.arange(n), lengths]
    counts = np.zeros(len(probs))
    for t in range(width - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -(t + 1), side="right"))
        beta[:live, t] += beta[:live, t + 1] * (UNKNOWN if t else BARE_START)
        for k in range(1, min(piece.shape[0], width - t) + 1):
            ids = piece[k - 1, :live, t]
            has = np.flatnonzero(ids != len(probs) - 1)
            if len(has):
                flow = probs[ids[has]] * beta[has, t + k]
                beta[has, t] += flow
                np.add.at(counts, ids[has], weights[has] * alpha[has, t] * flow / total[has])
    return counts


def fit(rows: list[tuple[str, str, int]], pieces: list[str], rounds: int = 4, smooth: float = 0.05) -> dict:
    """Model from (language, word, count) rows."""
    languages = sorted({lang for lang, _, _ in rows})
    lattice = Lattice(pieces)
    probs = np.zeros((lattice.n + 1, len(languages)))
    for j, lang in enumerate(languages):
        words = [w for x, w, _ in rows if x == lang]
        weights = np.array([c for x, _, c in rows if x == lang], float)
        p = np.full(lattice.n + 1, 1.0 / lattice.n)
        p[-1] = 0
        for _ in range(rounds):
            counts = np.zeros(lattice.n + 1)
            for i in range(0, len(words), 20_000):
                counts += expected_counts(lattice, p, words[i:i + 20_000], weights[i:i + 20_000])
            p = counts + smooth
            p[-1] = 0
            p /= p.sum()
        probs[:, j] = p
    return {"languages": languages, "pieces": pieces, "probs": probs}


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_language: int = 400, seed: int = 6, vocabulary: str = VOCABULARY) -> dict:
    """Fit on about ``docs_per_language`` rows of each language, chosen by a hash of their id."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    pieces = load_pieces(vocabulary)
    if not counts:
        return {"languages": [], "pieces": pieces, "probs": np.zeros((len(pieces) + 1, 0))}
    unit = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(None).cast("double")
    for lang, n in counts.items():
        share = F.when(F.col("_lang") == lang, F.lit(min(1.0, docs_per_language / n))).otherwise(share)
    letters = F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))), F.lit(r"\p{L}+"), 0)
    counted = (rows.filter(unit < share).select("_lang", F.explode(letters).alias("_word"))
                   .groupBy("_lang", "_word").count())
    table: Counter = Counter()
    for r in counted.collect():
        for w, n in count_words(r["_word"]).items():
            table[r["_lang"], w] += n * r["count"]
    return fit([(lang, w, n) for (lang, w), n in table.items()], pieces)


def scorer(model: dict, memo: int = 400_000):
    """Function from an iterator of text batches to one of (lang_pred, score) frames."""
    languages, pieces, probs = model["languages"], model["pieces"], model["probs"]

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(pieces)
        known: dict[str, int] = {}
        values = np.zeros((0, len(languages)))
        for batch in batches:
            # A slice holds a bounded number of characters, so memory follows no batch of long texts.
            names, best = [], []
            for part in _slices(batch.tolist()):
                words = [count_words(t) if t else Counter() for t in part]
                new = list({w for c in words for w in c if w not in known})
                if len(known) + len(new) > memo:
                    known, values = {}, values[:0]
                    new = list({w for c in words for w in c})
                if new and languages:
                    fresh = np.concatenate([forward(lattice, probs, new[i:i + 8192]) for i in range(0, len(new), 8192)])
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    values = np.concatenate([values, fresh])
                for c in words:
                    if not c or not languages:
                        names.append("und")
                        best.append(0.0)
                        continue
                    at = np.fromiter(map(known.__getitem__, c), np.int64, len(c))
                    logs = np.fromiter(c.values(), np.float64, len(c)) @ values[at]
                    k = int(np.argmax(logs))
                    names.append(languages[k])
                    best.append(float(1.0 / np.exp(logs - logs[k]).sum()))
            yield pd.DataFrame({"lang_pred": names, "score": best})

    return score


def _slices(texts: list, chars: int = 4_000_000) -> Iterator[list]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def predict(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    df = df.drop("lang_pred", "score")
    score = scorer(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from score(batches)

    out = df.select(packed(df), predicted(F.col(text_col)).alias("_p"))
    return out.select("_in.*", F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def split_held_out(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``held_out``: the crc32 of the id as text leaves 2 when divided by 4."""
    rest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4
    return df.withColumn("held_out", rest == 2)
